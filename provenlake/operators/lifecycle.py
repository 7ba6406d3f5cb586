"""What time does: expiry, memory, jobs, schedules, spending, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import counted_within

ALERT_MICROS = 5_000_000
#: Fixed: half-lives of memory layers in seconds (none: never), and the layers that need approval.
HALF_LIFE = {"working": 6 * 3600, "episodic": 14 * 86400}
NEEDS_APPROVAL = ("semantic", "skill_note")


def spend_report(events: DataFrame, now: Column, hours: int = 24, alert_micros: int = ALERT_MICROS) -> DataFrame:
    """channel, n, input_tokens, output_tokens, cost_micros, total_micros, alert: the last hours by channel.

    events: channel, input_tokens, output_tokens, cost_usd_micros, created_at. Sums are of whole micros.
    """
    recent = events.where(F.col("created_at") >= now - F.expr(f"INTERVAL {int(hours)} HOURS"))
    by = recent.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost_usd_micros").alias("cost_micros"))
    total = by.agg(F.coalesce(F.sum("cost_micros"), F.lit(0)).alias("total_micros"))
    out = by.crossJoin(F.broadcast(total))  # one row
    return out.withColumn("alert", F.lit(hours >= 24) & (F.col("total_micros") >= alert_micros))


def within_cap(total_micros: Column, cap_usd: str | None) -> Column:
    """False where the total reaches a valid cap; no cap, or one that is no number, allows everything."""
    try:
        cap = float(cap_usd) if cap_usd is not None else None
    except ValueError:
        cap = None
    return F.lit(True) if cap is None or cap < 0 or cap != cap else total_micros < round(cap * 1_000_000)


def rate_last_hour(events: DataFrame, key: str, time: str, order: str) -> DataFrame:
    """Adds ``in_hour``: events of the same key in the hour up to each one, itself included."""
    return counted_within(events, [key], F.unix_micros(F.col(time)), 3_600_000_000, "in_hour")


def expire_beliefs(beliefs: DataFrame, now: Column) -> DataFrame:
    """belief_id, status: active ones whose time has come (at or before now) expire."""
    due = (F.col("status") == "active") & F.coalesce(F.col("expires_at") <= now, F.lit(False))
    return beliefs.select("belief_id", F.when(due, "expired").otherwise(F.col("status")).alias("status"))


def re_evaluation_tickets(expired: DataFrame, dependencies: DataFrame, open_tickets: DataFrame) -> tuple[DataFrame, int]:
    """New tickets (belief_id, skill_id) for load-bearing dependents, and the number of attempts: those that an open ticket forestalls count as well."""
    tries = expired.join(dependencies.where("load_bearing"), "belief_id").select("belief_id", "skill_id")
    return tries.distinct().join(open_tickets, ["belief_id", "skill_id"], "left_anti"), tries.count()


def remember(items: DataFrame, now: Column) -> DataFrame:
    """Adds half_life_seconds, expires_at and needs_approval. items: layer, source, half_life_seconds."""
    default = F.when(F.col("layer") == "working", HALF_LIFE["working"]).when(F.col("layer") == "episodic", HALF_LIFE["episodic"])
    half = F.coalesce(F.col("half_life_seconds"), default)
    out = items.withColumn("half_life_seconds", half)
    out = out.withColumn("expires_at", F.when(half.isNotNull(), F.timestamp_micros(F.unix_micros(now) + half * 1_000_000)))
    return out.withColumn("needs_approval", F.col("layer").isin(list(NEEDS_APPROVAL)) | F.coalesce(F.col("source").rlike("(?i)session|transcript"), F.lit(False)))


def touch(items: DataFrame, accesses: DataFrame) -> DataFrame:
    """memory_id, access_count, salience after accesses (memory_id): each adds 0.05, up to 1; items that aren't active any more stay as they are."""
    n = accesses.groupBy("memory_id").agg(F.count(F.lit(1)).alias("n"))
    met = items.join(n, "memory_id", "left").withColumn("n", F.when(F.col("status") == "active", F.coalesce("n", F.lit(0))).otherwise(0))
    return met.select("memory_id", (F.col("access_count") + F.col("n")).alias("access_count"), F.when(F.col("n") > 0, F.least(F.lit(1.0), F.col("salience") + 0.05 * F.col("n"))).otherwise(F.col("salience")).alias("salience"))


def decay(items: DataFrame, now: Column) -> DataFrame:
    """memory_id, status: due items decay; short-lived ones of low salience are forgotten."""
    due = (F.col("status") == "active") & F.coalesce(F.col("expires_at") <= now, F.lit(False))
    low = ~F.col("layer").isin("semantic", "skill_note") & (F.col("salience") < 0.3)
    return items.select("memory_id", F.when(due & low, "forgotten").when(due, "decayed").otherwise(F.col("status")).alias("status"))


def dream(items: DataFrame, most: int = 10) -> DataFrame:
    """memory_id, proposal (promote, forget, harvest): at most ten of each."""
    promote = items.where("layer = 'episodic' AND status = 'active' AND salience >= 0.7").orderBy(F.desc("salience"), "memory_id").limit(most)
    forget = items.where("layer = 'working' AND status = 'decayed' AND salience < 0.2").orderBy("memory_id").limit(most)
    harvest = items.where("status = 'pending_harvest'").orderBy("memory_id").limit(most)
    named = lambda df, kind: df.select("memory_id", F.lit(kind).alias("proposal"))
    return named(promote, "promote").unionByName(named(forget, "forget")).unionByName(named(harvest, "harvest"))


def resolve_proposals(items: DataFrame, proposals: DataFrame) -> DataFrame:
    """memory_id, layer, status after accepted proposals (memory_id, proposal, accepted)."""
    met = items.join(proposals.where("accepted").select("memory_id", "proposal"), "memory_id", "left")
    layer = F.when(F.col("proposal") == "promote", "semantic").otherwise(F.col("layer"))
    return met.select("memory_id", layer.alias("layer"), F.when(F.col("proposal") == "forget", "forgotten").otherwise(F.col("status")).alias("status"))


def layered(items: DataFrame) -> DataFrame:
    return items.orderBy("layer", F.desc("salience"), F.desc("created_at"))


def backoff_seconds(attempts: Column) -> Column:
    """A second, doubled up to five times, a minute at most."""
    return F.least(F.lit(60.0), F.pow(F.lit(2.0), F.least(attempts, F.lit(5))))


def after_failure(jobs: DataFrame, now: Column) -> DataFrame:
    """job_id, status, run_after of jobs whose run failed: retried later, failed at the most attempts. attempts counts this one."""
    dead = F.col("attempts") >= F.col("max_attempts")
    later = F.timestamp_micros(F.unix_micros(now) + (backoff_seconds(F.col("attempts")) * 1_000_000).cast("long"))
    return jobs.select("job_id", F.when(dead, "failed").otherwise("pending").alias("status"), F.when(dead, F.col("run_after")).otherwise(later).alias("run_after"))


def next_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """The job of each kind that is due first."""
    due = jobs.where((F.col("status") == "pending") & (F.col("run_after") <= now))
    return due.groupBy("kind").agg(F.min(F.struct("run_after", "job_id")).alias("first")).select("kind", "first.job_id", "first.run_after")


def interval_seconds(schedule: Column) -> Column:
    """interval:<n>[mhd] in seconds; anything else is an hour."""
    n = F.regexp_extract(schedule, r"^interval:(\d+)[mhd]$", 1)
    unit = F.regexp_extract(schedule, r"^interval:\d+([mhd])$", 1)
    scale = F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    return F.coalesce(F.when(n != "", n.cast("long") * scale), F.lit(3600).cast("long"))


def token_bucket(events: DataFrame, key: str, time: str, capacity: int = 8, refill_seconds: float = 60.0) -> DataFrame:
    """key, time, allowed: a bucket for each key that fills up continuously within ``refill_seconds``.

    The fill after an event depends on all before it, so it is a fold; keys are sorted by the shuffle and
    streamed through it, one number a key is kept.
    """
    import pandas as pd

    ordered = events.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(time)).alias("us")).repartition("key").sortWithinPartitions("key", "us")

    def fold(batches):
        at, fill, last = object(), 0.0, 0
        for pdf in batches:
            out = []
            for k, us in zip(pdf["key"], pdf["us"], strict=True):
                if k != at:
                    at, fill, last = k, float(capacity), us
                fill = min(float(capacity), fill + (us - last) / 1e6 * capacity / refill_seconds)
                last = us
                out.append(fill >= 1)
                fill -= out[-1]
            yield pd.DataFrame({"key": pdf["key"], "us": pdf["us"], "allowed": out})

    return ordered.mapInPandas(fold, "key string, us long, allowed boolean").select("key", F.timestamp_micros("us").alias("time"), "allowed")
