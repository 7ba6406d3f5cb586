"""Ledger health over windows of time: seven queries whose results should be quiet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def debt_blocks(gate_events: DataFrame, turns: DataFrame, now: Column) -> DataFrame:
    """blocks, turns, alert (dead or inflated): debt blocks of 7 days against turns. gate_events: action, created_at; turns: created_at."""
    week = now - F.expr("INTERVAL 7 DAYS")
    b = gate_events.where((F.col("action") == "commit:blocked") & (F.col("created_at") >= week)).agg(F.count(F.lit(1)).alias("blocks"))
    t = turns.where(F.col("created_at") >= week).agg(F.count(F.lit(1)).alias("turns"))
    return b.crossJoin(t).withColumn("alert", F.when(F.col("blocks") == 0, "dead").when(F.col("blocks") * 100 > 30 * F.col("turns"), "inflated"))  # one row each


def waivers(debts: DataFrame) -> DataFrame:
    """waiver_rate, median_seconds, lapse_rate, alert. debts: status, created_at, decided_at, lapsed."""
    secs = F.unix_micros("decided_at") / 1e6 - F.unix_micros("created_at") / 1e6
    out = debts.where("status IN ('paid', 'waived')").agg(F.avg((F.col("status") == "waived").cast("double")).alias("waiver_rate"), F.median(secs).alias("median_seconds"), F.avg(F.col("lapsed").cast("double")).alias("lapse_rate"))
    return out.withColumn("alert", (F.col("waiver_rate") > 0.6) | (F.col("median_seconds") < 30) | (F.col("lapse_rate") > 0.2))


def overdue(beliefs: DataFrame, tickets: DataFrame, now: Column) -> DataFrame:
    """Active beliefs past their time without an open ticket."""
    late = beliefs.where((F.col("status") == "active") & (F.col("expires_at") <= now))
    return late.join(tickets.where("status = 'open'").select("belief_id"), "belief_id", "left_anti").select("belief_id")


def hold_breaches(gate_events: DataFrame) -> DataFrame:
    """breaches, blocked."""
    n = lambda a: F.coalesce(F.sum((F.col("action") == a).cast("int")), F.lit(0))
    return gate_events.agg(n("hold:breach").alias("breaches"), n("hold:blocked").alias("blocked"))


def silent_mutations(snapshots: DataFrame, gate_events: DataFrame) -> DataFrame:
    """skill_id, changes, events: skills whose hash changed more or less often than events tell. snapshots: skill_id, hash, created_at; gate_events: skill_id, action."""
    from pyspark.sql.window import Window

    before = F.lag("hash").over(Window.partitionBy("skill_id").orderBy("created_at"))
    changed = snapshots.withColumn("before", before).groupBy("skill_id").agg(F.sum((F.col("before").isNotNull() & (F.col("before") != F.col("hash"))).cast("int")).alias("changes"))
    told = gate_events.where("action = 'mutation'").groupBy("skill_id").agg(F.count(F.lit(1)).alias("events"))
    return changed.join(told, "skill_id", "full_outer").fillna(0).where("changes <> events")


def fast_beliefs(beliefs: DataFrame) -> DataFrame:
    """Beliefs committed on the fast path; there must be none."""
    return beliefs.where("epistemic_type = 'belief' AND committed_path = 'fast'").select("belief_id")


def repeated_debts(debts: DataFrame, now: Column, least: int = 3) -> DataFrame:
    """claim_hash, n: claims that minted a debt three times or more in 30 days."""
    return debts.where(F.col("created_at") >= now - F.expr("INTERVAL 30 DAYS")).groupBy("claim_hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
