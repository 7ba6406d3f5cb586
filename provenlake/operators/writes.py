"""The life of a pending write: proposed, decided, expired, applied; and of holds: opened, released.

Batch form. What an event meets depends on four moments of its write alone: the proposal, its expiry, the first decision in time, and
the first application after an approval. They are one aggregate per write, joined back, so a write with very many events isn't
gathered. ``streaming.writes`` has the same machine as a stream with state and timers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKILL_TARGETS = ("skill", "skill_file")
BACKGROUND = ("background_review", "dream", "cron")


@dataclass(frozen=True)
class Policy:
    """Which targets need a decision, what becomes of skill writes from the background, and how long a write may wait."""

    skills: bool = True
    memory: bool = True
    beliefs: bool = True
    strict: bool = False
    auto_skill_improve: str = "quarantine"
    ttl_hours: int = 72

    def needs_approval(self, target: str) -> bool:
        of = {"skill": self.skills, "skill_file": self.skills, "memory": self.memory, "user_profile": self.memory, "belief": self.beliefs}
        return self.strict or of.get(target, True)

    def refuses(self, target: str, origin: str) -> bool:
        return target in SKILL_TARGETS and origin in BACKGROUND and self.auto_skill_improve == "off"


def _needs_approval(policy: Policy, target: Column) -> Column:
    free = [t for t in ("skill", "skill_file", "memory", "user_profile", "belief") if not policy.needs_approval(t)]
    return ~target.isin(free) if free else F.lit(True)


def write_lifecycle(events: DataFrame, policy: Policy = Policy(), now: Column | None = None) -> DataFrame:
    """write_id, seq, kind, code, status: what each event does to its write, and a row of kind expire for each write that is pending past its time.

    events: write_id, seq, at, kind (propose, approve, reject, apply), target, origin, ttl_hours (null: the policy's). Events count in the order of
    (at, seq). A write expires after its time, not at it, and expiry never approves. Codes: queued, applied_immediate,
    rejected_by_policy, duplicate (proposals); ok, idempotent, conflict_opposite, already_applied, already_rejected, cannot_apply, expired, not_found.
    The status is that after the event; null where there is no write. ``now`` ends the wait of what is still pending; without it nothing is swept.
    """
    order = F.struct("at", "seq")
    proposed = events.where("kind = 'propose'").groupBy("write_id").agg(F.min(F.struct("at", "seq", "target", "origin", "ttl_hours")).alias("p"))
    refused = F.col("p.target").isin(list(SKILL_TARGETS)) & F.col("p.origin").isin(list(BACKGROUND)) & F.lit(policy.auto_skill_improve == "off")
    expires = F.timestamp_micros(F.unix_micros("p.at") + F.coalesce("p.ttl_hours", F.lit(policy.ttl_hours)).cast("long") * 3_600_000_000)
    first = proposed.select("write_id", F.struct("p.at", "p.seq").alias("born"), refused.alias("refused"), _needs_approval(policy, F.col("p.target")).alias("waits"), expires.alias("expires"))
    met = events.join(first, "write_id", "left")
    live = F.col("born").isNotNull() & (order > F.col("born")) & ~F.col("refused")
    decision = F.when(live & F.col("waits") & F.col("kind").isin("approve", "reject") & (F.col("at") <= F.col("expires")), F.struct("at", "seq", "kind"))
    decided = met.groupBy("write_id").agg(F.min(decision).alias("d"))
    met = met.join(decided, "write_id", "left")
    approved_at = F.when(~F.col("waits"), F.col("born")).when(F.col("d.kind") == "approve", F.struct("d.at", "d.seq"))
    met = met.withColumn("approved_at", approved_at)
    applied = met.where(live & (F.col("kind") == "apply") & (order > F.col("approved_at"))).groupBy("write_id").agg(F.min(order).alias("applied_at"))
    met = met.join(applied, "write_id", "left")

    settled = F.col("d").isNotNull() & (order > F.struct("d.at", "d.seq"))
    before = (
        F.when(~F.coalesce(live, F.lit(False)), None).when(order > F.col("applied_at"), "applied").when(~F.col("waits"), "approved")
        .when(settled, F.when(F.col("d.kind") == "approve", "approved").otherwise("rejected")).when(F.col("at") > F.col("expires"), "expired").otherwise("pending")
    )
    met = met.withColumn("before", before)
    is_first = F.coalesce(order == F.col("born"), F.lit(False))
    was = F.col("before")
    proposal = F.when(~is_first, "duplicate").when(F.col("refused"), "rejected_by_policy").when(F.col("waits"), "queued").otherwise("applied_immediate")
    approve = F.when(was == "pending", "ok").when(was.isin("approved", "applied"), "idempotent").when(was == "rejected", "conflict_opposite").when(was == "expired", "expired")
    reject = F.when(was == "pending", "ok").when(was == "rejected", "idempotent").when(was == "approved", "conflict_opposite").when(was == "applied", "already_applied").when(was == "expired", "expired")
    apply = F.when(was == "approved", "ok").when(was == "applied", "idempotent").when(was == "rejected", "already_rejected").when(was == "expired", "expired").when(was == "pending", "cannot_apply")
    code = F.when(F.col("kind") == "propose", proposal).when(was.isNull(), "not_found").when(F.col("kind") == "approve", approve).when(F.col("kind") == "reject", reject).when(F.col("kind") == "apply", apply)
    to = {"approve": "approved", "reject": "rejected", "apply": "applied"}
    after = F.when(F.col("kind") == "propose", F.when(is_first & ~F.col("refused"), F.when(F.col("waits"), "pending").otherwise("approved")).otherwise(was))
    for kind, status in to.items():
        after = after.when((F.col("kind") == kind) & (F.col("code") == "ok"), status)
    out = met.withColumn("code", code).withColumn("status", after.otherwise(was)).select("write_id", "seq", "kind", "code", "status")
    if now is None:
        return out
    swept = first.join(decided, "write_id", "left").where(~F.col("refused") & F.col("waits") & F.col("d").isNull() & (F.col("expires") < now))
    return out.unionByName(swept.select("write_id", F.lit(None).cast("long").alias("seq"), F.lit("expire").alias("kind"), F.lit("expired").alias("code"), F.lit("expired").alias("status")))


def release_holds(holds: DataFrame, releases: DataFrame) -> DataFrame:
    """release_id, hold_id, code (released, not_found, already_released, kind_mismatch) of each release, in the order of release_id.

    holds: hold_id, kind, released (already); releases: release_id, hold_id, expected_kind. A gate releases holds of its own kind only; the first
    that does ends the hold.
    """
    met = releases.join(holds.select("hold_id", "kind", "released"), "hold_id", "left")
    fits = F.col("kind") == F.col("expected_kind")
    first = met.where(fits & ~F.col("released")).groupBy("hold_id").agg(F.min("release_id").alias("by"))
    met = met.join(first, "hold_id", "left")
    over = F.col("released") | F.coalesce(F.col("release_id") > F.col("by"), F.lit(False))
    code = F.when(F.col("kind").isNull(), "not_found").when(over, "already_released").when(~fits, "kind_mismatch").otherwise("released")
    return met.select("release_id", "hold_id", code.alias("code"))


def open_holds(holds: DataFrame, releases: DataFrame) -> DataFrame:
    """The holds that no release has ended."""
    done = release_holds(holds, releases).where("code = 'released'").select("hold_id")
    return holds.where(~F.col("released")).join(done, "hold_id", "left_anti")


def activations(requests: DataFrame, holds: DataFrame, dependencies: DataFrame, snapshots: DataFrame, flip_at: Column | None = None, mode: str = "shadow", faculty: DataFrame | None = None) -> DataFrame:
    """request_id, ok, outcome (activated, shadow_activated, refused), reason, would_refuse: each request against the tables as of its time.

    requests: request_id, skill_id, at, content_hash, requested (capabilities), has_secret; holds: skill_id, opened_at, released_at; dependencies:
    skill_id, belief_id, load_bearing, stale_at (when the belief expired or was suspended or superseded, null: never); snapshots: skill_id,
    created_at, clearance, cleared_hash, manifest (array, null: none); faculty: request_id, status.

    An open hold, a secret, a capability beyond the manifest and a faculty that didn't pass refuse in any mode. A stale belief, no cleared
    snapshot, or content that isn't the cleared one refuse from ``flip_at`` on (or with mode teeth), and before that are only noted.
    The newest cleared snapshot before each request is an as-of join: snapshots and requests in one order per skill, the last snapshot carried on.
    """
    from pyspark.sql.window import Window

    r = requests.select("request_id", "skill_id", "at", "content_hash", "requested", "has_secret")
    cleared = snapshots.where("clearance = 'passed' AND cleared_hash IS NOT NULL").select("skill_id", F.col("created_at").alias("at"), F.struct("cleared_hash", "manifest").alias("snap"))
    both = cleared.withColumn("request_id", F.lit(None).cast(r.schema["request_id"].dataType)).unionByName(r.select("skill_id", "at", "request_id").withColumn("snap", F.lit(None).cast(cleared.schema["snap"].dataType)))
    newest = F.last("snap", ignorenulls=True).over(Window.partitionBy("skill_id").orderBy("at", F.col("request_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    as_of = both.withColumn("newest", newest).where("request_id IS NOT NULL").select("request_id", "newest")

    pairs = lambda df: r.select("request_id", "skill_id", "at").join(df, "skill_id")
    held = pairs(holds.select("skill_id", "opened_at", "released_at")).where((F.col("opened_at") <= F.col("at")) & (F.col("released_at").isNull() | (F.col("released_at") > F.col("at")))).groupBy("request_id").agg(F.count(F.lit(1)).alias("open"))
    stale = pairs(dependencies.where("load_bearing").select("skill_id", "belief_id", "stale_at")).where(F.col("stale_at") <= F.col("at")).groupBy("request_id").agg(F.array_sort(F.collect_set("belief_id")).alias("stale"))
    met = r.join(as_of, "request_id", "left").join(held, "request_id", "left").join(stale, "request_id", "left")
    met = met.join(faculty.select("request_id", F.col("status").alias("faculty")), "request_id", "left") if faculty is not None else met.withColumn("faculty", F.lit(None).cast("string"))

    teeth = F.lit(mode == "teeth") if flip_at is None else F.lit(mode == "teeth") | (F.col("at") >= flip_at)
    stale_beliefs = F.coalesce("stale", F.array().cast("array<string>"))
    mutation = F.when(F.col("newest").isNull(), "no_cleared_snapshot").when(F.col("newest.cleared_hash") != F.col("content_hash"), "mutation_delta")
    over = F.when(F.col("newest.manifest").isNotNull(), F.array_except("requested", "newest.manifest")).otherwise(F.array().cast("array<string>"))
    reason = (
        F.when(F.coalesce("open", F.lit(0)) > 0, "open_holds").when(F.col("has_secret"), "secret").when(teeth & (F.size(stale_beliefs) > 0), F.concat(F.lit("stale:"), F.get(stale_beliefs, F.lit(0))))
        .when(teeth & mutation.isNotNull(), mutation).when(F.size(over) > 0, F.concat(F.lit("capabilities:"), F.array_join(over, ","))).when(F.col("faculty").isNotNull() & (F.col("faculty") != "passed"), F.concat(F.lit("faculty:"), "faculty"))
    )
    noted = F.array_compact(F.concat(F.transform(stale_beliefs, lambda b: F.concat(F.lit("stale:"), b)), F.array(mutation)))
    out = met.withColumn("reason", reason).withColumn("noted", F.when(F.col("reason").isNull() & ~teeth, noted).otherwise(F.array().cast("array<string>")))
    outcome = F.when(F.col("reason").isNotNull(), "refused").when(F.size("noted") > 0, "shadow_activated").otherwise("activated")
    return out.select("request_id", F.col("reason").isNull().alias("ok"), outcome.alias("outcome"), "reason", F.col("noted").alias("would_refuse"))
