"""Approvals: rules matched against pending writes, decisions, expiry, and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordered import counted_within

#: Fixed: the default rules, in order of priority: id, name, priority, target, action, origin, stakes, outcome, most automatic approvals an hour. None fits anything.
DEFAULT_RULES = [
    ("wf_constitution_human", "constitution_always_human", 10, "constitution", None, None, None, "require_human", None),
    ("wf_consequential_human", "consequential_always_human", 20, None, None, None, "consequential", "require_human", None),
    ("wf_bg_skill_create_human", "background_skill_create_human", 30, "skill", "create", "background_review", None, "require_human", None),
    ("wf_bg_skill_delete_human", "background_skill_delete_human", 31, "skill", "delete", "background_review", None, "require_human", None),
    ("wf_dream_skill_human", "dream_skill_writes_human", 32, "skill", None, "dream", None, "require_human", None),
    ("wf_reject_empty_reason", "reject_empty_background_reason", 40, None, None, "background_review", "routine", "auto_reject", None),
    ("wf_fg_memory_add", "foreground_routine_memory_add", 80, "memory", "add", "foreground", "routine", "auto_approve", 30),
    ("wf_fg_user_add", "foreground_routine_user_add", 81, "user_profile", "add", "foreground", "routine", "auto_approve", 20),
    ("wf_default_human", "default_require_human", 1000, None, None, None, None, "require_human", None),
]
RULE_SCHEMA = "rule_id string, name string, priority int, target string, action string, origin string, stakes string, outcome string, max_auto_per_hour int"
MOST_RULES = 1000
EMPTY_REASON_RULE = "wf_reject_empty_reason"
QUORUM = {"consequential": 4, "elevated": 3}
FACULTIES = ("epistemology", "applied_ethics", "language_logic", "philosophy_of_tech", "mind_consciousness")


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_RULES, RULE_SCHEMA)


def match_rules(pending: DataFrame, rules: DataFrame) -> DataFrame:
    """write_id, rule_id, outcome, max_auto_per_hour: the first rule, by priority and name, that fits each write.

    pending: write_id, target, action, origin, stakes (null: routine), reason. Rules are a configuration table of at most MOST_RULES
    rows, an error beyond it; they come as one array to every write, and the first that fits is found in the row.
    """
    ordered = F.sort_array(F.collect_list(F.struct("priority", "name", "rule_id", "target", "action", "origin", "stakes", "outcome", "max_auto_per_hour")))
    one = rules.agg(F.count(F.lit(1)).alias("n"), ordered.alias("rules"))
    one = one.select(F.when(F.col("n") <= MOST_RULES, F.col("rules")).otherwise(F.raise_error(F.lit(f"more than {MOST_RULES} rules"))).alias("rules"))
    fits = lambda rule, c, value: rule[c].isNull() | (rule[c] == value)
    has_reason = F.trim(F.coalesce("reason", F.lit(""))) != ""

    def fit(r: Column) -> Column:
        ok = fits(r, "target", F.col("target")) & fits(r, "action", F.col("action")) & fits(r, "origin", F.col("origin")) & fits(r, "stakes", F.coalesce("stakes", F.lit("routine")))
        return ok & ~((r["rule_id"] == EMPTY_REASON_RULE) & (F.col("origin") == "background_review") & has_reason)

    p = pending.select("write_id", "target", "action", "origin", "stakes", "reason")
    met = p.crossJoin(F.broadcast(one)).withColumn("rule", F.get(F.filter("rules", fit), F.lit(0)))  # one row
    return met.select("write_id", "rule.rule_id", "rule.outcome", "rule.max_auto_per_hour")


def decide(pending: DataFrame, rules: DataFrame, auto_enabled: bool = True) -> DataFrame:
    """write_id, rule_id, decision: matched rules with the hourly limit of automatic approvals.

    Approvals before a write within the hour count against the limit; as each one granted stays within it,
    the n-th candidate of a window is granted while n is not above the limit. Constitution is never automatic.
    """
    met = pending.join(match_rules(pending, rules), "write_id")
    auto = F.col("outcome") == "auto_approve"
    met = counted_within(met, ["rule_id", "outcome"], F.unix_micros("created_at"), 3_600_000_000, "n")
    allowed = auto & F.lit(auto_enabled) & (F.col("target") != "constitution") & (F.col("max_auto_per_hour").isNull() | (F.col("n") <= F.col("max_auto_per_hour")))
    return met.select("write_id", "rule_id", F.when(auto & ~allowed, "require_human").otherwise(F.coalesce("outcome", F.lit("require_human"))).alias("decision"))


def write_states(writes: DataFrame, decisions: DataFrame) -> DataFrame:
    """write_id, status, conflicts: pending writes after their decisions (write_id, seq, decision, at), in order.

    The first decision before the write expires holds; the same again changes nothing, the opposite is a
    conflict. One after the end finds the write expired.
    """
    met = decisions.join(writes.select("write_id", "expires_at"), "write_id").where((F.col("expires_at").isNull()) | (F.col("at") <= F.col("expires_at")))
    first = met.groupBy("write_id").agg(F.min(F.struct("seq", "decision")).alias("first"), F.collect_list("decision").alias("all"))
    out = writes.join(first, "write_id", "left")
    said = F.when(F.col("first.decision") == "approve", "approved").when(F.col("first.decision") == "reject", "rejected")
    conflicts = F.coalesce(F.size(F.filter("all", lambda d: d != F.col("first.decision"))), F.lit(0))
    return out.select("write_id", F.coalesce(said, F.col("status")).alias("status"), conflicts.alias("conflicts"))


def expire_pending(writes: DataFrame, now: Column) -> DataFrame:
    """write_id, status: pending ones whose time is past (before now, not at it) expire."""
    late = (F.col("status") == "pending") & F.coalesce(F.col("expires_at") < now, F.lit(False))
    return writes.select("write_id", F.when(late, "expired").otherwise(F.col("status")).alias("status"))


def faculty_votes(cases: DataFrame) -> DataFrame:
    """case_id, faculty, vote. cases: case_id, stakes, subject_kind, question, open_debts, has_sources, risk_tags, is_skill_mutation."""
    tagged = lambda *tags: F.coalesce(F.arrays_overlap("risk_tags", F.array(*[F.lit(t) for t in tags])), F.lit(False))
    debts = F.coalesce("open_debts", F.lit(0)) > 0
    bare = F.coalesce(~F.col("has_sources"), F.lit(False))
    stakes = F.coalesce("stakes", F.lit("routine"))
    votes = {
        "epistemology": F.when(debts, "reject").when(bare & (F.col("subject_kind") == "belief"), "defer"),
        "applied_ethics": F.when(tagged("harm", "deception"), "reject").when(stakes == "consequential", "defer"),
        "language_logic": F.when(F.length(F.coalesce("question", F.lit(""))) < 8, "reject"),
        "philosophy_of_tech": F.when(F.coalesce("is_skill_mutation", F.lit(False)) & (stakes != "routine"), "defer").when(tagged("network", "shell"), "reject"),
        "mind_consciousness": F.when(bare & debts, "abstain"),
    }
    each = F.array(*[F.struct(F.lit(f).alias("faculty"), F.coalesce(votes[f], F.lit("approve")).alias("vote")) for f in FACULTIES])
    return cases.select("case_id", F.explode(each).alias("v")).select("case_id", "v.faculty", "v.vote")


def tally(cases: DataFrame, votes: DataFrame) -> DataFrame:
    """case_id, approves, rejects, quorum, status. cases: case_id, stakes, timed_out. One reject blocks, whatever the count of approvals."""
    n = lambda v: F.coalesce(F.sum((F.col("vote") == v).cast("int")), F.lit(0))
    got = votes.groupBy("case_id").agg(n("approve").alias("approves"), n("reject").alias("rejects"), F.max(F.when(F.col("faculty") == "epistemology", F.col("vote"))).alias("epi"))
    met = cases.join(got, "case_id", "left").fillna({"approves": 0, "rejects": 0})
    stakes = F.coalesce("stakes", F.lit("routine"))
    quorum = F.when(stakes == "consequential", 4).when(stakes == "elevated", 3).otherwise(2)
    late = F.when((stakes == "routine") & (F.col("epi") == "approve"), "passed").otherwise("parked")
    status = F.when(F.col("rejects") > 0, "rejected").when(F.col("approves") >= quorum, "passed").when(F.col("timed_out"), late).otherwise("open")
    return met.select("case_id", "approves", "rejects", quorum.alias("quorum"), status.alias("status"))


def activation(skills: DataFrame, teeth: bool = True) -> DataFrame:
    """skill_id, outcome, held_by: the first check that holds a skill back; without teeth it is only noted (shadow).

    skills: skill_id, open_holds, has_secret, stale_dependencies, snapshot_cleared, requested, manifest, faculty_status.
    """
    held = (F.when(F.col("open_holds") > 0, "open_hold").when(F.col("has_secret"), "credential").when(F.col("stale_dependencies") > 0, "stale_dependency")
            .when(~F.col("snapshot_cleared"), "critic").when(F.col("manifest").isNull(), "manifest").when(F.size(F.array_except("requested", "manifest")) > 0, "capability")
            .when(F.col("faculty_status") == "rejected", "faculty"))
    return skills.select("skill_id", F.when(held.isNull(), "activated").when(F.lit(teeth), "held").otherwise("shadow").alias("outcome"), held.alias("held_by"))


def risky_tools(tools: DataFrame) -> DataFrame:
    """Adds blocked: tools that reach the network, a shell or the disk, or whose source opens a fence."""
    risk = F.coalesce(F.arrays_overlap("risk", F.array(F.lit("network"), F.lit("shell"), F.lit("write_fs"))), F.lit(False))
    return tools.withColumn("blocked", risk | F.coalesce(F.col("source").contains("```"), F.lit(False)))


def catalogue_diff(pinned: DataFrame, live: DataFrame) -> DataFrame:
    """name, change (added, removed, schema, description, none). Both: name, description, input_schema."""
    p = pinned.select("name", F.col("description").alias("d1"), F.col("input_schema").alias("s1"), F.lit(True).alias("was"))
    n = live.select("name", F.col("description").alias("d2"), F.col("input_schema").alias("s2"), F.lit(True).alias("now"))
    met = p.join(n, "name", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("s1").eqNullSafe(F.col("s2")), "schema").when(~F.col("d1").eqNullSafe(F.col("d2")), "description").otherwise("none")
    return met.select("name", change.alias("change"))


def workspace(events: DataFrame) -> DataFrame:
    """key, seq, ok, version, reason: puts, locks and unlocks of shared objects, in order.

    events: key, seq, op (put, lock, unlock), by, expected (version, null: any). A put fails where another
    holds the lock or the version is not the expected one. State is one version and one owner a key; keys
    come sorted from the shuffle and pass through in a stream.
    """
    import pandas as pd

    ordered = events.select("key", "seq", "op", "by", F.col("expected").cast("double")).repartition("key").sortWithinPartitions("key", "seq")

    def fold(batches):
        at, version, owner = object(), 0, None
        for pdf in batches:
            out = []
            for key, seq, op, by, expected in pdf.itertuples(index=False, name=None):
                if key != at:
                    at, version, owner = key, 0, None
                reason = "locked" if owner is not None and owner != by else "version" if op == "put" and expected == expected and expected is not None and expected != version else None
                if reason is None:
                    version += op == "put"
                    owner = by if op == "lock" else None if op == "unlock" else owner
                out.append((key, seq, reason is None, version, reason))
            yield pd.DataFrame(out, columns=["key", "seq", "ok", "version", "reason"])

    return ordered.mapInPandas(fold, "key string, seq long, ok boolean, version long, reason string")
