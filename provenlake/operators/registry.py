"""Registries kept as tables: skills, profiles, scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import match_triggers
from .ordered import numbered
from .writes import Policy, _needs_approval, write_lifecycle

LEARNED = ("learned", "synth")
ACTIVABLE = ("pending", "draft", "quarantine")
APPROVED_KINDS = ("soul", "user", "memory")


def register_skills(skills: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """skill_id, content_hash, status (draft, pending), write (what became of the write it proposes; null for a draft).

    skills: skill_id, body, source (null: human), activate. What was learned, and what shall be activated, waits for a decision; what was learned
    comes from the background, where a policy may refuse it.
    """
    source = F.coalesce("source", F.lit("human"))
    waits = source.isin(list(LEARNED)) | F.coalesce("activate", F.lit(False))
    out = skills.select("skill_id", F.sha2("body", 256).alias("content_hash"), F.when(waits, "pending").otherwise("draft").alias("status"), source.alias("source"))
    proposed = out.where("status = 'pending'").select(
        F.col("skill_id").alias("write_id"), F.lit(0).cast("long").alias("seq"), F.lit("1970-01-01 00:00:00").cast("timestamp").alias("at"), F.lit("propose").alias("kind"), F.lit("skill").alias("target"),
        F.when(F.col("source") == "learned", "dream").otherwise("foreground").alias("origin"), F.lit(None).cast("int").alias("ttl_hours"),
    )
    said = write_lifecycle(proposed, policy).select(F.col("write_id").alias("skill_id"), F.col("code").alias("write"))
    return out.join(said, "skill_id", "left").select("skill_id", "content_hash", "status", "write")


def activate_skills(registry: DataFrame, chosen: DataFrame) -> DataFrame:
    """The registry (skill_id, status, ...) with the chosen skills (skill_id) active, where they waited, were drafts, or in quarantine."""
    hit = chosen.select("skill_id").distinct().withColumn("__chosen", F.lit(True))
    met = registry.join(hit, "skill_id", "left")
    status = F.when(F.col("__chosen") & F.col("status").isin(list(ACTIVABLE)), "active").otherwise(F.col("status"))
    return met.withColumn("status", status).select(*registry.columns)


def match_active(registry: DataFrame, utterances: DataFrame) -> DataFrame:
    """skill_id, utterance_id: the active skills that an utterance triggers. registry: skill_id, status, trigger."""
    return match_triggers(registry.where("status = 'active'").select("skill_id", "trigger"), utterances)


def profile_updates(profiles: DataFrame, updates: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """update_id, status (missing, queued, active), body (cut to the profile's size), content_hash, version (of an active update).

    profiles: profile_id, kind, max_chars, version; updates: update_id (their order), profile_id, body, direct. The three kinds of
    APPROVED_KINDS wait for a decision unless the update is direct or the policy lets them through. Each active update is one version more.
    """
    met = updates.join(profiles.select("profile_id", "kind", "max_chars", "version"), "profile_id", "left")
    body = F.when(F.coalesce("max_chars", F.lit(0)) > 0, F.substring(F.col("body"), F.lit(1), F.col("max_chars"))).otherwise(F.col("body"))
    waits = F.col("kind").isin(list(APPROVED_KINDS)) & ~F.coalesce("direct", F.lit(False)) & _needs_approval(policy, F.lit("user_profile"))
    out = met.select("update_id", "profile_id", F.when(F.col("kind").isNull(), "missing").when(waits, "queued").otherwise("active").alias("status"), body.alias("body"), "version")
    active = numbered(out.where("status = 'active'").select("profile_id", "update_id"), ["profile_id"], "update_id", "nth").select("update_id", "nth")
    done = out.join(active, "update_id", "left")
    text = F.when(F.col("status") != "missing", F.col("body"))
    return done.select("update_id", "profile_id", "status", text.alias("body"), F.sha2(text, 256).alias("content_hash"), (F.col("version") + F.col("nth") + 1).alias("version"))


def scope_policies(asked: DataFrame, scopes: DataFrame, posture: str = "auto") -> DataFrame:
    """The asked rows (scope_id, ...) with ``policy``: strict where the posture or the scope is; a scope that isn't known is auto. A parent's policy has no effect."""
    local = scopes.select("scope_id", F.col("policy").alias("__local"))
    policy = F.when(F.lit(posture == "strict") | (F.col("__local") == "strict"), "strict").otherwise("auto")
    return asked.join(local, "scope_id", "left").withColumn("policy", policy).drop("__local")
