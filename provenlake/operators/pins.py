"""Pins: claims' sources re-checked against the corpus, with rescue of moved passages, and the roll-up.

Rescue is for reports only. Granting support uses ``verify_pins(..., rescue=False)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import passage_path, pin_hash
from ..materialise import durable

CITABLE = ("vault_page",)


def verify_pins(pins: DataFrame, corpus: DataFrame, kinds: tuple[str, ...] = CITABLE, rescue: bool = True) -> DataFrame:
    """pin_id, belief_id, verified, reason, relocated_to.

    pins: pin_id, belief_id, kind, ref_id, snapshot_hash, pinned_ref, pinned_root; corpus: id, kind, title,
    body, ref, ingest_root. Reasons: kind_unregistered, not_found, hash_mismatch. A lost pin is rescued by
    the same snapshot anywhere of its kind (smallest id), or by a passage of the same file and recorded root
    whose text gives the pinned hash under the pinned ref.
    """
    rows = corpus.select("id", F.col("kind").alias("c_kind"), "title", "body", F.col("ref").alias("c_ref"), F.col("ingest_root").alias("c_root"), pin_hash(F.col("title"), F.col("body"), F.col("ref")).alias("c_hash"))
    found = rows.select(F.col("id").alias("ref_id"), F.col("c_kind").alias("kind"), F.col("c_hash").alias("now_hash"))
    met = pins.join(found, ["ref_id", "kind"], "left")
    reason = F.when(~F.col("kind").isin(list(kinds)), "kind_unregistered").when(F.col("now_hash").isNull(), "not_found").when(F.col("now_hash") != F.col("snapshot_hash"), "hash_mismatch")
    met = met.withColumn("reason", reason)
    if not rescue:
        return met.select("pin_id", "belief_id", F.col("reason").isNull().alias("verified"), "reason", F.lit(None).cast("string").alias("relocated_to"))
    same = rows.groupBy(F.col("c_hash").alias("snapshot_hash"), F.col("c_kind").alias("kind")).agg(F.min("id").alias("same_id"))
    met = met.join(same, ["snapshot_hash", "kind"], "left")
    lost = met.where("reason IN ('not_found', 'hash_mismatch') AND same_id IS NULL AND pinned_ref IS NOT NULL AND pinned_root IS NOT NULL")
    lost = lost.select("pin_id", "kind", "pinned_ref", "pinned_root", "snapshot_hash", passage_path(F.col("pinned_ref")).alias("path"))
    near = rows.select(F.col("c_kind").alias("kind"), F.col("c_root").alias("pinned_root"), passage_path(F.col("c_ref")).alias("path"), "id", "c_ref", "title", "body")
    moved = lost.join(near, ["kind", "pinned_root", "path"]).where((F.col("c_ref") != F.col("pinned_ref")) & (pin_hash(F.col("title"), F.col("body"), F.col("pinned_ref")) == F.col("snapshot_hash")))
    moved = moved.groupBy("pin_id").agg(F.min("id").alias("moved_id"))
    met = met.join(moved, "pin_id", "left")
    target = F.when(F.col("reason").isin("not_found", "hash_mismatch"), F.coalesce("same_id", "moved_id"))
    return met.select("pin_id", "belief_id", (F.col("reason").isNull() | target.isNotNull()).alias("verified"), F.when(target.isNull(), F.col("reason")).alias("reason"), target.alias("relocated_to"))


def roll_up(verdicts: DataFrame) -> DataFrame:
    """belief_id, total, verified, failures (sorted), relocated, state (sound, degraded, broken)."""
    out = verdicts.groupBy("belief_id").agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.col("verified").cast("int")).alias("verified"),
        F.array_sort(F.collect_list("reason")).alias("failures"), F.count("relocated_to").alias("relocated"),
    )
    state = F.when(F.col("total") == F.col("verified"), "sound").when(F.col("verified") == 0, "broken").otherwise("degraded")
    return out.withColumn("state", state)


def run_report(rolled: DataFrame, beliefs: DataFrame, pins: DataFrame) -> DataFrame:
    """checked, broken, degraded, relocated, unsourced, failed: one row; failed if anything is broken or degraded."""
    of = lambda s: F.coalesce(F.sum((F.col("state") == s).cast("int")), F.lit(0))
    counts = rolled.agg(F.count(F.lit(1)).alias("checked"), of("broken").alias("broken"), of("degraded").alias("degraded"), F.coalesce(F.sum("relocated"), F.lit(0)).alias("relocated"))
    bare = unsourced(beliefs, pins).agg(F.count(F.lit(1)).alias("unsourced"))
    return counts.crossJoin(bare).withColumn("failed", F.col("broken") + F.col("degraded") > 0)  # one row each


def unsourced(beliefs: DataFrame, pins: DataFrame) -> DataFrame:
    """Beliefs without any source."""
    return beliefs.join(pins.select("belief_id"), "belief_id", "left_anti")


def missing_parents(pins: DataFrame, beliefs: DataFrame) -> DataFrame:
    """Pins on beliefs that don't exist."""
    return pins.where("kind = 'belief'").join(beliefs.select(F.col("belief_id").alias("ref_id")), "ref_id", "left_anti")


def gone_files(pins: DataFrame, corpus: DataFrame, listing: DataFrame) -> DataFrame:
    """path: cited files that the listing (path) no longer has."""
    cited = pins.join(corpus.select(F.col("id").alias("ref_id"), "ref"), "ref_id").select(passage_path(F.col("ref")).alias("path")).distinct()
    return cited.join(listing.select("path"), "path", "left_anti")


def newest_first(pins: DataFrame, beliefs: DataFrame, since=None) -> DataFrame:
    """Beliefs with their pins, newest first."""
    met = beliefs.join(pins, "belief_id")
    return (met if since is None else met.where(F.col("created_at") >= since)).orderBy(F.desc("created_at"), "belief_id", "pin_id")


def strided_sample(rows: DataFrame, changed, key: str, budget: int) -> DataFrame:
    """Changed rows first, up to the budget; then every floor(n / budget)-th of the others, in key order.

    Rows are numbered per range of the key and the ranges' sizes added up, so no task orders all rows.
    """
    touched = rows.where(changed).orderBy(key).limit(budget)
    rest = number_rows(rows.where(~changed), key)
    total = rest.agg(F.greatest(F.floor(F.count(F.lit(1)) / budget), F.lit(1)).alias("step"))
    picked = rest.crossJoin(F.broadcast(total)).where((F.col("row") - 1) % F.col("step") == 0).drop("step", "row")  # one row
    return touched.unionByName(picked.orderBy(key).limit(budget))


def number_rows(rows: DataFrame, key: str) -> DataFrame:
    """Adds ``row``, from 1 in key order."""
    # Written once: a second computation might cut the ranges elsewhere.
    spread = durable(rows.repartitionByRange(F.col(key)).withColumn("range", F.spark_partition_id()))
    sizes = spread.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("range", "before")
    numbered = spread.withColumn("at", F.row_number().over(Window.partitionBy("range").orderBy(key)))
    return numbered.join(F.broadcast(before), "range").withColumn("row", F.col("before") + F.col("at")).drop("range", "at", "before")
