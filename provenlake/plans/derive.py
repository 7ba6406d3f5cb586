"""Ledger-shaped tables derived from the given tables, each by a plain rule that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import passage_id, pin_hash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; times without a zone are UTC."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as passages: ten to a file, files in the folder of their source."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.col("source"), F.lit("/f"), F.floor(F.col("doc_id") / 10).cast("string"), F.lit(".md"))
    ref = F.concat(path, F.lit("#p"), (F.col("doc_id") % 10).cast("string"))
    return d.select("doc_id", F.lit("vault_page").alias("kind"), F.col("lang").alias("title"), F.col("text").alias("body"), ref.alias("ref"), path.alias("path"), F.lit("/vault").alias("ingest_root")).withColumn("id", passage_id(F.col("kind"), F.col("ingest_root"), F.col("ref")))


def edited(p: DataFrame) -> DataFrame:
    """The corpus after an edit: every 7th text has a note added, every 11th is gone, every 13th stands under the next ref of its file."""
    out = p.where("doc_id % 11 <> 3")
    ref = F.when(F.col("doc_id") % 13 == 5, F.concat("path", F.lit("#p"), (F.col("doc_id") % 10 + 10).cast("string"))).otherwise(F.col("ref"))
    body = F.when(F.col("doc_id") % 7 == 2, F.concat("body", F.lit(" (edited)"))).otherwise(F.col("body"))
    out = out.withColumn("ref", ref).withColumn("body", body)
    return out.withColumn("id", passage_id(F.col("kind"), F.col("ingest_root"), F.col("ref")))


def with_hash(p: DataFrame) -> DataFrame:
    return p.withColumn("snapshot_hash", pin_hash(F.col("title"), F.col("body"), F.col("ref")))


def pins(p: DataFrame) -> DataFrame:
    """A pin on every passage but every fifth; three passages in a row belong to one claim, every 17th pin is of a kind that can't be cited."""
    return with_hash(p).where("doc_id % 5 <> 4").select(
        F.col("doc_id").alias("pin_id"), F.floor(F.col("doc_id") / 3).alias("belief_id"), F.when(F.col("doc_id") % 17 == 0, "transcript").otherwise(F.col("kind")).alias("kind"),
        F.col("id").alias("ref_id"), "snapshot_hash", F.col("ref").alias("pinned_ref"), F.col("ingest_root").alias("pinned_root"),
    )


def beliefs(p: DataFrame) -> DataFrame:
    """One claim for every passage number, so that the upper two thirds have no source."""
    return p.select(F.col("doc_id").alias("belief_id")).distinct()


#: The same tables in DuckDB.
PASSAGES_SQL = """
    passages AS (
        SELECT doc_id, kind, title, body, ref, path, ingest_root, 'vdoc_' || substr(sha256(to_json([kind, ingest_root, ref])::VARCHAR), 1, 16) AS id
        FROM (SELECT doc_id, 'vault_page' AS kind, lang AS title, text AS body, source || '/f' || (doc_id // 10) || '.md#p' || (doc_id % 10) AS ref, source || '/f' || (doc_id // 10) || '.md' AS path, '/vault' AS ingest_root FROM documents)),
    edited AS (
        SELECT doc_id, kind, title, body, ref, path, ingest_root, 'vdoc_' || substr(sha256(to_json([kind, ingest_root, ref])::VARCHAR), 1, 16) AS id
        FROM (SELECT doc_id, kind, title, path, ingest_root, CASE WHEN doc_id % 7 = 2 THEN body || ' (edited)' ELSE body END AS body,
                     CASE WHEN doc_id % 13 = 5 THEN path || '#p' || (doc_id % 10 + 10) ELSE ref END AS ref FROM passages WHERE doc_id % 11 <> 3)),
    pins AS (
        SELECT doc_id AS pin_id, doc_id // 3 AS belief_id, CASE WHEN doc_id % 17 = 0 THEN 'transcript' ELSE kind END AS kind, id AS ref_id,
               sha256(to_json([title, body, ref])::VARCHAR) AS snapshot_hash, ref AS pinned_ref, ingest_root AS pinned_root FROM passages WHERE doc_id % 5 <> 4)"""
