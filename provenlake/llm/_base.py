"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..materialise import durable, shared_folder  # noqa: F401

#: What the contracts call white space between words: space and \t \n \v \f \r.
WORD_RE = r"[^\x20\x09-\x0D]+"
SPACE_RE = r"[\x20\x09-\x0D]+"
BATCH_BYTES = 4 << 20
#: Labels that a model tells apart at most.
MOST_LABELS = 2000
#: Bits of a table of maybes: a million rows of 64.
MOST_BITS = 1 << 26
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(df: DataFrame) -> DataFrame:
    """The frame, after its session's Arrow batches are bounded to BATCH_BYTES where they may be larger.

    Texts differ in length by orders of magnitude, so a bound in rows doesn't bound a worker's memory.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", conf.get(key))
    if now is None or not 0 < int(now[1]) <= BATCH_BYTES:
        conf.set(key, f"{BATCH_BYTES}b")
    return df


def with_maybe(df: DataFrame, id: Column, ids: DataFrame) -> DataFrame:
    """Adds ``__maybe``: false only for rows whose id is not among ``ids`` (one column, written rows).

    The ids' hashes set bits of a table of 16 bits an id, which is broadcast: at most MOST_BITS / 64 rows. It spares shuffles
    rows that no join would match. Beyond MOST_BITS / 16 ids more rows pass than are asked for, which costs speed, not rows.
    """
    bits = min(max(1 << (16 * ids.count() + 1).bit_length(), 1 << 12), MOST_BITS)
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    word = lambda c: F.shiftright(spot(c), 6).cast("int")
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(spot(c), F.lit(64)).cast("int"))
    at = F.col(ids.columns[0])
    table = ids.select(word(at).alias("__word"), bit(at).alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    met = df.withColumn("__word", word(id)).withColumn("__bit", bit(id)).join(F.broadcast(table), "__word", "left")  # at most bits / 64 rows
    return met.withColumn("__maybe", F.coalesce(F.col("__bits").bitwiseAND(F.col("__bit")) != 0, F.lit(False))).drop("__word", "__bit", "__bits")


def quoted(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def words(text: Column) -> Column:
    """Words of a text, split at ASCII white space; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RE), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model may learn from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def hash_sample(rows: DataFrame, label: str, id_col: str, k: int, total: int) -> tuple[DataFrame, dict]:
    """id, label, n (rank): up to k ids of each label, in the order of a hash of the id; and the labels' counts.

    At most MOST_LABELS labels take part, the most frequent ones. Where there are so many that k ids of each would be more
    than ``total``, each gives an equal smaller number, at least one. Counts come first (one row a label). Of each label only
    ids whose hash lies in the lowest 4k of its rows, as the count says, are ranked at all, so that no task ranks the rows of
    a whole label. An id that stands on several rows of a label is one.
    """
    ordered = rows.groupBy(label).agg(F.count_distinct(id_col).alias("n")).orderBy(F.desc("n"), label).limit(MOST_LABELS)
    counts = {r[0]: r["n"] for r in ordered.collect()}
    if not counts:
        return rows.select(id_col, label).limit(0).withColumn("n", F.lit(0)), counts
    k = max(min(k, total // len(counts)), 1)
    of_label = rows.sparkSession.createDataFrame(list(counts.items()), rows.select(label, F.lit(0).cast("long").alias("n_of")).schema)
    place = F.xxhash64(id_col).cast("double") / 2.0**64 + 0.5
    met = rows.select(id_col, label).join(F.broadcast(of_label), label)  # at most MOST_LABELS rows
    low = met.where(place <= 4.0 * (k + 4) / F.col("n_of")).select(id_col, label).distinct()
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(id_col), id_col))
    return low.withColumn("n", rank).where(F.col("n") <= k), counts
