"""The passage corpus: statistics, and the difference a new scan makes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import passage_path


def upper_median(values: Column) -> Column:
    """The element in the middle of a sorted list, the upper one of two."""
    ordered = F.array_sort(F.collect_list(values))
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def top_folder(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise("(root)")


def folder_stats(passages: DataFrame) -> DataFrame:
    """folder, passages, files, chars. passages: path, body."""
    return passages.groupBy(top_folder(F.col("path")).alias("folder")).agg(F.count(F.lit(1)).alias("passages"), F.countDistinct("path").alias("files"), F.sum(F.length("body")).alias("chars"))


def file_sizes(passages: DataFrame) -> DataFrame:
    return passages.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def median_passages(passages: DataFrame) -> DataFrame:
    """median_n: passages of the file in the middle. File sizes are counted per size first, so the median needs no list of all files."""
    from pyspark.sql.window import Window

    by_size = file_sizes(passages).groupBy("n").agg(F.count(F.lit(1)).alias("files"))
    upto = by_size.withColumn("upto", F.sum("files").over(Window.orderBy("n"))).withColumn("total", F.sum("files").over(Window.partitionBy()))
    return upto.where(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min("n").alias("median_n"))


def oversized_files(passages: DataFrame, times: int = 8, most: int = 5) -> DataFrame:
    """path, n: the largest files with more than ``times`` the median number of passages."""
    met = file_sizes(passages).crossJoin(F.broadcast(median_passages(passages)))  # one row
    return met.where(F.col("n") > times * F.col("median_n")).orderBy(F.desc("n"), "path").limit(most).select("path", "n")


def ingest_diff(current: DataFrame, incoming: DataFrame, scanned: DataFrame) -> DataFrame:
    """id, action (insert, update, keep, delete): what a scan does to the corpus.

    current and incoming: id, ref, snapshot_hash, ingest_root; scanned: path, ingest_root, blank (a file of
    white space only, whose rows stay). A row goes only if the scan saw its file below the same root and
    didn't write its id again.
    """
    now = current.select("id", F.col("ref").alias("old_ref"), F.col("snapshot_hash").alias("old_hash"), F.col("ingest_root").alias("old_root"))
    new = incoming.select("id", F.col("snapshot_hash").alias("new_hash"))
    both = now.join(new, "id", "full_outer").withColumn("path", passage_path(F.col("old_ref")))
    seen = scanned.where("NOT blank").select(F.col("path"), F.col("ingest_root").alias("old_root"), F.lit(True).alias("seen")).distinct()
    met = both.join(seen, ["path", "old_root"], "left")
    action = F.when(F.col("old_hash").isNull(), "insert").when(F.col("new_hash").isNull(), F.when(F.col("seen"), "delete").otherwise("keep")).when(F.col("old_hash") == F.col("new_hash"), "keep").otherwise("update")
    return met.select("id", action.alias("action"))


def apply_ingest(current: DataFrame, incoming: DataFrame, scanned: DataFrame) -> DataFrame:
    """The corpus after a scan: incoming rows replace those of the same id, orphans of scanned files go, the rest stays."""
    gone = ingest_diff(current, incoming, scanned).where("action = 'delete'").select("id")
    stay = current.join(incoming.select("id"), "id", "left_anti").join(gone, "id", "left_anti")
    return stay.unionByName(incoming.select(*current.columns))


def ownership(current: DataFrame, paths: DataFrame) -> DataFrame:
    """id, owner: whether a row of a scanned path belongs to this root (owned), to none (legacy) or to another (other). paths: path, ingest_root."""
    rows = current.select("id", passage_path(F.col("ref")).alias("path"), "ref", F.col("ingest_root").alias("row_root"))
    met = rows.join(paths.select("path", F.col("ingest_root").alias("scan_root")), "path")
    owner = F.when(F.col("row_root").isNull(), "legacy").when(F.col("row_root") == F.col("scan_root"), "owned").otherwise("other")
    return met.select("id", "path", owner.alias("owner"))


def collisions(current: DataFrame, paths: DataFrame) -> DataFrame:
    """path: scanned paths that another root holds already."""
    return ownership(current, paths).where("owner = 'other'").select("path").distinct()
