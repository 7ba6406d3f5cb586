"""Sharding by fixed virtual slots (DataFrame functions only).

Records are hashed into a fixed number of virtual slots. Bytes are summed per slot, and a small stored
table, with a version on each edition, maps slots to shards. Its first version deals the slots evenly,
whatever they hold. Rebalancing, after new loads or for another number of shards, appends a version in
which only the slots that must move have a new shard; no record is ever hashed again.

Defined results: null text counts as empty text (size 1); rows repeated with one id and text are
separate records of one slot; of slots with equal bytes the smaller number is dealt first, of shards with
equal loads the smaller number takes it; an empty table gives an empty result; extra columns are ignored.
Equal texts need not share a shard: under the byte law a group of copies that holds a third of all bytes
could not be balanced otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._base import durable, quoted, shared_folder

N_SLOTS = 4096


def _lightest_first(slots: Column, loads: Column) -> Column:
    """Deal slots (largest first) one after another to the shard with the least bytes.

    ``slots`` is an array of struct(neg_bytes, virtual_slot, ...), ``loads`` the bytes each shard
    has already. Returns the chosen shard of each slot in order. The array has at most one entry
    a virtual slot, so its size is fixed.
    """

    def deal(state: Column, slot: Column) -> Column:
        def put(at: Column) -> Column:
            return F.struct(
                F.transform(state["loads"], lambda x, i: F.when(i == at, x - slot["neg_bytes"]).otherwise(x)).alias("loads"),
                F.concat(state["chosen"], F.array(at)).alias("chosen"),
            )

        least = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        return F.transform(F.array(least), put)[0]

    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("chosen"))
    return F.aggregate(slots, start, deal, lambda s: s["chosen"])


def slot_loads(records: DataFrame) -> DataFrame:
    """Bytes and rows of each virtual slot; one row a slot, so at most the fixed slot count."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))


def even_slot_map(spark: SparkSession, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 1 of the slot map: virtual_slot, shard, bytes (0: no loads are known yet), version."""
    slots = spark.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return slots.select("virtual_slot", F.floor(F.col("virtual_slot") * n_shards / n_slots).cast("int").alias("shard"), F.lit(0).cast("long").alias("bytes"), F.lit(1).alias("version"))


def rebalance_slot_map(slot_map: DataFrame, n_shards: int, loads: DataFrame | None = None) -> DataFrame:
    """The next version of a slot map, for more (or fewer) shards or for new loads.

    A shard keeps its slots, in slot order, while their bytes stay within the new mean; only the
    rest, and the slots of shards that no longer exist, are dealt anew, the largest first, each to the shard
    with the least bytes. All of it works on one row a slot.
    """
    old = slot_map.select("virtual_slot", "shard", "bytes", "version")
    if loads is not None:
        old = old.drop("bytes").join(loads.select("virtual_slot", "bytes"), "virtual_slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    total = old.agg((F.sum("bytes") / F.lit(n_shards)).alias("mean"), F.max("version").alias("last"))
    so_far = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    held = old.withColumn("upto", F.sum("bytes").over(so_far)).crossJoin(F.broadcast(total))  # one row
    held = held.withColumn("stays", (F.col("upto") <= F.col("mean")) & (F.col("shard") < n_shards))
    slot = F.struct((-F.col("bytes")).alias("neg_bytes"), "virtual_slot")
    shard_bytes = F.array(*[F.coalesce(F.sum(F.when(F.col("stays") & (F.col("shard") == s), F.col("bytes"))), F.lit(0)) for s in range(n_shards)])
    moved = held.agg(F.sort_array(F.collect_list(F.when(~F.col("stays"), slot))).alias("slots"), shard_bytes.alias("loads"))
    moved = moved.select("slots", _lightest_first(F.col("slots"), F.col("loads")).alias("chosen"))
    moved = moved.select(F.explode(F.arrays_zip("slots", "chosen")).alias("z")).select(F.col("z.slots.virtual_slot").alias("virtual_slot"), F.col("z.chosen").alias("new_shard"))
    return held.join(moved, "virtual_slot", "left").select("virtual_slot", F.coalesce("new_shard", "shard").alias("shard"), "bytes", (F.col("last") + 1).alias("version"))


class SlotMapConflict(RuntimeError):
    """A version was taken by another writer, or a stored version lists a slot twice."""


def _claim(spark: SparkSession, path: str, version: int) -> None:
    """Take the name of a version. The file system lets one writer only create the file, whoever else tries."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    name = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_claims/{version}")
    try:
        name.getFileSystem(conf).create(name, False).close()
    except Exception as taken:
        raise SlotMapConflict(f"version {version} of {path} is another writer's") from taken


def release_claim(spark: SparkSession, path: str, version: int) -> None:
    """Give back the name of a version whose writer died before the version was complete."""
    name = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_claims/{version}")
    name.getFileSystem(spark._jsc.hadoopConfiguration()).delete(name, False)


def save_slot_map(slot_map: DataFrame, path: str) -> None:
    """Publish a version of the stored map; older versions stay readable.

    A version's name is claimed before it is written, so of two writers that edit the same version one fails with
    SlotMapConflict and can load the other's version and try again.
    """
    spark, slot_map = slot_map.sparkSession, durable(slot_map)
    version = slot_map.agg(F.max("version")).first()[0]
    _claim(spark, path, version)
    slot_map.drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{path.rstrip('/')}/version={version}")


def load_slot_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The stored map as of a version; the newest complete one if none is named."""
    stored = spark.read.parquet(path)
    if version is None:
        stored = stored.join(F.broadcast(stored.agg(F.max("version").alias("version"))), "version", "left_semi")
    else:
        stored = stored.where(F.col("version") == version)
    sizes = stored.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("virtual_slot").alias("slots")).first()
    if sizes["n"] != sizes["slots"]:
        raise SlotMapConflict(f"{path} lists a slot twice")
    return stored


def slot_records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """The slim rows that sharding works on: doc_id, size, text_crc32, virtual_slot."""
    text = F.coalesce(quoted(text_col), F.lit(""))
    slim = docs.select(quoted(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    return slim.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slots)).cast("int"))


def shard_documents(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, map_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (position in its shard, from 0), grown_shard, virtual_slot, map_version.

    ``map_path`` is where the slot map is stored; the map there is edited for the loads of these documents and for
    ``n_shards``, and records go by the new version. Without a path a new map is stored in the shared folder and
    edited once. Texts are read once, for their size and checksum; the slim rows are kept and everything
    else works on them. A record's place in its shard is its slot's offset plus its rank in the slot, so
    no task ever orders a whole shard.
    """
    spark = docs.sparkSession
    records = durable(slot_records(docs, id_col, text_col, n_slots))
    loads = slot_loads(records)
    if map_path is None:
        map_path = shared_folder(spark, "slot-map")
        save_slot_map(even_slot_map(spark, n_shards, n_slots), map_path)
    save_slot_map(rebalance_slot_map(load_slot_map(spark, map_path), n_shards, loads), map_path)
    slot_map = load_slot_map(spark, map_path).select("virtual_slot", "shard", "version").join(loads.select("virtual_slot", "n_rows"), "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = slot_map.select("virtual_slot", "shard", "version", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32"))
    return (
        records.withColumn("rank", rank)
        .join(F.broadcast(placed), "virtual_slot")  # at most n_slots rows, whatever the corpus
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("offset") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"),
        )
    )
