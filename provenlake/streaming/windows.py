"""Event-time windows and stateful folds over streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

GENESIS = "GENESIS"


def read_folder(spark: SparkSession, path: str, schema, files_at_once: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def sliding_spend(events: DataFrame, window: str = "1 hour", slide: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """window_start, channel, n, cost_micros per sliding window; late rows beyond the watermark are not counted. events: created_at, channel, cost_usd_micros."""
    late = events.withWatermark("created_at", lateness)
    by = late.groupBy(F.window("created_at", window, slide).alias("w"), "channel").agg(F.count(F.lit(1)).alias("n"), F.sum("cost_usd_micros").alias("cost_micros"))
    return by.select(F.col("w.start").alias("window_start"), "channel", "n", "cost_micros")


class ChainTip(StatefulProcessor):
    """Appends to a hash chain per key; the state is the last hash and the last sequence number, so replays of old rows are dropped."""

    def init(self, handle) -> None:
        self.tip = handle.getValueState("tip", "hash string, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        frames = [f for f in rows]
        if not frames:
            return
        pdf = pd.concat(frames).sort_values("seq")
        prev, last = self.tip.get() if self.tip.exists() else (GENESIS, -(1 << 62))
        out = []
        for seq, payload in zip(pdf["seq"], pdf["payload"], strict=True):
            if seq <= last:
                continue
            entry = sha256(f"{prev}\n{payload}".encode()).hexdigest()
            out.append((key[0], seq, payload, prev, entry))
            prev, last = entry, seq
        self.tip.update((prev, int(last)))
        if out:
            yield pd.DataFrame(out, columns=["chain", "seq", "payload", "prev_hash", "entry_hash"])

    def close(self) -> None:
        pass


CHAIN_SCHEMA = "chain long, seq long, payload string, prev_hash string, entry_hash string"


def stream_chain(rows: DataFrame) -> DataFrame:
    """Chain entries of a stream of chain, seq, payload. Needs the RocksDB state store."""
    return rows.groupBy("chain").transformWithStateInPandas(ChainTip(), CHAIN_SCHEMA, "Append", "none")


def fold_chain_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends each micro-batch to stored chains: tips are read from the entries already written, an epoch that was written is not written again."""
    from ..operators.chains import append_chain

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        try:
            stored = spark.read.parquet(path)
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            stored = None
        if stored is not None and not stored.where(F.col("epoch") == epoch).isEmpty():
            return
        tips = None if stored is None else stored.groupBy("chain").agg(F.max_by("entry_hash", "seq").alias("tip"))
        append_chain(batch, "chain", "seq", "payload", tips).withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(path)

    return write


def on_new_pending(stream: DataFrame, notify: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls ``notify`` with the pending writes of each micro-batch."""
    return stream.where("status = 'pending'").writeStream.foreachBatch(notify).option("checkpointLocation", checkpoint).start()


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All a stream gives for the input there is now, as a table in memory; for tests and small results."""
    spark = stream.sparkSession
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
