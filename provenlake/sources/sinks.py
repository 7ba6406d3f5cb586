"""Writing: versioned tables with one published version, logs that only grow, receipts and anchors."""

from __future__ import annotations

import json
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTable:
    """A table whose every write is a new folder, published by a one-row pointer.

    One writer at a time. A write that dies before it publishes leaves an unseen folder; readers see the
    version the newest pointer names, whole.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> int:
        try:
            return self.spark.read.parquet(f"{self.path}/published").agg(F.max("version")).first()[0] or 0
        except Exception as missing:
            if "PATH_NOT_FOUND" in str(missing):
                return 0
            raise

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v={self.version() if version is None else version}")

    def publish(self, df: DataFrame) -> int:
        new = self.version() + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v={new}")
        self.spark.range(1).select(F.lit(new).alias("version")).coalesce(1).write.mode("append").parquet(f"{self.path}/published")
        return new

    def upsert(self, incoming: DataFrame, key: str) -> int:
        """Rows of the same key are replaced, others added."""
        if not self.version():
            return self.publish(incoming)
        old = self.read()
        return self.publish(old.join(incoming.select(key), key, "left_anti").unionByName(incoming.select(*old.columns)))

    def delete(self, keys: DataFrame, key: str) -> int:
        return self.publish(self.read().join(keys.select(key), key, "left_anti"))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def canonical_json(value) -> str:
    """JSON with sorted keys at every depth and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def anchor(entry: dict) -> dict:
    """The entry with its hash, taken over everything but the hash."""
    return entry | {"anchorHash": sha256(canonical_json({k: v for k, v in entry.items() if k != "anchorHash"}).encode()).hexdigest()}


class DamagedLog(ValueError):
    """A line of an anchor log isn't an anchor, or doesn't follow the one before it."""


def last_anchor(anchor_path: str) -> str | None:
    """The hash of a log's last anchor, null for none. Every line is checked: nothing is appended over damage."""
    prev = None
    try:
        with open(anchor_path, encoding="utf-8") as f:
            for n, line in enumerate(filter(str.strip, f), 1):
                try:
                    entry = json.loads(line)
                except ValueError:
                    entry = None
                if not isinstance(entry, dict) or anchor(entry)["anchorHash"] != entry.get("anchorHash") or entry.get("prevAnchorHash") != prev:
                    raise DamagedLog(f"{anchor_path}, line {n}: inspect and repair the log first")
                prev = entry["anchorHash"]
    except FileNotFoundError:
        return None
    return prev


def export_checkpoint(checkpoint: dict, receipt_path: str, anchor_path: str) -> dict:
    """Appends the anchor first and writes the receipt after it, so that no receipt is without an anchor. It follows the log's last anchor."""
    made = anchor(checkpoint | {"prevAnchorHash": last_anchor(anchor_path)})
    with open(anchor_path, "a", encoding="utf-8") as f:
        f.write(canonical_json(made) + "\n")
    with open(receipt_path, "w", encoding="utf-8") as f:
        f.write(canonical_json(made) + "\n")
    return made
