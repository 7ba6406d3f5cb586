"""Cutting the lineage of iterative operators, and the folder that all executors share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's checkpoint folder, as ``spark.checkpoint.dir`` names it.

    Only where the driver and the executors are one process (``local[...]``, as in tests) a temporary folder
    stands in for one that isn't named; on a cluster a missing folder is an error, because a folder of one
    machine can't be read by the others.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of our own below the shared one."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid4().hex}"


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each query made within it go when the query ends, not when the driver's memory is next cleaned.

    For steps whose result is written: nothing reads their shuffles again, so the disk in use is that of the largest
    step instead of the sum of all.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the folder that all executors share; the shuffles it was made from are released.

    The copy outlives any executor, and Spark's cleaner removes it where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    shared_root(df.sparkSession)
    with released_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a query of its own, planned under that setting
