"""Session settings, and shipping the package to workers that can't import it."""

from __future__ import annotations

import os
import re
import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def build_session(app: str = "provenlake", master: str | None = None, shuffle_partitions: int | None = None, checkpoint_dir: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is written for; ``conf`` adds to them (``_`` stands for ``.``).

    ``checkpoint_dir`` is the folder that the driver and all executors share; a cluster needs one, here or in its own
    settings. With a local master a temporary folder is taken where none is given.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if checkpoint_dir is None and master is not None and re.fullmatch(r"local(\[[^\]]*\])?", master):
        checkpoint_dir = tempfile.mkdtemp(prefix="provenlake-checkpoint-")
    if checkpoint_dir:
        settings["spark.checkpoint.dir"] = checkpoint_dir
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings |= {k.replace("_", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers once, where their path doesn't have it already."""
    home = Path(__file__).resolve().parent.parent
    known = [Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if home in known or Path.cwd().resolve() == home or app in _SHIPPED:
        return
    _SHIPPED.add(app)
    target = Path(tempfile.mkdtemp(prefix="provenlake-")) / "provenlake.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((home / "provenlake").rglob("*.py")):
            z.write(f, f.relative_to(home))
    spark.sparkContext.addPyFile(str(target))
    if str(target) in sys.path:  # the driver keeps the files it has
        sys.path.remove(str(target))
