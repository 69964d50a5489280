"""Spark session helpers.

The library never creates a cluster-wide setting on its own: the helpers
below only fill in values that are unset, so a cluster's own
configuration (shuffle partitions, checkpoint directory, AQE flags) wins.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every job in the library relies on. AQE re-plans joins from
# runtime sizes, coalesces small shuffle partitions and splits skewed join
# partitions; the session time zone is pinned so timestamps print the same
# on every executor and in the DuckDB oracle.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "mediacat") -> SparkSession:
    """Session for tests and the local bench (``local[cores]``)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("MEDIACAT_DRIVER_MEMORY", "8g"))
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory of the session.

    ``spark.checkpoint.dir`` names the folder that driver and executors
    share and is used as is. Only a ``local`` master, whose tasks all run in
    the driver's own process, may go without it: a fresh scratch folder is
    then made and registered. Anywhere else an unset folder is an error,
    because each executor would write to a disk the others cannot see.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is unset: set it to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="mediacat-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint directory (never machine-local
    on a cluster): used for ledger versions written by streaming jobs."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"
