"""Session builder and the run-time settings every plan here relies on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that may be changed on a live session. Joins on building, flight or client keys can
# meet one key with a large share of the rows: skewed partitions are split at run time, also
# where that costs one more exchange.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # A folder of many folders is listed by so many tasks, each for a share of them, not by one task a folder.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "96",
    # Frames travel as binaries: keep Arrow batches small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "facadelake") -> SparkSession:
    """Single-machine session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("FACADELAKE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_root(spark: SparkSession) -> str | None:
    """The shared folder that a cluster names in ``spark.checkpoint.dir``; None on one machine, as in tests.

    On a cluster without it this fails: a temporary folder of the driver is not one that executors see.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.conf.get("spark.master", None) or spark.sparkContext.master
    if not root and not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
    return root or None


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for written intermediates, below the shared folder; on one machine a temporary folder."""
    root = shared_root(spark)
    if not root:
        return tempfile.mkdtemp(prefix=f"facadelake-{purpose}-")
    return f"{root.rstrip('/')}/facadelake/{purpose}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """``DataFrame.checkpoint`` needs a folder: the cluster's where it names one."""
    if spark.sparkContext.getCheckpointDir() is None:
        root = shared_root(spark)
        spark.sparkContext.setCheckpointDir(root or tempfile.mkdtemp(prefix="facadelake-checkpoint-"))
