"""Session construction and the shared stage folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(app: str = "cohortkit", master: str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session or build a local one tuned for tests/bench.

    On a cluster the session comes from the launcher and this only returns it;
    the settings below matter for local runs.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    builder = (
        SparkSession.builder.appName(app)
        .master(master or f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # ~128 MB input splits and ~64 MB post-shuffle partitions keep tasks in
        # executor memory at any scale; AQE coalesces the small ones
        .config("spark.sql.files.maxPartitionBytes", "134217728")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "67108864")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("COHORTKIT_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    It is read from the session; only when nothing is configured (local tests)
    is a private folder created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="cohortkit-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def stage_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared checkpoint folder for stage tables and models."""
    base = checkpoint_dir(spark).rstrip("/")
    return "/".join([base, "cohortkit", *parts])
