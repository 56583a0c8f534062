"""Spark session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "lakehealth",
              shuffle_partitions: int | None = None,
              driver_memory: str = "8g") -> SparkSession:
    """Session with the settings the checks assume (AQE on, UTC, no UI)."""
    cpus = os.environ.get("BENCH_CPUS")
    master = master or (f"local[{cpus}]" if cpus else "local[*]")
    parts = shuffle_partitions or int(cpus or 8)
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at storage every executor can reach and
    is only read here; there, an unset folder is an error. In local mode (tests), where the
    driver is the executor, a folder under the system temp dir is registered once for the session.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="lakehealth-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf)
    spark.sparkContext.setCheckpointDir(conf)
    current = spark.sparkContext.getCheckpointDir() or conf
    return current.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder for one written table."""
    return f"{shared_dir(spark)}/lakehealth/{name}-{uuid.uuid4().hex[:12]}"
