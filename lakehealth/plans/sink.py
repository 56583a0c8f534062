"""Findings sinks (K1 latest snapshot, K2 appended history)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _observed(findings: DataFrame) -> tuple[DataFrame, Observation]:
    """A2: row and anomaly counts gathered while the sink writes (no extra job)."""
    obs = Observation("lakehealth_findings")
    metrics = [F.count(F.lit(1)).alias("rows")]
    if "is_anomaly" in findings.columns:
        metrics.append(F.count_if(F.col("is_anomaly").cast("boolean")).alias("anomalies"))
    return findings.observe(obs, *metrics), obs


def _move(fs, source, target) -> None:
    """Rename, or raise: FileSystem.rename reports most failures by returning false."""
    if not fs.rename(source, target):
        raise OSError(f"could not rename {source} to {target}")


def write_latest(findings: DataFrame, path: str, fmt: str = "parquet") -> dict:
    """K1: replace the whole latest table; returns the observed counts (A2).

    The new snapshot is written to a sibling staging folder first and swapped
    in with two checked renames; the old snapshot is deleted last. A failed job or
    a failed rename leaves the previous snapshot in place, and a snapshot that
    is derived from the current one never reads a half-deleted folder.
    """
    spark = findings.sparkSession
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex[:8]}"
    findings, obs = _observed(findings)
    findings.write.mode("overwrite").format(fmt).save(staging)
    fs, target = _fs(spark, path)
    _, new = _fs(spark, staging)
    swap(fs, new, target, _fs(spark, f"{path.rstrip('/')}.old-{uuid.uuid4().hex[:8]}")[1])
    return obs.get


def swap(fs, new, target, old) -> None:
    """Put folder ``new`` in place of ``target``, which waits at ``old`` until that is done."""
    if not fs.exists(target):
        _move(fs, new, target)
        return
    _move(fs, target, old)
    try:
        if fs.exists(target):  # another run put one there: a rename would nest the folders
            raise OSError(f"{target} was written by another run")
        _move(fs, new, target)
    except Exception:
        if not fs.exists(target):
            _move(fs, old, target)
        raise
    fs.delete(old, True)


def append_history(findings: DataFrame, path: str, fmt: str = "parquet") -> dict:
    """K2: append one run, partitioned by scan day (``scan_date`` text, first 10 chars)."""
    findings, obs = _observed(findings)
    (findings.withColumn("scan_day", F.substring("scan_date", 1, 10))
     .write.mode("append").partitionBy("scan_day").format(fmt).save(path))
    return obs.get


def read_history(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """All appended runs; ``mergeSchema`` tolerates runs with different column sets."""
    return spark.read.format(fmt).option("mergeSchema", "true").load(path)
