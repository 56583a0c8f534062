"""Helpers the operators of this subpackage share.

* ``table`` reads one of the given tables through Spark's reader.
* ``cut`` writes an intermediate frame to the shared checkpoint folder, so that
  a lost executor re-reads it instead of recomputing all that led to it.
* ``join_bounded`` joins with a side whose size was measured: it is broadcast
  below the bound and joined by shuffle beyond it; the rows are the same.
* ``runs`` walks a sorted partition group by group in bounded memory.
* ``rows_of`` walks Arrow batches in small slices, so that a batch of long
  texts is never turned into Python objects as a whole.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A measured side of at most this many bytes may be broadcast.
BROADCAST_BYTES = 32 << 20
#: Whether Spark removes the shuffle files of an action when it ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a slice that is held as Python objects.
SLICE_ROWS = 256


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, whatever folder they start in.
    (Where executors do not see that folder, ship the package with --py-files.)"""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode, where
    the driver is also the executor. On a cluster an unset folder is an error."""
    share_package(spark)
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame, tidy: bool = False) -> DataFrame:
    """``df`` written to the shared checkpoint folder; its lineage ends there. ``tidy``: what was shuffled for it is removed at
    once, not when the driver happens to collect its garbage (for large shuffles)."""
    ensure_checkpoint_dir(df.sparkSession)
    if not tidy:
        return df.checkpoint(eager=True)
    conf = df.sparkSession.conf
    was = conf.get(TIDY, None)
    conf.set(TIDY, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a frame heeds what was set when it was made
    finally:
        if was is None:
            conf.unset(TIDY)
        else:
            conf.set(TIDY, was)


def size_bound(df: DataFrame) -> int:
    """Bytes of a written (cut) frame, measured: fixed columns by width, others by length."""
    widths = {"bigint": 8, "int": 4, "double": 8, "boolean": 1, "float": 4}
    parts = []
    for name, kind in df.dtypes:
        col = F.col(f"`{name}`")
        if kind in widths:
            parts.append(F.lit(widths[kind] + 8))
        elif kind.startswith("array"):
            parts.append(F.coalesce(F.size(col), F.lit(0)) * 16 + 16)
        else:
            parts.append(F.coalesce(F.octet_length(col.cast("string")), F.lit(0)) + 16)
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return int(df.agg(F.coalesce(F.sum((total + 16).cast("long")), F.lit(0))).first()[0])


def join_bounded(left: DataFrame, right: DataFrame, on, how: str = "inner",
                 limit: int = BROADCAST_BYTES) -> DataFrame:
    """``left`` joined with the cut frame ``right``: broadcast if its measured size is within
    ``limit``, by shuffle otherwise. Both ways give the same rows."""
    side = F.broadcast(right) if size_bound(right) <= limit else right
    return left.join(side, on, how)


def give_back() -> None:
    """Return to the system what earlier tasks of this worker, which outlives them, have freed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only the GNU library has it
        pass


def rows_of(batches: Iterable[pa.RecordBatch], size: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    give_back()
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of equal ``keys`` of a partition that is sorted by them, one table each."""
    give_back()
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        codes = [c.dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in columns]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in codes:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            key = tuple(c[a].as_py() for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` (cut) with ``place``, the rank of each row by ``order`` from 0; rows that agree in it stand in
    either order. Range partitions are sorted side by side; only one count a partition is looked at as a whole,
    and ties are split between partitions by a row number."""
    rows = (df.withColumn("_tie", F.monotonically_increasing_id())
            .repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie")
            .withColumn("_at", F.monotonically_increasing_id()).drop("_tie"))
    rows = cut(rows)  # the id holds the partition above bit 33 and the place in it below
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    start = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", start.alias("_start"))  # one row per partition
    return (rows.withColumn("_part", part).join(F.broadcast(starts), "_part")
            .withColumn("place", F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1))
            .drop("_part", "_start", "_at"))
