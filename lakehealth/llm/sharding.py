"""Shards along a Hilbert curve over several metadata dimensions.

Every dimension is quantised to 2**bits cells by quantiles of all rows: a number by approximate ones,
a string by its whole value, from the running count of the distinct values in order. The cells'
position on the Hilbert curve orders the rows: neighbours on the curve are close in every
dimension, so a run of it covers a small box and files cut from runs can be skipped by any of
the dimensions. Rows with equal texts are a group and take the first curve position of them all.
Rows are range-partitioned and sorted by (curve position, text checksum, text hash, id); one
count per partition turns places into global ranks, and ranks are cut into runs whose lengths
differ by one row at most (law ``rows``). A crowded cell is split by checksum, hash and id,
so no partition depends on how rows spread over cells, and equal texts stay side by side: a cut
falls into at most one group, so that 15 groups at most lie in two of 16 shards, unless one is longer than a shard.

Edge cases: a null dimension is the lowest cell; a null text has size 1 and checksum 0;
rows that agree in curve position, checksum and id may stand in either order; with fewer rows than
shards some shards are empty; other columns pass untouched through ``write_shards`` (in the
struct ``row``, so that names cannot clash) and are ignored by ``assign``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakehealth.llm.common import cut, join_bounded, ranked

#: Bits of each dimension's cell number.
BITS = 6
#: Distinct strings of one stretch of the running count.
RUN_ROWS = 100_000


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of points [point, dimension] with ``bits`` bits each.

    The well-known transposed form: undo the excess rotations from the highest bit down, Gray-code
    the result, then interleave the bits of the dimensions."""
    x = [cells[:, d].astype(np.int64).copy() for d in range(cells.shape[1])]
    dims = len(x)
    high = 1 << (bits - 1)
    q = high
    while q > 1:
        low = q - 1
        for d in range(dims):
            on = (x[d] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] = x[d] ^ swap
        q >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    q = high
    while q > 1:
        flip = np.where((x[dims - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << 1) | (((x[d] ^ flip) >> bit) & 1)
    return out


def string_bounds(values: DataFrame, cells: int) -> list[str]:
    """The strings at the ``cells`` - 1 quantiles of the column ``value``, nulls left out (a count of each distinct value,
    then their running count over range partitions)."""
    counts = cut(values.where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n")))
    placed = cut(ranked(counts, ["value"]))
    part = F.floor(F.col("place") / RUN_ROWS).cast("long")
    sums = placed.groupBy(part.alias("part")).agg(F.sum("n").alias("all"))
    before = F.sum("all").over(Window.orderBy("part")) - F.col("all")  # one row for every RUN_ROWS distinct values
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("place")) + F.col("before")
    run = placed.withColumn("part", part).join(sums.select("part", before.alias("before")), "part").withColumn("upto", upto)
    total = counts.agg(F.sum("n")).first()[0] or 0
    reached = lambda c: F.floor(c * cells / F.lit(max(total, 1)))
    crossing = run.withColumn("last", F.least(reached(F.col("upto")), F.lit(cells - 1))) \
        .withColumn("first", reached(F.col("upto") - F.col("n"))).where(F.col("last") > F.col("first"))
    found = crossing.orderBy("place").select("value", "first", "last").collect()  # cells - 1 rows at most
    return [v for v, first, last in found for _ in range(first, last)]


def string_cell(value: Column, bounds: list[str]) -> Column:
    """How many of the sorted ``bounds`` lie below the string; 0 for null."""
    if not bounds:
        return F.lit(0).cast("long")
    below = F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: b < value)
    return F.coalesce(F.when(value.isNotNull(), F.size(below)), F.lit(0)).cast("long")


def by_group(rows: DataFrame) -> DataFrame:
    """``rows`` with the least curve position of all rows of the same text (``size``, ``text_crc32``, ``text_hash``)."""
    key = ["size", "text_crc32", "text_hash"]
    first = rows.groupBy(*key).agg(F.min("curve").alias("least"), F.max("curve").alias("most"))
    apart = cut(first.where("least <> most").select(*key, "least"))  # groups with one position need no other
    joined = join_bounded(rows, apart, key, "left")
    return joined.withColumn("curve", F.coalesce("least", "curve")).drop("least")


def ordered(docs: DataFrame, dimensions: list[Column], carry: list[str], bits: int = BITS) -> DataFrame:
    """``row struct<carry>, doc_id, size, text_crc32, curve, place`` for every row of ``docs``:
    ``place`` is the row's rank along the curve, from 0."""
    text = F.col("text").cast("string")
    held = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row") if carry else F.lit(None).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"), *(d.alias(f"d{i}") for i, d in enumerate(dimensions)))
    names = [f"d{i}" for i in range(len(dimensions))]
    strings = [n for n in names if held.schema[n].dataType.simpleString() == "string"]
    numbers = [n for n in names if n not in strings]
    steps = [k / (1 << bits) for k in range(1, 1 << bits)]
    base = held.withColumns({n: F.coalesce(F.col(n).cast("long"), F.lit(-1)) for n in numbers} | {
        n: string_cell(F.col(n), string_bounds(held.select(F.col(n).alias("value")), 1 << bits)) for n in strings})
    found = base.agg(*(F.percentile_approx(n, steps, 10_000).alias(n) for n in numbers)).first() if numbers else {}
    bounds = {n: np.array(found[n] or [0], dtype=np.int64) for n in numbers}  # 2**bits - 1 numbers each

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names}
            cells = np.stack([np.searchsorted(bounds[n], at[n], side="left") if n in bounds else at[n] for n in names], axis=1)
            kept = [c for c in batch.schema.names if c not in names]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in kept),
                 pa.array(hilbert_index(cells, bits), pa.int64())], names=[*kept, "curve"])

    schema = base.drop(*names).schema.add("curve", "long")
    order = ["curve", "text_crc32", "text_hash", "doc_id"]
    rows = by_group(base.mapInArrow(place, schema)).repartitionByRange(*order).sortWithinPartitions(*order)
    # The id holds the partition above bit 33 and the place in it below.
    rows = cut(rows.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = rows.groupBy(part.alias("part")).count().orderBy("part").collect()  # one row per partition
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total, 0))
        total += n
    starts = [(p, start, total) for p, start, _ in starts]
    first = docs.sparkSession.createDataFrame(starts, "part long, start long, total long")
    return (rows.withColumn("part", part).join(F.broadcast(first), "part")
            .withColumn("place", F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1))
            .drop("part", "start", "at"))


def dealt(rows: DataFrame, shards: int) -> DataFrame:
    """Runs of the curve: ``shard`` and ``slot`` from ``place`` and ``total``."""
    shard = F.expr(f"place * {shards}L div total")
    start = F.expr(f"(shard * total + {shards - 1}L) div {shards}L")
    return (rows.withColumn("shard", shard).withColumn("slot", F.col("place") - start)
            .withColumn("shard", F.col("shard").cast("int")))


def metadata_dimensions() -> list[Column]:
    """Size, language and source of a document."""
    return [F.octet_length(F.col("text").cast("string")), F.col("lang").cast("string"), F.col("source").cast("string")]


def assign(docs: DataFrame, shards: int = 16, dimensions: list[Column] | None = None) -> DataFrame:
    """The shard and slot of every row, without its text."""
    rows = ordered(docs, dimensions or metadata_dimensions(), [])
    return dealt(rows, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, path: str, shards: int = 16, dimensions: list[Column] | None = None) -> None:
    """Write whole rows of ``docs``, in curve order, one folder ``_shard=n`` per shard."""
    rows = dealt(ordered(docs, dimensions or metadata_dimensions(), docs.columns), shards)
    (rows.select(F.col("shard").alias("_shard"), "slot", "row")
     .repartitionByRange("_shard", "slot").sortWithinPartitions("_shard", "slot")
     .write.partitionBy("_shard").parquet(path))
