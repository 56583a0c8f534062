"""Exact top-k inner-product search by three-phase uniform thresholds.

The dimensions are cut into ``BLOCKS`` blocks; a candidate's score for a query is the
sum of its block scores, so each block holds one score list per query.

1. Every block gives its local best entries of each query. Their full scores are known then,
   and the k-th best of them is a safe cutoff: the k-th best of all rows is no smaller.
2. The cutoffs go back to the lists. A row that reaches a cutoff must reach cutoff / blocks
   in one block at least, whatever the signs; every block collects the entries that do.
   A row's upper bound takes the threshold for blocks that did not collect it; rows whose
   bound misses the cutoff are dropped.
3. The missing block scores of the rows left are resolved, exactly, in integers.

Queries and candidates meet in cells of a grid (a block of queries, a block of candidates), so that
a task holds a bounded part of both whatever their number. Equal vectors have equal scores
and are searched once: a class of them keeps its k + 1 smallest ids, which is all
that can stand in a result, so thousands of copies cost as much as one row.

Edge cases: a null vector, or one with a null or non-finite component, takes no part, nor does a
row without id; vectors of unequal length are filled with zeros; a repeated row counts once;
rows of the query's own id are no candidates for it; ties go to the smaller id; with fewer than k
candidates all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakehealth.llm.common import cut, runs

BLOCKS = 4
#: Queries and candidates of one grid cell.
CELL_QUERIES = 1024
CELL_ROWS = 8192
#: Queries scored at once in a cell.
STEP = 128


def quantised(df: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, vec array<long>`` of the rows that take part."""
    broken = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (df.select(F.col("vec_id").cast("long").alias("vec_id"),
                      F.col("embedding").cast("array<double>").alias("e"))
            .where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & ~broken)
            .select("vec_id", F.transform("e", lambda x: F.floor(x * scale)).alias("vec")))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors as rows of a matrix, filled up with zeros."""
    column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


class Cell:
    """The queries and candidates of one grid cell."""

    def __init__(self, rows: pa.Table):
        side = rows["side"].to_numpy()
        split = int(np.searchsorted(side, 1))
        lengths = rows["vec"].combine_chunks().value_lengths().to_numpy()
        width = int(lengths.max(initial=1)) or 1
        vectors = matrix(rows["vec"], width)
        top = float(np.abs(vectors).max(initial=0))
        if top * top * width < 2.0 ** 52:  # sums of products are exact in doubles
            vectors = vectors.astype(np.float64)
        self.queries, self.rows = vectors[:split], vectors[split:]
        ids, single = rows["cid"].to_numpy(), rows["single"].to_numpy(zero_copy_only=False)
        self.query_ids, self.row_ids = ids[:split], ids[split:]
        self.single = single[split:]  # classes of one id: no candidates for their own query
        self.cutoff = rows["cutoff"].to_pylist()[:split]
        self.blocks = [b for b in np.array_split(np.arange(width), BLOCKS) if len(b)]

    def steps(self) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
        """(first query, block scores [query, row] of every block, barred entries)."""
        for a in range(0, len(self.queries), STEP):
            some = self.queries[a:a + STEP]
            scores = [some[:, b] @ self.rows[:, b].T for b in self.blocks]
            own = (self.query_ids[a:a + STEP, None] == self.row_ids) & self.single
            yield a, scores, own


def first_phase(cell: Cell, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The k best of the entries that are in some block's list of k best, with full scores."""
    for a, scores, own in cell.steps():
        total = sum(scores)
        total = np.where(own, -np.inf, total.astype(np.float64))
        n = min(k, total.shape[1])
        if not n:
            continue
        found = [np.argpartition(np.where(own, -np.inf, s), -n, axis=1)[:, -n:] for s in scores]
        listed = np.sort(np.concatenate(found, axis=1), axis=1)
        value = np.take_along_axis(total, listed, axis=1)
        value[:, 1:][listed[:, 1:] == listed[:, :-1]] = -np.inf
        best = np.argsort(-value, axis=1, kind="stable")[:, :n]
        value = np.take_along_axis(value, best, axis=1)
        q = np.broadcast_to(cell.query_ids[a:a + STEP, None], value.shape)
        keep = np.isfinite(value)
        yield q[keep], value[keep].astype(np.int64)


def later_phases(cell: Cell) -> Iterator[tuple[np.ndarray, ...]]:
    """Entries that reach their query's cutoff, with exact scores."""
    for a, scores, own in cell.steps():
        m = len(scores)
        given = cell.cutoff[a:a + STEP]
        cutoff = np.array([np.iinfo(np.int64).min >> 8 if c is None else c for c in given])[:, None]
        least = -(-cutoff // m)  # the smallest integer that reaches cutoff / blocks
        bound = np.zeros(own.shape)
        some = np.zeros(own.shape, dtype=bool)
        for s in scores:
            reached = s >= least
            some |= reached
            bound += np.where(reached, s, least - 1)
        q, r = np.nonzero(some & (bound >= cutoff) & ~own)
        exact = sum(s[q, r].astype(np.int64) for s in scores)
        keep = exact >= cutoff[q, 0]
        yield cell.query_ids[a + q[keep]], cell.row_ids[r[keep]], exact[keep]


def search(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best candidates of each query row.

    ``vectors``: ``vec_id long, vec array<long>``; ``is_query``: a condition on ``vec_id``."""
    rows = cut(vectors.groupBy("vec", "vec_id").agg(F.lit(1).alias("one")).select("vec_id", "vec"))
    by_vec = Window.partitionBy("vec").orderBy("vec_id")
    classes = cut(rows.withColumn("n", F.row_number().over(by_vec)).where(F.col("n") <= k + 1)
                  .groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
                  .select(F.col("ids")[0].alias("cid"), "vec", "ids", (F.size("ids") == 1).alias("single")))
    asked = rows.where(is_query)
    wanted = cut(asked.join(classes.select("vec", "cid"), "vec").select(F.col("vec_id").alias("query_id"), "cid"))
    query_classes = cut(wanted.select("cid").distinct().join(classes.select("cid", "vec"), "cid"))
    across = max(1, -(-query_classes.count() // CELL_QUERIES))
    down = max(1, -(-classes.count() // CELL_ROWS))
    cell_of = lambda n: F.pmod(F.xxhash64("cid"), F.lit(n)).cast("int")

    candidates = classes.select(
        F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("g"), cell_of(down).alias("h"),
        F.lit(1).alias("side"), "cid", "single", "vec", F.lit(None).cast("long").alias("cutoff"))

    def cells(cutoffs: DataFrame | None) -> DataFrame:
        asking = query_classes if cutoffs is None else query_classes.join(cutoffs, "cid", "left")
        cutoff = F.lit(None).cast("long") if cutoffs is None else F.col("cutoff")
        asking = asking.select(
            cell_of(across).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("h"),
            F.lit(0).alias("side"), "cid", F.lit(False).alias("single"), "vec", cutoff.alias("cutoff"))
        return asking.unionByName(candidates).repartition(max(across * down, 1), "g", "h") \
            .sortWithinPartitions("g", "h", "side")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["g", "h"]):
            for q, score in first_phase(Cell(group), k):
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(score, pa.int64())],
                                                 names=["cid", "score"])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["g", "h"]):
            for q, c, score in later_phases(Cell(group)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(score, pa.int64())],
                    names=["cid", "other", "score"])

    best = Window.partitionBy("cid").orderBy(F.desc("score"))
    cutoffs = cut(cells(None).mapInArrow(gather, "cid long, score long")
                  .withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)
                  .groupBy("cid").agg(F.when(F.count("*") == k, F.min("score")).alias("cutoff")))
    found = cells(cutoffs).mapInArrow(resolve, "cid long, other long, score long")
    # Copies of a candidate share its score: of the classes that reach the cutoff the k + 1 first suffice.
    first = Window.partitionBy("cid").orderBy(F.desc("score"), "other")
    found = cut(found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).drop("n"))
    hits = (found.join(classes.select(F.col("cid").alias("other"), "ids"), "other")
            .select("cid", "score", F.explode("ids").alias("vec_id")))
    # Of a query class's entries the k + 1 first hold the k first of each of its queries.
    among = Window.partitionBy("cid").orderBy(F.desc("score"), "vec_id")
    hits = hits.withColumn("n", F.row_number().over(among)).where(F.col("n") <= k + 1).drop("n")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (wanted.join(hits, "cid").where(F.col("query_id") != F.col("vec_id"))
            .withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
