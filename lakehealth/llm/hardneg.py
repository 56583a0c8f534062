"""Hard negatives by exact integer scores from a residue number system.

Scores are integer inner products. They are computed as float32 matrix products, which are fast but exact only
below 2 ** 24, by working modulo several small primes: the component matrices are reduced modulo each prime (to
residues around zero, so that a product of two is below a quarter of its square), multiplied in
runs of dimensions short enough to stay exact, and reduced again. The residues of a score under all primes determine
it, by Chinese remaindering, if the product of the primes exceeds the range of scores; that range
follows from the lengths of the vectors at hand (Cauchy-Schwarz), and as many primes are taken as it needs. A
shift by the range makes the reconstructed number non-negative, so signs come out right.

1. Every anchor meets the rows of its own label; its positives are the best of them.
2. Each positive opens a window of scores, from 30 to 90 % of its own. Every anchor meets all rows,
   and of those with another label the best in each window are its negatives.

Anchors and rows meet in cells of bounded size: a block of anchors and a block of rows. Blocks come from hashes of
row numbers, so labels, copies and ids of any frequency spread evenly; a label that a third of all rows carry
only means more blocks. A cell hands on at most the wanted number per anchor (and window); Spark keeps the best of those, first
within a task, then per anchor.

Edge cases: rows with a null id or label, a null vector or a null or non-finite component take no part; vectors of
unequal length are filled up with zeros; a row with the anchor's own id is never its positive or negative;
repeated rows count each time; ties go to the smaller id; a negative positive score has an empty window; a window with
fewer rows gives those it has; an anchor without positives gives none; scores are exact as far as a long holds them; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakehealth.llm.common import cut, runs

#: Primes in the order they are taken.
PRIMES = [251, 241, 239, 233, 229, 227, 223, 211, 199, 197, 193, 191, 181, 179, 173, 167, 163, 157, 151, 149]
#: Anchors and rows of one cell.
CELL_ANCHORS = 1024
CELL_ROWS = 8192
#: Row blocks that one task goes through for a block of anchors, at most.
STRIP = 16
#: Anchors scored at once in a cell.
STEP = 128
SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these percentages of the positive's.
LOW, HIGH = 30, 90
#: No score: the smallest long.
NONE = np.iinfo(np.int64).min


def score_range(a: np.ndarray, b: np.ndarray) -> int:
    """A bound no inner product of a row of ``a`` and one of ``b`` exceeds."""
    longest = [float(np.sqrt(np.square(m.astype(np.float64)).sum(axis=1).max(initial=0.0))) for m in (a, b)]
    return int(longest[0] * longest[1] * (1 + 1e-9)) + 1


def primes_for(bound: int) -> list[int]:
    """The first primes whose product exceeds the number of scores from -bound to bound."""
    product, taken = 1, []
    for p in PRIMES:
        if product > 2 * bound:
            break
        product, taken = product * p, [*taken, p]
    if product <= 2 * bound:
        raise ValueError("scores far beyond a long")
    return taken


def residues(m: np.ndarray, p: int) -> np.ndarray:
    """``m`` modulo ``p``, around zero, in float32."""
    r = np.mod(m, p)
    return (r - p * (r > p // 2)).astype(np.float32)


def product_mod(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """``a @ b.T`` modulo ``p`` (0 to p - 1) for residue matrices, exact: dimensions in runs of a safe length."""
    half = p // 2
    run = (1 << 24) // (half * half)
    total = np.zeros((len(a), len(b)), dtype=np.int64)
    for d in range(0, a.shape[1], run):
        total += (a[:, d:d + run] @ b[:, d:d + run].T).astype(np.int64)
    return np.mod(total, p)


def remaindered(parts: list[np.ndarray], primes: list[int], bound: int) -> np.ndarray:
    """The signed numbers in [-bound, bound] with these residues: mixed-radix digits of the number plus ``bound``."""
    digits: list[np.ndarray] = []
    for part, p in zip(parts, primes):
        value = np.mod(part + bound % p, p)
        radix = 1
        for digit, q in zip(digits, primes):
            value = np.mod(value - digit * radix, p)
            radix = radix * q % p
        digits.append(np.mod(value * pow(radix, -1, p), p))
    # Sums wrap at 2 ** 64, which is right for every result that fits a long.
    total, radix = np.zeros(parts[0].shape, dtype=np.uint64), 1
    for digit, p in zip(digits, primes):
        total += digit.astype(np.uint64) * np.uint64(radix % (1 << 64))
        radix *= p
    return (total - np.uint64(bound % (1 << 64))).astype(np.int64)


class Scores:
    """Exact inner products of anchors and rows, a few anchors at a time."""

    def __init__(self, anchors: np.ndarray, rows: np.ndarray):
        self.bound = score_range(anchors, rows)
        self.primes = primes_for(self.bound)
        self.anchors = [residues(anchors, p) for p in self.primes]
        self.rows = [residues(rows, p) for p in self.primes]
        self.count = len(anchors)

    def steps(self) -> Iterator[tuple[slice, np.ndarray]]:
        for start in range(0, self.count, STEP):
            some = slice(start, start + STEP)
            parts = [product_mod(a[some], r, p) for a, r, p in zip(self.anchors, self.rows, self.primes)]
            yield some, remaindered(parts, self.primes, self.bound)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` best entries of each row of ``scores``, ties to the smaller id; ``NONE`` is no entry."""
    width = scores.shape[1]
    if width > k:
        least = np.partition(scores, width - k, axis=1)[:, width - k]
        a, c = np.nonzero((scores >= least[:, None]) & (scores != NONE))
    else:
        a, c = np.nonzero(scores != NONE)
    order = np.lexsort((ids[c], -scores[a, c], a))
    a, c = a[order], c[order]
    first = np.searchsorted(a, a, side="left")
    kept = np.arange(len(a)) - first < k
    return a[kept], c[kept]


def vectors_of(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors as rows of a matrix, filled up with zeros."""
    column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    width = int(lengths.max(initial=1)) or 1
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy()
    return out


class Cell:
    """The anchors (side 0) and rows (side 1) of one cell."""

    def __init__(self, rows: pa.Table):
        split = int(np.searchsorted(rows["side"].to_numpy(), 1))
        vectors = vectors_of(rows["vec"])
        self.key, self.id, self.label = (rows[c].to_numpy() for c in ("rid", "vec_id", "label"))
        self.anchors, self.rows = slice(0, split), slice(split, None)
        self.scores = Scores(vectors[self.anchors], vectors[self.rows])
        self.windows = rows["windows"].to_pylist()[:split] if "windows" in rows.column_names else []

    def steps(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(anchors, scores, rows of the anchor's own label); an anchor's own id has no score."""
        for some, scores in self.scores.steps():
            own = self.id[self.anchors][some, None] == self.id[self.rows]
            scores[own] = NONE
            yield some, scores, self.label[self.anchors][some, None] == self.label[self.rows]


def prepared(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """``rid, vec_id, label, vec array<long>`` of the rows that take part."""
    broken = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                      F.col("embedding").cast("array<double>").alias("e"))
            .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & ~broken))
    return cut(rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label",
                           F.transform("e", lambda x: F.floor(x * scale)).alias("vec")))


def cells(anchors: DataFrame, rows: DataFrame, keys: list[str], count: int) -> DataFrame:
    """Both sides of ``count`` cells, spread over partitions by block of anchors and strip of row blocks, sorted cell by
    cell. A strip is as long as leaves every task one, so that a block's best rows meet early where there are many."""
    tasks = 16 * rows.sparkSession.sparkContext.defaultParallelism
    strip = F.floor(F.col("down") / max(1, min(STRIP, count // tasks)))
    both = anchors.withColumn("side", F.lit(0)).unionByName(rows.withColumn("side", F.lit(1)), allowMissingColumns=True)
    return both.repartition(tasks, *keys, "across", strip).sortWithinPartitions(*keys, "across", "down", "side", "vec_id")


def block(n: Column) -> Column:
    return F.pmod(F.xxhash64("rid"), n).cast("int")


def every(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))


def blocks(rows: Column, size: int) -> Column:
    return F.greatest(F.ceil(rows / size), F.lit(1)).cast("int")


def positives(anchors: DataFrame, rows: DataFrame, k: int = POSITIVES) -> DataFrame:
    """``rid, positive_id, positive_score, n``: the ``k`` best rows of each anchor's own label."""
    sizes = cut(rows.groupBy("label").agg(blocks(F.count("*"), CELL_ROWS).alias("n_down"))
                .join(anchors.groupBy("label").agg(blocks(F.count("*"), CELL_ANCHORS).alias("n_across")), "label"))
    asked = anchors.join(sizes, "label").select(
        "label", block(F.col("n_across")).alias("across"), every(F.col("n_down")).alias("down"), "rid", "vec_id", "vec")
    given = rows.join(sizes, "label").select(
        "label", every(F.col("n_across")).alias("across"), block(F.col("n_down")).alias("down"), "rid", "vec_id", "vec")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["label", "across", "down"]):
            cell = Cell(group)
            for some, scores, _ in cell.steps():
                a, c = best(scores, cell.id[cell.rows], k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.key[cell.anchors][some][a]), pa.array(cell.id[cell.rows][c]), pa.array(scores[a, c])],
                    names=["rid", "positive_id", "positive_score"])

    order = Window.partitionBy("rid").orderBy(F.desc("positive_score"), "positive_id")
    count = sizes.agg(F.coalesce(F.sum(F.col("n_down") * F.col("n_across")), F.lit(0))).first()[0]
    found = cells(asked, given, ["label"], count).mapInArrow(score, "rid long, positive_id long, positive_score long")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)


def negatives(anchors: DataFrame, rows: DataFrame, k: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """``rid, window, negative_id, negative_score, rank``: the ``k`` best rows of other labels in each of the anchors'
    ``windows`` (scores of positives, in order)."""
    across = max(1, -(-anchors.count() // CELL_ANCHORS))
    down = max(1, -(-rows.count() // CELL_ROWS))
    asked = anchors.select(block(F.lit(across)).alias("across"), every(F.lit(down)).alias("down"),
                           "rid", "vec_id", "label", "vec", "windows")
    given = rows.select(every(F.lit(across)).alias("across"), block(F.lit(down)).alias("down"),
                        "rid", "vec_id", "label", "vec")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["across", "down"]):
            cell = Cell(group)
            for some, scores, same in cell.steps():
                scores[same] = NONE
                windows = cell.windows[some]
                for w in range(max(map(len, windows), default=0)):
                    at = [i for i, given in enumerate(windows) if w < len(given)]
                    positive = [windows[i][w] for i in at]
                    least = np.array([-(-low * s // 100) for s in positive], dtype=np.int64)[:, None]
                    most = np.array([high * s // 100 for s in positive], dtype=np.int64)[:, None]
                    part = scores[at]
                    a, c = best(np.where((part >= least) & (part <= most), part, NONE), cell.id[cell.rows], k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell.key[cell.anchors][some][at][a]), pa.array(np.full(len(a), w, dtype=np.int32)),
                         pa.array(cell.id[cell.rows][c]), pa.array(part[a, c])],
                        names=["rid", "window", "negative_id", "negative_score"])

    found = cells(asked, given, [], across * down).mapInArrow(score, "rid long, window int, negative_id long, negative_score long")
    order = Window.partitionBy("rid", "window").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, k_positive: int = POSITIVES, k_negative: int = NEGATIVES,
         low: int = LOW, high: int = HIGH) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the ``prepared`` rows."""
    anchors = rows.where(is_anchor)
    pairs = cut(positives(anchors, rows, k_positive))
    opened = pairs.groupBy("rid").agg(  # at most k_positive a row
        F.transform(F.sort_array(F.collect_list(F.struct("n", "positive_score"))), lambda x: x["positive_score"])
        .alias("windows"))
    asking = cut(anchors.join(opened, "rid"))
    found = negatives(asking, rows, k_negative, low, high).withColumn("n", F.col("window") + 1)
    return (pairs.join(found, ["rid", "n"]).join(asking.select("rid", F.col("vec_id").alias("anchor_id")), "rid")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def shifted_labels(df: DataFrame) -> DataFrame:
    """The label of every seventh id moved to the next of ten."""
    label = F.col("label").cast("long")
    return df.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))


ORACLE_SQL = """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS vec
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    a AS (SELECT row_number() OVER () AS rid, * FROM v WHERE vec_id % 100 = 0),
    s AS (
        SELECT rid, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
               CAST(list_sum(list_transform(list_zip(a.vec, c.vec), lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT) AS score
        FROM a JOIN v c ON c.vec_id <> a.vec_id),
    p AS (
        SELECT rid, anchor_id, vec_id AS positive_id, score AS positive_score,
               row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS n
        FROM s WHERE same QUALIFY n <= 5)
    SELECT p.anchor_id, positive_id,
           CAST(row_number() OVER (PARTITION BY p.rid, n ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s ON s.rid = p.rid AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY rank <= 10"""
