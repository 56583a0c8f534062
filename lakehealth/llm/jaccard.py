"""Jaccard join on word five-grams by a MinHash LSH forest, with exact verification.

A text's features are its sets of five consecutive words. Its label in each of ``TREES`` trees is the
sequence of ``DEPTH`` min-hashes of them, two bytes each. All labels of a tree are sorted (one range
partitioning for all trees, which splits a label of any number of texts), so that a node of
depth d of its prefix trie is a run of rows that agree in d min-hashes. One walk finds for each row how
long a prefix it shares with the row before, and ties it to the first row of the run of that
depth: one edge a row, and the edges of level d or more join just the nodes of depth d.

Texts that share a whole label are candidates first. Then prefixes are shortened, a min-hash at a time, until the
target recall is reached (``reached``): the similarity of the pairs tied so far is estimated from
all their min-hashes, each counts for those of its kind that its depth missed, and every band of
similarity that occurs must have ``RECALL`` of its pairs. Where too few pairs are known to tell, the
threshold itself decides, so the depth that finds a pair at the threshold with that chance is always enough.

Candidates are verified exactly, on whole feature sets. Nodes that share members are joined to
candidate groups (connected components of one edge a row, ``stars``), so that each text meets its candidates once and not
once per tree. A group of any size is dealt into blocks of bounded weight, and a task compares one
pair of blocks; it returns link counts and a spanning forest of the links it found, never the
pairs. So a group of copies costs its comparisons, but no more rows than it has members.
A text is fetched by an id and a digest of the whole text, so rows without an id meet only their own text.

Texts with equal words are one class from the start: copies are counted, not compared.

Edge cases: null and wordless texts are in no group and have no links; a text of fewer
than five words is one feature, all its words; class ids are the smallest id of the group (null
ids first); repeated rows are copies of each other; other columns pass through ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from lakehealth.llm.common import cut, join_bounded, rows_of, runs
from lakehealth.llm.graph import components
from lakehealth.llm.words import MIX, WordHash, mix, shingles, words

THRESHOLD = 0.8
TREES = 16
DEPTH = 8
RECALL = 0.99
#: Bands of similarity from the threshold to 1 whose recall is measured apart.
BANDS = 4
#: Pairs at the threshold that may exist where none is seen (the rule of three, at 95 %).
UNSEEN = 3
#: Texts and features of a block; two blocks meet in one task.
BLOCK_ROWS = 128
BLOCK_FEATURES = 400_000
#: Features compared at once as a dense matrix.
STEP = 4096


def prefix_depth(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair of that similarity is found with the wanted chance."""
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < recall:
        depth -= 1
    return depth


def digest(found: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(found))


def labels(sets: list[np.ndarray], trees: int = TREES, depth: int = DEPTH) -> np.ndarray:
    """The min-hashes [text, tree, level] of non-empty feature sets, big-endian so that bytes sort as numbers."""
    rng = np.random.default_rng(20_240_917)
    factor = rng.integers(1 << 31, 1 << 32, (trees, depth), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    offset = rng.integers(0, 1 << 32, (trees, depth), dtype=np.uint64).astype(np.uint32)
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), trees, depth), dtype=">u2")
    buffer = np.empty_like(flat)
    for t in range(trees):
        for d in range(depth):
            np.multiply(flat, factor[t, d], out=buffer)
            np.add(buffer, offset[t, d], out=buffer)
            out[:, t, d] = mix(np.minimum.reduceat(buffer, starts).astype(np.uint64)) & np.uint64(0xFFFF)
    return out


def marks(docs: DataFrame) -> DataFrame:
    """``doc_id, mark`` (of the text)``, key`` (of the words; null without any), number of features and labels per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = WordHash().of
        for part in rows_of(batches):
            keys, sets = [], []
            for text in part.column(2).to_pylist():
                found = words(text)
                keys.append(digest(found) if found else None)
                sets.append(shingles(of(found)))
            full = [s for s in sets if len(s)]
            made = iter(labels(full) if full else ())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([next(made).tobytes() if len(s) else None for s in sets], pa.binary())],
                names=["doc_id", "mark", "key", "n", "labels"])

    return marked(docs).mapInArrow(run, "doc_id long, mark long, key binary, n long, labels binary")


def marked(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, text``: an id (or none) and a digest of the text say where a text may be found."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def fixed_width(column: pa.Array, width: int) -> np.ndarray:
    """Byte strings of one width as the rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), width)


def trie_edges(least: int, depth: int = DEPTH):
    """A walk over rows ``tree, label, key`` in sorted order. Every row that shares ``least`` min-hashes or more with
    the row before gives ``a, b, level``: the first row of its run of that depth, itself, the depth. The
    first and the last row come out once more with their label, for the walk over what partitions cut apart."""

    def ends(rows: pa.RecordBatch) -> pa.RecordBatch:
        none = pa.nulls(rows.num_rows)
        return pa.RecordBatch.from_arrays(
            [none.cast(pa.binary()), rows.column("key"), none.cast(pa.int32()), rows.column("tree"), rows.column("label")],
            names=["a", "b", "level", "tree", "label"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the last row so far, and the first rows of its runs by depth
        hubs: dict[int, bytes] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            trees = batch.column("tree").to_numpy()
            path = fixed_width(batch.column("label"), 2 * depth).view(">u2")
            keys = batch.column("key").to_pylist()
            if before is None:
                yield ends(batch.slice(0, 1))
                last_tree, last_path = np.array([-1]), path[:1]
            else:
                last_tree, last_path = before
            same = path == np.concatenate([last_path, path[:-1]])
            level = np.logical_and.accumulate(same, axis=1).sum(axis=1)
            level[trees != np.concatenate([last_tree, trees[:-1]])] = 0
            hub: list[bytes | None] = [None] * len(keys)
            rows = np.arange(len(keys))
            for d in range(least, depth + 1):
                first = np.maximum.accumulate(np.where(level < d, rows, -1))
                for at in np.flatnonzero(level == d).tolist():
                    hub[at] = keys[first[at]] if first[at] >= 0 else hubs[d]
                if first[-1] >= 0:
                    hubs[d] = keys[first[-1]]
            tied = np.flatnonzero(level >= least)
            yield pa.RecordBatch.from_arrays(
                [pa.array([hub[k] for k in tied.tolist()], pa.binary()), batch.column("key").take(pa.array(tied)),
                 pa.array(level[tied], pa.int32()), pa.nulls(len(tied), pa.int32()), pa.nulls(len(tied), pa.binary())],
                names=["a", "b", "level", "tree", "label"])
            before, held = (trees[-1:], path[-1:]), batch.slice(batch.num_rows - 1, 1)
        if before is not None:
            yield ends(held)

    return walk


def forest(texts: DataFrame, least: int, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """``a, b, level`` (cut): texts tied in the tries of all trees, with the longest prefix they are tied by."""
    label = F.expr(f"transform(sequence(0, {trees - 1}), t -> substring(labels, {2 * depth} * t + 1, {2 * depth}))")
    order = ["tree", "label", "key"]
    rows = texts.select("key", F.posexplode(label).alias("tree", "label")) \
        .repartitionByRange(*order).sortWithinPartitions(*order)
    kind = "a binary, b binary, level int, tree int, label binary"
    walked = cut(rows.mapInArrow(trie_edges(least, depth), kind))
    # Two rows a partition; where the order goes on in the next one, they are neighbours.
    seams = walked.where("label IS NOT NULL").select("tree", "label", F.col("b").alias("key")) \
        .coalesce(1).sortWithinPartitions(*order).mapInArrow(trie_edges(least, depth), kind)
    tied = walked.where("label IS NULL").unionByName(seams.where("label IS NULL")).where("a != b")
    # A pair tied both ways stays once, under one of its rows, so that a row has one hub a tree at most (and one a seam).
    return cut(tied.groupBy(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b"))
               .agg(F.max("level").alias("level"), F.min(F.struct("a", "b")).alias("tie")).select("tie.a", "tie.b", "level"))


def stars(edges: DataFrame) -> DataFrame:
    """``a, b`` that join the same nodes as ``edges`` of ``forest``: each row is tied to the least of its hubs alone, and
    its other hubs to that one. Rows of a group share their hubs, so a group has about one edge a row, not one a row and tree."""
    hubs = edges.groupBy("b").agg(F.sort_array(F.collect_set("a")).alias("hubs"))
    least = F.element_at("hubs", 1)
    others = hubs.where("size(hubs) > 1").select(least.alias("a"), F.explode(F.slice("hubs", 2, TREES * 2)).alias("b"))
    return hubs.select(least.alias("a"), "b").unionByName(others.distinct())


def agreement(edges: DataFrame, texts: DataFrame, trees: int = TREES, depth: int = DEPTH) -> dict[tuple[int, int], int]:
    """Number of tied pairs by (level, equal min-hashes among all): at most (depth + 1) * (trees * depth + 1) counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches):
            left, right = (fixed_width(part.column(c), 2 * trees * depth).view(">u2") for c in ("of_a", "of_b"))
            yield pa.RecordBatch.from_arrays(
                [part.column("level"), pa.array((left == right).sum(axis=1), pa.int32())], names=["level", "equal"])

    pairs = (edges.join(texts.select(F.col("key").alias("a"), F.col("labels").alias("of_a")), "a")
             .join(texts.select(F.col("key").alias("b"), F.col("labels").alias("of_b")), "b")
             .select("level", "of_a", "of_b").mapInArrow(run, "level int, equal int"))
    return {(r.level, r.equal): r["count"] for r in pairs.groupBy("level", "equal").count().collect()}


def chance(similarity: float, depth: int, trees: int = TREES) -> float:
    """That a pair of that similarity shares a prefix of ``depth`` min-hashes in some tree."""
    return 1 - (1 - similarity ** depth) ** trees


def reached(counts: dict[tuple[int, int], int], threshold: float, trees: int = TREES, depth: int = DEPTH,
            recall: float = RECALL) -> int:
    """The depth to which prefixes must be shortened for the target recall.

    A pair tied at a depth stands for 1 / ``chance`` pairs, taken at the lower end of its band of similarity (an
    estimate up to one standard error below the threshold counts as the threshold). Of every band, and of all
    pairs with ``UNSEEN`` unknown ones at the threshold, the share found must be ``recall``."""
    least = prefix_depth(threshold, trees, depth, recall)
    size = trees * depth
    slack = (threshold * (1 - threshold) / size) ** 0.5
    step = (1 - threshold) / BANDS or 1
    for d in range(depth, least, -1):
        bands = dict.fromkeys(range(BANDS), 0)
        for (level, equal), n in counts.items():
            if level >= d and equal / size >= threshold - slack:
                bands[min(BANDS - 1, max(0, int((equal / size - threshold) / step)))] += n
        stand_for = {b: n / chance(threshold + b * step, d, trees) for b, n in bands.items()}
        missed = UNSEEN * (1 - chance(threshold, d, trees))
        if all(n >= recall * stand_for[b] for b, n in bands.items()) \
                and sum(bands.values()) >= recall * (sum(stand_for.values()) + missed):
            return d
    return least


def common_features(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """[i, j]: number of features of a[i] that b[j] has as well."""
    sizes = [len(x) for x in a] + [len(x) for x in b]
    row = np.repeat(np.arange(len(sizes)), sizes)
    _, column, seen = np.unique(np.concatenate([*a, *b]), return_inverse=True, return_counts=True)
    shared = seen[column] > 1
    row, column = row[shared], column[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], np.cumsum(np.diff(column[order], prepend=column[order][:1]) != 0)
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for first in range(0, width, STEP):
        lo, hi = np.searchsorted(column, [first, first + STEP])
        dense = np.zeros((len(sizes), min(STEP, width - first)), dtype=np.float32)
        dense[row[lo:hi], column[lo:hi] - first] = 1
        out += dense[:len(a)] @ dense[len(a):].T
    return out


def compare(group: pa.Table, threshold: float) -> tuple[list[bytes], list[int], list[bytes]]:
    """(keys, links, roots) of one pair of blocks: the copies each text links to, and the smallest
    key of its part of the links found here."""
    i, j = group["i"][0].as_py(), group["j"][0].as_py()
    keys, block = group["key"].to_pylist(), group["block"].to_pylist()
    fresh = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]]  # sorted by key
    keys, block = [keys[k] for k in fresh], [block[k] for k in fresh]
    copies = np.array([group["copies"][k].as_py() for k in fresh], dtype=np.float64)
    sets = [np.frombuffer(group["features"][k].as_py(), dtype=np.uint64) for k in fresh]
    left = [k for k in range(len(keys)) if block[k] == i]
    right = left if i == j else [k for k in range(len(keys)) if block[k] == j]
    links = np.zeros(len(keys))
    root = list(range(len(keys)))
    if left and right:
        both = common_features([sets[k] for k in left], [sets[k] for k in right]).astype(np.float64)
        sizes = np.array([len(s) for s in sets], dtype=np.float64)
        total = sizes[left][:, None] + sizes[right][None, :]
        linked = both * (1 + threshold) >= threshold * total - 1e-9
        if i == j:
            np.fill_diagonal(linked, False)
        links[left] += linked @ copies[right]
        if i != j:
            links[right] += linked.T @ copies[left]

        def top(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for x, y in zip(*(v.tolist() for v in np.nonzero(linked))):
            p, q = top(left[x]), top(right[y])
            if p != q:  # rows are sorted by key, so the smaller place is the smaller key
                root[max(p, q)] = min(p, q)
        root = [top(k) for k in range(len(keys))]
    return keys, links.astype(np.int64).tolist(), [keys[k] for k in root]


def link(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, key, class_id, class_key, n_links`` of every row: the group of texts linked by a
    similarity of ``threshold`` or more (directly or by others), and to how many other
    documents the row itself is linked, copies included."""
    seen = cut(marks(docs))
    texts = cut(seen.where("key IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("nulls"), F.count("*").alias("copies"),
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("place"),
        F.max("n").alias("n"), F.first("labels").alias("labels"))
        .withColumn("doc", F.when(~F.col("nulls"), F.col("least"))).drop("least", "nulls"))
    edges = forest(texts, prefix_depth(threshold))
    edges = edges.where(F.col("level") >= reached(agreement(edges, texts), threshold))
    groups = components(stars(edges)).withColumnRenamed("node", "key").withColumnRenamed("label", "comp")
    members = groups.join(texts.drop("labels"), "key")
    weight = members.groupBy("comp").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_FEATURES)).cast("int").alias("blocks"))
    members = cut(members.join(weight, "comp").select(
        "key", "comp", F.col("place.doc_id").alias("at"), F.col("place.mark").alias("at_mark"), "copies", "blocks",
        F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block")))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = WordHash().of
        for part in rows_of(batches):
            rows = []
            for text, key in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                found = words(text)
                same = bool(found) and digest(found) == key
                rows.append(shingles(of(found)).tobytes() if same else None)
            got = pa.array(rows, pa.binary())
            whole = pa.RecordBatch.from_arrays([*part.columns[1:], got], names=[*part.schema.names[1:], "features"])
            yield whole.filter(got.is_valid())

    # Id and digest say where a text may be; its words say whether it is the one.
    found = (join_bounded(marked(docs), members, F.col("doc_id").eqNullSafe(F.col("at")) & (F.col("mark") == F.col("at_mark")))
             .select("text", "key", "comp", "copies", "blocks", "block")
             .mapInArrow(featured, "key binary, comp binary, copies long, blocks int, block int, features binary"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = (found.withColumn("other", other)
             .select("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                     "key", "block", "blocks", "copies", "features")
             .repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "key"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["comp", "i", "j"]):
            keys, links, roots = compare(group, threshold)
            blocks = [group["blocks"][0].as_py()] * len(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(links, pa.int64()), pa.array(roots, pa.binary()),
                 pa.array(blocks, pa.int32())], names=["key", "links", "root", "blocks"])

    verified = cut(pairs.mapInArrow(verify, "key binary, links long, root binary, blocks int"))
    label = verified.where("blocks = 1").select("key", F.col("root").alias("label"))
    split = verified.where("blocks > 1 AND key != root").select(F.col("key").alias("a"), F.col("root").alias("b"))
    if split.limit(1).count():
        label = label.union(components(split).select(F.col("node").alias("key"), "label"))
    links = verified.groupBy("key").agg(F.sum("links").alias("links"))
    known = cut(texts.drop("labels", "place", "n").join(links, "key", "left").join(label, "key", "left")
                .withColumn("label", F.coalesce("label", "key")))
    first = F.min(F.struct(F.col("doc").isNotNull(), "doc", "key")).alias("first")
    best = known.groupBy("label").agg(first).select(
        "label", F.col("first.doc").alias("class_id"), F.col("first.key").alias("class_key"))
    known = known.join(best, "label").select(
        "key", "class_id", "class_key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return seen.select("doc_id", "key").join(known, "key", "left").select(
        "doc_id", "key", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        "class_key", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


@F.pandas_udf(BinaryType())
def words_key(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([digest(found) if (found := words(t)) else None for t in texts])


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose group has an earlier document; one row of each group stays."""
    linked = cut(link(docs, threshold).where("key IS NOT NULL"))
    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("class_key"))
    many = linked.groupBy(F.col("doc_id").alias("_doc"), F.col("key").alias("_key")).agg(
        F.max(stays).alias("_stays"), F.count("*").alias("_rows"))
    odd = cut(many.where("NOT _stays OR _rows > 1"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = docs.select(row, F.col("doc_id").cast("long").alias("_id"),
                        words_key.asNondeterministic()(F.col("text").cast("string")).alias("_of"))
    same = F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_of") == F.col("_key"))
    once = odd.where("_stays")
    out = join_bounded(keyed, odd, same, "left_anti")
    if once.limit(1).count():
        again = join_bounded(keyed, cut(once), same, "left_semi").dropDuplicates(["_id", "_of"])
        out = out.unionByName(again)
    return out.select("row.*")
