"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

An item contaminates a document if some run of the document's words is within ``edits(n)`` word edits
(insertions, deletions, substitutions) of the item's n words.

* Windows of an item's size are taken at every word of a document, except where the q-gram lemma proves
  that no match can lie: a match shares at least n - q + 1 - q * edits q-grams with its item. Common
  documents are settled by this count alone, without loss.
* Every window left is mapped by random walks: at step j the walk writes the word it stands on and
  moves on by a random bit of (j, word). Words edited in or out put two walks out of step only until
  they meet again, so edit distance becomes Hamming distance. ``SAMPLE`` random steps of a walk make
  an LSH key; walks are repeated until a match at the edit bound is found with chance ``RECALL``,
  measured on randomly edited items of each size. Long items (a few hundred words) have so many edits
  that ``MOST_WALKS`` walks do not reach it: for these sizes every window left is verified, without loss.
* Windows whose key equals one of an item's are verified by the exact edit distance (item against
  any run of words around the window).

The items are read in chunks of bounded size, one pass over the documents each, so the index a task
holds stays bounded for any benchmark.

Edge cases: null or wordless items and texts match nothing; items of one or two words must
occur exactly; repeated items are reported under each id, a repeated item row once; repeated documents are
reported per row; null ids are reported as null; other columns pass through ``clean`` untouched.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakehealth.llm.common import rows_of
from lakehealth.llm.words import MIX, mix, words

#: Share of an item's words that may be edited.
EDIT_SHARE = 0.15
#: Words of a q-gram.
GRAM = 3
#: Steps sampled per key, wanted recall, and most repetitions.
SAMPLE = 3
RECALL = 0.99
MOST_WALKS = 64
#: Bytes of item text one pass may hold.
CHUNK_BYTES = 4 << 20
HIT = "doc_id long, item_id long, first_word long, end_word long, edits int"


def edits(n: int) -> int:
    return int(EDIT_SHARE * n)


def best_run(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the run of ``text`` nearest to ``item``; the first of equals."""
    m = len(text)
    steps = np.arange(m + 1)
    cost, start = np.zeros(m + 1, dtype=np.int64), steps.copy()
    for i, word in enumerate(item, 1):
        over = np.empty(m + 1, dtype=np.int64)
        origin = np.empty(m + 1, dtype=np.int64)
        over[0], origin[0] = i, 0
        diagonal = cost[:-1] + (text != word)
        up = cost[1:] + 1
        over[1:] = np.minimum(diagonal, up)
        origin[1:] = np.where(diagonal <= up, start[:-1], start[1:])
        # A deletion from the text costs one per word: a running minimum of cost - position.
        key = over - steps
        best = np.minimum.accumulate(key)
        last = np.maximum.accumulate(np.where(key == best, steps, 0))
        cost, start = best + steps, origin[last]
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end


class Walks:
    """The random walks of windows of n words."""

    def __init__(self, n: int, repeats: int):
        rng = np.random.default_rng(1_000_003 * n + 17)
        self.n, self.repeats = n, repeats
        self.length = 2 * n  # a walk passes n words in about 2 n steps
        self.seeds = rng.integers(1, 1 << 62, (MOST_WALKS, 1), dtype=np.uint64)[:repeats]
        self.samples = rng.integers(0, max(self.length - n // 4, 1), (MOST_WALKS, SAMPLE))[:repeats]

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """LSH keys [repetition, window] of windows [window, word]."""
        count = len(windows)
        padded = np.concatenate([windows.astype(np.uint64) + np.uint64(1),
                                 np.zeros((count, 1), dtype=np.uint64)], axis=1)
        at = np.zeros((self.repeats, count), dtype=np.int64)
        key = np.zeros((self.repeats, count), dtype=np.uint64)
        rows = np.arange(count)
        for j in range(int(self.samples.max(initial=0)) + 1):
            word = padded[rows, at]
            taken = (self.samples == j).any(axis=1)
            if taken.any():
                key[taken] = mix(key[taken] * MIX + word[taken] + np.uint64(j + 1))
            bit = (mix(word * MIX + self.seeds + np.uint64(j * 0xD6E8FEB86659FD93 & (1 << 64) - 1)) >> np.uint64(33)) \
                & np.uint64(1)
            at = np.minimum(at + bit.astype(np.int64), self.n)
        return key


def repeats_for(n: int, items: list[np.ndarray], vocabulary: int) -> int | None:
    """Walks needed to find an item at its edit bound with chance RECALL, measured on random edits;
    None where they, with a margin for the small sample, are more than MOST_WALKS."""
    bound = edits(n)
    if not bound:
        return 1  # equal words have equal keys
    rng = np.random.default_rng(7 * n + 1)
    walks = Walks(n, MOST_WALKS)
    plain, changed = [], []
    for trial in range(40):
        item = items[trial % len(items)].tolist()
        other = list(item)
        for _ in range(bound):
            kind, where = rng.integers(3), int(rng.integers(len(other)))
            word = int(rng.integers(vocabulary + 1))
            if kind == 0:
                other[where] = word
            elif kind == 1:
                other.insert(where, word)
            elif len(other) > 1:
                del other[where]
        other = (other + [0] * n)[:n]  # a window of n words that starts with the match
        plain.append(item)
        changed.append(other)
    equal = walks.keys(np.array(plain)) == walks.keys(np.array(changed))
    for repeats in range(1, MOST_WALKS + 1):
        if equal[:repeats].any(axis=0).mean() >= RECALL:
            wanted = repeats + repeats // 2
            return wanted if wanted <= MOST_WALKS else None
    return None


class Index:
    """The items of one pass."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.vocabulary: dict[str, int] = {}
        self.ids: list[int | None] = []
        self.items: list[np.ndarray] = []
        for item_id, text in items:
            found = words(text)
            if found:
                self.ids.append(item_id)
                self.items.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found]))
        self.size = len(self.vocabulary) + 1
        by_gram: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.need = []  # q-grams a match shares with its item at least
        by_length = defaultdict(list)
        for k, item in enumerate(self.items):
            n = len(item)
            q = min(GRAM, n)
            self.need.append(max(1, n - q + 1 - q * edits(n)))
            for gram in set(self.grams(item, q).tolist()):
                by_gram[q][gram].append(k)
            by_length[n].append(k)
        self.by_gram = {q: (np.array(sorted(table)), [table[g] for g in sorted(table)]) for q, table in by_gram.items()}
        self.walks: dict[int, Walks] = {}  # of the sizes that walks find
        self.keys: dict[int, np.ndarray] = {}  # item -> its key in every repetition
        for n, members in sorted(by_length.items()):
            own = [self.items[k] for k in members]
            repeats = repeats_for(n, own, len(self.vocabulary))
            if repeats is None:
                continue
            walks = self.walks[n] = Walks(n, repeats)
            self.keys.update(zip(members, walks.keys(np.array(own)).T))

    def grams(self, ids: np.ndarray, q: int) -> np.ndarray:
        """Numbers of the q-grams; -1 where a word is in no item."""
        out = ids[:len(ids) - q + 1].astype(np.int64)
        known = out > 0
        for j in range(1, q):
            more = ids[j:len(ids) - q + 1 + j]
            out = out * self.size + more
            known &= more > 0
        return np.where(known, out, -1)

    def match(self, text: str | None) -> list[tuple[int | None, int, int, int]]:
        """(item id, first word, end word, edits) of every item that contaminates the text."""
        found = words(text)
        if not found:
            return []
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in found), np.int64, len(found))
        hits = []
        for q, (grams, members) in self.by_gram.items():
            if len(ids) < q:
                continue
            here = self.grams(ids, q)
            places = np.flatnonzero(here >= 0)
            if not len(places):
                continue
            slot = np.minimum(np.searchsorted(grams, here[places]), len(grams) - 1)
            same = grams[slot] == here[places]
            places, slot = places[same], slot[same]
            own: dict[int, list[int]] = defaultdict(list)
            for p, s in zip(places.tolist(), slot.tolist()):
                for k in members[s]:
                    own[k].append(p)
            for k, at in own.items():
                if len(at) >= self.need[k]:
                    hit = self.look(k, np.array(at), ids)
                    if hit:
                        hits.append((self.ids[k], *hit))
        return hits

    def look(self, k: int, at: np.ndarray, ids: np.ndarray) -> tuple[int, int, int] | None:
        """The best match of item k among the windows its q-grams at ``at`` allow."""
        item, need = self.items[k], self.need[k]
        n, bound = len(item), edits(len(item))
        # A match spans n + bound words at most and holds `need` of the places.
        spans = at[need - 1:] - at[:len(at) - need + 1]
        good = np.flatnonzero(spans <= n + bound - 1)
        if not len(good):
            return None
        starts = [range(max(0, int(at[g + need - 1]) - n - bound), int(at[g]) + 1) for g in good.tolist()]
        places = np.unique(np.fromiter(chain.from_iterable(starts), np.int64))
        padded = np.concatenate([ids, np.zeros(n, dtype=np.int64)])
        best = None
        held: list[int] = [] if n in self.walks else places.tolist()
        for a in range(0, len(places) if n in self.walks else 0, 2048):
            some = places[a:a + 2048]
            keys = self.walks[n].keys(padded[some[:, None] + np.arange(n)])
            held += some[(keys == self.keys[k][:, None]).any(axis=0)].tolist()
        while held:
            first = last = held.pop(0)
            while held and held[0] <= last + n:
                last = held.pop(0)
            low = max(0, first - bound)
            cost, start, end = best_run(item, ids[low:last + n + bound])
            if cost <= bound and (best is None or cost < best[2]):
                best = (low + start, low + end, cost)
        return best


def chunks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items, at most about CHUNK_BYTES of text at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")) \
        .where("text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-int(total) // CHUNK_BYTES))
    for c in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == c).dropDuplicates()
        yield sorted(((r[0], r[1]) for r in mine.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row and item that contaminates it: words [first_word, end_word)."""
    spark = docs.sparkSession
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in chunks(benchmark):
        shared = spark.sparkContext.broadcast(items)  # at most about CHUNK_BYTES

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value)
            for part in rows_of(batches):
                rows = [(d, *hit) for d, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist())
                        for hit in index.match(text)]
                if rows:
                    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                                     names=["doc_id", "item_id", "first_word", "end_word", "edits"])

        hits = picked.mapInArrow(run, HIT)
        out = hits if out is None else out.unionByName(hits)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns."""
    spark, at = docs.sparkSession, docs.columns.index("text")
    for items in chunks(benchmark):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value)
            for part in rows_of(batches):
                keep = [not index.match(text) for text in part.column(at).cast(pa.string()).to_pylist()]
                yield part.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
