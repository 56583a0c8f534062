"""Quality classifier: document evidence combined with host and path posteriors.

1. A logistic regression over text shape and a word list gives each document's evidence: its log
   odds of being good, less those of the training rows. It is fitted on at most
   ``MAX_LABELLED`` labelled rows (good: quality 1 and not toxic). The word list holds words
   that stand in bad rows far more often than chance allows; near copies among
   the labelled rows are counted once (rows that share a shingle min-hash).
2. Grouped sums over *all* documents give the share of good documents of every host and
   every path (the first path segment below a host). Sparse sites are shrunk: a path's share
   towards its host's, a host's towards the global share, with strengths
   estimated from all groups by the method of moments (empirical Bayes).
3. A document's log odds are its evidence plus those of its path's posterior share; it
   is kept if they are not negative.

Sums are partial per task before they are shuffled, so a host with a third of all rows costs
one row per task.

Edge cases: null and empty texts have the features of an empty text and stay subject to the same
rule, except that without any word there is no evidence (0); a null source is the host ``""``; labels
without a row, null qualities and null ids are ignored, repeated labels count once with
their worst value; without labelled rows of both kinds evidence is 0 and the share 1, so all
is kept; repeated rows are judged alike; other columns pass untouched, and the result columns
``quality_score`` and ``quality_keep`` replace ones of that name.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakehealth.llm.common import BROADCAST_BYTES, cut, rows_of, size_bound
from lakehealth.llm.words import CACHE_WORDS, WordHash, shingles, words

#: Labelled rows the classifier is fitted on, at most (chosen by a hash of the id).
MAX_LABELLED = 20_000
#: Words of the list, at most, and the evidence each needs: rows times the Kullback-Leibler
#: divergence of its share of bad rows from the overall share, and that share itself.
MAX_LIST = 2_000
LIST_EVIDENCE = 12.0
LIST_SHARE = 0.95
#: Lengths of the word beginnings that the list may hold (inflected words share them).
STEMS = (4, 5, 6, 7)
#: Words without findings that are added to every text's shares.
SHRINK = 20
#: Ridge penalty on standardised weights; evidence is cut off at this many log odds.
RIDGE = 1.0
MOST_EVIDENCE = 12.0
FEATURES = 10


def stems(word: str) -> list[str]:
    """What the word list may hold of a word: the word itself and its beginnings."""
    return [word, *(word[:k] + "-" for k in STEMS if k < len(word))]


def telling(found: dict[str, int]) -> frozenset[str]:
    """The list without beginnings that say no more than a longer entry: nearly the same rows."""
    vague = set()
    for entry, rows in found.items():
        word = entry.removesuffix("-")
        vague.update(s for k in STEMS if k < len(word) and rows >= 0.9 * found.get(s := word[:k] + "-", 1 << 62))
    return frozenset(found.keys() - vague)


class Flags(dict):
    """word -> whether it or a beginning of it is in the word list; kept for words seen before."""

    def __init__(self, word_list: frozenset[str]):
        super().__init__()
        self.word_list = word_list

    def __missing__(self, word: str) -> bool:
        if len(self) >= CACHE_WORDS // 2:
            self.clear()
        value = self[word] = not self.word_list.isdisjoint(stems(word))
        return value


def shape(text: str | None, flags: Flags) -> list[float]:
    """The features of a text."""
    found = words(text)
    n = len(found)
    if not n:
        return [0.0] * FEATURES
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    visible = int((codes > 32).sum())
    upper = int((((codes >= 65) & (codes <= 90)) | ((codes >= 192) & (codes <= 222))).sum())
    digits = int(((codes >= 48) & (codes <= 57)).sum())
    in_words = sum(map(len, found))
    lines = text.split("\n")
    # A few extra words, characters and lines without findings keep short texts near the middle.
    most, room = n + SHRINK, visible + 5 * SHRINK
    hits = sum(map(flags.__getitem__, found)) if flags.word_list else 0
    return [
        float(np.log1p(n)),
        max(visible - in_words, 0) / room,                      # symbols
        upper / room,
        digits / room,
        float(np.log1p(len(set(found))) / np.log1p(n)),         # variety
        sum(map(operator.eq, found, found[1:])) / most,         # stuttering
        (in_words + 5 * SHRINK) / most,                         # word length
        (len(lines) - len(set(lines))) / (len(lines) + SHRINK / 4),  # repeated lines
        float(np.log1p(hits)),
        hits / most * 100,
    ]


class Model:
    """Weights over standardised features; the evidence of a text."""

    def __init__(self, word_list: frozenset[str], x: np.ndarray, good: np.ndarray):
        self.word_list, self.fitted = word_list, len(good) > 0 and 0 < good.mean() < 1
        self.base = float(good.mean()) if self.fitted else 1.0
        if not self.fitted:
            return
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        ridge = np.diag([1e-6] + [RIDGE] * FEATURES)
        w = np.zeros(FEATURES + 1)
        for _ in range(50):  # Newton steps
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            grad = z.T @ (good - p) - ridge @ w
            step = np.linalg.solve((z.T * (p * (1 - p))) @ z + ridge, grad)
            w = w + step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def evidence(self, features: np.ndarray) -> np.ndarray:
        """Log odds of being good beyond those of the training rows."""
        if not self.fitted or not len(features):
            return np.zeros(len(features))
        z = (features - self.mean) / self.scale
        odds = self.weights[0] + z @ self.weights[1:] - np.log(self.base / (1 - self.base))
        return np.where(features[:, 0] > 0, np.clip(odds, -MOST_EVIDENCE, MOST_EVIDENCE), 0.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """``text, good`` of about ``most`` labelled documents, evenly by a hash of the id."""
    rows = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
            .agg(((F.min("quality") >= 1) & (F.max(F.coalesce("toxic", F.lit(0))) < 1)).alias("good")))
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    # About MAX_LABELLED rows of two short columns, whatever the size of the tables.
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .join(F.broadcast(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "good")), "doc_id")
            .select("text", "good"))


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, bad rows, good rows) of a task's rows."""
    counts = {True: Counter(), False: Counter()}
    for part in rows_of(batches):
        for text, good in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            counts[good].update({s for w in set(words(text)) for s in stems(w)})
    names = list(counts[True].keys() | counts[False].keys())
    for i in range(0, len(names), 20_000):
        some = names[i:i + 20_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.string()), pa.array([counts[False][w] for w in some], pa.int64()),
             pa.array([counts[True][w] for w in some], pa.int64())], names=["word", "bad", "well"])


def mark_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the smallest shingle hash of each text."""
    of = WordHash().of
    for part in rows_of(batches):
        least = [int(s[0]) - (1 << 63) if len(s := shingles(of(words(t)))) else None
                 for t in part.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(least, pa.int64())], names=["text", "good", "mark"])


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    sample = labelled_sample(docs, labels, most).mapInArrow(mark_copies, "text string, good boolean, mark long") \
        .where("mark IS NOT NULL").dropDuplicates(["mark", "good"]).select("text", "good")
    sample = cut(sample)
    totals = sample.agg(F.sum((~F.col("good")).cast("long")), F.count("*")).first()
    bad, n = int(totals[0] or 0), int(totals[1])
    if not 0 < bad < n:
        return Model(frozenset(), np.zeros((0, FEATURES)), np.zeros(0))
    share = bad / n
    b, w = F.col("bad"), F.col("well")
    part = b / (b + w)
    evidence = b * F.log(part / share) + F.when(w > 0, w * F.log((1 - part) / (1 - share))).otherwise(0.0)
    counted = (sample.mapInArrow(count_words, "word string, bad long, well long").groupBy("word")
               .agg(F.sum("bad").alias("bad"), F.sum("well").alias("well")).where(b > 0)
               .where((part >= max(LIST_SHARE, share)) & (evidence >= LIST_EVIDENCE)))
    top = counted.orderBy(evidence.desc(), "word").limit(MAX_LIST).select("word", "bad").collect()
    word_list = telling({r[0]: r[1] for r in top})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = Flags(word_list)
        for p in rows_of(batches):
            x = [shape(t, flags) for t in p.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), p.column(1)], names=["x", "good"])

    rows = sample.mapInArrow(measure, "x array<double>, good boolean").toPandas()  # MAX_LABELLED short rows
    x = np.array(rows["x"].tolist(), dtype=float)
    order = np.lexsort(x.T)  # the order of rows leaves no trace in the sums
    return Model(word_list, x[order], rows["good"].to_numpy(dtype=float)[order])


def site(source: Column) -> tuple[Column, Column]:
    """(host, path) of a source: scheme and trailing parts dropped, one path segment."""
    plain = F.regexp_replace(F.lower(F.coalesce(source.cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.-]*://", "")
    parts = F.split(F.regexp_replace(plain, r"[?#].*$", ""), "/", 3)
    return parts[0], F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))


def with_evidence(docs: DataFrame, model: Model) -> DataFrame:
    """``host, path, evidence`` beside ``row``, a struct of all columns of ``docs``."""
    text = F.col("text").cast("string")
    host, path = site(F.col("source"))

    @F.pandas_udf("double")
    def evidence(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        flags = Flags(model.word_list)
        for texts in batches:
            found = [np.array([shape(t, flags) for t in texts.iloc[i:i + 256]]) for i in range(0, len(texts), 256)]
            yield pd.Series(model.evidence(np.concatenate(found) if found else np.zeros((0, FEATURES))))

    # Called non-deterministic, it is run once per row and not again in every filter and column made of it.
    once = evidence.asNondeterministic()
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                       host.alias("host"), path.alias("path"), once(text).alias("evidence"))


def posteriors(scored: DataFrame, base: float) -> DataFrame:
    """``host, path, share``: the shrunken share of good documents of every path."""
    odds = float(np.log(base / (1 - base))) if base < 1 else MOST_EVIDENCE
    good = 1 / (1 + F.exp(-(F.col("evidence") + odds)))
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.round(good, 9)).alias("s")))
    hosts = cut(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.count("*").alias("paths"),
                                          F.sum(F.col("n") * F.col("n")).alias("squares")))
    n, s, groups, squares = hosts.agg(
        F.sum("hn"), F.sum("hs"), F.count("*"), F.sum(F.col("hn").cast("double") * F.col("hn"))).first()
    if not n:
        return paths.select("host", "path", F.lit(1.0).alias("share"))
    m = min(max(s / n, 1e-6), 1 - 1e-6)
    between = hosts.agg(F.sum(F.col("hn") * F.pow(F.col("hs") / F.col("hn") - m, 2))).first()[0]
    host_strength = strength(between, groups - 1, n - squares / n, m)
    joined = paths.join(hosts, "host")
    within, free, spread = joined.agg(
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("hs") / F.col("hn"), 2)),
        F.count("*"), F.sum(F.col("n") - F.col("n") * F.col("n") / F.col("hn"))).first()
    path_strength = strength(within, free - groups, spread, m)
    host_share = (F.col("hs") + host_strength * m) / (F.col("hn") + host_strength)
    return joined.select("host", "path", ((F.col("s") + path_strength * host_share)
                                          / (F.col("n") + path_strength)).alias("share"))


def strength(spread: float, free: float, weight: float, m: float) -> float:
    """Prior rows a group's share is worth: few where groups differ, many where they do not."""
    variance = m * (1 - m)
    if free < 1 or weight <= 0:
        return 1e6
    between = (spread - free * variance) / weight
    return float(min(max(variance / between - 1, 1.0), 1e6)) if between > 0 else 1e6


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """``row`` (the columns of ``docs``), ``evidence``, ``share``, ``score`` and ``keep``."""
    shares = cut(posteriors(with_evidence(docs, model), model.base))
    side = F.broadcast(shares) if size_bound(shares) <= BROADCAST_BYTES else shares
    share = F.least(F.greatest("share", F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = F.col("evidence") + F.log(share / (1 - share))
    return (with_evidence(docs, model).join(side, ["host", "path"])
            .select("row", "host", "path", "evidence", "share", (1 / (1 + F.exp(-odds))).alias("score"),
                    (odds >= 0).alias("keep")))


def classify(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """``docs`` with ``quality_score`` and ``quality_keep``."""
    judged = judge(docs, fit(docs, labels, most))
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("quality_score", "quality_keep")]
    return judged.select(*kept, F.col("score").alias("quality_score"), F.col("keep").alias("quality_keep"))
