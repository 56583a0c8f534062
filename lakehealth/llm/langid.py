"""Language identification by segmentation-marginalised unigrams.

A fixed public piece vocabulary is given one probability table per language. A word's
probability in a language is the sum, over all ways to cut it into pieces, of the product
of the piece probabilities; the forward algorithm computes that sum. A text's score is the
sum of its words' log probabilities, so each distinct word is scored once per batch and cached.

``fit`` learns the tables by one expectation step over at most ``MAX_ROWS`` training rows a language: starting from
equal piece probabilities, the forward-backward algorithm gives the expected count of each piece
in each language; tasks add up counts of the fixed vocabulary and only these sums are shuffled.
``predict`` scores whole texts. Only text and lang of the training rows are used.

Words are runs of letters of the lower-cased text; a run of more than ``MAX_WORD`` letters is
cut there (as scripts without spaces need). A letter no piece covers has probability ``UNKNOWN``
in every language.

Edge cases: a null text or one without a letter is ``und`` with score 0; without a training
row every text is ``und``; equal scores go to the alphabetically first language; repeated rows
give one row each; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakehealth.llm.common import rows_of
from lakehealth.llm.words import mix

#: Runs of letters, and of numerals that are no digits ("½", "²"), which ``letters`` takes out.
find_runs = re.compile(r"[^\W\d_]+").findall
MAX_WORD = 32
#: Smoothing count of every piece in every language.
ALPHA = 0.01
#: Probability of a character that no piece covers.
UNKNOWN = 1e-9
#: Training rows of a language, at most (chosen by a hash of the text).
MAX_ROWS = 4_000
#: Words a worker keeps scores of, and scores (words times languages).
CACHE_WORDS = 1_000_000
CACHE_SCORES = 4_000_000
#: Sums (words times positions times languages) of one forward-backward batch.
BATCH_SUMS = 600_000
#: Words a task counts before it turns them into piece counts.
COUNT_WORDS = 200_000
#: Languages a model may hold; the size bound of what is broadcast.
MAX_LANGUAGES = 500


def letters(text: str | None) -> list[str]:
    found = find_runs(text.lower()) if text else []
    if not all(map(str.isalpha, found)):
        found = [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]
    if found and max(map(len, found)) > MAX_WORD:
        found = [w[i:i + MAX_WORD] for w in found for i in range(0, len(w), MAX_WORD)]
    return found


def read_pieces(model_path: str) -> list[str]:
    """The letter pieces of a sentencepiece vocabulary, lower-cased; a word start is a space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = {model.id_to_piece(i).lower().replace("▁", " ") for i in range(model.get_piece_size())
              if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    return sorted(p for p in pieces if p.strip(" ").isalpha() and p.rstrip(" ") == p)


class Lattice:
    """Forward and backward sums over all segmentations, for many words at once.

    Pieces are found by a rolling hash of their characters in a direct-address table; 64 bits of
    hash stand for the piece. The word start counts as one character, so a word of n letters has n + 1 places."""

    BASE = 0x9E3779B97F4A7C15
    BITS = 20

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.unknown = len(pieces)
        powers = [pow(self.BASE, k, 1 << 64) for k in range(max(MAX_WORD, self.longest) + 2)]
        self.powers = np.array(powers, dtype=np.uint64)
        self.hashes = np.zeros(len(pieces), dtype=np.uint64)
        for i, p in enumerate(pieces):
            self.hashes[i] = self.span(self.codes([p], False), 0, len(p))[0]
        # A first table by low bits, a second by high bits for pieces whose place was taken.
        self.low = np.full(1 << self.BITS, -1, dtype=np.int32)
        self.high = np.full(1 << self.BITS, -1, dtype=np.int32)
        self.rest: dict[int, int] = {}
        for i, h in enumerate(self.hashes.tolist()):
            x, y = h & (1 << self.BITS) - 1, h >> 64 - self.BITS
            if self.low[x] < 0:
                self.low[x] = i
            elif self.high[y] < 0:
                self.high[y] = i
            else:
                self.rest[h] = i

    def codes(self, words: list[str], start: bool = True) -> np.ndarray:
        """Prefix hashes [word, place] of equally long words, a space before each."""
        n = len(words[0])
        letters = np.array(words, dtype=f"<U{n}").view("<u4").reshape(len(words), n).astype(np.uint64)
        if start:
            letters = np.concatenate([np.full((len(words), 1), 32, dtype=np.uint64), letters], axis=1)
        out = np.zeros((len(words), letters.shape[1] + 1), dtype=np.uint64)
        for k in range(letters.shape[1]):
            out[:, k + 1] = out[:, k] * np.uint64(self.BASE) + letters[:, k]
        return out

    def span(self, codes: np.ndarray, first: int, end: int) -> np.ndarray:
        return mix(codes[:, end] - codes[:, first] * self.powers[end - first] + np.uint64(end - first))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        out = np.full(len(hashes), -1, dtype=np.int32)
        if not self.unknown:
            return out
        for table, place in ((self.low, hashes & np.uint64((1 << self.BITS) - 1)),
                             (self.high, hashes >> np.uint64(64 - self.BITS))):
            k = table[place]
            hit = (k >= 0) & (self.hashes[k] == hashes)
            out[hit] = k[hit]
        for h, k in self.rest.items():
            out[hashes == np.uint64(h)] = k
        return out

    def edges(self, words: list[str]) -> np.ndarray:
        """Piece of every span [word, start, length - 1] of equally long words; -1 if none. A letter
        without a piece is an unknown one, the word start alone the entry after it."""
        n, codes = len(words[0]) + 1, self.codes(words)
        width = min(n, self.longest)
        out = np.full((len(words), n, width), -1, dtype=np.int32)
        for start in range(n):
            for length in range(1, min(width, n - start) + 1):
                out[:, start, length - 1] = self.find(self.span(codes, start, start + length))
        single = out[:, :, 0]
        single[:, 1:][single[:, 1:] < 0] = self.unknown
        single[:, 0][single[:, 0] < 0] = self.unknown + 1
        return out

    def forward(self, edges: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Sums over the segmentations of each prefix: [word, place, language]."""
        m, n, width = edges.shape
        alpha = np.zeros((m, n + 1, prob.shape[1]))
        alpha[:, 0] = 1
        for end in range(1, n + 1):
            for length in range(1, min(end, width) + 1):
                alpha[:, end] += alpha[:, end - length] * prob[edges[:, end - length, length - 1]]
        return alpha

    def expected(self, edges: np.ndarray, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts: weight[word, language] is how often the word occurs."""
        m, n, width = edges.shape
        alpha = self.forward(edges, prob)
        beta = np.zeros_like(alpha)
        beta[:, n] = 1
        for start in range(n - 1, -1, -1):
            for length in range(1, min(n - start, width) + 1):
                beta[:, start] += prob[edges[:, start, length - 1]] * beta[:, start + length]
        pieces, shares = [], []
        for start in range(n):
            for length in range(1, min(n - start, width) + 1):
                k = edges[:, start, length - 1]
                pieces.append(k)
                shares.append(alpha[:, start] * prob[k] * beta[:, start + length] / alpha[:, n] * weight)
        at, share = np.concatenate(pieces), np.concatenate(shares)
        at = np.where(at < 0, len(prob) - 1, at)
        return np.stack([np.bincount(at, share[:, c], len(prob)) for c in range(weight.shape[1])], axis=1)


def table_of(counts: np.ndarray, size: int) -> np.ndarray:
    """Piece probabilities [piece, language], with rows for unknown letter, lone start, none."""
    smooth = counts[:size] + ALPHA
    prob = np.zeros((size + 3, counts.shape[1]))
    prob[:size] = smooth / smooth.sum(axis=0)
    prob[size], prob[size + 1] = UNKNOWN, 1.0 / max(size, 1)
    return prob  # the last row (index -1) stays 0: no piece


def by_length(words: list[str], languages: int) -> Iterator[list[str]]:
    """Words of equal length, in batches whose sums stay small."""
    size = max(16, BATCH_SUMS // ((MAX_WORD + 2) * max(languages, 1)))
    groups = defaultdict(list)
    for w in words:
        groups[len(w)].append(w)
    for same in groups.values():
        for i in range(0, len(same), size):
            yield same[i:i + size]


_lattices: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    if path not in _lattices:
        _lattices[path] = Lattice(read_pieces(path))
    return _lattices[path]


def row_counts(train: DataFrame) -> list[tuple[str, int]]:
    """Rows of each language, in order; of more than ``MAX_LANGUAGES`` only so many come to the driver as show it."""
    counts = train.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return sorted((lang, n) for lang, n in counts)


def sample(train: DataFrame, counts: list[tuple[str, int]], most: int) -> DataFrame:
    """About ``most`` rows of each language at most, evenly by a hash of the text."""
    parts = 1_000_000
    limit = F.create_map(*(F.lit(x) for lang, n in counts for x in (lang, min(parts, -(-parts * most // n))))) \
        if counts else F.lit(None)
    return train.where(F.pmod(F.xxhash64("text"), F.lit(parts)) < limit[F.col("lang")]) if counts else train


def fit(train: DataFrame, vocabulary: str, most: int = MAX_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, piece probabilities) from the ``text`` and ``lang`` of ``train``."""
    train = train.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")) \
        .where("lang IS NOT NULL AND text IS NOT NULL")
    rows = row_counts(train)
    languages = [lang for lang, _ in rows]
    train = sample(train, rows, most)
    at = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(vocabulary)
        flat = np.zeros((lat.unknown + 3, 1))
        flat[:lat.unknown] = flat[lat.unknown + 1] = 1.0 / max(lat.unknown, 1)
        flat[lat.unknown] = UNKNOWN
        total = np.zeros((lat.unknown + 3, len(languages)))
        seen: list[Counter] = [Counter() for _ in languages]

        def settle() -> None:
            for same in by_length(list(set().union(*seen)), len(languages)):
                weight = np.array([[c[w] for c in seen] for w in same], dtype=float)
                total[:] += lat.expected(lat.edges(same), flat, weight)
            for c in seen:
                c.clear()

        for part in rows_of(batches):
            for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                seen[at[lang]].update(letters(text))
            if sum(map(len, seen)) > COUNT_WORDS:
                settle()
        settle()
        piece, lang = np.nonzero(total[:lat.unknown])
        yield pa.RecordBatch.from_arrays(
            [pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(total[piece, lang])],
            names=["piece", "lang", "n"])

    size = lattice(vocabulary).unknown
    counts = np.zeros((size, len(languages)))
    if languages:
        sums = train.mapInArrow(count, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n"))
        for piece, lang, n in sums.collect():  # at most one row per piece of the fixed vocabulary and language
            counts[piece, lang] = n
    # Rounded, so that the order in which tasks were added up leaves no trace.
    return languages, table_of(np.round(counts, 6), size)


def predict(docs: DataFrame, languages: list[str], prob: np.ndarray, vocabulary: str) -> DataFrame:
    """``doc_id, lang_pred, score``: the language with the highest score, and its share."""
    model = docs.sparkSession.sparkContext.broadcast(prob)  # vocabulary size times MAX_LANGUAGES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat, prob = lattice(vocabulary), model.value
        place: dict[str, int] = {}
        most = max(1000, min(CACHE_WORDS, CACHE_SCORES // max(len(languages), 1)))
        scores = np.zeros((most + 1, len(languages)))

        def settle(step: list[tuple[int, list[str]]], totals: np.ndarray) -> None:
            """Score words not seen before, all at once, and add up the rows' words."""
            if not languages:
                return
            new = list({w for _, words in step for w in words if w not in place})
            if len(place) + len(new) > most:
                kept = dict(islice(place.items(), max(0, min(most // 2, most - len(new)))))
                place.clear()
                place.update(kept)  # the words met first are the frequent ones
                new = list({w for _, words in step for w in words if w not in place})
            for same in by_length(new, len(languages)):
                end = lat.forward(lat.edges(same), prob)[:, -1]
                first = len(place)
                scores[first:first + len(same)] = np.log(np.maximum(end, 1e-300))
                place.update(zip(same, range(first, first + len(same))))
            for row, words in step:
                totals[row] += scores[list(map(place.__getitem__, words))].sum(axis=0)

        for part in rows_of(batches):
            texts = part.column(1).to_pylist()
            totals, letters_of = np.zeros((len(texts), len(languages))), np.zeros(len(texts), dtype=np.int64)
            step: list[tuple[int, list[str]]] = []  # (row, words), at most `most` words in all
            size = 0
            for row, text in enumerate(texts):
                found = letters(text)
                letters_of[row] = len(found)
                for i in range(0, len(found), most // 4):
                    if size + most // 4 > most:
                        settle(step, totals)
                        step, size = [], 0
                    step.append((row, found[i:i + most // 4]))
                    size += len(step[-1][1])
            settle(step, totals)
            known = (letters_of > 0) & (len(languages) > 0)
            best = totals.argmax(axis=1) if languages else np.zeros(len(texts), dtype=int)
            gap = np.maximum(totals - totals.max(axis=1, keepdims=True), -700) if languages else totals
            share = np.where(known, 1 / np.maximum(np.exp(gap).sum(axis=1), 1e-300), 0.0)
            preds = [languages[k] if ok else "und" for k, ok in zip(best.tolist(), known.tolist())]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(preds, pa.string()), pa.array(np.clip(share, 0, 1), pa.float64())],
                names=["doc_id", "lang_pred", "score"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id) -> F.Column:
    """Rows kept from training: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Fit on the rows that are not held out and predict all: ``doc_id, held_out, lang_pred, score``."""
    languages, prob = fit(docs.where(~held_out("doc_id")), vocabulary)
    return predict(docs, languages, prob, vocabulary) \
        .select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
