"""Line dedup by a deletion-neighbourhood join.

A line is dropped if an earlier line (by document id, then line number) of any document equals it or is
within ``bound`` word edits of it (words put in, taken out or changed): one for every ``WORDS_PER_EDIT`` words
of the shorter of the two lines, and at least one. Where the shorter one has fewer than ``MIN_WORDS`` words,
a whole word is much of it; such lines are near within one character put in, taken out or changed,
the words joined by one space (so "log in" is near "login"). One character is an eighth of ``MIN_CHARS``, as
one word is of ``MIN_WORDS``: where the shorter line has fewer characters ("1", "b)"), only equal lines are dropped. The first one stays.

A line's deletion neighbourhood is the line without one of its parts; two lines within one edit share
a member of it. It is emitted in two rounds, so that long lines do not emit one key per word unless needed:

1. Parts are halves. One edit leaves one half as it is, so each line emits its hashed halves, cut as
   for its own length and as for a line shorter by one word: four keys. Lines alone under all
   their keys have no partner.
2. Parts are words, for the lines left: every line without one word, keyed with the place of that word
   (a changed word) and without it (against lines one word shorter), and the line itself.
   All lines under a key with a place are within one edit of each other, and all longer lines under a
   plain key within one edit of the line itself; so the earliest line of a key
   settles the others, and only (line, earlier line) pairs are made, at most one per key.

Lines of up to ``MIN_WORDS`` words do the same with their characters (those of ``MIN_WORDS`` words with both, as their
partner may have a word less).

Lines long enough for a bound of k = two edits or more (``far``) have too many variants without that many words (820
of 40 words, 79 million of 100). Their keys are what such a deletion leaves whole: of all windows of ``RUN`` words
an edit touches at most ``RUN``, so the windows that two near lines share are all but ``RUN`` k. A window is
known by the least of its hashed word grams (a minimizer, weighted with the windows it stands for). A line
puts its keys in order, those of the fewest lines first, and needs the first of them only, up to a weight of
``RUN`` k + 1: near lines share one of these. Keys no other line has count towards that weight, so a
line that shares a passage and has as many words of its own has no partner, and a passage of very many lines is a key of
those only that hold little else. In round 2 the lines under such a key are compared
with its earliest one. A line that is not near it meets the earlier lines that share both that first line and one of the
words that both need: of two lines within k edits each lacks at most k of the other's distinct words, so whatever the order of
the words, the first k + 1 of either hold one that both have. The order puts words that the first line lacks before its own, and
rare ones before common ones: copies of one text, or lines that hold one passage, then meet by what sets them apart. What meets
is compared in cells of bounded size.

The pairs are verified on the lines' words, by the exact edit distance. Equal lines are grouped first, by a 128-bit hash;
counts and minima are partial per task. Keys of both rounds are packed into blocks and dealt by key once, not a row each. In round 1
only those of two lines or more go on, packed again and dealt by line; a bounded bit filter (``Filter``) then picks the
lines concerned in a second pass over the texts, so that no text is shuffled for others. In round 2 a task settles the lines that
meet in it under a key with a place, and deals only the first of them on, so that a key of very many lines brings a few from each task. A line that holds over one in ``HOT_PART`` of all rows (there are fewer than that many)
is joined where its rows are; no other line can bring more than that part of all rows to one task.

Words are what stands between white space, lower-cased.

Edge cases: lines without a word are never dropped; null texts stay null; null ids sort first; rows
that share an id (or have none) follow the 64-bit hash of their text; rows that share id and text are one
document to the order, so what stays in one stays in both; an empty table gives an empty table; other columns pass untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakehealth.llm.common import cut, join_bounded, rows_of, runs
from lakehealth.llm.jaccard import common_features
from lakehealth.llm.words import MIX, WordHash, mix

#: Words a line needs to be compared by word edits, and characters to be compared by character edits.
MIN_WORDS = 8
MIN_CHARS = 8
#: What tells keys of characters from keys of words.
SPELLED = np.uint64(0x5851F42D4C957F2E)
#: Role of a pair that has met in round 2: its key is the earlier line.
MET = np.int8(3)
#: Words of a line for each edit that two near lines may be apart.
WORDS_PER_EDIT = 20
#: Words of a line whose bound is two edits or more, words of a window and of its grams. Near lines share at least
#: n - RUN + 1 - RUN (n // 20) windows: 8 of 30 at 40 words, never less.
FAR_WORDS = 2 * WORDS_PER_EDIT
RUN = 11
GRAM = 4
#: Lines of a block in round 2, and the part of all rows beyond which a line's rows are not shuffled.
BLOCK_LINES = 128
#: Spots that words are counted on by their hash, for their order in round 2, and those of one piece.
SPOTS = 1 << 16
PIECE_SPOTS = 1 << 12
#: Pairs of lines that are compared without counting their common words first.
FEW_PAIRS = 64
HOT_PART = 1024
#: Buckets that keys are dealt into (a task holds one at a time), and keys that a task gathers before it deals them.
BUCKETS = 1024
FLUSH = 1 << 20
#: Bits of a filter for each line in it, the most a filter may have (16 MB), and those of one piece of it.
FILTER_BITS = 16
MOST_BITS = 1 << 27
PIECE_BITS = 1 << 19
# Odd multipliers, of the polynomial hash and of a deleted word's place.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
U64 = np.uint64


def fresh(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the row before."""
    out = np.ones(len(columns[0]), dtype=bool)
    out[1:] = False
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


class Powers:
    """Powers of a multiplier and of its inverse modulo 2**64, as far as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U64)

    def upto(self, n: int) -> Powers:
        while len(self.up) <= n:
            more = U64(pow(self.base, len(self.up), 1 << 64))
            less = U64(pow(self.inverse, len(self.down), 1 << 64))
            self.up = np.concatenate([self.up, self.up * more])
            self.down = np.concatenate([self.down, self.down * less])
        return self


class Lines:
    """Hashes of many lines at once. ``words`` are the word hashes of all lines, end to end."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray):
        self.lengths = lengths
        self.starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else lengths
        place = np.arange(len(words)) - np.repeat(self.starts, lengths)
        self.place, top = place, int(lengths.max(initial=0))
        self.powers = POWERS.upto(top)
        self.sums = np.concatenate([np.zeros(1, U64), np.cumsum(words * self.powers.up[place], dtype=U64)])

    def span(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words [first, end) of each line, as a text of its own."""
        s = self.sums
        return (s[self.starts + end] - s[self.starts + first]) * self.powers.down[first]

    def halves(self) -> list[np.ndarray]:
        """The two halves for the line's own length and for a length shorter by one."""
        n, out = self.lengths, []
        for m in (n, n - 1):
            half = m // 2
            for kind, span in ((1, self.span(np.zeros_like(n), half)), (2, self.span(n - (m - half), n))):
                out.append(mix(span * MIX + (m * 4 + kind).astype(U64)))
        return out

    def minimizers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, key, windows) of the least grams of the windows of ``RUN`` words of lines that have ``FAR_WORDS``."""
        far = self.lengths >= FAR_WORDS
        n = self.lengths[far]
        if not len(n):
            return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
        s, p = self.sums, self.powers
        at = np.flatnonzero(np.repeat(far, self.lengths))
        at = at[:-(GRAM - 1)]  # the last grams belong to no window
        own = mix((s[at + GRAM] - s[at]) * p.down[self.place[at]] * MIX + U64(3))
        # The least of RUN - GRAM + 1 = 8 grams, by halves; what reaches into another line is left out below.
        least, wide = own, 1
        while wide < RUN - GRAM + 1:
            step = min(wide, RUN - GRAM + 1 - wide)
            least, wide = np.minimum(least[:-step], least[step:]), wide + step
        line = np.repeat(np.flatnonzero(far), n)[:len(least)]
        good = self.place[at[:len(least)]] + RUN <= self.lengths[line]
        # Keys of windows are odd, those of halves even.
        line, least = line[good], least[good] | U64(1)
        # Windows side by side mostly have one key: they are counted first, the rest is sorted.
        first = np.flatnonzero(fresh(line, least))
        count, line, least = np.diff(np.append(first, len(line))), line[first], least[first]
        order = np.lexsort((least, line))
        line, least, count = line[order], least[order], count[order]
        first = np.flatnonzero(fresh(line, least))
        return line[first], least[first], np.add.reduceat(count, first)

    def without_one(self) -> tuple[np.ndarray, np.ndarray]:
        """(line, hash of the line without that word) for every word of every line."""
        line = np.repeat(np.arange(len(self.lengths)), self.lengths)
        first, n, s, p = self.starts[line], self.lengths[line], self.sums, self.powers
        before = s[first + self.place] - s[first]
        after = s[first + n] - s[first + self.place + 1]
        return line, before + after * p.down[1]


POWERS = Powers(BASES[0])


def units(line: str) -> list[str]:
    return line.lower().split()


class Plain:
    """All lines with a word of some texts, lower-cased, with one blank between words: ``whole`` holds them end to
    end, line k from ``start[k]`` to ``stop[k]``, with ``words[k]`` words; it is line ``number[k]`` of text ``doc[k]``."""

    def __init__(self, texts: list[str | None]):
        low = [(t or "").lower() for t in texts]
        low = [t if t.isascii() else ODD_SPACES.sub(" ", t) for t in low]
        raw = np.frombuffer(("\n".join(low) + "\n").encode(), dtype=np.uint8)
        space = SPACES[raw]
        after = space.copy()  # the first blank after a word
        after[0] = False
        after[1:] &= ~space[:-1]
        kept = raw[~space | after]
        self.ends = np.flatnonzero(SPACES[kept])
        kept[self.ends] = 32
        words = np.diff(np.searchsorted(np.flatnonzero(after), np.flatnonzero(raw == 10), "right"), prepend=0)
        lines = np.array([t.count("\n") + 1 for t in low], dtype=np.int64)
        full = np.flatnonzero(words)
        doc = np.repeat(np.arange(len(low)), lines)
        self.doc, self.words = doc[full], words[full]
        self.number = (np.arange(len(doc)) - np.repeat(np.cumsum(lines) - lines, lines))[full]
        self.stop = self.ends[np.cumsum(self.words) - 1]
        self.start = np.concatenate([np.zeros(min(1, len(full)), np.int64), self.stop[:-1] + 1])
        self.codes, self.whole = kept, kept.tobytes()

    def digests(self) -> np.ndarray:
        """The 128-bit hash of each line, as two long columns."""
        of, whole = xxhash.xxh3_128_digest, self.whole
        found = b"".join([of(whole[a:b]) for a, b in zip(self.start.tolist(), self.stop.tolist())])
        return np.frombuffer(found, dtype=np.int64).reshape(-1, 2)

    def hashes(self) -> np.ndarray:
        """A hash of each word (and the blank behind it) of all lines."""
        if not len(self.ends):
            return np.zeros(0, U64)
        starts = np.concatenate([[0], self.ends[:-1] + 1])
        sizes = self.ends - starts + 1
        place = np.arange(len(self.codes)) - np.repeat(starts, sizes)
        return mix(np.add.reduceat(POWERS.upto(int(sizes.max())).up[place] * self.codes, starts))

    def texts(self, lines: np.ndarray) -> list[str]:
        return [self.whole[a:b].decode() for a, b in zip(self.start[lines].tolist(), self.stop[lines].tolist())]


#: What str.split takes for white space: its bytes in ASCII, and the other characters.
SPACES = np.array([k < 128 and chr(k).isspace() for k in range(256)])
ODD_SPACES = re.compile("[" + "".join(chr(k) for k in range(128, 0x10000) if chr(k).isspace()) + "]")


def spelled(texts: list[str]) -> Lines:
    """Lines whose units are the characters of the texts."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(U64)
    return Lines(mix((codes + U64(1)) * MIX), np.array([len(t) for t in texts], dtype=np.int64))


def within_one(a: list[str] | str, b: list[str] | str) -> bool:
    """Whether one word (or character, of strings) put in, taken out or changed (or nothing) makes a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    same = 0
    while same < len(short) and short[same] == long[same]:
        same += 1
    return short[same + (len(a) == len(b)):] == long[same + 1:]


def bound(n: int) -> int:
    """Word edits that a line of n words may be away from one that is not shorter."""
    return max(1, n // WORDS_PER_EDIT)


def within(a: list[str], b: list[str], most: int) -> bool:
    """Whether ``most`` word edits or fewer make a into b: on every diagonal, the furthest place that e edits reach."""
    last = len(b) - len(a)
    if abs(last) > most:
        return False
    reach: dict[int, int] = {}  # diagonal (place in b less place in a) -> words of a that are through
    for e in range(most + 1):
        now = {}
        for d in range(-e, e + 1):
            at = 0 if not e else max(reach.get(d, -2) + 1, reach.get(d + 1, -2) + 1, reach.get(d - 1, -2))
            at = min(at, len(a), len(b) - d)
            if at < 0 or at + d < 0:
                continue
            while at < len(a) and at + d < len(b) and a[at] == b[at + d]:
                at += 1
            now[d] = at
        if now.get(last) == len(a):
            return True
        reach = now
    return False


def near(a: str, b: str) -> bool:
    """Whether two lines that differ are near enough for the later one to go."""
    return near_words(units(a), units(b))


def near_words(x: list[str], y: list[str]) -> bool:
    if min(len(x), len(y)) >= MIN_WORDS:
        return within(x, y, bound(min(len(x), len(y))))
    p, q = " ".join(x), " ".join(y)
    return min(len(p), len(q)) >= MIN_CHARS and within_one(p, q)


def halves_of(lines: Lines, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of the halves of lines that have ``least`` units, and one more to be cut as for one unit less."""
    n = lines.lengths
    masks = [n >= least] * 2 + [n > least] * 2
    found = [(np.flatnonzero(m), k[m]) for k, m in zip(lines.halves(), masks)]
    return tuple(np.concatenate(c) for c in zip(*found))


def round_one(plain: Plain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, weight) of the keys of halves (of weight 0) and of windows of lines; lines alone under all
    their keys have no near line."""
    lines = Lines(plain.hashes(), plain.words)
    short = np.flatnonzero(plain.words <= MIN_WORDS)
    line, words = halves_of(lines, MIN_WORDS)
    row, letters = halves_of(spelled(plain.texts(short)), MIN_CHARS)
    half = np.concatenate([words, letters ^ SPELLED]) & ~U64(1)
    far, windows, weights = lines.minimizers()
    return (np.concatenate([line, short[row], far]), np.concatenate([half, windows]),
            np.concatenate([np.zeros(len(half), np.int64), weights]))


def variants(lines: Lines, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, role) of lines that have ``least`` units;
    role: 0 line without a unit, 1 whole line, 2 line without a unit at a place."""
    n = lines.lengths
    line, rest = lines.without_one()
    plain, zero = n[line] > least, np.zeros_like(n)
    keys = [mix(rest * MIX + (n[line] - 1).astype(U64))[plain], mix(lines.span(zero, n) * MIX + n.astype(U64)),
            mix((rest + lines.place.astype(U64) * U64(BASES[1])) * MIX + U64(1 << 62) + n[line].astype(U64))]
    role = np.repeat(np.array([0, 1, 2], dtype=np.int8), [len(k) for k in keys])
    return np.concatenate([line[plain], np.arange(len(n)), line]), np.concatenate(keys), role


def picked(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, text``: what lines are taken from, and what tells documents apart that share an id."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))


def planes(values: np.ndarray) -> bytes:
    """Integers of some bytes, all first bytes before all second ones, so that zeros stand side by side."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def packed(bucket: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """``bucket, block``: of each bucket one block with its values, column after column; signed ones (ids, counts) by ``planes``,
    hashes as they are."""
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    edges = np.flatnonzero(fresh(bucket)) if len(bucket) else np.zeros(0, np.int64)
    blocks = [b"".join(planes(c[a:b]) if c.dtype.kind == "i" else c[a:b].tobytes() for c in columns)
              for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(bucket)])]
    return pa.RecordBatch.from_arrays([pa.array(bucket[edges].astype(np.int32)), pa.array(blocks, pa.binary())],
                                      names=["bucket", "block"])


def unpacked(blocks: list[bytes], *kinds: type) -> list[np.ndarray]:
    """The columns of some blocks of ``packed``, whose types are ``kinds``."""
    types = [np.dtype(k) for k in kinds]
    width, parts = sum(t.itemsize for t in types), []
    for block in blocks:
        values, n, at = np.frombuffer(block, np.uint8), len(block) // width, 0
        row = []
        for t in types:
            own = values[at:at + n * t.itemsize]
            row.append((own.reshape(t.itemsize, n).T.copy() if t.kind == "i" else own).view(t).ravel())
            at += n * t.itemsize
        parts.append(row)
    return [np.concatenate(c) for c in zip(*parts)]


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> U64(20)) % U64(BUCKETS)).astype(np.uint16)


def key_blocks(docs: DataFrame) -> DataFrame:
    """``bucket, block``: the keys of all lines, dealt into buckets. A block holds ``key, line, weight, words`` of many keys:
    the key, the first half of the line's hash, the key's weight and the line's words. A key of weight -1 is the
    line itself, its ``words`` say how often it is there."""

    def dealt(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, *rest = (np.concatenate(c) for c in zip(*parts))
        return packed(bucket_of(key), key, *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for part in rows_of(batches):
            plain = Plain(part.column(0).to_pylist())
            if not len(plain.words):
                continue
            own = plain.digests()[:, 0].copy().view(U64)
            name, first, times = np.unique(own, return_index=True, return_counts=True)
            line, key, weight = round_one(plain)
            once = np.zeros(len(own), dtype=bool)
            once[first] = True
            good = once[line]
            line, key, weight = line[good], key[good], weight[good]
            held.append((np.concatenate([key, name]), np.concatenate([own[line], name]),
                         np.concatenate([weight, np.full(len(name), -1)]).astype(np.int32),
                         np.concatenate([plain.words[line], times]).astype(np.int32)))
            count += len(held[-1][0])
            if count >= FLUSH:
                yield dealt(held)
                held, count = [], 0
        if held:
            yield dealt(held)

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, block binary")


def shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, v, w, words, rows`` of the keys of two lines or more: the line, the key, its weight, the line's words and the number of
    the key's lines; and of the lines that are there more than once, with ``w`` -1."""
    for group in runs(batches, ["bucket"]):
        key, line, weight, words = unpacked(group["block"].to_pylist(), U64, U64, np.int32, np.int32)
        whole = weight < 0
        name, at = np.unique(key[whole], return_inverse=True)
        often = name[np.bincount(at, weights=words[whole], minlength=len(name)) > 1]
        rest = np.flatnonzero(~whole)
        rest = rest[np.argsort(key[rest], kind="stable")]
        k = key[rest]
        new = np.append(fresh(k), True)
        rest = rest[~(new[1:] & new[:-1])]
        rest = rest[np.lexsort((line[rest], key[rest]))]
        k, x = key[rest], line[rest]
        # A line may have been met in several tasks.
        first = np.flatnonzero(fresh(k, x))
        rest, k = rest[first], k[first]
        start = np.flatnonzero(fresh(k))
        size = np.diff(np.append(start, len(k)))
        rows = np.repeat(size, size)
        rest, rows = rest[rows > 1], rows[rows > 1]
        none = np.zeros(len(often), np.int64)
        columns = [(np.concatenate([line[rest], often]).view(np.int64), pa.int64()),
                   (np.concatenate([key[rest].view(np.int64), none]), pa.int64()),
                   (np.concatenate([weight[rest], none - 1]), pa.int32()),
                   (np.concatenate([words[rest], none]), pa.int32()), (np.concatenate([rows, none]), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["id", "v", "w", "words", "rows"])


def line_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``bucket, block``: what ``shared_keys`` finds, dealt by line. A block holds ``id, v, w, words, rows`` of many of its rows."""
    held, count = [], 0

    def dealt() -> pa.RecordBatch:
        line, *rest = (np.concatenate(c) for c in zip(*held))
        return packed(bucket_of(line), line, *rest)

    for batch in shared_keys(batches):
        line, key, *rest = (c.to_numpy() for c in batch.columns)
        held.append((line.view(U64), key.view(U64), *rest))
        count += len(line)
        if count >= FLUSH:
            yield dealt()
            held, count = [], 0
    if count:
        yield dealt()


def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, half, windows, again`` of the lines in ``line_blocks``: whether the line shares a half, the windows it shares among the
    rarest ones that it needs, and whether it is there more than once."""
    for group in runs(batches, ["bucket"]):
        line, key, weight, words, rows = unpacked(group["block"].to_pylist(), U64, U64, np.int32, np.int32, np.int64)
        order = np.lexsort((key, rows, line))
        line, key, weight, words = line[order], key[order], weight[order].astype(np.int64), words[order]
        start = np.flatnonzero(fresh(line))
        size = np.diff(np.append(start, len(line)))
        n, window = np.maximum.reduceat(words, start), np.maximum(weight, 0)
        # The keys that come before a weight of RUN k is passed; those of no other line come first.
        before = np.cumsum(window) - window
        before += np.repeat(n - (RUN - 1) - np.add.reduceat(window, start) - before[start], size)
        taken = (weight > 0) & (before <= np.repeat(np.maximum(1, n // WORDS_PER_EDIT) * RUN, size))
        half, again = (np.bitwise_or.reduceat(c, start) for c in (weight == 0, weight < 0))
        keys = np.add.reduceat(taken.astype(np.int32), start)
        good = half | again | (keys > 0)
        windows = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(keys[good])), pa.int32()),
                                           pa.array(key[taken].view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(line[start[good]].view(np.int64)), pa.array(half[good]), windows, pa.array(again[good])],
                                         names=["id", "half", "windows", "again"])


class Filter:
    """Which lines may be among some: one bit for each first part of a line's hash. No line of those is missed; of the others a
    part passes that grows with their number beyond ``MOST_BITS`` / ``FILTER_BITS``, and is sorted out by the joins that follow."""

    def __init__(self, ids: DataFrame):
        bits = PIECE_BITS
        count = ids.count()
        while bits < min(MOST_BITS, FILTER_BITS * count):
            bits *= 2
        self.shift = shift = 64 - (bits.bit_length() - 1)
        piece = F.shiftrightunsigned(F.shiftrightunsigned("id", shift), PIECE_BITS.bit_length() - 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made: dict[int, np.ndarray] = {}
            for batch in batches:
                place = batch.column(1).to_numpy().view(U64) >> U64(shift)
                which = batch.column(0).to_numpy()
                for p in np.unique(which).tolist():
                    own = made.setdefault(p, np.zeros(PIECE_BITS, dtype=bool))
                    own[(place[which == p] % U64(PIECE_BITS)).astype(np.int64)] = True
            for p, own in made.items():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([np.packbits(own).tobytes()], pa.binary())],
                                                 names=["piece", "bits"])

        pieces = ids.select(piece.alias("piece"), "id").repartition("piece").mapInArrow(run, "piece long, bits binary")
        whole = np.zeros(bits // 8, dtype=np.uint8)
        for row in pieces.toLocalIterator():
            whole[row.piece * (PIECE_BITS // 8):][:PIECE_BITS // 8] = np.frombuffer(row.bits, np.uint8)
        self.bits: Broadcast = ids.sparkSession.sparkContext.broadcast(whole)

    def has(self, ids: np.ndarray) -> np.ndarray:
        place = ids.view(U64) >> U64(self.shift)
        return (self.bits.value[(place >> U64(3)).astype(np.int64)] << (place & U64(7)).astype(np.uint8)) & np.uint8(128) > 0


def occurrences(docs: DataFrame, wanted: Filter, again: Filter) -> DataFrame:
    """``doc_id, digest, line, k1, k2, text`` of every line that may be in one of the filters; the text
    only where it may be ``wanted`` and no other row beside it holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches):
            plain = Plain(part.column(2).to_pylist())
            if not len(plain.words):
                continue
            whole = plain.digests()
            own = whole[:, 0].copy()
            near = wanted.has(own)
            some = np.flatnonzero(near | again.has(own))
            _, first = np.unique(whole[some], axis=0, return_index=True)
            told = np.zeros(len(some), dtype=bool)
            told[first] = True
            told &= near[some]
            texts = np.full(len(some), None, dtype=object)
            texts[told] = plain.texts(some[told])
            at = pa.array(plain.doc[some])
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(at), part.column(1).take(at), pa.array(plain.number[some], pa.int32()), pa.array(own[some]),
                 pa.array(whole[some, 1]), pa.array(texts.tolist(), pa.string())],
                names=["doc_id", "digest", "line", "k1", "k2", "text"])

    return picked(docs).mapInArrow(run, "doc_id long, digest long, line int, k1 long, k2 long, text string")


def met_here(key: np.ndarray, role: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of ``variants`` that have to meet others still, and a row of role ``MET`` for each line that the earliest one of
    these settles: of the lines under a key with a place only the earliest goes on, and a line that it settles
    needs no whole line either (but stays for longer ones, where it is a key's earliest or whole)."""
    order = np.argsort(key, kind="stable")
    new = np.append(fresh(key[order]), True)
    some = order[~(new[1:] & new[:-1])]
    some = some[np.lexsort((at[some], role[some], key[some]))]
    if not len(some):
        return key, role, at
    kind, line = role[some], at[some]
    new = fresh(key[some], kind)
    first = line[new][np.cumsum(new) - 1]
    later = (kind == 2) & (line != first)
    asks, earlier = least_of(line[later], first[later])
    left = np.ones(len(key), dtype=bool)
    left[some[later | ((kind == 0) & (line != first) & np.isin(line, asks))]] = False
    return (np.concatenate([key[left], earlier.view(U64)]), np.concatenate([role[left], np.full(len(asks), MET)]),
            np.concatenate([at[left], asks]))


def met(key: np.ndarray, role: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, earlier line near it), once a line, of all rows of some keys."""
    past = role == MET
    asks, earlier = [at[past]], [key[past].view(np.int64)]
    rest = np.flatnonzero(~past)
    rest = rest[np.argsort(key[rest], kind="stable")]
    new = np.append(fresh(key[rest]), True)
    rest = rest[~(new[1:] & new[:-1])]
    if len(rest):
        key, role, at = key[rest], role[rest], at[rest]
        new = fresh(key)
        # A changed word is met among its like; a word taken out against the whole shorter line, and the reverse.
        for mine, other in ((2, 2), (0, 1), (1, 0)):
            first = np.minimum.reduceat(np.where(role == other, at, np.iinfo(np.int64).max), np.flatnonzero(new))[np.cumsum(new) - 1]
            good = (role == mine) & (first < at)
            asks.append(at[good])
            earlier.append(first[good])
    return least_of(np.concatenate(asks), np.concatenate(earlier))


def least_of(name: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each name once, with its least value."""
    order = np.lexsort((value, name))
    name, value = name[order], value[order]
    first = fresh(name)
    return name[first], value[first]


def near_lines(wanted: DataFrame, firsts: DataFrame, texts: DataFrame) -> DataFrame:
    """``k1, k2`` of the distinct lines near an earlier line (``wanted``: candidates; ``firsts``: where each
    line is met first; ``texts``: k1, k2, text)."""
    # After a range partitioning by document and line the ids that Spark counts up follow that order.
    placed = cut(firsts.join(wanted, F.col("id") == F.col("k1"))
                 .select("k1", "k2", "half", "windows", "at.doc_id", "at.digest", F.col("at.line").alias("line"))
                 .repartitionByRange("doc_id", "digest", "line").sortWithinPartitions("doc_id", "digest", "line")
                 .select("k1", "k2", "half", "windows", F.monotonically_increasing_id().alias("at")))
    lines = cut(placed.join(texts.dropDuplicates(["k1", "k2"]), ["k1", "k2"]))

    def dealt(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, role, at = met_here(*(np.concatenate(c) for c in zip(*parts)))
        # What has met is dealt by its later line, as one line may have settled very many.
        return packed(np.where(role == MET, (at % BUCKETS).astype(np.uint16), bucket_of(key)), key, role, at)

    def neighbourhood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``bucket, block`` (``key, role, at``) of the lines' words, or of their characters where they have few words, or of both."""
        held, count = [], 0
        for part in rows_of(batches):
            texts, own = part.column(0).to_pylist(), part.column(1).to_numpy()
            plain = Plain(texts)
            n = plain.words
            chars = plain.stop - plain.start
            long = np.flatnonzero(n >= MIN_WORDS)
            short = np.array([k for k in np.flatnonzero((n <= MIN_WORDS) & (chars >= MIN_CHARS)).tolist()
                              if len(texts[k]) >= MIN_CHARS], dtype=np.int64)
            by_word = Lines(plain.hashes()[np.repeat(n >= MIN_WORDS, n)], n[long])
            for salt, mine, lines, least in ((U64(0), long, by_word, MIN_WORDS),
                                             (SPELLED, short, spelled([texts[k] for k in short.tolist()]), MIN_CHARS)):
                line, key, role = variants(lines, least)
                held.append((key ^ salt, role, own[mine[line]]))
                count += len(key)
            if count >= FLUSH:
                yield dealt(held)
                held, count = [], 0
        if count:
            yield dealt(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["bucket"]):
            found = met(*unpacked(group["block"].to_pylist(), U64, np.int8, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["at", "earlier"])

    around = lines.where("half").select("text", "at").mapInArrow(neighbourhood, "bucket int, block binary")
    pairs = (around.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "at long, earlier long")
             .groupBy("at").agg(F.min("earlier").alias("earlier")))
    one = verified(pairs, lines)
    settled = one.unionByName(far_lines(lines, one))
    return cut(placed.join(settled.distinct(), "at").select("k1", "k2"))


def verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """``at`` of the lines that are near the other line of a pair (``at, earlier``)."""
    other = lines.select(F.col("at").alias("earlier"), F.col("text").alias("_text"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches):
            good = [near(a, b) for a, b in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
            yield part.select([0]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(lines.select("at", "text"), "at").join(other, "earlier").select("at", "text", "_text")
    return cut(both.mapInArrow(verify, "at long").distinct())


def spots_of(words: np.ndarray) -> np.ndarray:
    return (words & U64(SPOTS - 1)).astype(np.int64)


def commonness(lines: DataFrame) -> Broadcast:
    """How many words of the lines fall on each of ``SPOTS`` spots, by their hash: a rough order of words from rare to common."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(SPOTS, dtype=np.int64)
        for part in rows_of(batches):
            found += np.bincount(spots_of(Plain(part.column(0).to_pylist()).hashes()), minlength=SPOTS)
        pieces = found.reshape(-1, PIECE_SPOTS)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary())],
                                         names=["piece", "found"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                whole[p] = whole.get(p, 0) + np.frombuffer(found, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(whole), pa.int32()), pa.array([x.tobytes() for x in whole.values()], pa.binary())],
                                         names=["piece", "found"])

    schema = "piece int, found binary"
    pieces = lines.where("size(windows) > 0").select("text").mapInArrow(count, schema).repartition("piece").mapInArrow(add, schema)
    out = np.zeros(SPOTS, dtype=np.int64)
    for row in pieces.toLocalIterator():
        out[row.piece * PIECE_SPOTS:][:PIECE_SPOTS] = np.frombuffer(row.found, np.int64)
    return lines.sparkSession.sparkContext.broadcast(out)


def rare_words(texts: list[str], firsts: list[str], common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of words of each text, their hashes): the words that a text needs among lines that share its first line: with a bound of k edits k + 1 of them,
    those that the first line lacks before the others, and rare ones before common ones."""
    of = []
    for plain in (Plain(texts), Plain(firsts)):
        line, word = np.repeat(np.arange(len(plain.words)), plain.words), plain.hashes()
        order = np.lexsort((word, line))
        line, word = line[order], word[order]
        new = fresh(line, word)
        of.append((line[new], word[new], plain.words))
    (line, word, n), (line2, word2, _) = of
    both_line, both_word = np.concatenate([line, line2]), np.concatenate([word, word2])
    order = np.lexsort((both_word, both_line))  # stable: a text's word stands before the same one of its first line
    held = np.zeros(len(both_line) + 1, dtype=bool)
    held[order[:-1]] = ~fresh(both_line[order], both_word[order])[1:]
    order = np.lexsort((word, common[spots_of(word)], held[:len(word)], line))
    place = np.arange(len(line)) - np.searchsorted(line, line)
    need = np.maximum(1, n // WORDS_PER_EDIT) + 1
    taken = place < need[line]
    return np.bincount(line[taken], minlength=len(n)), word[order][taken]


def told(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """``pairs`` (at, first, wide, done) with ``near`` (whether the line is near the first one; not looked at where it is done) and
    the ``words`` that it needs (where the pair is wide)."""
    common = commonness(lines)
    other = lines.select(F.col("at").alias("first"), F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches):
            wide, done, texts, firsts = (part.column(k).to_pylist() for k in range(2, 6))
            close = [not d and near(a, b) for a, b, d in zip(texts, firsts, done)]
            ends, some = np.zeros(len(wide) + 1, dtype=np.int32), np.flatnonzero(wide)
            ends[some + 1], found = rare_words([texts[k] for k in some], [firsts[k] for k in some], common.value)
            words = pa.ListArray.from_arrays(pa.array(np.cumsum(ends), pa.int32()), pa.array(found.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(4)), pa.array(close, pa.bool_()), words],
                                             names=["at", "first", "wide", "done", "near", "words"])

    both = pairs.join(lines.select("at", "text"), "at").join(other, "first").select("at", "first", "wide", "done", "text", "_text")
    return cut(both.mapInArrow(run, "at long, first long, wide boolean, done boolean, near boolean, words array<long>"))


def meetings(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """``first, word, i, j, asks, held, at, before``: lines that share their first line and a word that both need, dealt into cells,
    where every line that is open (``asks``; not in ``least``) meets every one that is ``held``. Lines that share a word of
    those that come ``before`` this one meet under that one too."""
    open_ = pairs.where("wide AND NOT done AND NOT near").join(least, "at", "left_anti") \
        .select("at", "first", F.lit(True).alias("_asks"))
    some = pairs.where("wide").join(open_.select("first").distinct(), "first", "left_semi").join(open_, ["at", "first"], "left")
    spread = some.select("first", F.posexplode("words").alias("place", "word"), "at", F.coalesce("_asks", F.lit(False)).alias("asks"), "words")
    spread = cut(spread.select("first", "word", "at", "asks", F.slice("words", F.lit(1), F.col("place")).alias("before")))
    sizes = spread.groupBy("first", "word").agg(F.count("*").alias("rows"), F.sum(F.col("asks").cast("long")).alias("asking")) \
        .where("rows > 1 AND asking > 0")
    # A row is held in one column of cells and asks in one row of cells; both meet in one cell.
    down, across = (F.ceil(F.col(c) / BLOCK_LINES).cast("int") for c in ("asking", "rows"))
    i, j = (F.pmod(F.xxhash64("at"), n).cast("int") for n in (down, across))
    column = F.transform(F.sequence(F.lit(0), down - 1), lambda x: F.struct(
        x.alias("i"), j.alias("j"), (F.col("asks") & (x == i)).alias("asks"), F.lit(True).alias("held")))
    row = F.transform(F.filter(F.sequence(F.lit(0), across - 1), lambda x: F.col("asks") & (x != j)), lambda x: F.struct(
        i.alias("i"), x.alias("j"), F.lit(True).alias("asks"), F.lit(False).alias("held")))
    return spread.join(sizes, ["first", "word"]).select("first", "word", "at", "before", F.explode(F.concat(column, row)).alias("cell")) \
        .select("first", "word", "cell.i", "cell.j", "cell.asks", "cell.held", "at", "before")


def far_lines(lines: DataFrame, one: DataFrame) -> DataFrame:
    """``at`` of the lines of ``FAR_WORDS`` words or more near an earlier one; of those in ``one`` some or none."""

    spots = lines.select(F.explode("windows").alias("key"), "at")
    first = spots.groupBy("key").agg(F.min("at").alias("first"), F.count("*").alias("rows")).where("rows > 1")
    later = spots.join(first, "key").where("at > first").groupBy("at", "first").agg(F.max(F.col("rows") > 2).alias("wide"))
    settled = one.select("at", F.lit(True).alias("_done")).distinct()
    later = later.join(settled, "at", "left").select("at", "first", "wide", F.coalesce("_done", F.lit(False)).alias("done"))
    pairs = told(later.where("wide OR NOT done"), lines)
    least = cut(pairs.where("near").select("at").distinct())
    # Keys of two lines are settled by the first; in longer ones the lines still open meet the later ones.
    cells = meetings(pairs, least)
    by = ["first", "word", "i", "j"]
    dealt = cells.join(lines.select("at", "text"), "at").repartition(*by) \
        .select(*by, "asks", "held", "at", "text", "before").sortWithinPartitions(*by)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = WordHash().of
        for group in runs(batches, by):
            asks, held, at = (group[c].to_pylist() for c in ("asks", "held", "at"))
            left = [k for k in range(len(at)) if asks[k]]
            right = [k for k in range(len(at)) if held[k]]
            if not left or not right or max(at[k] for k in left) <= min(at[k] for k in right):
                continue
            split = [units(t) for t in group["text"].to_pylist()]
            most = [bound(len(w)) for w in split]
            before = [frozenset(w) for w in group["before"].to_pylist()]
            many = len(left) * len(right) > FEW_PAIRS
            sets = [np.unique(of(w)) for w in split] if many else [set(w) for w in split]
            both = common_features([sets[k] for k in left], [sets[k] for k in right]) if many else None
            found = []
            for x, k in enumerate(left):
                # A word that the other line lacks costs an edit of its own.
                like = np.flatnonzero(len(sets[k]) - both[x] <= most[k] + 0.5).tolist() if many else range(len(right))
                for y in like:
                    o = right[y]
                    if at[o] < at[k] and abs(len(split[o]) - len(split[k])) <= most[k] \
                            and before[k].isdisjoint(before[o]) and (many or len(sets[k] - sets[o]) <= most[k]) \
                            and near_words(split[k], split[o]):
                        found.append(at[k])
                        break
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["at"])

    return least.unionByName(dealt.mapInArrow(compare, "at long"))


def dropped(lines: DataFrame, settled: DataFrame) -> DataFrame:
    """``lines`` with the row of their line in ``settled`` (k1, k2, first, near, copies)."""
    least = lines.count() // HOT_PART
    hot = F.broadcast(settled.where(F.col("copies") > least))  # fewer than HOT_PART rows
    few = lines.join(hot.select("k1", "k2"), ["k1", "k2"], "left_anti")
    return few.join(settled.where(F.col("copies") <= least), ["k1", "k2"]).unionByName(lines.join(hot, ["k1", "k2"]))


def mark(docs: DataFrame) -> DataFrame:
    """``row`` (the columns of ``docs`` but text), ``text`` without dropped lines, and the number of
    its lines with a word (``n_lines``), dropped as equal (``n_equal``) and as near (``n_near``)."""
    # The keys are most of a line's bytes: they are dealt once, and only lines that share some are told further.
    shared = key_blocks(docs).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(line_blocks, "bucket int, block binary")
    needs = cut(shared.repartition("bucket").sortWithinPartitions("bucket")
                .mapInArrow(needed, "id long, half boolean, windows array<long>, again boolean"), tidy=True)
    wanted = needs.where("half OR size(windows) > 0").select("id", "half", "windows")
    lines = cut(occurrences(docs, Filter(wanted.select("id")), Filter(needs.where("again").select("id"))))
    at = F.struct("doc_id", "digest", "line")
    firsts = cut(lines.groupBy("k1", "k2").agg(F.min(at).alias("at"), F.count("*").alias("copies")))
    close = near_lines(wanted, firsts, lines.where("text IS NOT NULL").select("k1", "k2", "text")) \
        .withColumn("near", F.lit(True))
    settled = cut(firsts.join(close, ["k1", "k2"], "left")
                  .select("k1", "k2", F.col("at").alias("first"), F.coalesce("near", F.lit(False)).alias("near"), "copies")
                  .where("near OR copies > 1"))
    lines = lines.drop("text")
    gone = cut(dropped(lines, settled).where(F.col("near") | (at != F.col("first")))
               .groupBy(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"))
               .agg(F.collect_set(F.struct("line", "near")).alias("gone")))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches):
            out = []
            for text, drop in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                split = text.split("\n") if text is not None else []
                full = sum(1 for s in split if s and not s.isspace())
                lost = {d["line"]: d["near"] for d in drop or ()}
                close = sum(lost.values())
                kept = text if not lost else "\n".join(s for i, s in enumerate(split) if i not in lost)
                out.append((kept, full, len(lost) - close, close))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))],
                names=["row", "text", "n_lines", "n_equal", "n_near"])

    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*rest).alias("row"), F.col("text").cast("string").alias("text"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_digest"))
    joined = join_bounded(rows, gone, same, "left") \
        .select("row", "text", "gone")
    schema = joined.select("row", "text").schema.add("n_lines", "integer").add("n_equal", "integer").add("n_near", "integer")
    return joined.mapInArrow(rebuild, schema)


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without the dropped lines; documents that lose all their lines go."""
    marked = mark(docs).where("n_lines = 0 OR n_equal + n_near < n_lines")
    return marked.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
