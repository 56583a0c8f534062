"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string exactly one token can end the prefix's BPE
encoding. ``PrefixCoder`` stores that last token per prefix: the token ``t``
ending at ``i`` is the one whose start ``j`` has a last token ``s`` such that the
pair ``(s, t)`` survives encoding on its own. Following the stored tokens from
the end gives the encoding. The table of a prefix never depends on what
follows, so appending bytes only adds entries, and after an edit entries are
recomputed from the edit on until they agree with the old ones over a whole
maximal token length (``PrefixText``).

``PrefixCoder.encode`` needs the entries of the token boundaries only. It asks for the last one, and that for the entries
its candidates stand behind; those of other prefixes, most of a word's, are never worked out. Longer strings get the
whole table.

``encode_documents`` applies it to a table: every match of the split pattern is
encoded on its own, as rank-file encoders do.

Edge cases: a null text is an empty text and gives no ids; repeated rows and
repeated ids give one row each; columns other than the id and the text are
ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakehealth.llm.common import rows_of
from lakehealth.llm.pieces import PieceEncoder

#: Bytes up to which ``encode`` asks for entries from the end back; each may ask for one before it.
SHORT = 200


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> id of a rank file (base64 token, space, rank per line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


class PrefixCoder:
    """Encoder and decoder of one rank vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                for cut in range(1, len(token)):
                    left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                    if left is not None and right is not None and left < rank and right < rank \
                            and self._survives(left, right):
                        self.parts[rank] = left, right
                        self.merged[left, right] = rank
                        break
        #: token bytes that merging can reach; only these can stand in an encoding.
        self.reachable = {t: r for t, r in ranks.items() if len(t) == 1 or r in self.parts}

    def _survives(self, left: int, right: int) -> bool:
        """Whether the bytes of two tokens, encoded together, give these two tokens.

        The merges that made the two tokens are undone from the latest back; the pair
        breaks if at some moment the two parts at the seam would have merged before the
        merges still standing were made."""
        made = self.merged
        bound = 1 << 62  # merges at or after this rank come too late to break the pair
        while True:
            joined = made.get((left, right))
            if joined is not None and joined < bound:
                return False
            open_left, open_right = self.parts.get(left), self.parts.get(right)
            if open_left is None and open_right is None:
                return True
            # Undo the later of the two merges. At equal rank the left one was made first.
            if open_right is None or (open_left is not None and left > right):
                bound, left = left, open_left[1]
            else:
                bound, right = right + 1, open_right[0]

    def pair(self, left: int, right: int) -> bool:
        key = left, right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 200_000:
                self._pairs.clear()
            known = self._pairs[key] = self._survives(left, right)
        return known

    def extend(self, data: bytes, last: list[int], upto: int | None = None) -> None:
        """Add the last tokens of the prefixes of ``data`` beyond those in ``last``."""
        get, tokens, pair, longest = self.reachable.get, self.tokens, self.pair, self.longest
        for end in range(len(last) + 1, (len(data) if upto is None else upto) + 1):
            for start in range(max(0, end - longest), end):
                token = get(data[start:end])
                if token is not None and (start == 0 or pair(last[start - 1], token)):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def walk(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            token = last[end - 1]
            out.append(token)
            end -= len(self.tokens[token])
        return out[::-1]

    def entry(self, data: bytes, end: int, last: list[int | None]) -> int:
        """The last token of the prefix up to ``end``, which is kept in ``last``, as are the entries it asks for."""
        get = self.reachable.get
        for start in range(max(0, end - self.longest), end):
            token = get(data[start:end])
            if token is not None:
                if start:
                    before = last[start]
                    if before is None:
                        before = self.entry(data, start, last)
                    stands = self._pairs.get((before, token))
                    if not (self.pair(before, token) if stands is None else stands):
                        continue
                last[end] = token
                return token
        raise ValueError("the vocabulary lacks a byte")

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(data) > SHORT:
            last: list[int] = []
            self.extend(data, last)
            return self.walk(last)
        known: list[int | None] = [None] * (len(data) + 1)
        out, end = [], len(data)
        while end:
            token = known[end]
            if token is None:
                token = self.entry(data, end, known)
            out.append(token)
            end -= len(self.tokens[token])
        return out[::-1]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PrefixText:
    """Bytes with the last token of each prefix: exact appends and cheap edits."""

    def __init__(self, coder: PrefixCoder, data: bytes = b""):
        self.coder, self.data, self.last, self.recomputed = coder, b"", [], 0
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        before = len(self.last)
        self.coder.extend(self.data, self.last)
        self.recomputed = len(self.last) - before

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Replace ``data[start:end]``; prefixes before ``start`` keep their entries, and
        recomputing stops once a whole token length of entries is as it was."""
        old_last, shift, longest = self.last, len(new) - (end - start), self.coder.longest
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old_last[:start]
        agree, at = 0, start
        while at < len(self.data):
            self.coder.extend(self.data, self.last, at + 1)
            at += 1
            # The entry at `at` repeats the old one only if its token lies in unchanged bytes.
            same = at > start + len(new) and self.last[at - 1] == old_last[at - 1 - shift]
            agree = agree + 1 if same else 0
            if agree >= longest:
                self.last += old_last[at - shift:]
                break
        self.recomputed = at - start

    def ids(self) -> list[int]:
        return self.coder.walk(self.last)


class TextEncoder:
    """Whole texts to ids, with caches for the worker's life."""

    def __init__(self, coder: PrefixCoder, pattern: str):
        self.coder, self.matches = coder, regex.compile(pattern).findall
        self.pieces = PieceEncoder(self.match, self.by_pattern, pattern)

    def match(self, match: str) -> bytes:
        ids = self.coder.encode(match.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def by_pattern(self, text: str) -> bytes:
        return b"".join(map(self.pieces.match, self.matches(text)))

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.pieces.encode(text)


_encoders: dict[tuple[str, str], TextEncoder] = {}


def encoder(ranks_path: str, pattern: str) -> TextEncoder:
    key = ranks_path, pattern
    if key not in _encoders:
        _encoders[key] = TextEncoder(PrefixCoder(read_ranks(ranks_path)), pattern)
    return _encoders[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN,
                     id_col: str = "doc_id", text_col: str = "text",
                     keep_text: bool = False) -> DataFrame:
    """Ids of every text and the text decoded from them, one row per input row.

    ``doc_id, ids binary (little-endian unsigned 32-bit), n_tokens, ids_sha256,
    decoded_sha256`` and, with ``keep_text``, ``decoded string``.
    """
    schema = "doc_id long, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string" \
        + (", decoded string" if keep_text else "")
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        types = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for part in rows_of(batches):
            rows = []
            for text in part.column(1).to_pylist():
                ids = enc.encode(text)
                decoded = enc.coder.decode(np.frombuffer(ids, dtype="<u4").tolist())
                rows.append((ids, len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                             hashlib.sha256(decoded).hexdigest(),
                             *([decoded.decode()] if keep_text else [])))
            columns = [part.column(0), *(list(c) for c in zip(*rows))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=names)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                         F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, schema)
