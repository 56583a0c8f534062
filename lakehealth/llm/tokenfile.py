"""Token files with directly addressable codes.

Ids are cut into 8-bit chunks. Level 0 holds the lowest chunk of every id and one
continuation bit per id; level 1 holds the next chunk of the ids that have one, and
so on. A rank directory (ones before every 512-bit block of a level's bitmap) leads
from a position of one level to its position in the next, so any single token is
read with one rank per level and nothing is decoded in blocks (``Segment.token``).

``write_token_files`` encodes the texts with the tokenizers library and writes the
ids in ascending document order as Parquet rows of one segment each: part, number in
the part, tokens of the part before it, document ids, token offsets and the coded
bytes. ``read_documents`` reads the files back, ``read_token`` one token.

Edge cases: a null text is an empty text (its only id is the end id); null ids sort
first; rows that share an id are ordered by a hash of their text and keep one row
each; a document is never split, so a longer one makes a longer segment; an empty
table writes files without rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakehealth.llm.common import ensure_checkpoint_dir, rows_of
from lakehealth.llm.pieces import PieceEncoder

#: Tokens after which a segment is closed at the next document end.
SEGMENT_TOKENS = 1 << 18
#: Bits between two entries of a rank directory.
RANK_BITS = 512
MAGIC = b"DAC1"
#: Entries of each of a worker's two caches of encoded pieces.
CACHE_PIECES = 1_100_000


def pack(ids: np.ndarray) -> bytes:
    """The coded bytes of unsigned 32-bit ids."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest > 255
        chunks = (rest & 255).astype(np.uint8)
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.uint32) \
            if len(more) else np.zeros(0, np.uint32)
        ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4") if len(ones) else ones
        levels.append((len(chunks), chunks.tobytes(), bits.tobytes(), ranks.astype("<u4").tobytes()))
        if not more.any():
            break
        rest = rest[more] >> 8
    head = MAGIC + struct.pack("<I", len(levels)) + b"".join(struct.pack("<Q", x[0]) for x in levels)
    return head + b"".join(c + b + r for _, c, b, r in levels)


class Segment:
    """Reader of one segment's bytes."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token segment")
        (n,) = struct.unpack_from("<I", data, 4)
        counts = struct.unpack_from(f"<{n}Q", data, 8)
        at, self.levels = 8 + 8 * n, []
        for count in counts:
            chunks = np.frombuffer(data, np.uint8, count, at)
            at += count
            bits = np.frombuffer(data, np.uint8, -(-count // 8), at)
            at += len(bits)
            ranks = np.frombuffer(data, "<u4", -(-count // RANK_BITS), at)
            at += 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def token(self, position: int) -> int:
        """One id, by one rank per level."""
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[position]) << shift
            byte, bit = divmod(position, 8)
            if not bits[byte] >> bit & 1:
                return value
            block = position // RANK_BITS
            first = block * RANK_BITS // 8
            before = bits[first:byte].tobytes() + bytes([int(bits[byte]) & ((1 << bit) - 1)])
            position = int(ranks[block]) + int.from_bytes(before, "little").bit_count()
            shift += 8
        return value

    def tokens(self) -> np.ndarray:
        """All ids."""
        value = None
        for chunks, bits, _ in reversed(self.levels):
            out = chunks.astype(np.uint32)
            if value is not None:
                out[np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)] |= value << 8
            value = out
        return value


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters for themselves, the others, in order, from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class LibraryEncoder:
    """The tokenizers library behind a cache of pieces.

    Matches of the byte-level pattern go to the library's BPE model; what the cache cannot cut and texts
    with a special token's string go through the library whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, self.alphabet = self.library.model, byte_alphabet()
        self.space = self.alphabet[ord(" ")]
        self.ids = [struct.pack("<I", i) for i in range(self.library.get_vocab_size())]
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.pieces = PieceEncoder(self.match, self.whole, most=CACHE_PIECES)

    def whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def match(self, match: str) -> bytes:
        if match.isascii() and match.isprintable():
            plain = match.replace(" ", self.space)
        else:
            plain = match.encode().decode("latin-1").translate(self.alphabet)
        tokens = self.model.tokenize(plain)
        return self.ids[tokens[0].id] if len(tokens) == 1 else b"".join([self.ids[t.id] for t in tokens])

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if text and any(s in text for s in self.special):
            return self.whole(text)
        return self.pieces.encode(text)


_encoders: dict[str, LibraryEncoder] = {}


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode, append ``end_id`` to each document, and write the files under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _encoders:
            _encoders[tokenizer_path] = LibraryEncoder(tokenizer_path)
        enc, end = _encoders[tokenizer_path], struct.pack("<I", end_id)
        part = number = before = held = 0
        ids: list[bytes] = []
        doc_ids: list[int | None] = []
        offsets = [0]

        def segment() -> pa.RecordBatch:
            blob = pack(np.frombuffer(b"".join(ids), dtype="<u4"))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([before], pa.int64()),
                 pa.array([held], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())),
                 pa.array([offsets], pa.list_(pa.int64())), pa.array([blob], pa.binary())],
                names=["part", "number", "before", "n_tokens", "doc_ids", "offsets", "codes"])

        for rows in rows_of(batches):
            part = rows.column(2)[0].as_py()
            for doc_id, coded in zip(rows.column(0).to_pylist(), map(enc.encode, rows.column(1).to_pylist())):
                ids += [coded, end]
                held += len(coded) // 4 + 1
                doc_ids.append(doc_id)
                offsets.append(held)
                if held >= SEGMENT_TOKENS:
                    yield segment()
                    number, before = number + 1, before + held
                    ids, doc_ids, offsets, held = [], [], [0], 0
        if doc_ids:
            yield segment()

    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text", F.spark_partition_id().alias("part"))
    )
    schema = "part int, number long, before long, n_tokens long, doc_ids array<long>, offsets array<long>, codes binary"
    ordered.mapInArrow(run, schema).write.option("compression", "none").parquet(path)


def _starts(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(part, tokens before it); one row per written part, not per document."""
    totals = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    starts, total = [], 0
    for part, n in totals:
        starts.append((part, total))
        total += n
    return starts


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone."""
    starts = dict(_starts(spark, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches, 1):
            row = rows.to_pylist()[0]
            ids = Segment(row["codes"]).tokens().astype("<u4")
            offsets = np.array(row["offsets"])
            first = starts[row["part"]] + row["before"]
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(offsets[:-1] + first, pa.int64()),
                 pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.read.parquet(path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_token(spark: SparkSession, path: str, position: int) -> int:
    """The id at a position of the whole corpus: one segment is read, one token decoded."""
    part, start = max((x for x in _starts(spark, path) if x[1] <= position), key=lambda x: (x[1], x[0]))
    inside = position - start
    row = (spark.read.parquet(path)
           .where((F.col("part") == part) & (F.col("before") <= inside)
                  & (F.col("before") + F.col("n_tokens") > inside))
           .select("before", "codes").first())
    if row is None:
        raise IndexError(position)
    return Segment(bytes(row["codes"])).token(inside - row["before"])


def fresh_path(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
