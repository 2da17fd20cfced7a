"""Token files in directly addressable codes.

An id is cut into chunks of 8 bits, the lowest in level 0. Level ``j`` holds
chunk ``j`` of the ids that have more than ``j`` chunks, in order, and a bitmap
that says which of them go on in level ``j + 1``; a rank directory keeps the
number of ones before every 512 bits. The place of token ``i`` in the next
level is the rank of its bit, so any token is read from its own chunks, without
decoding what lies before it.

A segment (some whole documents) is one binary value:

    magic "DAC1" | tokens u64 | levels u8 | per level: entries u64,
    chunks, bitmap bytes, directory (u64 a block)

The last level has no bitmap. Segments are stored by Spark's own writer as a
table, with the number of the writing partition and the tokens before it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.tokens import default_path, encoder
from palimpsest.session import scratch_path

_MAGIC = b"DAC1"
_BLOCK = 512
_ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)
SEGMENT_TOKENS = 1 << 20


def encode(ids: np.ndarray) -> bytes:
    """A segment of unsigned 32-bit ids."""
    parts, levels, rest = [], 0, ids.astype(np.uint32)
    while levels == 0 or len(rest):
        parts += [struct.pack("<Q", len(rest)), (rest & np.uint32(255)).astype(np.uint8).tobytes()]
        longer = rest > 255
        if longer.any():
            bits = np.packbits(longer, bitorder="little")
            padded = np.zeros(-(-len(rest) // _BLOCK) * (_BLOCK // 8), np.uint8)
            padded[: len(bits)] = bits
            per_block = _ONES[padded].reshape(-1, _BLOCK // 8).sum(axis=1)
            directory = np.cumsum(per_block) - per_block
            parts += [padded.tobytes(), directory.astype("<u8").tobytes()]
        rest = rest[longer] >> np.uint32(8)
        levels += 1
    return b"".join([_MAGIC, struct.pack("<QB", len(ids), levels), *parts])


class Segment:
    """Reads tokens of one encoded segment at any place."""

    def __init__(self, data: bytes):
        if data[:4] != _MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.tokens, levels = struct.unpack_from("<QB", data, 4)
        at = 13
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for level in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            chunks = np.frombuffer(data, np.uint8, n, at)
            at += n
            bitmap, directory = np.empty(0, np.uint8), np.empty(0, np.uint64)
            if level < levels - 1:
                blocks = -(-n // _BLOCK)
                bitmap = np.frombuffer(data, np.uint8, blocks * (_BLOCK // 8), at)
                at += len(bitmap)
                directory = np.frombuffer(data, "<u8", blocks, at)
                at += 8 * blocks
            self.levels.append((chunks, bitmap, directory))

    def _rank(self, level: int, i: int) -> int:
        """Ones before bit ``i``."""
        _, bitmap, directory = self.levels[level]
        block = i // _BLOCK
        start = block * (_BLOCK // 8)
        ones = int(directory[block]) + int(_ONES[bitmap[start : i // 8]].sum())
        return ones + int(_ONES[bitmap[i // 8] & ((1 << (i % 8)) - 1)]) if i % 8 else ones

    def token(self, i: int) -> int:
        """Token ``i`` alone."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value = 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if level == len(self.levels) - 1 or not bitmap[i // 8] >> (i % 8) & 1:
                break
            i = self._rank(level, i)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Tokens ``start`` to ``stop``: a run of places in every level."""
        out = np.zeros(max(0, stop - start), np.uint32)
        where = np.arange(len(out))
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            if not len(where):
                break
            out[where] |= chunks[start : start + len(where)].astype(np.uint32) << np.uint32(8 * level)
            if level == len(self.levels) - 1:
                break
            first = start // 8
            bits = np.unpackbits(
                bitmap[first : -(-(start + len(where)) // 8)], bitorder="little"
            )[start - 8 * first :][: len(where)].astype(bool)
            start, where = self._rank(level, start) if start < len(chunks) else 0, where[bits]
        return out


_SEGMENT = (
    "part int, nth int, before long, tokens long, doc_ids array<long>, lengths array<long>, "
    "codes binary"
)


def write(
    docs: DataFrame,
    path: str,
    end_id: int = 2,
    tokenizer: str | None = None,
    segment_tokens: int = SEGMENT_TOKENS,
) -> None:
    """Write all documents in ascending id order as segments under ``path``.

    Null ids come first; documents with equal ids go by their text. A null
    text is empty, that is the end id alone. An empty table gives an empty
    file. A document is never split, so a segment has ``segment_tokens`` and
    one document more at most.
    """
    model = tokenizer or default_path()
    end = np.uint32(end_id).tobytes()
    schema = pa.schema(
        [
            ("part", pa.int32()),
            ("nth", pa.int32()),
            ("before", pa.int64()),
            ("tokens", pa.int64()),
            ("doc_ids", pa.list_(pa.int64())),
            ("lengths", pa.list_(pa.int64())),
            ("codes", pa.binary()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text, part = encoder(model).encode, TaskContext.get().partitionId()
        nth = before = held = 0
        ids: list[int | None] = []
        texts: list[bytes] = []

        def segment() -> pa.RecordBatch:
            codes = encode(np.frombuffer(b"".join(texts), "<u4"))
            row = (part, nth, before, held // 4, ids, [len(t) // 4 for t in texts], codes)
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema
            )

        for batch in batches:
            for doc_id, text in zip(
                batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True
            ):
                ids.append(doc_id)
                texts.append(encode_text(text) + end)
                held += len(texts[-1])
                if held >= 4 * segment_tokens:
                    yield segment()
                    nth, before, held, ids, texts = nth + 1, before + held // 4, 0, [], []
        if ids:
            yield segment()

    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    tie = F.xxhash64("text")
    shuffled = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = named.repartitionByRange(
        # The last key only parts equal rows, which may come in any order.
        shuffled, "doc_id", tie, F.rand(0)
    ).sortWithinPartitions("doc_id", tie, "text")
    ordered.mapInArrow(run, _SEGMENT).write.parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The stored segments, each with ``start``: the tokens of all before it."""
    rows = spark.read.schema(_SEGMENT).parquet(path)
    # A row per writing task.
    totals = rows.groupBy("part").agg(F.sum("tokens").alias("in_part"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("offset")
    )
    return rows.join(F.broadcast(offsets), "part").withColumn(
        "start", F.col("offset") + F.col("before")
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every stored document, its
    tokens taken out of the segment by their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stored = Segment(row["codes"])
                lengths = np.array(row["lengths"], np.int64)
                stops = np.cumsum(lengths)
                crcs = [
                    zlib.crc32(stored.slice(a, b).astype("<u4").tobytes())
                    for a, b in zip(stops - lengths, stops, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(row["start"] + stops - lengths),
                        pa.array(lengths),
                        pa.array(crcs, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    rows = segments(spark, path).select("start", "doc_ids", "lengths", "codes")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def through_files(docs: DataFrame) -> DataFrame:
    """Write all documents to the shared folder and read them back."""
    path = scratch_path(docs.sparkSession, "dac")
    write(docs, path)
    return read(docs.sparkSession, path)
