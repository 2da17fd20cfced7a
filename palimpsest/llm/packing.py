"""First-fit decreasing packing with a tournament tree of bin capacities.

A document is cut into whole sequences and a rest; the pieces are dealt to
random groups of about ``group`` pieces, and each group packs itself. A group
is a bounded task whatever the corpus, and thousands of pieces in one group
leave first-fit decreasing almost no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import tokens
from palimpsest.llm.common import trimmed
from palimpsest.llm.tokens import default_path, encoder
from palimpsest.session import materialize

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@dataclass(frozen=True)
class Settings:
    capacity: int = 2048
    end_id: int = 1
    group: int = 8192
    tokenizer: str | None = None


class CapacityTree:
    """Free space of bins 0, 1, ..; every inner node holds its larger child."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < bins:
            self.leaves *= 2
        self.free = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """The first bin with room for ``length``, and its space before."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < length:
                node += 1
        was = free[node]
        free[node] = was - length
        bin_ = node - self.leaves
        while node > 1:
            node //= 2
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
        return bin_, was


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; no length exceeds ``capacity``. Equal
    lengths go in the order given."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree = CapacityTree(max(1, len(lengths)), capacity)
    for i in np.argsort(-lengths, kind="stable"):
        bins[i], was = tree.place(int(lengths[i]))
        offsets[i] = capacity - was
    return bins, offsets


def pieces(docs: DataFrame, settings: Settings | None = None, with_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most ``capacity`` tokens.

    ``doc_id, start, length, ids_crc32, doc_tokens``, and with ``with_ids``
    the ids themselves as little-endian unsigned 32-bit integers in ``ids``.
    A null or empty text is the end id alone. Ids may be null or repeat.
    """
    settings = settings or Settings()
    path = settings.tokenizer or default_path()
    end = np.uint32(settings.end_id).tobytes()
    step = 4 * settings.capacity
    schema = pa.schema(
        [(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
        + [("ids", pa.binary())] * with_ids
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            found: list[tuple] = []
            held = 0
            for doc_id, text in zip(
                batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True
            ):
                ids = encode(text) + end
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    row = (doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4)
                    found.append((*row, part) if with_ids else row)
                    held += len(part) if with_ids else 0
                if held > 1 << 24:
                    yield _batch(found, schema)
                    found, held = [], 0
            yield _batch(found, schema)

    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    return named.mapInArrow(trimmed(run, tokens.CACHE), _PIECE + (", ids binary" if with_ids else ""))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def pack(docs: DataFrame, settings: Settings | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with ``sequence_id`` and ``offset``.

    Every sequence holds ``capacity`` tokens at most, its pieces gapless from
    offset 0. Numbers of sequences are unique, not gapless. An empty table
    gives no row.
    """
    settings = settings or Settings()
    cut = pieces(docs, settings, with_ids).withColumn("piece", F.monotonically_increasing_id())
    cut = materialize(cut, "pieces")
    groups = max(1, -(-cut.count() // settings.group))
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("piece"), F.lit(groups)))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("piece")
        bins, offsets = first_fit_decreasing(group.column("length").to_numpy(), settings.capacity)
        sequence = (group.column("group").to_numpy() << 32) + bins
        group = group.drop_columns(["piece", "group"])
        return group.append_column("sequence_id", pa.array(sequence)).append_column(
            "offset", pa.array(offsets)
        )

    fields = ", ".join(f"{n} {t}" for n, t in cut.drop("piece").dtypes)
    fields = fields.replace("bigint", "long")
    return dealt.groupBy("group").applyInArrow(run, f"{fields}, sequence_id long, offset long")
