"""Byte passages that occur earlier in the corpus, exact to the byte.

Every string of ``size`` bytes (a window) is known by a sampled place in it: the
least hash among its runs of ``k`` bytes, the same place in every equal window.
A sampled place stands for all windows that chose it, and is named by its run
and by the bytes that those windows span together. Names are sorted over the
whole corpus; neighbours that agree in both are whole copies and only the first
of them stays, a run with a single name has no partner, and what is left -
places whose run occurs in several surroundings - goes to the next level, with
longer runs. On the last level the run is the window itself, so every window is
decided by equality of its bytes' 96-bit names.

Documents travel in batches, one to a row, and each level only hands on the
bytes around windows that are still open.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.kernels import mix
from palimpsest.operators.ordering import with_index
from palimpsest.session import materialize, spread

# Text bytes of a batch; a longer document is a batch of its own.
BATCH_BYTES = 1 << 20

_SEEDS = np.arange(256, dtype=np.uint64)
_U32 = np.uint64(32)


@dataclass(frozen=True)
class Settings:
    size: int = 100
    # Run lengths of the levels; the last must be the size.
    runs: tuple[int, ...] = (32, 84, 100)


class _Fingerprints:
    """Fingerprints of any stretch of a byte string from sums over its begin."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, which: int):
        base = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)[which]
        known = self._powers.get(which)
        if known is None or len(known[0]) <= len(data):
            n = max(BATCH_BYTES + 4096, len(data) + 1)
            both = []
            for b in (base, pow(base, -1, 1 << 64)):
                steps = np.full(n, b, np.uint64)
                steps[0] = 1
                both.append(np.cumprod(steps))
            known = self._powers[which] = tuple(both)
        self._back = known[1]
        letters = mix(_SEEDS + np.uint64(0x51_7C_C1_B7 + which))
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(letters[data] * known[0][: len(data)], out=self._sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self._sums[stop] - self._sums[start]) * self._back[start])

    def runs(self, k: int) -> np.ndarray:
        n = len(self._sums) - k
        return mix((self._sums[k:] - self._sums[:n]) * self._back[:n])


# Bits of a value that ``_least`` gives up for its place, and so the values it
# handles at once.
_PLACE_BITS = 24


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` values the place of its first least one.

    Values are compared by all but their last bits, where the place goes; equal
    windows choose the same place all the same, because the first wins.
    """
    n = max(0, len(values) - width + 1)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    out = np.empty(n, np.int32 if len(values) < 1 << 31 else np.int64)
    step = (1 << _PLACE_BITS) - width + 1
    for at in range(0, n, step):
        part = values[at : at + step + width - 1]
        least, done = (part & ~low) | np.arange(len(part), dtype=np.uint64), 1
        while done < width:
            shift = min(done, width - done)
            least = np.minimum(least[:-shift], least[shift:])
            done += shift
        out[at : at + step] = (least & low).astype(np.int64) + at
    return out


@dataclass
class Pieces:
    """Stretches of the documents of one batch.

    ``data`` holds them one after the other, ``bounds`` where each begins there
    and ``origin`` where in the batch; ``open`` marks the windows to decide.
    ``ords`` and ``begins`` are the batch's documents.
    """

    data: np.ndarray
    bounds: np.ndarray
    origin: np.ndarray
    open: np.ndarray
    ords: np.ndarray
    begins: np.ndarray


@dataclass
class Places:
    """Sampled places with the windows ``first`` to ``last`` that chose them."""

    first: np.ndarray
    last: np.ndarray
    h: np.ndarray
    c: np.ndarray
    ord: np.ndarray
    pos: np.ndarray


def sampled(pieces: Pieces, k: int, size: int) -> Places:
    """The places of all open windows of a batch."""
    width = size - k + 1
    starts = np.flatnonzero(pieces.open)
    none = np.empty(0, np.int64)
    if not len(starts):
        return Places(none, none, none, none, none, none)
    run, around = _Fingerprints(pieces.data, 0), _Fingerprints(pieces.data, 1)
    hashes = run.runs(k)
    chosen = _least(hashes, width)[starts].astype(np.int64)
    head = np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)))
    first = np.flatnonzero(head)
    place = chosen[first]
    piece = np.searchsorted(pieces.bounds, place, "right") - 1
    low = np.maximum(place - (width - 1), pieces.bounds[piece])
    high = np.minimum(place + size, pieces.bounds[piece + 1])
    in_batch = pieces.origin[piece] + place - pieces.bounds[piece]
    doc = np.searchsorted(pieces.begins, in_batch, "right") - 1
    return Places(
        starts[first],
        starts[np.append(first[1:], len(starts)) - 1],
        hashes[place].view(np.int64),
        (around.of(low, high) >> _U32).astype(np.int64),
        pieces.ords[doc],
        in_batch - pieces.begins[doc],
    )


def _match(places: Places, h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each place the index of its name among the given ones, or -1."""

    def key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(a.view(np.uint64) + b.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    if not len(h):
        return np.full(len(places.h), -1)
    keys = key(h, c)
    order = np.argsort(keys)
    at = order[np.minimum(np.searchsorted(keys[order], key(places.h, places.c)), len(keys) - 1)]
    return np.where((h[at] == places.h) & (c[at] == places.c), at, -1)


def _marks(starts: np.ndarray, stops: np.ndarray, n: int) -> np.ndarray:
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, stops, -1)
    return np.cumsum(change, out=change)[:n] > 0


def _ranges(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(mask.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _around(pieces: Pieces, opened: np.ndarray, margin: int, size: int) -> Pieces:
    """The stretches around open windows with ``margin`` bytes at both sides."""
    n = len(pieces.data)
    starts = np.flatnonzero(opened)
    piece = np.searchsorted(pieces.bounds, starts, "right") - 1
    low = np.maximum(starts - margin, pieces.bounds[piece])
    high = np.minimum(starts + size + margin, pieces.bounds[piece + 1])
    a, b = _ranges(_marks(low, high, n))
    # A stretch over the border of two pieces is two.
    inner = pieces.bounds[1:-1]
    inside = np.searchsorted(a, inner, "right") - 1
    cut = inner[(inside >= 0) & (inner > a[inside]) & (inner < b[inside])] if len(a) else inner[:0]
    a, b = np.sort(np.concatenate((a, cut))), np.sort(np.concatenate((b, cut)))
    keep = _marks(a, b, n)
    piece = np.searchsorted(pieces.bounds, a, "right") - 1
    return Pieces(
        pieces.data[keep],
        np.concatenate(([0], np.cumsum(b - a))),
        pieces.origin[piece] + a - pieces.bounds[piece],
        opened[keep],
        pieces.ords,
        pieces.begins,
    )


_ROW = (
    "batch long, ords array<long>, begins array<long>, bounds array<long>, origin array<long>, "
    "open binary, data binary, ids array<long>"
)
_ROW_SCHEMA = pa.schema(
    [("batch", pa.int64())]
    + [(c, pa.list_(pa.int64())) for c in ("ords", "begins", "bounds", "origin")]
    + [("open", pa.binary()), ("data", pa.binary()), ("ids", pa.list_(pa.int64()))]
)


def _packed(data: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(data.tobytes(), 3)


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(data), np.uint8)


def _stored(number: int, pieces: Pieces, ids: list) -> pa.RecordBatch:
    row = (
        number,
        pieces.ords,
        pieces.begins,
        pieces.bounds,
        pieces.origin,
        _packed(np.packbits(pieces.open)),
        _packed(pieces.data),
        ids,
    )
    return pa.RecordBatch.from_arrays(
        [pa.array([v], f.type) for v, f in zip(row, _ROW_SCHEMA, strict=True)], schema=_ROW_SCHEMA
    )


def _loaded(row: dict) -> Pieces:
    data = _unpacked(row["data"])
    ints = (np.array(row[c], np.int64) for c in ("bounds", "origin", "ords", "begins"))
    bounds, origin, ords, begins = ints
    opened = np.unpackbits(_unpacked(row["open"]))[: len(data)].astype(bool)
    return Pieces(data, bounds, origin, opened, ords, begins)


def _batches(docs: DataFrame, size: int) -> DataFrame:
    """All documents, whole, some to a row; every window is open."""

    def row(number: int, ids: list, ords: list, texts: list[bytes]) -> pa.RecordBatch:
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        data = np.frombuffer(b"".join(texts), np.uint8)
        long = np.flatnonzero(np.diff(bounds) >= size)
        opened = _marks(bounds[long], bounds[long + 1] - size + 1, len(data))
        pieces = Pieces(data, bounds, bounds[:-1], opened, np.array(ords, np.int64), bounds)
        return _stored(number, pieces, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, ords, texts, held = [], [], [], 0
        for batch in batches:
            column = batch.column("text")
            for i, (doc_id, ord_) in enumerate(
                zip(batch.column("doc_id").to_pylist(), batch.column("ord").to_pylist(), strict=True)
            ):
                text = (column[i].as_py() or "").encode()
                if ids and held + len(text) > BATCH_BYTES:
                    yield row(number, ids, ords, texts)
                    number, ids, ords, texts, held = number + 1, [], [], [], 0
                ids.append(doc_id)
                ords.append(ord_)
                texts.append(text)
                held += len(text)
        if ids:
            yield row(number, ids, ords, texts)

    return docs.mapInArrow(run, _ROW)


def _names(stored: DataFrame, k: int, size: int) -> DataFrame:
    """``h, c, ord, pos, batch, more``: the first place of each name in each
    batch, and whether the batch has more of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                p = sampled(_loaded(row), k, size)
                order = np.lexsort((p.pos, p.ord, p.c, p.h))
                h, c = p.h[order], p.c[order]
                head = np.ones(len(order), bool)
                head[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
                first = np.flatnonzero(head)
                more = np.diff(np.append(first, len(order))) > 1
                at = order[first]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(p.h[at]),
                        pa.array(p.c[at]),
                        pa.array(p.ord[at]),
                        pa.array(p.pos[at]),
                        pa.array(np.full(len(at), row["batch"])),
                        pa.array(more),
                    ],
                    ["h", "c", "ord", "pos", "batch", "more"],
                )

    return stored.mapInArrow(run, "h long, c long, ord long, pos long, batch long, more boolean")


def _verdicts(names: DataFrame) -> DataFrame:
    """Names that occur more than once or whose run has several: where the
    first is, and whether its windows stay open. One sort by run and name."""
    name, run = Window.partitionBy("h", "c"), Window.partitionBy("h")
    place = F.struct("ord", "pos")
    judged = names.repartition("h").select(
        "h",
        "c",
        "batch",
        F.min(place).over(name).alias("first"),
        (F.max("more").over(name) | (F.count("*").over(name) > 1)).alias("copied"),
        (F.min("c").over(run) != F.max("c").over(run)).alias("open"),
    )
    return judged.filter("copied or open").select("batch", "h", "c", "first.ord", "first.pos", "open")


def _level(stored: DataFrame, k: int, margin: int, size: int) -> DataFrame:
    """One level: rows of the next one, and ``dup``: begins and ends of ranges
    of windows that occur earlier, in places of the batch."""

    def decide(key: tuple, rows: pa.Table, known: pa.Table) -> pa.Table:
        row = rows.to_pylist()[0]
        pieces = _loaded(row)
        p = sampled(pieces, k, size)
        h, c, ord_, pos = (known.column(x).to_numpy() for x in ("h", "c", "ord", "pos"))
        at = _match(p, h, c)
        named = at >= 0
        is_first = np.zeros(len(at), bool)
        is_first[named] = (ord_[at[named]] == p.ord[named]) & (pos[at[named]] == p.pos[named])
        opens = known.column("open").to_numpy(zero_copy_only=False).astype(bool)
        goes_on = is_first.copy()
        goes_on[named] &= opens[at[named]]
        copies = named & ~is_first
        # Windows of a place are consecutive, in one piece.
        first, last = p.first[copies], p.last[copies]
        piece = np.searchsorted(pieces.bounds, first, "right") - 1
        shift = pieces.origin[piece] - pieces.bounds[piece]
        opened = _marks(p.first[goes_on], p.last[goes_on] + 1, len(pieces.data))
        after = _around(pieces, opened, margin, size)
        out = _stored(row["batch"], after, [])
        dup = np.stack((first + shift, last + shift + 1), axis=1).astype("<i8").tobytes()
        return pa.Table.from_batches([out]).append_column("dup", pa.array([dup], pa.binary()))

    verdicts = _verdicts(_names(stored, k, size))
    return stored.groupBy("batch").cogroup(verdicts.groupBy("batch")).applyInArrow(
        decide, _ROW + ", dup binary"
    )


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _removed(whole: bool, size: int):
    def finish(key: tuple, rows: pa.Table, found: pa.Table) -> pa.Table:
        row = rows.to_pylist()[0]
        data = _unpacked(row["data"])
        bounds = np.array(row["bounds"], np.int64)
        dup = np.concatenate(
            [np.frombuffer(d, "<i8").reshape(-1, 2) for d in found.column("dup").to_pylist()]
            or [np.empty((0, 2), np.int64)]
        )
        gone = _marks(dup[:, 0], dup[:, 1] + size - 1, len(data))
        columns: list[list] = [[] for _ in range(5 + whole)]
        for i, doc_id in enumerate(row["ids"]):
            mine = gone[bounds[i] : bounds[i + 1]]
            kept = data[bounds[i] : bounds[i + 1]][~mine].tobytes()
            values = [
                doc_id,
                len(mine),
                int(mine.sum()),
                len(_ranges(mine)[0]),
                hashlib.sha256(kept).hexdigest(),
            ]
            for column, value in zip(columns, [*values, kept] if whole else values, strict=True):
                column.append(value)
        fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64())]
        fields += [("n_spans", pa.int64()), ("kept_sha256", pa.string())]
        schema = pa.schema(fields + [("kept", pa.binary())] * whole)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return finish


def _ordered(docs: DataFrame) -> DataFrame:
    """Documents with ``ord``, a number that rises with the id: the id itself
    where all are there and differ, else a row number (null ids first, equal
    ids by text)."""
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    ids = named.groupBy("doc_id").count()
    if ids.filter("count > 1 or doc_id is null").isEmpty():
        return named.withColumn("ord", F.col("doc_id"))
    return with_index(named, [F.asc_nulls_first("doc_id"), F.xxhash64("text"), F.col("text")], "ord")


def without_repeats(
    docs: DataFrame, settings: Settings | None = None, whole: bool = False
) -> DataFrame:
    """Every document without the bytes that a window starting earlier covers.

    Earlier is a smaller id, or a smaller place in the same document; rows of
    equal id go by their text and null ids come first. Windows never cross
    documents and are judged on the texts as they are given. ``n_bytes``,
    ``n_removed``, ``n_spans`` (maximal removed stretches) and ``kept_sha256``;
    with ``whole`` also the bytes left, ``kept``. A null text is empty; a text
    shorter than a window stays whole. An empty table gives no row.
    """
    settings = settings or Settings()
    size, ks = settings.size, settings.runs
    base = materialize(_batches(spread(_ordered(docs), "doc_id"), size), "batches")
    stored, found = base, []
    for i, k in enumerate(ks):
        margin = size - ks[min(i + 1, len(ks) - 1)]
        level = materialize(_level(stored, k, margin, size), "level")
        found.append(level.select("batch", "dup"))
        stored = level.drop("dup").filter(F.size("origin") > 0)
    dups = found[0]
    for more in found[1:]:
        dups = dups.unionByName(more)
    return base.drop("ords", "begins", "origin", "open").groupBy("batch").cogroup(
        dups.groupBy("batch")
    ).applyInArrow(_removed(whole, size), _OUT + (", kept binary" if whole else ""))
