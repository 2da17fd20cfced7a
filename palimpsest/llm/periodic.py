"""Runs of periodic words by an enhanced suffix array, all documents of a batch
at once.

Ranks of the prefixes of 1, 2, 4, .. words are kept per document as long as two
suffixes of it agree, so the last ranks are the inverse suffix array and the
levels answer any question about a common prefix exactly. Every interval of the
common-prefix array is known by its bounds alone. In each, the suffixes of all
children but the largest look up the rank ``depth`` words further and
``depth`` words back: a rank inside the interval but outside the own child is a
square that cannot be moved right (a branching tandem). Moving it left as far
as it goes gives the run; squares of one run merge by their common end.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import spread

# Words handled together; a longer document is a batch of its own.
BATCH_WORDS = 1 << 19


@dataclass(frozen=True)
class Settings:
    least_length: int = 6
    least_periods: int = 4


def _pair_ranks(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs of numbers from 0 on."""
    key = high * np.int64(int(low.max()) + 1 if len(low) else 1) + low
    order = np.argsort(key)
    new = np.empty(len(key), np.int64)
    if len(key):
        new[order] = np.cumsum(np.concatenate(([0], key[order][1:] != key[order][:-1])))
    return new


class _Numbers(dict):
    """Numbers of words by first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Suffixes:
    """The suffix, inverse and common-prefix arrays of many documents.

    ``words`` are numbers of words, ``bounds`` where each document begins, with
    one entry more than documents. Suffixes are ordered by document first, so
    ``isa`` minus the document's begin is the place inside the document.
    """

    def __init__(self, words: np.ndarray, bounds: np.ndarray):
        self.words, self.bounds = words, bounds
        sizes = np.diff(bounds)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.isa = np.empty(len(words), np.int64)
        # Per level: ranks of the documents still open, and how far each
        # document's positions are shifted there (below 0: not there).
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        at = np.arange(len(words))
        ranks = _pair_ranks(self.doc, words)
        width = 1
        while len(at):
            shift = np.full(len(sizes), -1, np.int64)
            owner = self.doc[at]
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            shift[owner[first]] = first
            self.levels.append((ranks, shift))
            held = np.diff(np.append(first, len(at)))
            # Ranks are ordered by document: all differ if they span its size.
            top, low = np.maximum.reduceat(ranks, first), np.minimum.reduceat(ranks, first)
            done = np.repeat(top - low + 1 == held, held)
            ended = at[done]
            self.isa[ended] = bounds[self.doc[ended]] + (ranks - np.repeat(low, held))[done]
            keep = ~done
            at, ranks, owner = at[keep], ranks[keep], owner[keep]
            if not len(at):
                break
            # Kept documents lie together: the rank `width` further, 0 beyond the end.
            ahead = np.zeros(len(at), np.int64)
            same = np.flatnonzero(owner[width:] == owner[:-width]) if len(at) > width else []
            ahead[same] = ranks[np.asarray(same, np.int64) + width] + 1
            ranks = _pair_ranks(ranks, ahead)
            width *= 2
        self.sa = np.empty(len(words), np.int64)
        self.sa[self.isa] = np.arange(len(words))

    def _equal(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the ``2**level`` words from ``a`` and from ``b`` (of the same
        document) agree; a document that has left has no such two."""
        ranks, shift = self.levels[level]
        base = shift[self.doc[a]]
        there = base >= 0
        out = np.zeros(len(a), bool)
        x, y = a[there], b[there]
        begin = base[there] - self.bounds[self.doc[x]]
        out[there] = ranks[x + begin] == ranks[y + begin]
        return out

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common words from ``a`` and ``b`` on, ``a`` unlike ``b``."""
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for level in reversed(range(len(self.levels))):
            step = 1 << level
            end = self.bounds[self.doc[np.minimum(a, len(self.words) - 1)] + 1] if len(a) else a
            fits = np.flatnonzero((np.maximum(a, b) + step <= end) & (total >= 0))
            hit = fits[self._equal(level, a[fits], b[fits])]
            a[hit] += step
            b[hit] += step
            total[hit] += step
        return total

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common words that end right before ``a`` and before ``b``."""
        begin = self.bounds[self.doc[a]]
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for level in reversed(range(len(self.levels))):
            step = 1 << level
            fits = np.flatnonzero(np.minimum(a, b) - step >= begin)
            hit = fits[self._equal(level, a[fits] - step, b[fits] - step)]
            a[hit] -= step
            b[hit] -= step
            total[hit] += step
        return total

    def common(self) -> np.ndarray:
        """For each place but the first of a document the words its suffix
        shares with the one before; 0 at a document's first."""
        out = np.zeros(len(self.sa), np.int64)
        first = self.words[self.sa]
        inner = np.flatnonzero((np.diff(self.doc, prepend=-1) == 0) & (np.diff(first, prepend=-1) == 0))
        out[inner] = self.forward(self.sa[inner - 1], self.sa[inner])
        return out


def _smaller_before(values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """For each asked place the last one before it with a smaller value; place
    0 holds 0, the least. Pointers jump over what is known to be larger."""
    at = np.arange(len(values)) - 1
    open_ = asked
    while len(open_):
        target = at[open_]
        open_ = open_[values[target] >= values[open_]]
        at[open_] = at[at[open_]]
    return at


def squares(suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Begins and periods of all branching tandems: squares that end with
    their run. A square may come more than once."""
    common, sa, isa, doc = suffixes.common(), suffixes.sa, suffixes.isa, suffixes.doc
    n = len(common)
    cut = np.flatnonzero(common > 0)
    if not len(cut):
        return cut, cut
    before = _smaller_before(common, cut)[cut]
    mirrored = np.concatenate(([0], common[::-1]))
    after = n - _smaller_before(mirrored, n - cut[::-1])[n - cut[::-1]][::-1]
    depth, low, high = common[cut], before, after - 1
    # An interval is named by its bounds; its cuts are in order.
    order = np.lexsort((cut, high, low))
    cut, depth, low, high = cut[order], depth[order], low[order], high[order]
    opens = np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
    first = np.flatnonzero(opens)
    # Children: from the lower bound or a cut to the next cut or the upper bound.
    count = np.diff(np.append(first, len(cut))) + 1
    node = np.repeat(np.arange(len(first)), count)
    place = np.arange(len(node)) - node  # cuts before this child, over all nodes
    starts = np.where(
        np.diff(node, prepend=-1) > 0, low[first][node], cut[np.maximum(place - 1, 0)]
    )
    last = np.diff(node, append=len(first)) > 0
    ends = np.where(last, high[first][node], cut[np.minimum(place, len(cut) - 1)] - 1)
    sizes = ends - starts + 1
    # The largest child of each interval, the first of equals, is passed over.
    rank = np.lexsort((np.arange(len(node)), -sizes, node))
    small = np.ones(len(node), bool)
    small[rank[np.flatnonzero(np.diff(node[rank], prepend=-1) > 0)]] = False
    node, starts, ends, sizes = node[small], starts[small], ends[small], sizes[small]
    found, periods = [], []
    total = np.cumsum(sizes)
    at = 0
    while at < len(node):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 21))))
        n_of = sizes[at:stop]
        which = np.repeat(np.arange(at, stop), n_of)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(n_of) - n_of, n_of) + starts[which]
        i, q = sa[rows], depth[first][node[which]]
        lo, hi = low[first][node[which]], high[first][node[which]]
        for j, begin in ((i + q, i), (i - q, i - q)):
            inside = np.flatnonzero((j >= 0) & (j < n))
            inside = inside[doc[j[inside]] == doc[i[inside]]]
            r = isa[j[inside]]
            hit = (r >= lo[inside]) & (r <= hi[inside])
            hit &= (r < starts[which[inside]]) | (r > ends[which[inside]])
            found.append(begin[inside[hit]])
            periods.append(q[inside[hit]])
        at = stop
    return np.concatenate(found), np.concatenate(periods)


def runs(
    words: np.ndarray, bounds: np.ndarray, settings: Settings
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, length and least period of every run long enough, ordered by
    begin and period; begins count over all documents of the batch."""
    suffixes = Suffixes(words, bounds)
    begin, period = squares(suffixes)
    end = begin + 2 * period
    starts, lengths, periods = [], [], []
    while len(end):
        order = np.lexsort((period, end))
        end, period = end[order], period[order]
        head = np.flatnonzero(np.diff(end, prepend=-1) > 0)
        e, q = end[head], period[head]
        length = q + suffixes.backward(e - q, e)
        starts.append(e - length)
        lengths.append(length)
        periods.append(q)
        # Squares of the same run: its end, a multiple of its period, inside it.
        owner = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(end))))
        rest = (period % q[owner] != 0) | (2 * period > length[owner])
        end, period = end[rest], period[rest]
    if not starts:
        none = np.empty(0, np.int64)
        return none, none, none
    s, l, p = map(np.concatenate, (starts, lengths, periods))
    keep = l >= np.maximum(settings.least_length, settings.least_periods * p)
    s, l, p = s[keep], l[keep], p[keep]
    # The least period of one stretch stands for it.
    order = np.lexsort((p, l, s))
    s, l, p = s[order], l[order], p[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (l[1:] != l[:-1])
    s, l, p = s[fresh], l[fresh], p[fresh]
    order = np.lexsort((p, s))
    return s[order], l[order], p[order]


def repeated_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The planted repetition: where crc32 of the decimal id ends in 0, all
    words from a place on repeat the first few from there. No id, no change."""
    n = len(words)
    if doc_id is None or not n:
        return words
    g, digit = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if digit:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    turns = -(-(n - a) // p)
    return words[:a] + (words[a : a + p] * turns)[: n - a]


_OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_runs", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("period", pa.int64()),
        ("exponent_milli", pa.int64()),
        ("runs_sha256", pa.string()),
        ("collapsed_sha256", pa.string()),
    ]
)
_RUNS = pa.list_(
    pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
)


def _judged(
    ids: list, texts: list[list[bytes]], settings: Settings, whole: bool
) -> pa.RecordBatch:
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    every = itertools.chain.from_iterable(texts)
    flat = np.fromiter(map(_Numbers().__getitem__, every), np.int64, int(bounds[-1]))
    start, length, period = runs(flat, bounds, settings)
    doc = np.searchsorted(bounds, start, "right") - 1
    start = start - bounds[doc]
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    columns: list[list] = [[] for _ in range(len(_OUT) + 2 * whole)]
    for k, (doc_id, words) in enumerate(zip(ids, texts, strict=True)):
        mine = slice(cuts[k], cuts[k + 1])
        s, l, p = start[mine], length[mine], period[mine]
        best = np.lexsort((p, s, -l))[:1]
        row = [None] * 4
        kept = words
        if len(best):
            b = best[0]
            row = [int(s[b]), int(l[b]), int(p[b]), int(1000 * l[b] // p[b])]
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, s + p, 1)
            np.add.at(change, s + l, -1)
            kept = [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0)]
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in zip(s, l, p, strict=True))
        collapsed = b" ".join(kept)
        values = [
            doc_id,
            len(s),
            *row,
            hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(collapsed).hexdigest(),
        ]
        if whole:
            values += [
                [{"start": a, "length": b, "period": c} for a, b, c in zip(s.tolist(), l.tolist(), p.tolist(), strict=True)],
                collapsed.decode(),
            ]
        for column, value in zip(columns, values, strict=True):
            column.append(value)
    schema = _schema(whole)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def _schema(whole: bool) -> pa.Schema:
    return pa.schema([*_OUT, ("runs", _RUNS), ("collapsed", pa.string())]) if whole else _OUT


def periodic_runs(
    docs: DataFrame,
    settings: Settings | None = None,
    plant: bool = False,
    whole: bool = False,
) -> DataFrame:
    """Runs of repeating words of every document, a row per row of ``docs``.

    ``n_runs``; ``start, length, period, exponent_milli`` of the longest (nulls
    without a run); digests of all runs and of the text that keeps the first
    period of each. With ``whole`` also the runs and that text themselves.
    ``plant`` first rewrites a tenth of the documents (``repeated_tail``). A
    null, empty or blank text has no words and no runs. Ids may be null or
    repeat. No row is shuffled; a document is judged inside its row.
    """
    settings = settings or Settings()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, held = [], [], 0
            column = batch.column("text")
            for doc_id, i in zip(batch.column("doc_id").to_pylist(), range(len(column)), strict=True):
                words = (column[i].as_py() or "").encode().split()
                if texts and held + len(words) > BATCH_WORDS:
                    yield _judged(ids, texts, settings, whole)
                    ids, texts, held = [], [], 0
                ids.append(doc_id)
                texts.append(repeated_tail(words, doc_id) if plant else words)
                held += len(words)
            yield _judged(ids, texts, settings, whole)

    fields = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    if whole:
        fields += ", runs array<struct<start: long, length: long, period: long>>, collapsed string"
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    return spread(named, "doc_id").mapInArrow(run, fields)
