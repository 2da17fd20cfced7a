"""Levenshtein distances of many pairs of texts at once, as an Arrow-batched function."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.alignment import padded, trimmed
from palimpsest.functions.shipping import ship

ship(__name__)

# Lengths up to which texts are met together, the shorter and the longer one; of
# fewer pairs each is met alone. From 64 on, a class has its own number of words.
_SHORTER = np.array([4, 8, 16, 24, 32, 48, 64, 128, 192, 256])
_LONGER = np.array([8, 16, 32, 64, 96, 128, 192, 256, 384, 512, 1024])
_FEWEST = 32
_WORD = 64
# Words of matches held at a time, and characters of a batch met together.
_HELD_WORDS = 1 << 20
_BATCH_CHARACTERS = 1 << 21


def text_distance(x: list, y: list) -> int:
    """Bit-parallel: one sweep of ``x`` per sign of ``y``."""
    if not x or not y:
        return len(x) + len(y)
    where: dict = {}
    for i, sign in enumerate(x):
        where[sign] = where.get(sign, 0) | (1 << i)
    full, high = (1 << len(x)) - 1, 1 << (len(x) - 1)
    up, down, score = full, 0, len(x)
    for sign in y:
        equal = where.get(sign, 0)
        steep = equal | down
        flat = (((equal & up) + up) ^ up) | equal
        more, less = down | (full & ~(flat | up)), up & flat
        score += bool(more & high) - bool(less & high)
        more, less = (more << 1) | 1, less << 1
        up, down = (less | ~(steep | more)) & full, more & steep & full
    return score


def _swept(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Distances of the columns of two tables, of which ``n`` and ``m`` rows count."""
    count, words = x.shape[1], -(-len(x) // _WORD)
    match = np.zeros((len(y), words, count), np.uint64)
    for i in range(len(x)):
        match[:, i // _WORD] |= (y == x[i]).astype(np.uint64) << np.uint64(i % _WORD)
    one, top = np.uint64(1), np.uint64(_WORD - 1)
    up, down = np.full((words, count), ~np.uint64(0)), np.zeros((words, count), np.uint64)
    last = (n - 1 - (words - 1) * _WORD).astype(np.uint64)
    score = n.astype(np.int64)
    for k in range(len(y)):
        more_in, less_in = one, np.uint64(0)
        for w in range(words):
            equal, was_up = match[k, w], up[w]
            steep = equal | down[w]
            equal = equal | less_in
            flat = (((equal & was_up) + was_up) ^ was_up) | equal
            more, less = down[w] | ~(flat | was_up), was_up & flat
            if w == words - 1:
                grows = ((more >> last) & one).astype(np.int64) - ((less >> last) & one).astype(np.int64)
                score += np.where(k < m, grows, 0)
            more_out, less_out = more >> top, less >> top
            more, less = (more << one) | more_in, (less << one) | less_in
            up[w], down[w] = less | ~(steep | more), more & steep
            more_in, less_in = more_out, less_out
    return score


def _signs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all texts, and where each begins and how many it has."""
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = "".join(texts.to_pylist())
    signs = np.frombuffer(flat.encode("ascii"), np.uint8) if flat.isascii() else np.frombuffer(flat.encode("utf-32-le"), np.uint32)
    return signs, np.cumsum(sizes) - sizes, sizes


def _distances(before: pa.Array, after: pa.Array) -> np.ndarray:
    (x, i, n), (y, j, m) = _signs(before), _signs(after)
    kind = np.promote_types(x.dtype, y.dtype)
    x, y = x.astype(kind), y.astype(kind)
    head, tail = trimmed(x, y, i, j, n, m)
    i, j, n, m = i + head, j + head, n - head - tail, m - head - tail
    out = np.maximum(n, m)
    # The distance is the same both ways; the bits are those of the shorter text.
    turned = n > m
    both = np.concatenate((x, y))
    i, j = np.where(turned, j + len(x), i), np.where(turned, i, j + len(x))
    n, m = np.minimum(n, m), np.maximum(n, m)
    some = n > 0
    rows = np.flatnonzero(some & (n <= _SHORTER[-1]) & (m <= _LONGER[-1]))
    kinds = np.searchsorted(_SHORTER, n[rows]) * len(_LONGER) + np.searchsorted(_LONGER, m[rows])
    order = np.argsort(kinds, kind="stable")
    ends = np.searchsorted(kinds[order], np.arange(len(_SHORTER) * len(_LONGER) + 1))
    for at in np.flatnonzero(np.diff(ends) >= _FEWEST):
        mine = rows[order[ends[at] : ends[at + 1]]]
        some[mine] = False
        size = max(1, _HELD_WORDS // (int(m[mine].max()) * -(-int(n[mine].max()) // _WORD)))
        for start in range(0, len(mine), size):
            part = mine[start : start + size]
            # What is filled up is behind the last bit that counts.
            low, high = (padded(both, s[part], z[part], z[part].max(), 0) for s, z in ((i, n), (j, m)))
            out[part] = _swept(low, high, n[part], m[part])
    for row in np.flatnonzero(some):
        out[row] = text_distance(both[i[row] : i[row] + n[row]].tolist(), both[j[row] : j[row] + m[row]].tolist())
    return out


def distances(before: pa.Array, after: pa.Array) -> pa.Array:
    """Signs to insert, delete or change; null beside a null."""
    sizes = [pc.fill_null(pc.binary_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64) for a in (before, after)]
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes[0] + sizes[1]) // _BATCH_CHARACTERS)) + 1
    filled = [pc.fill_null(a, "") for a in (before, after)]
    steps = [0, *cuts.tolist(), len(before)]
    parts = [_distances(*(a.slice(s, e - s) for a in filled)) for s, e in zip(steps, steps[1:], strict=False)]
    there = pc.and_(before.is_valid(), after.is_valid()).to_numpy(zero_copy_only=False)
    return pa.array(np.concatenate(parts).astype(np.int32), mask=~there)


def distance_of(before: Column | str, after: Column | str) -> Column:
    """``int``: the Levenshtein distance of two texts."""
    return F.arrow_udf(distances, "int")(before, after)
