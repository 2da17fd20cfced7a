"""Longest common subsequences of many pairs of token lists at once.

The tokens are whole numbers in flat arrays. Pairs of moderate size are swept
together in bit rows of 64-bit words, the others one by one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from palimpsest.functions.shipping import ship

ship(__name__)

# Lengths up to which lists are swept together; of fewer pairs each is met alone.
_LENGTHS = np.array([4, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256])
_FEWEST = 8
# Words of bit rows held at a time.
_HELD_WORDS = 1 << 20
_WORD = 64
_MASKS = np.array([(1 << j) - 1 for j in range(_WORD + 1)], np.uint64)
_ONE = np.uint64(1)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[r], starts[r] + 1, ...``, ``sizes[r]`` places for every row."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _first_unlike(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, sizes: np.ndarray, step: int) -> np.ndarray:
    """How many tokens from places ``i`` and ``j`` on agree, ``sizes`` at most."""
    nth = ragged(np.zeros(len(sizes), np.int64), sizes)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    unlike = np.flatnonzero(x[i[rows] + step * nth] != y[j[rows] + step * nth])
    out = sizes.copy()
    # The first of a row is written last.
    out[rows[unlike[::-1]]] = nth[unlike[::-1]]
    return out


def trimmed(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the common heads, and of the common tails behind them."""
    head = _first_unlike(x, y, i, j, np.minimum(n, m), 1)
    tail = _first_unlike(x, y, i + n - 1, j + m - 1, np.minimum(n, m) - head, -1)
    return head, tail


def padded(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int, fill: int) -> np.ndarray:
    """(place, row)"""
    out = np.full((width, len(starts)), fill, values.dtype)
    rows = np.repeat(np.arange(len(starts)), sizes)
    out[ragged(np.zeros(len(starts), np.int64), sizes), rows] = values[ragged(starts, sizes)]
    return out


def _highest(bits: np.ndarray) -> np.ndarray:
    """Number of the highest bit set, from 1; 0 without one."""
    for shift in (1, 2, 4, 8, 16, 32):
        bits = bits | (bits >> np.uint64(shift))
    return np.bitwise_count(bits).astype(np.int64)


def _swept(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common places of the columns of two tables: (column, place in x, in y).

    Row ``i`` of a column has bit ``j`` 0 where the length grows from the first
    ``j`` to the first ``j + 1`` tokens of ``y``, as in ``functions.lcs``, and
    the walk back is that of ``common_places``.
    """
    count, words = x.shape[1], -(-len(y) // _WORD)
    kept = np.empty((len(x) + 1, words, count), np.uint64)
    kept[0] = ~np.uint64(0)
    match = np.zeros((len(x), words, count), np.uint64)
    for j in range(len(y)):
        match[:, j // _WORD] |= (x == y[j]).astype(np.uint64) << np.uint64(j % _WORD)
    for i in range(len(x)):
        carry = None
        for w in range(words):
            row, hit = kept[i, w], kept[i, w] & match[i, w]
            total = row + hit
            over = total < row
            if carry is not None:
                total += carry
                over |= total < carry
            kept[i + 1, w] = total | (row - hit)
            carry = over.astype(np.uint64)
    np.invert(kept, out=kept)
    grown = kept
    j = np.full(count, len(y))
    found = []
    for i in range(len(x), 0, -1):
        high, lengths = np.zeros(count, np.int64), np.zeros(count, np.int64)
        for w in range(words):
            bits = grown[i, w] & _MASKS[np.clip(j - w * _WORD, 0, _WORD)]
            high = np.where(bits != 0, w * _WORD + _highest(bits), high)
            lengths += np.bitwise_count(bits)
        live = (high > 0) & (i <= n)
        j = np.where(live, high, j)
        before = np.zeros(count, np.int64)
        for w in range(words):
            before += np.bitwise_count(grown[i - 1, w] & _MASKS[np.clip(j - w * _WORD, 0, _WORD)])
        pair = np.flatnonzero(live & (before != lengths))
        j[pair] -= 1
        found.append((pair, np.full(len(pair), i - 1), j[pair]))
    return tuple(np.concatenate(c) if found else np.zeros(0, np.int64) for c in zip(*found, strict=True))


def common_places_of_rows(
    x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray, m: np.ndarray,
    alone: Callable[[list, list], list[tuple[int, int]]],
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, place in x, place in y)`` of a longest common subsequence of every
    pair of ``x[i:i + n]`` and ``y[j:j + m]``, places counted from ``i`` and
    ``j``; ``alone`` aligns one pair of long lists."""
    out = [(np.zeros(0, np.int64),) * 3]
    some = (n > 0) & (m > 0)
    rows = np.flatnonzero(some & (n <= _LENGTHS[-1]) & (m <= _LENGTHS[-1]))
    # Lists of like lengths meet, so that little is filled up.
    kind = np.searchsorted(_LENGTHS, n[rows]) * len(_LENGTHS) + np.searchsorted(_LENGTHS, m[rows])
    order = np.argsort(kind, kind="stable")
    ends = np.searchsorted(kind[order], np.arange(len(_LENGTHS) ** 2 + 1))
    for at in np.flatnonzero(np.diff(ends) >= _FEWEST):
        mine = rows[order[ends[at] : ends[at + 1]]]
        some[mine] = False
        longest = n[mine].max(), m[mine].max()
        size = max(1, _HELD_WORDS // ((longest[0] + 1) * -(-longest[1] // _WORD)))
        for start in range(0, len(mine), size):
            part = mine[start : start + size]
            column, p, q = _swept(
                padded(x, i[part], n[part], n[part].max(), -1), padded(y, j[part], m[part], m[part].max(), -2), n[part])
            out.append((part[column], p, q))
    for row in np.flatnonzero(some):
        pairs = alone(x[i[row] : i[row] + n[row]].tolist(), y[j[row] : j[row] + m[row]].tolist())
        if pairs:
            p, q = np.array(pairs, np.int64).T
            out.append((np.full(len(p), row), p, q))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))
