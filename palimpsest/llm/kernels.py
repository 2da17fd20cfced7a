"""Vectorised text hashing shared by the operators that run NumPy inside tasks.

A word is a run of bytes other than blank, tab, LF, VT, FF and CR, the same in
UTF-8 as in code points. Texts are hashed in slices of bounded size, so memory
does not follow the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Text bytes handled together; a longer text is a group of its own.
GROUP_BYTES = 1 << 21
_SLICE = 1 << 22

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as floats in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column in UTF-8; null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def groups(texts: list[bytes], limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of neighbouring texts with about ``limit`` bytes together."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def _hash_slice(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    solid = ~_SPACE[data]
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    lengths = ends - starts
    inside = np.flatnonzero(solid)
    place = inside - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _BASE, np.uint64))
    terms = (data[inside].astype(np.uint64) + np.uint64(1)) * powers[place]
    sums = np.add.reduceat(terms, np.concatenate(([0], np.cumsum(lengths)[:-1])))
    return mix(sums + lengths.astype(np.uint64)), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words, and where each text's words begin.

    The second array has one more entry than there are texts.
    """
    data = b"\n".join([*texts, b""])
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)))
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + _SLICE)
        while end < len(data) and not _SPACE[data[end - 1]]:
            cut = max(data.rfind(b, at, end) for b in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f"))
            end = cut + 1 if cut >= at else min(len(data), end + _SLICE)
        h, s = _hash_slice(np.frombuffer(data, np.uint8, end - at, at))
        hashes.append(h)
        starts.append(s + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), begins)


def owners(bounds: np.ndarray) -> np.ndarray:
    """For each word the index of its text."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def windows(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside one text, and their texts."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total = total * _BASE + words[j : n + j]
    text = owners(bounds)
    whole = text[:n] == text[size - 1 :]
    return mix(total[whole]), text[:n][whole]


def shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of ``size`` words per text: text index, hash, occurrences.

    A text of 1 to ``size - 1`` words has one shingle, all of it; a text
    without words has none. Ordered by text and hash.
    """
    words, bounds = word_hashes(texts)
    hashes, text = windows(words, bounds, size)
    count = np.diff(bounds)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = []
        for i in short:
            h = np.uint64(count[i])
            for w in words[bounds[i] : bounds[i + 1]]:
                h = mix(np.array([h], np.uint64) + w)[0]
            extra.append(h)
        hashes = np.concatenate((hashes, np.array(extra, np.uint64)))
        text = np.concatenate((text, short))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    if not len(hashes):
        return text, hashes, np.empty(0, np.int64)
    first = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])))
    at = np.flatnonzero(first)
    return text[at], hashes[at], np.diff(np.append(at, len(hashes)))
