"""Longest common subsequences of token lists, as Arrow-batched functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.shipping import ship

ship(__name__)


def lcs_length(x, y) -> int:
    """Bit-parallel: one machine-word sweep of ``y`` per token of ``x``."""
    if len(x) == 0 or len(y) == 0:
        return 0
    where: dict[str, int] = {}
    for i, token in enumerate(y):
        where[token] = where.get(token, 0) | (1 << i)
    full = (1 << len(y)) - 1
    open_bits = full
    for token in x:
        hit = open_bits & where.get(token, 0)
        open_bits = ((open_bits + hit) | (open_bits - hit)) & full
    return len(y) - open_bits.bit_count()


def _lengths(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(a, b) for a, b in zip(x, y)], dtype="int64")


def lcs_length_of(x: Column, y: Column) -> Column:
    """Length of the longest common subsequence of two token arrays."""
    return F.pandas_udf(_lengths, "long")(x, y)


class _Lengths:
    """Lengths of longest common subsequences of all heads of two lists.

    Row ``i`` is one integer: bit ``j`` is 0 where the length grows from the
    first ``j`` to the first ``j + 1`` tokens of ``y``. Every ``step``-th row is
    kept and the rows between are swept again when asked for, so memory grows
    with the length of the lists times its square root, in bits.
    """

    def __init__(self, x, y):
        self._x, self._full = x, (1 << len(y)) - 1
        self._where: dict = {}
        for j, token in enumerate(y):
            self._where[token] = self._where.get(token, 0) | (1 << j)
        self._step = max(1, math.isqrt(len(x)))
        self._kept, row = [], self._full
        for i in range(len(x)):
            if i % self._step == 0:
                self._kept.append(row)
            row = self._after(row, x[i])
        if len(x) % self._step == 0:
            self._kept.append(row)
        self._first, self._rows = -1, []

    def _after(self, row: int, token) -> int:
        hit = row & self._where.get(token, 0)
        return ((row + hit) | (row - hit)) & self._full

    def row(self, i: int) -> int:
        block = i // self._step
        if block != self._first:
            row = self._kept[block]
            self._first, self._rows = block, [row]
            begin = block * self._step
            for token in self._x[begin : begin + self._step - 1]:
                row = self._after(row, token)
                self._rows.append(row)
        return self._rows[i - block * self._step]

    def at(self, i: int, j: int) -> int:
        """The length for the first ``i`` and the first ``j`` tokens."""
        return j - (self.row(i) & ((1 << j) - 1)).bit_count()


def common_places(x, y) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence.

    Walking back from the ends, a token of ``y`` is left out if the length
    stays, else one of ``x`` if it stays, else both are a pair.
    """
    if len(x) == 0 or len(y) == 0:
        return []
    lengths = _Lengths(x, y)
    pairs, i, j = [], len(x), len(y)
    while i:
        grows = ~lengths.row(i) & ((1 << j) - 1)
        if not grows:
            break
        j = grows.bit_length()
        if lengths.at(i - 1, j) == lengths.at(i, j):
            i -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


def lcs_words(x, y) -> set:
    """The words of one longest common subsequence of ``x`` and ``y``.

    Ties while walking back prefer a step along ``y``.
    """
    if len(x) == 0 or len(y) == 0:
        return set()
    lengths = _Lengths(x, y)
    found = set()
    i, j = len(x), len(y)
    while i and j:
        if x[i - 1] == y[j - 1]:
            found.add(x[i - 1])
            i, j = i - 1, j - 1
        elif lengths.at(i - 1, j) > lengths.at(i, j - 1):
            i -= 1
        else:
            j -= 1
    return found


def _union_value(hyps, refs) -> float:
    value = 0.0
    for ref in refs:
        found = [lcs_words(ref.split(" "), h.split(" ")) for h in hyps]
        size = sum(len(s) for s in found)
        value += len(set().union(*found)) / size if size else 0.0
    return value


def _union_values(hyps: pd.Series, refs: pd.Series) -> pd.Series:
    return pd.Series([_union_value(h, r) for h, r in zip(hyps, refs)], dtype="float64")


def union_lcs_of(hyp_sentences: Column | str, ref_sentences: Column | str) -> Column:
    """Sum over reference sentences of |union of LCS words| / sum of LCS sizes;
    a sentence nothing matches adds 0."""
    return F.pandas_udf(_union_values, "double")(hyp_sentences, ref_sentences)
