"""N-grams by name, and exact numbers of them, for texts whose n-grams are
mostly distinct.

A hash table of such n-grams outgrows its task and spills, and as texts they
outweigh the documents several times, so they are named and sorted. A name has
96 bits: 32 high ones, by whose range the names are dealt, and two times 32 low
ones. Each low half is sorted together with the high one as one integer; names of
equal high bits are as many as the half that tells more of them apart says. That
one of ten thousand million n-grams is taken for another has a probability of
about 1e-9.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.shipping import ship

ship(__name__)

# Tokens that are named at once, and n-grams of a range of names.
_CHUNK, _RANGE = 1_000_000, 4_000_000
_HIGH = np.uint64(0xFFFFFFFF00000000)
# Both are 3 modulo 8, so that swapped words keep all but a few bits apart.
_FACTORS = (np.uint64(0x9E3779B97F4A7C13), np.uint64(0xC2B2AE3D27D4EB4B))
_KEYS = ("palimpsest-first", "palimpsest-other")


def _word_names(words: pa.Array) -> list[np.ndarray]:
    """Two random-like integers for every word of a dictionary."""
    known = words.fill_null("\0").to_numpy(zero_copy_only=False)
    return [pd.util.hash_array(known, hash_key=key, categorize=False) for key in _KEYS]


def _sorted_once(names: np.ndarray) -> np.ndarray:
    names = np.sort(names)
    return names[np.concatenate(([True], names[1:] != names[:-1]))] if len(names) else names


def _cut(names: np.ndarray, at: np.ndarray) -> pa.Array:
    """Sorted names as one binary value per range."""
    ends = np.concatenate(([0], np.searchsorted(names, at), [len(names)])).astype(np.int32) * 8
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(names)])


def _named(max_order: int, ranges: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Names of the n-grams of some tokens without repeats, one row per order
    and range; the first has the number of occurrences."""
    # First name of every range but the first.
    at = (np.arange(1, ranges, dtype=np.uint64) << np.uint64(32)) // np.uint64(ranges) << np.uint64(32)

    def pack(flat: pa.Array, left: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``flat`` may go on behind the positions that have a ``left``."""
        coded = flat.dictionary_encode(null_encoding="encode")
        lanes = [names[coded.indices.to_numpy()] for names in _word_names(coded.dictionary)]
        sums = np.zeros((2, len(left)), np.uint64)
        for n in range(1, max_order + 1):
            here = left >= n
            if not here.any():
                return
            # Sums that go on behind the end of their array are never used.
            for total, lane, factor in zip(sums, lanes, _FACTORS, strict=True):
                total *= factor
                more = lane[n - 1 : n - 1 + len(total)]
                total[: len(more)] += more
            first, second = sums[0, here], sums[1, here]
            second = (first & _HIGH) | (second >> np.uint64(32))
            rows = np.zeros(ranges, np.int64)
            rows[0] = len(first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(ranges, n, np.int32)), pa.array(np.arange(ranges, dtype=np.int32)), pa.array(rows),
                 _cut(_sorted_once(first), at), _cut(_sorted_once(second), at)],
                ["n", "range", "occurrences", "first", "second"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0))
            n += len(batch.column(0).flatten())
            if n >= _CHUNK:
                yield from lists(held)
                held, n = [], 0
        yield from lists(held)

    def lists(held: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        flat = pa.concat_arrays([a.flatten() for a in held])
        sizes = np.concatenate([a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for a in held])
        left = np.repeat(np.cumsum(sizes, dtype=np.int64), sizes) - np.arange(len(flat))
        for lo in range(0, len(flat), _CHUNK):
            # The n-grams that start in the chunk may end behind it.
            yield from pack(flat.slice(lo, _CHUNK + max_order - 1), left[lo : lo + _CHUNK])

    return run


def named_ngrams(df: DataFrame, tokens: str, ngrams_at_most: int, max_order: int) -> DataFrame:
    """The n-grams of token arrays by name, packed: ``(n, range, occurrences,
    first, second)``.

    ``ngrams_at_most`` sets the number of ranges, so that one stays small; a
    wrong one costs memory, not rows. A null token counts as the word NUL.
    """
    ranges = max(1, -(-ngrams_at_most // _RANGE))
    return df.select(tokens).mapInArrow(
        _named(max_order, ranges), "n int, range int, occurrences long, first binary, second binary")


def _per_high(column: pa.ChunkedArray) -> np.ndarray:
    """How many names each value of the high bits has, in its order."""
    names = _sorted_once(np.frombuffer(b"".join(column.to_pylist()), np.uint64))
    high = names >> np.uint64(32)
    return np.diff(np.flatnonzero(np.concatenate(([True], high[1:] != high[:-1], [True])))) if len(names) else names


def _count_range(table: pa.Table) -> pa.Table:
    names = np.maximum(_per_high(table["first"]), _per_high(table["second"])).sum()
    rows = sum(table["occurrences"].to_pylist())
    return pa.table({"n": table["n"][:1], "occurrences": pa.array([rows]), "names": pa.array([int(names)])})


def count_names(named: DataFrame) -> DataFrame:
    """``(n, occurrences, distinct_ngrams)`` of ``named_ngrams``."""
    counted = named.groupBy("n", "range").applyInArrow(_count_range, "n int, occurrences long, names long")
    return counted.groupBy("n").agg(
        F.sum("occurrences").alias("occurrences"), F.sum("names").alias("distinct_ngrams"))
