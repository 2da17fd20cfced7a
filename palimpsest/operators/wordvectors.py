"""Word vectors by skip-grams with hierarchical softmax, trained in parts.

``ml.feature.Word2Vec`` trains in one task by default; its partitions share one
array per process, so more of them in a process write over each other. Here every
part has its own copy for an epoch, and a vector becomes the mean of the copies
in which it was met, which is the rule of Spark's partitions. Window, tree, rates
and limits are Spark's. A step adds up the pairs of some neighbouring words.

Draws come from the seed, the epoch and the part, rows are trained in key order
and means add up integers, so a fit can be repeated to the bit.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.shipping import ship
from palimpsest.session import materialize

ship(__name__)

# Fixed values of Spark's estimator.
WINDOW, LONGEST, STEEPEST = 5, 1000, 6.0
# Words of a part, words of a step, fixed-point unit of summed weights.
_PART, _STEP, _UNIT = 50_000, 16, 2.0**36
# A vocabulary of as many words is met whole in a step.
_FEW = 32


@dataclass(frozen=True)
class Tree:
    """Paths of all words through the tree of their counts, padded to one
    length: inner nodes, turns, and which of them are there."""

    points: np.ndarray
    turns: np.ndarray
    there: np.ndarray


def tree(counts: list[int]) -> Tree:
    """The Huffman tree of the counts; its root has the last number."""
    n = len(counts)
    heap = [(c, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    up, turn = {}, {}
    for inner in range(n, 2 * n - 1):
        (a, left), (b, right) = heapq.heappop(heap), heapq.heappop(heap)
        up[left] = up[right] = inner
        turn[left], turn[right] = 0, 1
        heapq.heappush(heap, (a + b, inner))
    paths = []
    for word in range(n):
        path, at = [], word
        while at in up:
            path.append((up[at] - n, turn[at]))
            at = up[at]
        paths.append(path)
    longest = max(map(len, paths), default=0)
    shape = (n, longest)
    points, turns, there = np.zeros(shape, np.int64), np.zeros(shape), np.zeros(shape)
    for i, path in enumerate(paths):
        for j, (point, t) in enumerate(path):
            points[i, j], turns[i, j], there[i, j] = point, t, 1
    return Tree(points, turns, there)


def _pairs(sizes: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all (word, neighbour) pairs of an epoch, each word with a
    reach of its own, in pieces of at most ``LONGEST`` words."""
    n = int(sizes.sum())
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(n)
    first = at - (at - start) % LONGEST
    last = np.minimum(first + LONGEST, start + np.repeat(sizes, sizes)) - 1
    reach = rng.integers(1, WINDOW + 1, n)
    words, others = [], []
    for by in [*range(-WINDOW, 0), *range(1, WINDOW + 1)]:
        met = np.flatnonzero((reach >= abs(by)) & (at + by >= first) & (at + by <= last))
        words.append(met)
        others.append(met + by)
    return np.concatenate(words), np.concatenate(others)


def _steps(
    ids: np.ndarray, sizes: np.ndarray, paths: Tree, rates: tuple[float, float], rng: np.random.Generator
) -> tuple[np.ndarray, ...]:
    """The pairs of an epoch by step: its number, the neighbour whose vector
    learns, and the inner nodes on the word's path with the turn and the weight,
    which is the rate for each of the equal pairs."""
    n = len(paths.points)
    word, other = _pairs(sizes, rng)
    keys, weight = np.unique((word // _STEP * n + ids[word]) * n + ids[other], return_counts=True)
    step, word, other = keys // (n * n), keys // n % n, keys % n
    rate = rates[0] + (rates[1] - rates[0]) * step / max(1, len(ids) / _STEP)
    return step, other, paths.points[word], 1 - paths.turns[word], paths.there[word] * (weight * rate)[:, None]


def train(
    parts: list[tuple[np.ndarray, np.ndarray, np.random.Generator]], paths: Tree,
    syn0: np.ndarray, syn1: np.ndarray, rates: tuple[float, float],
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Copies of both matrices after one epoch over each part, which is the ids
    of its sequences, their sizes and its draws; the rates go from the first to
    the second."""
    steps = [_steps(ids, sizes, paths, rates, rng) for ids, sizes, rng in parts]
    if len(syn0) <= _FEW:
        yield from zip(*_small(steps, syn0, syn1), strict=True)
        return
    for part in steps:
        own = syn0.copy(), syn1.copy()
        _any(*part, *own)
        yield own


def _any(step, other, points, right, weights, syn0, syn1) -> None:
    """Steps that touch the vectors of their own pairs."""
    cuts = np.flatnonzero(np.concatenate(([True], step[1:] != step[:-1], [True])))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        o, p = other[lo:hi], points[lo:hi]
        x, y = syn0[o], syn1[p]
        f = np.matmul(y, x[:, :, None])[:, :, 0]
        g = (right[lo:hi] - 1 / (1 + np.exp(-f))) * weights[lo:hi] * (np.abs(f) < STEEPEST)
        np.add.at(syn0, o, np.matmul(g[:, None, :], y)[:, 0])
        np.add.at(syn1, p, g[:, :, None] * x[:, None, :])


def _small(parts, syn0, syn1) -> tuple[np.ndarray, np.ndarray]:
    """The same steps as products of whole matrices, where words are few; a
    step of every part is done at once, each on its own copy."""
    n, m = len(syn0), len(syn1)
    steps = max((int(p[0][-1]) + 1 for p in parts if len(p[0])), default=0)
    both, wanted = np.zeros((2, steps, len(parts), n, m))
    for i, (step, other, points, right, weights) in enumerate(parts):
        cell = ((step * n + other)[:, None] * m + points).ravel()
        for to, w in ((both, weights), (wanted, weights * right)):
            to[:, i] = np.bincount(cell, w.ravel(), steps * n * m).reshape(steps, n, m)
    x, y = (np.repeat(side[None], len(parts), 0) for side in (syn0, syn1))
    for pulls, yes in zip(both, wanted, strict=True):
        f = x @ y.transpose(0, 2, 1)
        g = (yes - pulls / (1 + np.exp(-f))) * (np.abs(f) < STEEPEST)
        more = g @ y
        y += g.transpose(0, 2, 1) @ x
        x += more
    return x, y


def _packer(words: tuple[str, ...]) -> Callable[[pa.Table], pa.Table]:
    def pack(table: pa.Table) -> pa.Table:
        rows = table.sort_by("_key")["_words"].to_pylist()
        index = {w: i for i, w in enumerate(words)}
        known = [[index[w] for w in row if w in index] for row in rows]
        sizes = np.array([len(k) for k in known], np.int32)
        ids = np.array([i for k in known for i in k], np.int32)
        return pa.table({"part": table["_part"][:1], "ids": pa.array([ids.tobytes()]), "sizes": pa.array([sizes.tobytes()])})

    return pack


def _epoch(
    number: int, rates: tuple[float, float], paths: Tree, syn0: np.ndarray, syn1: np.ndarray, seed: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Trained copies: the vectors of the words and inner nodes that were met."""

    def trained(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        parts = [
            (*(np.frombuffer(row[c], np.int32).astype(np.int64) for c in ("ids", "sizes")),
             np.random.default_rng([seed, number, row["part"]])) for row in rows]
        for own in train(parts, paths, syn0, syn1, rates):
            for side, (old, new) in enumerate(zip((syn0, syn1), own, strict=True)):
                met = np.flatnonzero((old != new).any(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(met), side, np.int32)), pa.array(met),
                     pa.array(list(np.rint(new[met] * _UNIT).astype(np.int64)), pa.list_(pa.int64()))],
                    ["side", "i", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Parts at once; their steps of few words weigh 50 MB at most each.
        most = max(1, 16 * 6**2 // len(syn0) ** 2) if len(syn0) > 6 else 16
        rows = (row for batch in batches for row in batch.to_pylist())
        while held := list(islice(rows, most)):
            yield from trained(held)

    return run


@dataclass(frozen=True)
class WordModel:
    words: tuple[str, ...]
    matrix: np.ndarray

    def transform(self, sequences: DataFrame, key: str, actions: str) -> DataFrame:
        """``(key, vector)``: the sum of a row's word vectors by its length; a
        row without words has zeros."""
        model = self
        kind = sequences.schema[key].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = {w: i for i, w in enumerate(model.words)}
            for batch in batches:
                out = []
                for row in batch.column(1).to_pylist():
                    known = np.array([index[w] for w in row or () if w in index], np.int64)
                    ids, n = np.unique(known, return_counts=True)
                    out.append(n @ model.matrix[ids] / max(1, len(row or ())))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(out, pa.list_(pa.float64()))], [key, "vector"])

        return sequences.select(key, actions).mapInArrow(run, f"{key} {kind}, vector array<double>")


def fit(
    sequences: DataFrame, key: str, actions: str, *, vector_size: int, min_count: int, epochs: int, rate: float, seed: int
) -> WordModel:
    """A model of token arrays. Null arrays count as empty; ``sequences`` is
    read several times and should be stored."""
    counts = (
        sequences.select(F.explode(actions).alias("w")).filter("w is not null").groupBy("w").count()
        .filter(F.col("count") >= min_count).orderBy(F.desc("count"), "w").collect())
    words, total = tuple(r["w"] for r in counts), sum(r["count"] for r in counts)
    syn0 = (np.random.default_rng(seed).random((len(words), vector_size)) - 0.5) / vector_size
    syn1 = np.zeros((max(0, len(words) - 1), vector_size))
    if len(words) < 2:
        # A tree of one word has no turn to learn.
        return WordModel(words, syn0)
    paths = tree([r["count"] for r in counts])
    parts = -(-total // _PART)
    rows = sequences.filter(F.col(actions).isNotNull()).select(
        F.col(key).alias("_key"), F.col(actions).alias("_words"),
        F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(parts)).cast("int").alias("_part"))
    packed = rows.repartition(parts, "_part").groupBy("_part").applyInArrow(
        _packer(words), "part int, ids binary, sizes binary")
    # A file per part, so that the readers' shares are even.
    packed = materialize(packed.repartitionByRange(parts, "part"), "parts")
    for number in range(epochs):
        rates = tuple(rate * max(1 - k / epochs, 1e-4) for k in (number, number + 1))
        trained = packed.mapInArrow(_epoch(number, rates, paths, syn0, syn1, seed), "side int, i long, v array<long>")
        sums = (
            trained.select("side", "i", F.posexplode("v").alias("d", "x")).groupBy("side", "i", "d")
            .agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.count("*").alias("n")).collect())
        for r in sums:
            (syn1 if r["side"] else syn0)[r["i"], r["d"]] = float(r["x"]) / _UNIT / r["n"]
    return WordModel(words, syn0)
