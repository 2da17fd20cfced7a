"""Vectors of token sequences learned as paragraph vectors (PV-DBOW).

Every row has a vector that predicts the row's own words against drawn noise
words. Rows stay in their partition: a round trains each partition's rows
against its own copy of the word matrix for some epochs, and the copies are
averaged by the tokens they saw. Only that matrix is shared, and its size is
the vocabulary's, which has a bound; the rows never leave the executors. An
unseen row gets its vector by the same steps with the words held still.

All draws come from the seed, the row's key, the round and the partition, rows
are trained in key order, and the average adds up fixed-point numbers, so a run
can be repeated to the bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.shipping import ship
from palimpsest.session import BROADCAST_ROWS, materialize

ship(__name__)

# Fixed-point unit of averaged weights.
_UNIT = 2.0**36
# Pulls on one vector that a step adds up in full.
_PULLS = 8


@dataclass(frozen=True)
class Settings:
    vector_size: int = 50
    min_count: int = 1
    epochs: int = 20
    # Averages of the word matrix; the epochs are dealt to them evenly.
    rounds: int = 5
    alpha: float = 0.025
    min_alpha: float = 0.0001
    negative: int = 5
    seed: int = 96
    # Words kept, the most frequent first.
    max_words: int = 50_000
    # Rows of a part, which is a task; never fewer than there are words, so that
    # the parts' matrices together stay below the rows' vectors.
    rows_per_part: int = 200
    # Row and word pairs of one step.
    batch: int = 256


def _start_vectors(keys: np.ndarray, size: int) -> np.ndarray:
    """Small vectors that depend on the row's hash alone."""
    lanes = np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = keys.astype(np.int64).view(np.uint64)[:, None] + lanes
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53 - 0.5) / size


def _add(to: np.ndarray, where: np.ndarray, what: np.ndarray) -> None:
    """``to[where] += what`` with repeated places."""
    order = np.argsort(where, kind="stable")
    where = where[order]
    first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    to[where[first]] += np.add.reduceat(what[order], first, axis=0)


# Cells of rows and words that a step holds, and its pairs drawn ahead.
_CELLS = 1 << 12
_AHEAD = 1 << 14


def _drawn(noise: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """The words at the given shares; few words are found by comparing with each."""
    if len(noise) > 16:
        return np.searchsorted(noise, shares, "right")
    out = np.zeros(shares.shape, np.uint8)
    for edge in noise:
        out += (shares >= edge).view(np.uint8)
    return out


def _train_cells(
    rows: np.ndarray, words: np.ndarray, docs: np.ndarray, matrix: np.ndarray, noise: np.ndarray,
    rates: np.ndarray, rng: np.random.Generator, settings: Settings, learn: bool,
) -> None:
    """``_train`` for few rows and words: the steps, draws and damping are the
    same. The pairs of a cell (row, word) have one score in a step, so a step
    needs only how many wanted and noise words each cell has."""
    count, kinds = len(docs), len(matrix)
    size = count * kinds
    ahead = max(1, _AHEAD // settings.batch) * settings.batch
    for rate in rates:
        order = rng.permutation(len(rows))
        for begin in range(0, len(order), ahead):
            some = order[begin : begin + ahead]
            own = words[some][:, None]
            drawn = _drawn(noise, rng.random((len(some), settings.negative)))
            steps = -(-len(some) // settings.batch)
            first = np.arange(len(some)) // settings.batch * size + rows[some] * kinds

            def counts(cells: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
                return np.bincount(cells, weights, steps * size).reshape(steps, count, kinds)

            wanted = counts(first + own[:, 0])
            met = wanted + counts((first[:, None] + drawn).ravel())
            # A noise word equal to the row's word teaches nothing.
            taught = met - counts(first + own[:, 0], (drawn == own.astype(drawn.dtype)).sum(axis=1))
            per_row = np.maximum(1, met.sum(axis=2, keepdims=True) / (_PULLS * (1 + settings.negative)))
            per_word = np.maximum(1, met.sum(axis=1) / _PULLS)
            for step in range(steps):
                shares = 1 / (1 + np.exp(-np.clip(docs @ matrix.T, -30, 30)))
                error = (wanted[step] - taught[step] * shares) * rate
                moved = (error / per_row[step]) @ matrix
                if learn:
                    matrix += (error / per_word[step]).T @ docs
                docs += moved


def _train(
    rows: np.ndarray, words: np.ndarray, docs: np.ndarray, matrix: np.ndarray, noise: np.ndarray,
    rates: np.ndarray, rng: np.random.Generator, settings: Settings, learn: bool,
) -> None:
    """Epochs over all (row, word) pairs, in place; ``noise`` is the rising
    share of the words in the noise distribution."""
    if docs.shape[0] * matrix.shape[0] <= _CELLS:
        return _train_cells(rows, words, docs, matrix, noise, rates, rng, settings, learn)
    for rate in rates:
        order = rng.permutation(len(rows))
        for at in range(0, len(order), settings.batch):
            pick = order[at : at + settings.batch]
            r = rows[pick]
            drawn = np.searchsorted(noise, rng.random((len(pick), settings.negative)), "right")
            targets = np.concatenate((words[pick][:, None], drawn), axis=1)
            v, w = docs[r], matrix[targets]
            score = 1 / (1 + np.exp(-np.clip(np.einsum("bd,bkd->bk", v, w), -30, 30)))
            error = -score
            error[:, 0] += 1
            # A noise word equal to the row's word teaches nothing.
            error[:, 1:][drawn == words[pick][:, None]] = 0
            error *= rate
            if learn:
                # The pairs of a step do not see each other: a word or row met
                # often in it moves by the mean of its pulls, times a few.
                damp = np.maximum(1, np.bincount(targets.ravel()) / _PULLS)[targets]
                pulls = (error / damp)[:, :, None] * v[:, None, :]
                _add(matrix, targets.ravel(), pulls.reshape(-1, pulls.shape[2]))
            damp = np.maximum(1, np.bincount(r) / _PULLS)[r]
            _add(docs, r, np.einsum("bk,bkd->bd", error / damp[:, None], w))


def _pairs(sequences: pd.Series, index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    known = [[index[w] for w in (s if s is not None else ()) if w in index] for s in sequences]
    rows = np.repeat(np.arange(len(known)), [len(k) for k in known])
    return rows, np.array([i for k in known for i in k], np.int64)


@dataclass(frozen=True)
class ParagraphModel:
    """What a fit leaves: the words, their noise shares and their vectors."""

    words: tuple[str, ...]
    noise: np.ndarray
    matrix: np.ndarray
    settings: Settings

    def infer(self, sequences: DataFrame, key: str, actions: str = "edit_actions") -> DataFrame:
        """``(key, vector)`` of any rows, seen or not, with the words held still.

        The vector depends on the row's words and the seed alone. A row
        without a known word has zeros.
        """
        model, settings = self, self.settings
        kind = sequences.schema[key].dataType.simpleString()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = {w: i for i, w in enumerate(model.words)}
            matrix = model.matrix.copy()
            rates = np.linspace(settings.alpha, settings.min_alpha, settings.epochs)
            for pdf in batches:
                out = []
                for start, sequence in zip(pdf["_start"].to_numpy(), pdf["_words"], strict=True):
                    rows, words = _pairs(pd.Series([sequence]), index)
                    docs = _start_vectors(np.array([start]), settings.vector_size) * bool(len(rows))
                    if len(rows):
                        rng = np.random.default_rng([settings.seed, int(start) & (2**63 - 1)])
                        _train(rows, words, docs, matrix, model.noise, rates, rng, settings, False)
                    out.append(docs[0])
                yield pd.DataFrame({key: pdf[key], "vector": out})

        rows = sequences.select(
            key, F.col(actions).alias("_words"), F.xxhash64(actions, F.lit(settings.seed)).alias("_start")
        )
        return rows.mapInPandas(run, f"{key} {kind}, vector array<double>")


def _vocabulary(sequences: DataFrame, actions: str, settings: Settings) -> tuple[tuple[str, ...], np.ndarray]:
    if settings.max_words > BROADCAST_ROWS:
        raise ValueError(f"at most {BROADCAST_ROWS} words can be shared")
    counts = (
        sequences.select(F.explode(actions).alias("w"))
        .filter("w is not null")
        .groupBy("w")
        .count()
        .filter(F.col("count") >= settings.min_count)
        .orderBy(F.desc("count"), "w")
        .limit(settings.max_words)
        .collect()
    )
    weights = np.array([r["count"] for r in counts], np.float64) ** 0.75
    shares = np.cumsum(weights) / weights.sum() if len(weights) else weights
    # No draw lies beyond the last word.
    shares[-1:] = 1.0
    return tuple(r["w"] for r in counts), shares


def _round(
    number: int, rates: np.ndarray, words: tuple[str, ...], noise: np.ndarray, matrix: np.ndarray, settings: Settings
) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The training of one part in one round."""
    size = settings.vector_size

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_start", "_key"], kind="stable").reset_index(drop=True)
        rows, own = _pairs(pdf["_words"], {w: i for i, w in enumerate(words)})
        docs = np.stack(pdf["_vector"]) if number else _start_vectors(pdf["_start"].to_numpy(), size)
        docs[np.bincount(rows, minlength=len(pdf)) == 0] = 0
        local = matrix.copy()
        if len(rows):
            rng = np.random.default_rng([settings.seed, number, int(pdf["_part"].iat[0])])
            _train(rows, own, docs, local, noise, rates, rng, settings, True)
        pdf["_vector"] = list(docs)
        # The part's matrix travels in its first row, weighted by its tokens.
        scaled = np.rint(local * len(rows) * _UNIT / size).astype(np.int64)
        pdf["_local"] = [scaled.ravel() if i == 0 else None for i in range(len(pdf))]
        pdf["_tokens"] = [len(rows) if i == 0 else 0 for i in range(len(pdf))]
        return pdf

    return train


def fit(
    sequences: DataFrame, key: str, actions: str = "edit_actions", settings: Settings | None = None
) -> tuple[ParagraphModel, DataFrame]:
    """A model and ``(key, vector)`` of the rows it was fitted on.

    Sequences without a known word have zeros. Null sequences count as empty.
    Keys should differ; rows of equal key and words get equal starts. A table
    without words gives an empty model.
    """
    settings = settings or Settings()
    kind = sequences.schema[key].dataType.simpleString()
    words, noise = _vocabulary(sequences, actions, settings)
    size, seed = settings.vector_size, settings.seed
    parts = max(1, -(-sequences.count() // max(settings.rows_per_part, len(words))))
    start = F.xxhash64(key, actions, F.lit(seed))
    state = materialize(
        sequences.select(
            F.col(key).alias("_key"),
            F.col(actions).alias("_words"),
            start.alias("_start"),
            F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(parts)).cast("int").alias("_part"),
            F.lit(None).cast("array<double>").alias("_vector"),
        ),
        "paragraphs",
    )
    matrix = np.zeros((len(words), size))
    rates = np.linspace(settings.alpha, settings.min_alpha, settings.epochs)
    # A single part has nothing to average with.
    rounds = max(1, min(settings.rounds, settings.epochs)) if parts > 1 else 1
    for number, share in enumerate(np.array_split(rates, rounds)):
        fields = f"_key {kind}, _words array<string>, _start long, _part int, _vector array<double>"
        trained = materialize(
            state.repartition(parts, "_part").groupBy("_part").applyInPandas(
                _round(number, share, words, noise, matrix, settings), f"{fields}, _local array<long>, _tokens long"
            ),
            "paragraphs",
        )
        sums = (
            trained.filter("_local is not null")
            .select(F.posexplode("_local").alias("i", "x"))
            .groupBy("i")
            .agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
            .collect()
        )
        tokens = trained.agg(F.sum("_tokens")).first()[0] or 0
        flat = np.zeros(len(words) * size)
        for row in sums:
            flat[row["i"]] = float(row["x"]) / _UNIT * size / max(1, tokens)
        matrix = flat.reshape(len(words), size)
        state = trained.drop("_local", "_tokens")
    vectors = state.select(F.col("_key").alias(key), F.col("_vector").alias("vector"))
    return ParagraphModel(words, noise, matrix, settings), vectors
