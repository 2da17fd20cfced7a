"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams, one of the target text and one
of the raw corpus, give every document a log importance weight: the sum of the
log ratios of its n-grams. Adding a Gumbel draw and taking the ``k`` largest
keys is sampling ``k`` documents without replacement by importance. The draw is
a hash of the document, so a rerun or a lost executor gives the same sample.

``k`` is a number (``kth_key`` finds its key) or the count of documents whose
key is at least that of nearly all target documents held out of the model
(``target_edge``): the sample is then the part of the corpus that looks like
the target, at any size of corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import trimmed
from palimpsest.llm import kernels, ngrams
from palimpsest.session import discard, materialize

_DRAW = np.uint64(0xA0761D6478BD642F)


@dataclass(frozen=True)
class Settings:
    """``tail`` is the share of labelled target documents held out of the target
    model that the sample may leave out."""

    buckets: int = 1 << 16
    sizes: tuple[int, ...] = (1, 2)
    smoothing: float = 1.0
    tail: float = 0.002
    seed: int = 1


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray
    settings: Settings


def fit(docs: DataFrame, good: DataFrame, settings: Settings | None = None) -> Model:
    """Both models: raw over all documents, target over the labelled ones.
    Without target documents every weight is 0."""
    settings = settings or Settings()
    rows = ngrams.marked(docs, ngrams.parts(good))
    features = ngrams.gram_buckets(settings.buckets, settings.sizes)
    raw, target = ngrams.bucket_arrays(
        ngrams.bucket_sums(rows, settings.buckets, features), settings.buckets
    )
    return Model(ngrams.log_ratio(raw, target, settings.smoothing), settings)


def _keys(texts: list[bytes], ids: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    features = ngrams.gram_buckets(model.settings.buckets, model.settings.sizes)
    weight, _ = ngrams.text_sums(texts, features, model.ratio)
    # One draw for a document: its id and its words decide.
    words, bounds = kernels.word_hashes(texts)
    folded = np.bincount(
        kernels.owners(bounds), (words >> np.uint64(40)).astype(np.float64), minlength=len(texts)
    ).astype(np.uint64)
    seed = np.uint64(model.settings.seed * int(_DRAW) % 2**64)
    draw = kernels.unit(kernels.mix(kernels.mix(ids.astype(np.uint64) + seed) ^ folded))
    return weight, weight - np.log(-np.log(draw))


def weights(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, log_weight, key`` of every row. A null or wordless text has
    weight 0; a null id draws as id -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = kernels.as_bytes(batch.column("text"))
            ids = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
            for lo, hi in kernels.groups(texts):
                weight, key = _keys(texts[lo:hi], ids[lo:hi], model)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(weight), pa.array(key)],
                    ["doc_id", "log_weight", "key"],
                )

    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    return named.mapInArrow(trimmed(run), "doc_id long, log_weight double, key double")


def target_edge(docs: DataFrame, good: DataFrame, model: Model) -> float:
    """The key that all but ``tail`` of the held-out target documents reach."""
    labelled = ngrams.flagged(docs, ngrams.parts(good)).filter(F.col("good") == ngrams.HELD)
    return lower_quantile(weights(labelled, model).select("key"), model.settings.tail)


def lower_quantile(keys: DataFrame, share: float) -> float:
    """The exact quantile of all of ``key``, the lower of two neighbours; -inf
    without rows. The keys are stored first, since they are read several times."""
    stored = materialize(keys.select("key"), "keys")
    row = stored.agg(F.count("key").alias("n"), F.min("key").alias("lo")).first()
    if not row["n"]:
        return float("-inf")
    place = math.floor(row["n"] * share + (1 - share) - 1)
    edge = kth_key(stored, row["n"] - place) if place > 0 else row["lo"]
    discard(stored)
    return float(edge)


def kth_key(keys: DataFrame, k: int) -> float:
    """The k-th largest ``key``, by narrowing a histogram; no global sort.

    Every pass sends 4096 counts at most. Fewer than ``k`` rows give -inf.
    """
    if k <= 0:
        return float("inf")
    bounds = keys.agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("key").alias("n"))
    row = bounds.first()
    if row["n"] <= k:
        return float("-inf")
    lo, hi, above = row["lo"], row["hi"], 0
    while lo < hi:
        width = (hi - lo) / 4096
        if not lo + width > lo:
            break
        cell = F.least(F.floor((F.col("key") - lo) / width), F.lit(4095)).cast("int")
        inside = keys.filter((F.col("key") >= lo) & (F.col("key") <= hi))
        counts = (
            inside.groupBy(cell.alias("cell"))
            .agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
            .orderBy(F.desc("cell"))
            .collect()
        )
        for c in counts:
            if above + c["n"] >= k:
                lo, hi = c["lo"], c["hi"]
                break
            above += c["n"]
    return lo


def sample(docs: DataFrame, model: Model, edge: float) -> DataFrame:
    """The rows of ``docs`` whose key is at least ``edge``, all columns. With
    ``edge = kth_key(weights(docs, model), k)`` it is the Gumbel top-k; equal
    keys at the edge (repeated rows) all stay."""
    text_at, id_at = docs.columns.index("text"), docs.columns.index("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = kernels.as_bytes(batch.column(text_at))
            ids = batch.column(id_at).cast(pa.int64()).fill_null(-1)
            ids = ids.to_numpy(zero_copy_only=False)
            for lo, hi in kernels.groups(texts):
                _, key = _keys(texts[lo:hi], ids[lo:hi], model)
                yield batch.slice(lo, hi - lo).filter(pa.array(key >= edge))

    return docs.mapInArrow(trimmed(run), docs.schema)
