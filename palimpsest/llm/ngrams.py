"""Counts of hashed n-grams over a whole corpus, target and raw side by side.

Each task adds up its texts in arrays of a fixed number of buckets and sends
the buckets it met; Spark sums them. The collected table has ``buckets`` rows
at most, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import trimmed
from palimpsest.llm import kernels
from palimpsest.session import fits_broadcast

# From the texts of a group: bucket numbers, and the text each belongs to.
Features = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def gram_buckets(buckets: int, sizes: tuple[int, ...] = (1, 2)) -> Features:
    """Word n-grams of the given sizes, hashed into ``buckets``."""

    def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words, bounds = kernels.word_hashes(texts)
        found = [kernels.windows(words, bounds, n) for n in sizes]
        grams = np.concatenate([h ^ np.uint64(n) for n, (h, _) in zip(sizes, found, strict=True)])
        return (
            (kernels.mix(grams) % np.uint64(buckets)).astype(np.int64),
            np.concatenate([t for _, t in found]),
        )

    return features


# One trusted document in so many is held out of the counts, to set a threshold.
HELD_OUT = 4
FIT, HELD = 1, 2


def parts(good: DataFrame) -> DataFrame:
    """``doc_id, good`` with good = 1 split by the id into FIT and HELD."""
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(HELD_OUT)) == 0
    return good.select(
        "doc_id",
        F.when(F.col("good") == 1, F.when(held, HELD).otherwise(FIT)).otherwise(0).alias("good"),
    )


def flagged(docs: DataFrame, good: DataFrame) -> DataFrame:
    """``doc_id, text, good`` of every document, ``good`` being 0 where it has
    no row.

    ``good`` has unique ids. Up to the counted limit of rows (two numbers each)
    it is broadcast; beyond it the join shuffles, and Spark splits hot ids.
    """
    if fits_broadcast(good):
        good = F.broadcast(good)
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    known = F.coalesce("good", F.lit(0)).cast("int")
    return named.join(good, "doc_id", "left").select("doc_id", "text", known.alias("good"))


def marked(docs: DataFrame, good: DataFrame) -> DataFrame:
    """``text, good`` of ``flagged``."""
    return flagged(docs, good).select("text", "good")


def bucket_sums(texts: DataFrame, buckets: int, features: Features) -> DataFrame:
    """``bucket, raw, target`` sums of ``text, good`` rows: raw counts every
    text, target those with ``good`` = FIT. Buckets never met have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            rows = kernels.as_bytes(batch.column("text"))
            good = batch.column("good").to_numpy() == FIT
            for lo, hi in kernels.groups(rows):
                bucket, text = features(rows[lo:hi])
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[good[lo:hi][text]], minlength=buckets)
        met = np.flatnonzero(raw)
        for at in range(0, len(met), 1 << 16):
            some = met[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some), pa.array(raw[some]), pa.array(target[some])],
                ["bucket", "raw", "target"],
            )

    return (
        texts.mapInArrow(trimmed(run), "bucket long, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    )


def bucket_arrays(sums: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums as two arrays, raw and target; ``buckets`` rows at most."""
    got = sums.toArrow()
    at = got.column("bucket").to_numpy()
    out = np.zeros((2, buckets))
    out[0, at] = got.column("raw").to_numpy()
    out[1, at] = got.column("target").to_numpy()
    return out[0], out[1]


def log_ratio(raw: np.ndarray, target: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw), additively smoothed.

    The raw side is scaled to the target's total first, so that both carry the
    same weight of smoothing and a bucket that neither knows has ratio 0.
    Without any target text every ratio is 0.
    """
    if not target.sum():
        return np.zeros(len(raw))
    scaled = raw * (target.sum() / raw.sum())
    return np.log(target + smoothing) - np.log(scaled + smoothing)


def text_sums(
    texts: list[bytes], features: Features, ratio: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Per text the sum of its features' ratios, and the number of features."""
    bucket, text = features(texts)
    return (
        np.bincount(text, ratio[bucket], minlength=len(texts)),
        np.bincount(text, minlength=len(texts)),
    )
