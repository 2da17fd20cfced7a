"""Cross-entropy difference of two matched n-gram language models.

Target model: labelled good documents. Background model: all documents, its
counts scaled to the target's size, so that both are matched in vocabulary,
order, smoothing and weight. The vocabulary is the ``vocabulary`` most frequent
words of the corpus; every other word is one unknown word. A token's loss is
-ln P(word | word before), with the bigram counts hashed into ``buckets`` and
backed by smoothed unigrams; a document's score is the mean difference of its
two losses, below 0 for text that is nearer to the target.

Counts come from every word of every document, so what is gathered grows with
the corpus; what a task holds is bounded by ``vocabulary`` and ``buckets``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernels, ngrams


@dataclass(frozen=True)
class Settings:
    vocabulary: int = 1 << 16
    buckets: int = 1 << 20
    backing: float = 20.0


@dataclass(frozen=True)
class Model:
    """``words`` are the sorted hashes of the vocabulary; word number
    ``len(words)`` is unknown and the next one opens a document. Arrays have
    two rows: target, background."""

    words: np.ndarray
    unigram: np.ndarray
    bigram: np.ndarray
    settings: Settings


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, raw, target``: occurrences of every word hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = kernels.as_bytes(batch.column("text"))
            good = batch.column("good").to_numpy() == ngrams.FIT
            for lo, hi in kernels.groups(rows, 8 * kernels.GROUP_BYTES):
                words, bounds = kernels.word_hashes(rows[lo:hi])
                found, place = np.unique(words, return_inverse=True)
                trusted = good[lo:hi][kernels.owners(bounds)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found.view(np.int64)),
                        pa.array(np.bincount(place, minlength=len(found))),
                        pa.array(np.bincount(place[trusted], minlength=len(found))),
                    ],
                    ["word", "raw", "target"],
                )

    return (
        texts.mapInArrow(run, "word long, raw long, target long")
        .groupBy("word")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    )


def _numbers(words: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    if not len(vocabulary):
        return np.zeros(len(words), np.int64)
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    return np.where(vocabulary[at] == words, at, len(vocabulary))


def _steps(
    texts: list[bytes], vocabulary: np.ndarray, buckets: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word number, number of the word before, bigram bucket, text index."""
    words, bounds = kernels.word_hashes(texts)
    number = _numbers(words, vocabulary)
    before = np.empty_like(number)
    before[1:] = number[:-1]
    firsts = bounds[:-1][np.diff(bounds) > 0]
    before[firsts] = len(vocabulary) + 1
    pair = before.astype(np.uint64) * np.uint64(len(vocabulary) + 2) + number.astype(np.uint64)
    bucket = (kernels.mix(pair + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
    return number, before, bucket, kernels.owners(bounds)


def fit(docs: DataFrame, good: DataFrame, settings: Settings | None = None) -> Model:
    """Both models from all documents; ``good`` is ``doc_id, good``, unique
    ids. Without good documents the target is uniform."""
    settings = settings or Settings()
    texts = ngrams.marked(docs, good)
    top = word_counts(texts).orderBy(F.desc("raw"), "word").limit(settings.vocabulary).toArrow()
    vocabulary = np.sort(top.column("word").to_numpy().view(np.uint64))
    order = np.argsort(top.column("word").to_numpy().view(np.uint64))

    def features(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        _, _, bucket, text = _steps(rows, vocabulary, settings.buckets)
        return bucket, text

    raw, target = ngrams.bucket_arrays(
        ngrams.bucket_sums(texts, settings.buckets, features), settings.buckets
    )
    known = np.stack([top.column("target").to_numpy()[order], top.column("raw").to_numpy()[order]])
    bigram = np.stack([target, raw])
    total = bigram.sum(axis=1)
    unknown = np.maximum(total - known.sum(axis=1), 0)
    unigram = np.concatenate((known, unknown[:, None]), axis=1).astype(float)
    if total[1] > 0 and total[0] > 0:
        unigram[1] *= total[0] / total[1]
        bigram[1] *= total[0] / total[1]
    return Model(vocabulary, unigram, bigram, settings)


def losses(texts: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per text and a 2 x texts array of summed losses in nats."""
    size, backing = len(model.words), model.settings.backing
    number, before, bucket, text = _steps(texts, model.words, model.settings.buckets)
    out = np.zeros((2, len(texts)))
    for side in (0, 1):
        unigram = model.unigram[side]
        chance = (unigram + 1) / (unigram.sum() + size + 1)
        # A document's opening is a context of its own; its count is not kept,
        # so its step goes by the unigram alone.
        context = np.append(unigram, 0.0)[before]
        counted = np.where(before == size + 1, 0.0, model.bigram[side][bucket])
        counted = np.minimum(counted, context)
        loss = -np.log((counted + backing * chance[number]) / (context + backing))
        out[side] = np.bincount(text, loss, minlength=len(texts))
    return np.bincount(text, minlength=len(texts)), out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, score`` of every row,
    losses per token. Texts without words, null among them, have 0 tokens and
    null losses. Ids are carried as they are, null or repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = kernels.as_bytes(batch.column("text"))
            for lo, hi in kernels.groups(rows):
                n, loss = losses(rows[lo:hi], model)
                target, background = loss / np.maximum(n, 1)
                none = n == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.slice(lo, hi - lo).column("doc_id"),
                        pa.array(n.astype(np.int64)),
                        *(
                            pa.array(x, mask=none)
                            for x in (target, background, target - background)
                        ),
                    ],
                    ["doc_id", "n_tokens", "target_loss", "background_loss", "score"],
                )

    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    return named.mapInArrow(
        run,
        "doc_id long, n_tokens long, target_loss double, background_loss double, score double",
    )
