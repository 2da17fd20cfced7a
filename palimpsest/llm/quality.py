"""Quality rules: counts on the words of a text, then a hashed n-gram
log-likelihood ratio between trusted text and the raw corpus.

Both multinomials count all of their documents. A document's ratio is divided
by its number of n-grams, so length does not decide, and every document meets
the same threshold. The threshold is ``margin`` below the ``tail`` quantile of
all trusted documents that are held out of the target counts, so that it is not
set on documents the model has learnt.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import trimmed
from palimpsest.llm import kernels, ngrams
from palimpsest.llm.importance import lower_quantile


@dataclass(frozen=True)
class Rules:
    """``margin`` lies between the ``tail`` quantile and the threshold."""

    buckets: int = 1 << 16
    sizes: tuple[int, ...] = (1, 2)
    smoothing: float = 1.0
    min_words: int = 50
    repeat_share: float = 0.5
    tail: float = 0.002
    margin: float = 0.05


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray
    threshold: float
    rules: Rules


_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_HIDDEN = (np.arange(256) & 0xC0) == 0x80  # bytes inside a code point


def measures(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data = np.frombuffer(text, np.uint8)
    chars = len(data) - int(_HIDDEN[data].sum()) - int(kernels._SPACE[data].sum())
    words, _ = kernels.word_hashes([text])
    seen: set[bytes] = set()
    doubles = 0
    for line in text.split(b"\n"):
        if line.strip(b" \t\v\f\r"):
            doubles += line in seen
            seen.add(line)
    return (
        len(words),
        chars,
        int(_SYMBOLS[data].sum()),
        doubles,
        _repeated(words),
    )


def _repeated(words: np.ndarray) -> int:
    """Words inside a run of three that occurs at least twice."""
    runs, _ = kernels.windows(words, np.array([0, len(words)]), 3)
    if len(runs) < 2:
        return 0
    order = np.argsort(runs, kind="stable")
    same = runs[order][1:] == runs[order][:-1]
    twice = np.zeros(len(runs), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for j in range(3):
        covered[j : len(runs) + j] |= twice
    return int(covered.sum())


def _ratios(texts: list[bytes], model_ratio: np.ndarray, rules: Rules) -> np.ndarray:
    features = ngrams.gram_buckets(rules.buckets, rules.sizes)
    total, n = ngrams.text_sums(texts, features, model_ratio)
    return total / np.maximum(n, 1)


def fit(docs: DataFrame, good: DataFrame, rules: Rules | None = None) -> Model:
    """Count both corpora over all documents and set the threshold.

    ``good`` is ``doc_id, good``, unique ids. Without trusted documents all
    ratios are 0, and with none held out there is no threshold: nothing is
    rejected by the ratio then.
    """
    rules = rules or Rules()
    features = ngrams.gram_buckets(rules.buckets, rules.sizes)
    good = ngrams.parts(good)
    texts = ngrams.marked(docs, good)
    raw, target = ngrams.bucket_arrays(
        ngrams.bucket_sums(texts, rules.buckets, features), rules.buckets
    )
    ratio = ngrams.log_ratio(raw, target, rules.smoothing)
    if not target.sum():
        return Model(ratio, float("-inf"), rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = kernels.as_bytes(batch.column("text"))
            for lo, hi in kernels.groups(rows):
                score = _ratios(rows[lo:hi], ratio, rules)
                words = np.diff(kernels.word_hashes(rows[lo:hi])[1])
                yield pa.RecordBatch.from_arrays([pa.array(score[words >= rules.min_words])], ["key"])

    held = ngrams.flagged(docs, good).filter(F.col("good") == ngrams.HELD).select("text")
    # The lower of the two neighbours keeps more of the trusted documents.
    edge = lower_quantile(held.mapInArrow(trimmed(run), "key double"), rules.tail)
    return Model(ratio, edge - rules.margin, rules)


_FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "ratio double, base_failed boolean, kept boolean"
)


def _judged(texts: list[bytes], model: Model) -> list[np.ndarray]:
    rules = model.rules
    counts = np.array([measures(t) for t in texts], np.int64).reshape(-1, 5)
    ratio = _ratios(texts, model.ratio, rules)
    failed = (counts[:, 0] < rules.min_words) | (counts[:, 4] > rules.repeat_share * counts[:, 0])
    return [*counts.T, ratio, failed, ~failed & (ratio >= model.threshold)]


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, the counts, ``ratio``, ``base_failed`` and ``kept`` of every
    row. A null text counts as empty: no words, so its base fails. Ids are
    carried as they are, null or repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = kernels.as_bytes(batch.column("text"))
            for lo, hi in kernels.groups(texts):
                columns = _judged(texts[lo:hi], model)
                names = [f.split()[0] for f in _FIELDS.split(", ")]
                ids = batch.slice(lo, hi - lo).column("doc_id")
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(np.ascontiguousarray(c)) for c in columns)], ["doc_id", *names]
                )

    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    return named.mapInArrow(trimmed(run), f"doc_id long, {_FIELDS}")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = kernels.as_bytes(batch.column(at))
            for lo, hi in kernels.groups(texts):
                kept = _judged(texts[lo:hi], model)[-1]
                yield batch.slice(lo, hi - lo).filter(pa.array(kept))

    return docs.mapInArrow(trimmed(run), docs.schema)
