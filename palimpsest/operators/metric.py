"""Text metrics that plug into the running and the streaming forms.

A metric is a set of per-pair numbers that add up, and closing expressions
over their sums: a user aggregate built from columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.scores import ratio
from palimpsest.operators import bleu, rouge
from palimpsest.operators.ordering import with_running_sums
from palimpsest.session import materialize


@dataclass(frozen=True)
class TextMetric:
    """``per_pair(df, hyp, ref)`` adds the columns ``sums``; ``close()`` turns
    their totals into the result columns. ``postproc`` rewrites both texts."""

    sums: tuple[str, ...]
    per_pair: Callable[[DataFrame, str, str], DataFrame]
    close: Callable[[], list[Column]]
    postproc: Callable[[Column], Column] | None = None

    def _scored(self, df: DataFrame, hyp: str, ref: str) -> DataFrame:
        if self.postproc is not None:
            df = df.withColumns({c: self.postproc(F.col(c)) for c in (hyp, ref)})
        return self.per_pair(df, hyp, ref)

    def corpus(self, df: DataFrame, hyp: str, ref: str, *by: str) -> DataFrame:
        """Value over all pairs (of each group)."""
        sums = self._scored(df, hyp, ref).groupBy(*by).agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in self.sums]
        )
        return sums.select(*by, *self.close())

    def running(self, df: DataFrame, key: str, hyp: str, ref: str) -> DataFrame:
        """Value over all pairs up to each one, in key order."""
        rows = materialize(
            self._scored(df, hyp, ref).select(key, *[F.col(c).alias(f"_{c}") for c in self.sums]),
            "pair-scores",
        )
        sums = with_running_sums(rows, [F.col(key)], {c: f"_{c}" for c in self.sums})
        return sums.select(key, *self.close())


def bleu_metric(postproc: Callable[[Column], Column] | None = None) -> TextMetric:
    return TextMetric(
        tuple(bleu.COUNTS),
        lambda df, hyp, ref: bleu.pair_counts(df, hyp, [ref]),
        bleu.bleu_score,
        postproc,
    )


def rouge_n_metric(n: int, postproc: Callable[[Column], Column] | None = None) -> TextMetric:
    name = f"rouge_{n}_f"
    return TextMetric(
        (name, "_pairs"),
        lambda df, hyp, ref: rouge.with_rouge_n(df, hyp, ref, n).withColumn("_pairs", F.lit(1)),
        lambda: [ratio(name, "_pairs").alias(name)],
        postproc,
    )
