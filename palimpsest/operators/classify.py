"""Perfect, changed and bad predictions; losses, throughput and run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.scores import ratio
from palimpsest.functions.text import BEAM_SEPARATOR, WHITE


def stripped(text: Column) -> Column:
    """The text without white space at its ends; what is inside stays."""
    return F.btrim(text, F.lit(WHITE))


def outcome(hyp: str, source: str, target: str) -> Column:
    """perfect if the hypothesis is the target, else bad if it is the source,
    else changed; surrounding white space is ignored."""
    h, s, g = (stripped(F.col(c)) for c in (hyp, source, target))
    return F.when(h == g, "perfect").when(h == s, "bad").otherwise("changed")


def classify_greedy(df: DataFrame, hyp: str, source: str, target: str) -> DataFrame:
    """One row: counts per outcome and the perfect rate in percent, cut to two
    decimals."""
    kind = outcome(hyp, source, target)
    counts = df.agg(
        *[F.count_if(kind == k).alias(k) for k in ("perfect", "changed", "bad")],
        F.count("*").alias("total"),
    )
    return counts.withColumn("perfect_rate", truncated_rate("perfect", "total"))


def truncated_rate(part: str, whole: str) -> Column:
    """part / whole cut (not rounded) to two decimals of a percentage."""
    return ratio(F.floor(ratio(F.col(part) * 10000, whole)), F.lit(100))


def with_beam_outcomes(
    df: DataFrame, beams: str, source: str, target: str, separator: str = BEAM_SEPARATOR
) -> DataFrame:
    """Add per example whether a hypothesis is perfect, how many are potential
    and how many repeat the source."""
    hyps = F.transform(F.split(beams, separator, -1), stripped)
    g, s = (stripped(F.col(c)) for c in (target, source))
    return df.withColumns(
        {
            "n_hyps": F.size(hyps).cast("long"),
            "perfect": F.exists(hyps, lambda h: h == g),
            "potential": F.size(F.filter(hyps, lambda h: (h != g) & (h != s))).cast("long"),
            "same": F.size(F.filter(hyps, lambda h: (h != g) & (h == s))).cast("long"),
        }
    )


def classify_beams(df: DataFrame, beams: str, source: str, target: str) -> DataFrame:
    """One row: examples with a perfect hypothesis, potential and unchanged
    hypotheses, potential per example, examples where all are unchanged."""
    return with_beam_outcomes(df, beams, source, target).agg(
        F.count_if("perfect").alias("perfect"),
        F.coalesce(F.sum("potential"), F.lit(0)).alias("potential"),
        F.coalesce(F.sum("same"), F.lit(0)).alias("same"),
        ratio(F.coalesce(F.sum("potential"), F.lit(0)), F.count("*")).alias("potential_per_example"),
        F.count_if(F.col("same") == F.col("n_hyps")).alias("all_same"),
    )


def masked_mean_loss(df: DataFrame, loss: str, position: str, target_len: str) -> DataFrame:
    """One row: mean loss over positions before the last target token, and the
    perplexity of it."""
    kept = df.filter(F.col(position) < F.col(target_len) - 1)
    sums = kept.agg(
        F.count("*").alias("positions"), F.coalesce(F.sum(loss), F.lit(0.0)).alias("_sum")
    )
    mean = ratio("_sum", "positions")
    return sums.select("positions", mean.alias("log_perplexity"), F.exp(mean).alias("perplexity"))


def masked_loss_of_arrays(df: DataFrame, losses: str, target_len: str) -> DataFrame:
    """As :func:`masked_mean_loss` for rows that hold the losses as an array."""
    rows = df.select(target_len, F.posexplode(losses).alias("_pos", "_loss"))
    return masked_mean_loss(rows, "_loss", "_pos", target_len)


def token_throughput(df: DataFrame, source_len: str, target_len: str) -> DataFrame:
    return df.agg(
        F.coalesce(F.sum(F.col(source_len) + F.col(target_len)), F.lit(0)).alias("num_tokens")
    )


def length_histogram(df: DataFrame, length: str, width: int) -> DataFrame:
    """Rows per length band ``[lower, lower + width)``."""
    lower = F.floor(F.col(length) / width) * width
    return df.groupBy(lower.cast("long").alias("lower")).agg(F.count("*").alias("n"))


def run_report(log: DataFrame, seconds: str, hypotheses: str, *by: str) -> DataFrame:
    """Seconds per example and per hypothesis from a run-log table."""
    return (
        log.groupBy(*by)
        .agg(
            F.count("*").alias("examples"),
            F.sum(hypotheses).alias("hypotheses"),
            F.sum(seconds).alias("seconds"),
        )
        .withColumn("sec_per_example", ratio("seconds", "examples"))
        .withColumn("sec_per_hypothesis", ratio("seconds", "hypotheses"))
    )
