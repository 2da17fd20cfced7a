"""ROUGE per pair and averaged over pairs.

Everything is local to a row: n-gram sets are array functions, the longest
common subsequence is an Arrow-batched function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.lcs import lcs_length_of, union_lcs_of
from palimpsest.functions.rows import once
from palimpsest.functions.scores import f1, lcs_f, ratio
from palimpsest.operators.bleu import ngrams


def rouge_words(c: Column | str) -> Column:
    """Split on every single blank, so empty text is one empty word."""
    return F.split(F.col(c) if isinstance(c, str) else c, " ")


def with_rouge_n(df: DataFrame, hyp: str, ref: str, n: int) -> DataFrame:
    """Add ``rouge_n_{p,r,f}`` from the sets of n-grams."""
    out = df.withColumns(
        {
            "_h": once(rouge_words(hyp), lambda w: F.array_distinct(ngrams(w, n))),
            "_r": once(rouge_words(ref), lambda w: F.array_distinct(ngrams(w, n))),
        }
    )
    both = F.size(F.array_intersect("_h", "_r"))
    p, r = ratio(both, F.size("_h")), ratio(both, F.size("_r"))
    return out.withColumns(
        {f"rouge_{n}_p": p, f"rouge_{n}_r": r, f"rouge_{n}_f": f1(p, r)}
    ).drop("_h", "_r")


def with_rouge_l(df: DataFrame, hyp: str, ref: str) -> DataFrame:
    """Add ``lcs`` and sentence-level ``rouge_l_{p,r,f}``."""
    h, r = rouge_words(hyp), rouge_words(ref)
    out = df.withColumn("lcs", lcs_length_of(h, r))
    p, rec = ratio("lcs", F.size(h)), ratio("lcs", F.size(r))
    return out.withColumns({"rouge_l_p": p, "rouge_l_r": rec, "rouge_l_f": lcs_f(p, rec)})


def with_rouge_l_summary(df: DataFrame, hyp_sentences: str, ref_sentences: str) -> DataFrame:
    """Add summary-level ``rouge_lsum_{p,r,f}`` from arrays of sentences.

    The value of a reference sentence is |union| / sum of LCS sizes. Where
    nothing matches that is 0 / 0, which counts as 0.
    """
    def n_words(c: str) -> Column:
        return F.aggregate(c, F.lit(0), lambda a, s: a + F.size(F.split(s, " ")))

    union = union_lcs_of(hyp_sentences, ref_sentences)
    out = df.withColumn("_u", union)
    p, r = ratio("_u", n_words(hyp_sentences)), ratio("_u", n_words(ref_sentences))
    return out.withColumns(
        {"rouge_lsum_p": p, "rouge_lsum_r": r, "rouge_lsum_f": lcs_f(p, r)}
    ).drop("_u")


def rouge_report(df: DataFrame, hyp: str, ref: str) -> DataFrame:
    """One row: the means over all pairs of ROUGE-1, -2 and -L f, r and p."""
    scored = with_rouge_l(with_rouge_n(with_rouge_n(df, hyp, ref, 1), hyp, ref, 2), hyp, ref)
    return scored.agg(
        *[
            F.avg(f"rouge_{k}_{m}").alias(f"rouge_{k}_{m}")
            for k in ("1", "2", "l")
            for m in ("f", "r", "p")
        ]
    )
