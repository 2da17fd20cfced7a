"""Numeric formulas of the metrics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """``top / bottom``, 0 when the bottom is 0."""
    bottom = _col(bottom)
    return F.when(bottom == 0, F.lit(0.0)).otherwise(
        _col(top).cast("double") / F.when(bottom == 0, F.lit(None)).otherwise(bottom)
    )


def safe_log(x: Column | str) -> Column:
    """Natural log; a value so low that its exponential is 0 for 0."""
    x = _col(x)
    return F.when(x > 0, F.log(F.when(x > 0, x))).otherwise(F.lit(-9999999999.0))


def brevity_penalty(hyp_len: Column | str, ref_len: Column | str) -> Column:
    hyp, ref = _col(hyp_len), _col(ref_len)
    return F.when(hyp == 0, F.lit(0.0)).otherwise(
        F.when(hyp < ref, F.exp(1 - ratio(ref, hyp))).otherwise(F.lit(1.0))
    )


def length_penalty(length: Column | str, weight: float) -> Column:
    """((5 + length) / 6) ** weight."""
    return F.pow((_col(length).cast("double") + 5) / 6, F.lit(float(weight)))


def f1(p: Column, r: Column) -> Column:
    return 2.0 * p * r / (p + r + 1e-8)


def lcs_f(p: Column, r: Column) -> Column:
    """F with beta = P / R, as ROUGE-L weighs it."""
    beta2 = F.pow(p / (r + 1e-12), F.lit(2.0))
    return (1 + beta2) * r * p / (r + beta2 * p + 1e-12)
