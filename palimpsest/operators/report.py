"""Periodic samples of predictions next to their targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_every(df: DataFrame, step: str, every: int, delimiter: str = " ") -> DataFrame:
    """Rows of every n-th step with ``prediction`` and ``target`` text.

    The prediction is cut to the target length without the end, the target
    loses its start marker. Columns: predicted_tokens, target_tokens,
    target_len.
    """
    rows = df.filter(F.col(step) % every == 0)
    n = F.col("target_len") - 1
    return rows.withColumns(
        {
            "prediction": F.concat_ws(delimiter, F.slice("predicted_tokens", F.lit(1), n)),
            "target": F.concat_ws(delimiter, F.slice("target_tokens", F.lit(2), n)),
        }
    )
