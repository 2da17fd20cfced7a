"""Array elements as rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row, also where the body
    uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def element_rows(
    df: DataFrame, array: Column | str, name: str, *keep: str, pos: str | None = None
) -> DataFrame:
    """One row per element, with its position if ``pos`` names a column.

    The outer form is used and its empty rows dropped: for the inner form Spark
    adds a test of the array's size, which computes the array a second time and
    before any repartitioning.
    """
    at = pos or "_pos"
    rows = df.select(*keep, F.posexplode_outer(array).alias(at, name)).filter(F.col(at).isNotNull())
    return rows if pos else rows.drop(at)
