"""Row numbers, ranks and running sums without a single-task window.

Each one range-sorts, freezes the sorted rows in the shared folder, and adds a
per-partition offset. The only un-partitioned window runs over one row per
range partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import dictionary_join, materialize

_ROW_BITS = 33  # monotonically_increasing_id keeps the row in the low 33 bits


def _frozen(df: DataFrame, order: list[Column]) -> DataFrame:
    marked = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
    return materialize(marked, "sorted").withColumn(
        "_part", F.shiftright("_mid", _ROW_BITS).cast("int")
    )


def _before() -> Window:
    return Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def with_index(df: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """Number all rows 0.. in the given total order."""
    rows = _frozen(df, order)
    offsets = rows.groupBy("_part").count().select(
        "_part", F.coalesce(F.sum("count").over(_before()), F.lit(0)).alias("_offset")
    )
    in_part = F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        rows.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + in_part)
        .drop("_part", "_mid", "_offset")
    )


def with_group_index(
    df: DataFrame, group: list[str], order: list[Column], name: str = "idx"
) -> DataFrame:
    """Number rows 0.. inside each group, whatever the size of the group.

    The sort key is (group, order), so a group that holds a third of the rows
    spans many range partitions.
    """
    rows = with_index(df, [*[F.col(g) for g in group], *order], "_all")
    starts = rows.groupBy(*group).agg(F.min("_all").alias("_start"))
    return (
        dictionary_join(rows, starts, group, "inner")
        .withColumn(name, F.col("_all") - F.col("_start"))
        .drop("_all", "_start")
    )


def with_running_sums(
    df: DataFrame, order: list[Column], sums: dict[str, str]
) -> DataFrame:
    """Add cumulative sums (``{new column: summed column}``) in a total order."""
    rows = _frozen(df, order)
    totals = rows.groupBy("_part").agg(
        *[F.sum(src).alias(f"_t_{dst}") for dst, src in sums.items()]
    )
    offsets = totals.select(
        "_part",
        *[
            F.coalesce(F.sum(f"_t_{dst}").over(_before()), F.lit(0)).alias(f"_o_{dst}")
            for dst in sums
        ],
    )
    inside = (
        Window.partitionBy("_part")
        .orderBy("_mid")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    out = rows.join(F.broadcast(offsets), "_part")
    for dst, src in sums.items():
        out = out.withColumn(dst, F.col(f"_o_{dst}") + F.sum(src).over(inside))
    return out.drop("_part", "_mid", *[f"_o_{dst}" for dst in sums])
