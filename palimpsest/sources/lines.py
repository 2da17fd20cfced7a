"""Text files as numbered lines, and files aligned by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import WHITE
from palimpsest.session import dictionary_join, materialize


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line, idx, value)``: line numbers per file and over all files in
    path order, both from 0.

    A line's number is its place in its input split plus the lines of the
    splits before it, so nothing but one row per split is sorted. The lines are
    frozen with their places first: cores that come or go between two scans
    change how a file is split.
    """
    raw = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("mid"),
    )
    # Counting and numbering must see the same splits in the same tasks.
    raw = materialize(raw, "lines")
    in_file = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    overall = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        raw.groupBy("file", "start")
        .agg(F.min("mid").alias("first"), F.count("*").alias("n"))
        .select(
            "file",
            "start",
            "first",
            F.coalesce(F.sum("n").over(in_file), F.lit(0)).alias("line0"),
            F.coalesce(F.sum("n").over(overall), F.lit(0)).alias("idx0"),
        )
    )
    place = F.col("mid") - F.col("first")
    return dictionary_join(raw, splits, ["file", "start"], "inner").select(
        "file", (F.col("line0") + place).alias("line"), (F.col("idx0") + place).alias("idx"), "value"
    )


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """``(source, target)`` of a file of ``source<TAB>target`` lines, both
    stripped. Of several lines of a source the last counts; further fields are
    left out, and a line without a tab is an error."""
    parts = F.split("value", "\t")
    broken = F.raise_error(F.concat(F.lit("no tab in line: "), "value"))
    target = F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(broken)
    rows = read_lines(spark, path).select(
        F.btrim(F.get(parts, F.lit(0)), F.lit(WHITE)).alias("source"),
        F.btrim(target, F.lit(WHITE)).alias("target"),
        "idx",
    )
    return rows.groupBy("source").agg(F.max_by("target", "idx").alias("target"))


def read_parallel(spark: SparkSession, source: str, target: str) -> DataFrame:
    """``(pair_id, source, target)``: line i of one side with line i of the
    other; sides of unequal length are an error.

    The sides meet by a sorted merge: files of lines that repeat are small, but
    the lines are not, so a broadcast chosen by the size of the files may not
    fit the driver.
    """
    sides = [read_lines(spark, p).select("idx", "value") for p in (source, target)]
    counts = [s.count() for s in sides]
    if counts[0] != counts[1]:
        raise ValueError(f"{source} has {counts[0]} lines, {target} has {counts[1]}")
    left = sides[0].select(F.col("idx").alias("pair_id"), F.col("value").alias("source"))
    right = sides[1].select(F.col("idx").alias("pair_id"), F.col("value").alias("target"))
    return left.join(right.hint("merge"), "pair_id")
