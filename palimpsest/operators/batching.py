"""Length buckets, batches, splits, epochs and toy data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.rows import element_rows
from palimpsest.functions.text import stable_hash
from palimpsest.operators.ordering import with_group_index
from palimpsest.session import dictionary_join

# Default bucket boundaries and the shuffled-split shares.
BUCKET_BOUNDARIES = (10, 20, 30, 40)
TRAIN_TENTHS, EVAL_TENTHS = 8, 1


def bucket_id(length: Column | str, boundaries=BUCKET_BOUNDARIES) -> Column:
    """Number of boundaries the length has reached; a boundary goes up."""
    length = F.col(length) if isinstance(length, str) else length
    total = F.lit(0)
    for b in boundaries:
        total = total + (length >= b).cast("int")
    return total


def assign_batches(
    df: DataFrame,
    length: str,
    order: list[Column],
    *,
    batch_size: int,
    boundaries=BUCKET_BOUNDARIES,
    keep_short: bool = True,
) -> DataFrame:
    """Add ``bucket``, ``batch`` and ``slot``; empty rows are dropped.

    There are few buckets and one may hold most rows, so numbering goes by
    range partitions instead of a window per bucket.
    """
    kept = df.filter(F.col(length) >= 1).withColumn("bucket", bucket_id(length, boundaries))
    rows = with_group_index(kept, ["bucket"], order, "_n")
    rows = (
        rows.withColumn("batch", F.floor(F.col("_n") / batch_size).cast("long"))
        .withColumn("slot", F.pmod("_n", F.lit(batch_size)).cast("int"))
        .drop("_n")
    )
    if keep_short:
        return rows
    sizes = rows.groupBy("bucket").agg((F.max("batch") * batch_size + F.max(
        F.struct("batch", "slot"))["slot"] + 1).alias("_rows"))
    return (
        dictionary_join(rows, sizes, ["bucket"], "inner", rows_at_most=len(boundaries) + 1)
        .filter((F.col("batch") + 1) * batch_size <= F.col("_rows"))
        .drop("_rows")
    )


def pad_batches(df: DataFrame, tokens: str, pad: str = "") -> DataFrame:
    """Add ``padded``: each row's tokens padded to the longest of its batch, a
    group of as many rows as a batch has."""
    width = F.max(F.size(tokens)).over(Window.partitionBy("bucket", "batch"))
    return df.withColumn("width", width).withColumn(
        "padded",
        F.concat(F.col(tokens), F.array_repeat(F.lit(pad), F.col("width") - F.size(tokens))),
    )


def with_split(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Add ``split``: train, eval or test by 80/10/10, stable across runs."""
    tenth = F.pmod(stable_hash(F.lit(seed), key), F.lit(10))
    return df.withColumn(
        "split",
        F.when(tenth < TRAIN_TENTHS, "train")
        .when(tenth < TRAIN_TENTHS + EVAL_TENTHS, "eval")
        .otherwise("test"),
    )


def shuffle_order(key: str, seed: int = 0) -> list[Column]:
    """A repeatable random order."""
    return [stable_hash(F.lit(seed), key), F.col(key)]


def with_direction(df: DataFrame, before: str, after: str, reverse: bool = False) -> DataFrame:
    """Name the model's two sides; ``reverse`` learns after -> before."""
    src, dst = (after, before) if reverse else (before, after)
    return df.withColumn("source", F.col(src)).withColumn("target", F.col(dst))


def repeat_epochs(df: DataFrame, epochs: int) -> DataFrame:
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))


def toy_pairs(
    ids: DataFrame,
    key: str,
    *,
    kind: str = "copy",
    vocab_size: int = 100,
    min_len: int = 5,
    max_len: int = 40,
    seed: int = 0,
) -> DataFrame:
    """One toy example per id; the target copies or reverses the source.

    The vocabulary is the numbers below ``vocab_size - 1`` and one non-ASCII
    word.
    """
    if kind not in ("copy", "reverse"):
        raise ValueError(f"unknown kind {kind}")
    size = F.pmod(stable_hash(F.lit(seed), key), F.lit(max_len - min_len + 1)) + min_len

    def word(i: Column) -> Column:
        n = F.pmod(stable_hash(F.lit(seed), key, i), F.lit(vocab_size))
        return F.when(n == vocab_size - 1, "笑").otherwise(n.cast("string"))

    source = F.transform(F.sequence(F.lit(1), size.cast("int")), word)
    out = ids.select(key, source.alias("_s"))
    target = F.reverse("_s") if kind == "reverse" else F.col("_s")
    return out.select(
        key, F.concat_ws(" ", "_s").alias("source"), F.concat_ws(" ", target).alias("target")
    )


def unbatch(df: DataFrame, arrays: list[str], *keep: str) -> DataFrame:
    """Rows of a struct-of-arrays batch."""
    return element_rows(df, F.arrays_zip(*arrays), "_r", *keep, pos="slot").select(
        *keep, "slot", *[F.col(f"_r.{a}").alias(a) for a in arrays]
    )
