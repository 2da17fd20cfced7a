"""Helpers of the operators in this package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return memory that is free inside this process to the system: a worker
    lives on between tasks, beside the others of its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


# Caches that outlive a task, to be emptied by name of what fills them.
CACHES: dict[str, dict] = {}


def empty_caches(keeps: str | None = None) -> None:
    """Empty what earlier tasks of this process have cached, but for ``keeps``."""
    others = [cache for name, cache in CACHES.items() if name != keeps and cache]
    for cache in others:
        cache.clear()
    if others:
        give_back()


def trimmed(
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str | None = None
) -> Callable:
    """``run`` as a function of batches that gives free memory back at its end,
    and first empties the caches that earlier tasks left, but for ``keeps``."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty_caches(keeps)
        yield from run(batches)
        give_back()

    return whole


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; null as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def good_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, good``: good is 1 where every label of the id says quality 1
    and none says toxic; a missing quality is not good, a missing toxic is not
    toxic. Rows without an id are left out, because they name no document."""
    good = F.coalesce(F.col("quality") == 1, F.lit(False)) & ~F.coalesce(
        F.col("toxic") == 1, F.lit(False)
    )
    return (
        labels.filter(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(good.cast("int")).alias("good"))
    )
