"""Connected components of a stored edge table, by star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import discard, materialize

ONE_TASK_EDGES = 100_000


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.shiftright(F.xxhash64("u", "v"), 20)).alias("s")
    ).first()
    return row["n"], row["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return (
        both.join(least, "u")
        .filter((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = (
        down.join(least, "u")
        .filter(F.col("v") != F.col("m"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
    )
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``u, v`` edges between long ids to ``id, root``, root being the least id
    of the component. Nodes without an edge have no row.

    Large-star and small-star steps alternate until nothing moves. Every round
    is a written table; a node with many neighbours only meets a minimum that
    is aggregated before the shuffle and a join that Spark can split.
    """
    edges = edges.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    now = materialize(edges.distinct(), "edges")
    before = _state(now)
    if before[0] <= ONE_TASK_EDGES:
        return now.coalesce(1).mapInArrow(_joined, "id long, root long")
    while True:
        after_step = materialize(_small_star(_large_star(now)), "edges")
        discard(now)
        now = after_step
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    )


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All of a counted few edges, joined in one task."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    ids = list(parent)
    yield pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([find(x) for x in ids], pa.int64())], ["id", "root"]
    )
