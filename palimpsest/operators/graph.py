"""Distance graphs per cluster, their PageRank, and representatives.

Two members of a cluster are linked when their cosine distance exceeds a
threshold. Such a graph is nearly complete, so it is not stored: strengths come
from one pass over block pairs that emits one sum per node, and ranks from sums
over all rows less those over the few pairs without an edge.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.shipping import ship
from palimpsest.operators.vectors import (
    BLOCK_ROWS, dot, far_weights, sums_by_blocks, threshold_pairs, unit, with_blocks,
)
from palimpsest.session import dictionary_join, materialize, scratch_path

ship(__name__)

# Edge threshold, damping and per-node tolerance.
THETA = 0.4
DAMPING = 0.85
TOLERANCE = 1e-6
# Stored pairs a node up to which ranks are computed from them.
STORED_PER_NODE = 1000

# Sums of weight x share over a node's neighbours: cluster, id, q to cluster, id, y.
Pull = Callable[[DataFrame], DataFrame]


def _weighted_sums(blocked: DataFrame, theta: float, weighted: bool) -> DataFrame:
    """``(cluster, id, y, degree)``: y = sum of weight x ``q`` over neighbours."""

    def kernel(low: dict, high: dict, same: bool) -> tuple[np.ndarray, np.ndarray]:
        w = far_weights(low["u"], high["u"], theta, weighted)
        if same:
            np.fill_diagonal(w, 0.0)
        return np.arange(2), np.stack((w @ high["q"], np.count_nonzero(w, axis=1)), axis=1)

    parts = sums_by_blocks(blocked, "cluster", ["u", "q"], kernel)

    def total(which: int) -> Column:
        return F.sum(F.when(F.col("other") == which, F.col("total")))

    return parts.groupBy("cluster", "id").agg(total(0).alias("y"), total(1).cast("long").alias("degree"))


def _nodes(df: DataFrame, cluster: str, key: str, vector: str, rows_per_block: int) -> DataFrame:
    rows = df.select(
        F.col(cluster).alias("cluster"), F.col(key).alias("id"), unit(vector).alias("u")
    )
    return with_blocks(rows, "cluster", "id", rows_per_block)


def node_strengths(
    df: DataFrame, theta: float = THETA, weighted: bool = True, *, cluster: str = "cluster",
    key: str = "id", vector: str = "vector", rows_per_block: int = BLOCK_ROWS,
) -> DataFrame:
    """``(cluster, id, degree, strength)`` of the distance graph; a node without
    edges has 0."""
    blocked = _nodes(df, cluster, key, vector, rows_per_block).withColumn("q", F.lit(1.0))
    sums = _weighted_sums(blocked, theta, weighted)
    return sums.select("cluster", "id", "degree", F.col("y").alias("strength"))


def _recomputed(nodes: DataFrame, theta: float, weighted: bool) -> Pull:
    """Sums that meet all blocks again."""

    def pull(shares: DataFrame) -> DataFrame:
        blocked = nodes.join(shares, ["cluster", "id"])
        return _weighted_sums(blocked, theta, weighted).select("cluster", "id", "y")

    return pull


def _stored_edges(pairs: DataFrame, weighted: bool) -> DataFrame:
    """Both directions, frozen: ``cluster, id, other, w``."""
    w = F.col("distance") if weighted else F.lit(1.0)
    ends = pairs.select("cluster", F.col("id_a").alias("id"), F.col("id_b").alias("other"), w.alias("w"))
    back = ends.select("cluster", F.col("other").alias("id"), F.col("id").alias("other"), "w")
    return materialize(ends.unionByName(back), "edges")


def _over_edges(edges: DataFrame, shares: DataFrame) -> DataFrame:
    """``(cluster, id, e)``: sum of weight x ``q`` over stored edges."""
    theirs = shares.withColumnRenamed("id", "other")
    return edges.join(theirs, ["cluster", "other"]).groupBy("cluster", "id").agg(
        F.sum(F.col("w") * F.col("q")).alias("e")
    )


def _from_far(far: DataFrame, weighted: bool) -> Pull:
    """Sums over a graph that has few edges."""
    edges = _stored_edges(far, weighted)

    def pull(shares: DataFrame) -> DataFrame:
        sums = _over_edges(edges, shares)
        return shares.join(sums, ["cluster", "id"], "left").select(
            "cluster", "id", F.coalesce("e", F.lit(0.0)).alias("y")
        )

    return pull


def _from_near(nodes: DataFrame, near: DataFrame, weighted: bool) -> Pull:
    """Sums over a graph that lacks few edges: those over all rows of the
    cluster, which are a few sums of vectors, less those over near pairs.

    The vectors are dealt to buckets once; a round moves only shares to them.
    """
    edges = _stored_edges(near, weighted)
    spark = nodes.sparkSession
    dims = nodes.agg(F.max(F.size("u"))).first()[0] or 0
    if weighted:
        name = f"graph_nodes_{uuid.uuid4().hex}"
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        nodes.select("cluster", "id", "u").write.bucketBy(buckets, "cluster", "id").option(
            "path", scratch_path(spark, "nodes")
        ).saveAsTable(name)
        nodes = spark.table(name)

    def pull(shares: DataFrame) -> DataFrame:
        sums = _over_edges(edges, shares)
        if weighted:
            rows = nodes.join(shares, ["cluster", "id"])
            parts = [F.sum(F.get("u", F.lit(i)) * F.col("q")) for i in range(dims)]
            all_of = rows.groupBy("cluster").agg(
                F.sum("q").alias("all_q"), F.array(*parts).cast("array<double>").alias("all_u")
            )
        else:
            rows = shares
            all_of = shares.groupBy("cluster").agg(F.sum("q").alias("all_q"))
        rows = dictionary_join(rows, materialize(all_of, "totals"), ["cluster"], "inner")
        # A row has no edge to itself.
        whole = F.col("all_q") - F.col("q")
        if weighted:
            whole = whole - (dot("u", "all_u") - dot("u", "u") * F.col("q"))
        rows = rows.select("cluster", "id", whole.alias("whole"))
        return rows.join(sums, ["cluster", "id"], "left").select(
            "cluster", "id", F.greatest(F.col("whole") - F.coalesce("e", F.lit(0.0)), F.lit(0.0)).alias("y")
        )

    return pull


def pagerank(
    df: DataFrame, theta: float = THETA, weighted: bool = True, *, damping: float = DAMPING,
    tolerance: float = TOLERANCE, max_iterations: int = 100, cluster: str = "cluster",
    key: str = "id", vector: str = "vector", rows_per_block: int = BLOCK_ROWS,
    stored_per_node: int = STORED_PER_NODE,
) -> DataFrame:
    """``(cluster, id, rank)`` for all clusters at once.

    Edges are counted with the node strengths. Where there are few, or where
    few pairs have none, those pairs are stored once and a round is linear in
    rows and stored pairs; a graph with more than ``stored_per_node`` of both a
    node is met again block by block in every round.

    Rank of a node without edges is shared evenly. Each round is written to the
    shared folder, which cuts the lineage; the rounds stop when every cluster
    moved less than ``tolerance`` per node. Reaching ``max_iterations`` first is
    an error that names some of the clusters that still move.
    """
    nodes = materialize(_nodes(df, cluster, key, vector, rows_per_block), "nodes")
    sizes = nodes.groupBy("cluster").agg(F.count("*").alias("n"))
    strength = _weighted_sums(nodes.withColumn("q", F.lit(1.0)), theta, weighted)
    fixed = materialize(
        dictionary_join(
            strength.select("cluster", "id", F.col("y").alias("strength"), "degree"), sizes, ["cluster"], "inner"
        ),
        "strength",
    )
    seen = fixed.agg(
        F.count("*").alias("rows"), F.sum("degree").alias("far"), F.sum(F.col("n") - 1 - F.col("degree")).alias("near")
    ).first()
    most = stored_per_node * seen["rows"]
    vectors = nodes.select("cluster", "id", F.col("u").alias("vector"))
    if seen["rows"] and min(seen["far"], seen["near"]) <= most:
        few_near = seen["near"] <= seen["far"]
        pairs = threshold_pairs(vectors, theta, few_near, rows_per_block=rows_per_block)
        pull = _from_near(nodes, pairs, weighted) if few_near else _from_far(pairs, weighted)
    else:
        pull = _recomputed(nodes, theta, weighted)
    ranks = fixed.select("cluster", "id", "strength", "n", (1 / F.col("n")).alias("rank"))
    for _ in range(max_iterations):
        share = F.when(F.col("strength") > 0, F.col("rank") / F.col("strength")).otherwise(0.0)
        pulled = pull(ranks.select("cluster", "id", share.alias("q")))
        loose = ranks.groupBy("cluster").agg(
            F.sum(F.when(F.col("strength") > 0, 0.0).otherwise(F.col("rank"))).alias("loose")
        )
        y = F.when(F.col("strength") > 0, F.col("y")).otherwise(0.0)
        new = damping * (y + F.col("loose") / F.col("n")) + (1 - damping) / F.col("n")
        step = dictionary_join(ranks.join(pulled, ["cluster", "id"]), loose, ["cluster"], "inner")
        ranks = materialize(
            step.select(
                "cluster", "id", "strength", "n", new.alias("rank"), F.abs(new - F.col("rank")).alias("moved")
            ),
            "ranks",
        )
        moved = ranks.groupBy("cluster").agg((F.sum("moved") / F.max("n")).alias("m"))
        most = moved.agg(F.max("m")).first()[0]
        if most is None or most < tolerance:
            break
    else:
        some = [r["cluster"] for r in moved.filter(F.col("m") >= tolerance).limit(10).collect()]
        raise RuntimeError(f"no convergence in {max_iterations} rounds; clusters that still move: {some}")
    return ranks.select("cluster", "id", "rank")


def representatives(ranks: DataFrame) -> DataFrame:
    """``(cluster, id)`` of the highest rank, lowest id on ties."""
    best = F.min(F.struct((-F.col("rank")).alias("r"), F.col("id")))["id"]
    return ranks.groupBy("cluster").agg(best.alias("id"))
