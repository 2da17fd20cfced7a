"""Threshold joins between bounded blocks and ranks from stored pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import graph as R
from palimpsest.operators import vectors as V


def clustered(seed, rows, groups=2, spread=0.05, dims=6):
    """Tight bundles of directions, some zero vectors among them."""
    draw = np.random.default_rng(seed)
    centers = draw.normal(size=(8, dims))
    points = centers[draw.integers(0, 8, rows)] + draw.normal(size=(rows, dims)) * spread
    points[:: max(1, rows // 5)] = 0
    return [(int(i % groups), int(i), [float(x) for x in p]) for i, p in enumerate(points)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "cluster long, id long, vector array<double>")


def cosine_distances(rows):
    x = np.array([r[2] for r in rows])
    n = np.linalg.norm(x, axis=1)
    u = np.divide(x, n[:, None], out=np.zeros_like(x), where=n[:, None] > 0)
    return 1 - u @ u.T


@pytest.mark.parametrize("theta", [0.02, 0.4, 0.99, 1.3])
@pytest.mark.parametrize("near", [True, False])
def test_threshold_pairs_match_all_pairs(spark, theta, near):
    rows = clustered(2, 160)
    d = cosine_distances(rows)
    want = {
        (rows[i][0], i, j)
        for i in range(len(rows))
        for j in range(i + 1, len(rows))
        if rows[i][0] == rows[j][0] and (d[i, j] <= theta if near else d[i, j] > theta)
    }
    got = V.threshold_pairs(frame(spark, rows), theta, near, rows_per_block=16).collect()
    assert {(r["cluster"], r["id_a"], r["id_b"]) for r in got} == want and len(got) == len(want)
    assert all(abs(r["distance"] - d[r["id_a"], r["id_b"]]) < 1e-9 for r in got)


def test_bounds_hold_and_skip_most_block_pairs(spark):
    rows = clustered(5, 640, groups=1, spread=0.01)
    source = frame(spark, rows).select("cluster", "id", V.unit("vector").alias("_u"))
    blocked, pairs = V.pivot_blocks(source, "cluster", "id", rows_per_block=16)
    block = {r["id"]: r["block"] for r in blocked.collect()}
    bounds = {(r["_lo"], r["_hi"]): (r["least"], r["most"]) for r in pairs.collect()}
    assert len(bounds) == 40 * 41 // 2
    d = cosine_distances(rows)
    for i in range(0, 640, 3):
        for j in range(i + 1, 640):
            least, most = bounds[tuple(sorted((block[i], block[j])))]
            assert least <= d[i, j] <= most
    met = sum(least <= 0.05 for least, _ in bounds.values())
    assert met < 0.5 * len(bounds)


def test_no_rows_have_no_pairs(spark):
    assert V.threshold_pairs(frame(spark, []), 0.4, True).collect() == []
    assert R.pagerank(frame(spark, [])).collect() == []


def dense_ranks(rows, theta, weighted, damping):
    out = {}
    for cluster in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == cluster]
        d = cosine_distances(own)
        w = np.where(d > theta, d if weighted else 1.0, 0.0)
        np.fill_diagonal(w, 0)
        s, n = w.sum(axis=1), len(own)
        rank = np.full(n, 1 / n)
        for _ in range(300):
            q = np.divide(rank, s, out=np.zeros(n), where=s > 0)
            rank = damping * (w @ q + rank[s == 0].sum() / n) + (1 - damping) / n
        out |= {r[1]: x for r, x in zip(own, rank, strict=True)}
    return out


@pytest.mark.parametrize(
    ("theta", "weighted", "stored"),
    [(0.4, True, 1000), (0.4, False, 1000), (1.5, True, 1000), (1.5, False, 1000), (0.7, True, 0)],
)
def test_ranks_match_a_dense_matrix_by_every_way(spark, theta, weighted, stored):
    rows = clustered(9, 90)
    ranks = R.pagerank(
        frame(spark, rows), theta, weighted, damping=0.4, tolerance=1e-9, rows_per_block=16, stored_per_node=stored
    )
    want = dense_ranks(rows, theta, weighted, 0.4)
    got = {r["id"]: r["rank"] for r in ranks.collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[i] - want[i]) for i in want) < 1e-7


def test_a_round_moves_no_vectors(spark):
    rows = frame(spark, clustered(3, 60))
    nodes = R._nodes(rows, "cluster", "id", "vector", 16)
    near = V.threshold_pairs(rows, 0.4, True, rows_per_block=16)
    pull = R._from_near(nodes, near, True)
    shares = nodes.select("cluster", "id", F.lit(0.1).alias("q"))
    plan = pull(shares)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "Scan parquet" in line and "graph_nodes_" in line]
    assert scans and all("Bucketed: true" in line for line in scans)


def test_labelings_match_one_at_a_time(spark):
    rows = frame(spark, clustered(4, 70, groups=3)).withColumn("other", F.col("id") % 4)
    both = {
        r["labeling"]: r
        for r in V.silhouettes_of_labelings(rows, {"cluster": 3, "other": 6}, rows_per_block=16).collect()
    }
    for name in ("cluster", "other"):
        alone = V.mean_silhouette(rows, cluster=name, rows_per_block=16).first()[0]
        assert both[name]["silhouette"] == pytest.approx(alone) and both[name]["rows"] == 70
    assert both["cluster"]["squared_silhouette"] != pytest.approx(both["cluster"]["silhouette"])
    single = V.silhouettes_of_labelings(rows.withColumn("one", F.lit(0)), {"one": 1}).first()
    assert single["silhouette"] is None
