"""Sums over all pairs of rows by packed blocks."""

from __future__ import annotations

import numpy as np

from palimpsest.operators import graph, vectors


def table(spark, n=240, clusters=3):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 6)) + 1000.0
    x[1] = x[0]
    x[2] = x[0] + 1e-7
    own = rng.integers(0, clusters, n)
    rows = [(i, int(own[i]), x[i].tolist()) for i in range(n)]
    return x, own, spark.createDataFrame(rows, "id long, cluster long, vector array<double>")


def test_close_rows_keep_their_distance():
    rng = np.random.default_rng(6)
    y = rng.normal(size=(50, 6)) + 1000.0
    x = np.concatenate((y[:5], y[5:10] + 1e-7, rng.normal(size=(300, 6))))
    exact = ((x[:, None] - y[None]) ** 2).sum(axis=2)
    np.testing.assert_allclose(vectors._squared(x, y), exact, rtol=1e-9)
    member = np.eye(4)[rng.integers(0, 4, 50)]
    both = np.concatenate((np.sqrt(exact) @ member, exact @ member), axis=1)
    np.testing.assert_allclose(vectors._distance_sums(x, y, member, True), both, rtol=1e-9)


def test_sums_leave_a_task_and_not_a_pair_of_blocks(spark, monkeypatch):
    x, own, df = table(spark)
    stages = {}
    freeze = vectors.materialize

    def seen(frame, label="stage"):
        out = freeze(frame, label)
        stages[label] = out.count()
        return out

    monkeypatch.setattr(vectors, "materialize", seen)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = {r["id"]: r["silhouette"] for r in vectors.silhouette(df, rows_per_block=3).collect()}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch
    # Some 80 blocks: a row a block and cluster would be 240 x 80 x 3.
    assert stages["sums"] < 240 * 80
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for i in range(len(x)):
        mean = [d[i, own == c].sum() / ((own == c).sum() - (c == own[i])) for c in range(3)]
        a, b = mean[own[i]], min(m for c, m in enumerate(mean) if c != own[i])
        assert abs(found[i] - (b - a) / max(a, b)) < 1e-9


def test_ranks_that_meet_all_blocks_are_those_of_stored_pairs(spark):
    _, _, df = table(spark)
    df = df.selectExpr("id", "cluster", "transform(vector, x -> x - 1000) AS vector")
    names = {"theta": 1.0, "weighted": False, "tolerance": 1e-12, "rows_per_block": 50}
    met = graph.pagerank(df, stored_per_node=0, **names).collect()
    stored = {r["id"]: r["rank"] for r in graph.pagerank(df, **names).collect()}
    assert len(met) == len(stored) == 240
    assert all(abs(r["rank"] - stored[r["id"]]) < 1e-9 for r in met)
