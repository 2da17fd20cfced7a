"""Numbering, joins and pair sums that must not depend on how data is split."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest import session
from palimpsest.operators import batching as B
from palimpsest.operators import graph as R
from palimpsest.operators import ordering as O
from palimpsest.operators import vectors as V
from palimpsest.operators import vocab


def test_index_ranks_and_sums_with_a_hot_group(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("g", F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 5))
    order = [F.col("id")]
    indexed = O.with_index(df, order, "i").collect()
    assert sorted(r["i"] for r in indexed) == list(range(1000))
    assert all(r["i"] == r["id"] for r in indexed)
    for g, rows in _by_group(O.with_group_index(df, ["g"], order, "i").collect()).items():
        assert [r["i"] for r in sorted(rows, key=lambda r: r["id"])] == list(range(len(rows)))
    sums = O.with_running_sums(df, order, {"s": "id"}).collect()
    assert all(r["s"] == r["id"] * (r["id"] + 1) // 2 for r in sums)


def _by_group(rows):
    out = {}
    for r in rows:
        out.setdefault(r["g"], []).append(r)
    return out


def test_salted_join_equals_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"w{i}") for i in range(300)], "id long, token string")
    words = spark.createDataFrame([("hot", 0), ("w3", 1)], "token string, v long")
    small = session.dictionary_join(rows, words, ["token"]).collect()
    monkeypatch.setattr(session, "BROADCAST_ROWS", 1)
    salted = session.dictionary_join(rows, words, ["token"])
    assert "_salt" not in salted.columns
    assert sorted(map(str, salted.select("token", "id", "v").collect())) == sorted(
        str(r) for r in spark.createDataFrame(small).select("token", "id", "v").collect())


def test_vocabulary_lookups(spark):
    df = spark.createDataFrame([("Hello World Hello . World Hello",)], "t string")
    tokens = F.split("t", " ")
    v = vocab.build_vocab(df, tokens)
    assert [(r["id"], r["token"], r["count"]) for r in v.orderBy("id").collect()] == [
        (0, "Hello", 3), (1, "World", 2), (2, ".", 1)]
    assert v.collect() == vocab.build_vocab(df, tokens, max_size=None).select("id", "token", "count").orderBy("id").collect()
    assert [(r["id"], r["token"]) for r in vocab.special_tokens(v).orderBy("id").collect()] == [
        (3, "UNK"), (4, "SEQUENCE_START"), (5, "SEQUENCE_END")]
    probe = spark.createDataFrame([("Hello",), ("??",)], "token string")
    assert sorted(r["token_id"] for r in vocab.lookup_ids(probe, v, 3).collect()) == [0, 3]
    assert sorted(r["token_count"] for r in vocab.lookup_counts(probe, v).collect()) == [-1, 3]
    back = spark.createDataFrame([(1,), (3,)], "token_id long")
    assert sorted(r["token"] for r in vocab.lookup_tokens(back, v).collect()) == ["UNK", "World"]
    assert vocab.token_counts(df, tokens, min_frequency=2).count() == 1


def test_batches(spark):
    df = spark.createDataFrame([(i, ["x"] * (i % 13)) for i in range(100)], "id long, t array<string>")
    df = df.withColumn("n", F.size("t"))
    out = B.pad_batches(B.assign_batches(df, "n", [F.col("id")], batch_size=8, boundaries=(0, 5, 10)), "t").collect()
    assert len(out) == sum(1 for i in range(100) if i % 13)
    widths = {}
    for r in out:
        widths.setdefault((r["bucket"], r["batch"]), set()).add(len(r["padded"]))
    assert all(len(w) == 1 for w in widths.values())
    assert B.bucket_id(F.lit(10)).cast("int") is not None
    full = B.assign_batches(df, "n", [F.col("id")], batch_size=8, keep_short=False)
    assert {r["count"] for r in full.groupBy("bucket", "batch").count().collect()} == {8}
    one = spark.range(1).select(*[B.bucket_id(F.lit(n)).alias(str(n)) for n in (9, 10, 40)]).first()
    assert tuple(one) == (0, 1, 4)


def test_split_covers_everything(spark):
    out = B.with_split(spark.range(2000), "id").groupBy("split").count().collect()
    sizes = {r["split"]: r["count"] for r in out}
    assert sum(sizes.values()) == 2000 and 1500 < sizes["train"] < 1700
    with pytest.raises(ValueError):
        B.toy_pairs(spark.range(1), "id", kind="other")


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 6))
    x[60:70] = x[0]  # a group of copies
    x[80:] = np.array([5.0, 5, 5, 5, 5, 5]) + rng.normal(size=(10, 6)) * 0.01  # a tight cluster
    labels = np.array([0] * 60 + [0] * 10 + [1] * 10 + [2] * 9 + [3])
    df = spark.createDataFrame(
        [(i, int(c), [float(t) for t in v]) for i, (c, v) in enumerate(zip(labels, x))],
        "id long, cluster long, vector array<double>")
    return x, labels, df


def weights(x, theta):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    w = np.where(d > theta, d, 0.0)
    np.fill_diagonal(w, 0)
    return w


def test_pagerank_against_dense_matrix(points):
    x, labels, df = points
    ranks = {r["id"]: r["rank"] for r in R.pagerank(df, 0.4, tolerance=1e-8, rows_per_block=16).collect()}
    for c in set(labels):
        ids = np.flatnonzero(labels == c)
        w = weights(x[ids], 0.4)
        s = w.sum(axis=1)
        r = np.full(len(ids), 1 / len(ids))
        for _ in range(200):
            loose = r[s == 0].sum() / len(ids)
            r = 0.85 * (w @ np.divide(r, s, out=np.zeros_like(r), where=s > 0) + loose) + 0.15 / len(ids)
        assert [ranks[i] for i in ids] == pytest.approx(list(r), abs=1e-7)
        assert sum(ranks[i] for i in ids) == pytest.approx(1)


def test_silhouette_against_brute_force(points):
    x, labels, df = points
    got = {r["id"]: r["silhouette"] for r in V.silhouette(df, rows_per_block=16).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for i in range(len(x)):
        own = labels == labels[i]
        if own.sum() == 1:
            assert got[i] == 0
            continue
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][labels == c].mean() for c in set(labels) if c != labels[i])
        assert got[i] == pytest.approx((b - a) / max(a, b), abs=1e-9)


def test_distant_pairs_against_brute_force(points):
    x, labels, df = points
    got = {(r["id_a"], r["id_b"]) for r in V.distant_pairs(df, 1.2, rows_per_block=16).collect()}
    w = weights(x, 1.2)
    assert got == {(i, j) for i in range(90) for j in range(i + 1, 90) if w[i, j] > 0 and labels[i] == labels[j]}
