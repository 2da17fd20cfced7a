"""Heavy keys of large dictionaries, nearest centers, late choices."""

from __future__ import annotations

import random

import numpy as np
import pytest

from palimpsest.operators import ml, mining, vocab
from palimpsest.operators import abstraction as A
from palimpsest.operators import vectors as V


@pytest.mark.parametrize("counted", [True, False])
def test_lookups_of_a_large_vocabulary(spark, monkeypatch, counted):
    monkeypatch.setattr("palimpsest.session.BROADCAST_ROWS", 5)
    monkeypatch.setattr("palimpsest.session.HEAVY_KEYS", 3)
    draw = random.Random(1)
    names = [f"w{i}" for i in range(40)]
    words = ["w0"] * 300 + [draw.choice(names) for _ in range(600)] + ["unknown"] * 40 + [None, None]
    entries = [(i, n, 1000 - i) for i, n in enumerate(names)]
    v = spark.createDataFrame(entries, "id long, token string, count long")
    rows = spark.createDataFrame(list(enumerate(words)), "k long, token string").repartition(5)
    v = v if counted else v.drop("count")
    ids = {r["k"]: r["token_id"] for r in vocab.lookup_ids(rows, v, 40).collect()}
    assert ids == {k: names.index(w) if w in names else 40 for k, w in enumerate(words)}
    found = vocab.lookup_ids(rows, v, 40).select("k", "token_id")
    back = {r["k"]: r["token"] for r in vocab.lookup_tokens(found, v).collect()}
    assert back == {k: w if w in names else "UNK" for k, w in enumerate(words)}


def test_a_frequent_word_is_not_in_the_shuffled_tail(spark, monkeypatch):
    monkeypatch.setattr("palimpsest.session.BROADCAST_ROWS", 5)
    monkeypatch.setattr("palimpsest.session.HEAVY_KEYS", 3)
    v = spark.createDataFrame([(i, f"w{i}", 100 - i) for i in range(20)], "id long, token string, count long")
    rows = spark.createDataFrame([(i, "w1" if i % 3 else f"w{i % 20}") for i in range(900)], "k long, token string")
    plan = vocab.lookup_ids(rows, v, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "isnull(_heavy" in plan and "_salt" not in plan


def test_nearest_of_many_centers(spark):
    draw = np.random.default_rng(4)
    centers = draw.normal(size=(3000, 5)) * draw.uniform(0.1, 9, size=(3000, 1))
    centers[700] = centers[5]
    x = np.concatenate((draw.normal(size=(200, 5)) * 3, centers[700:701], np.zeros((1, 5))))
    names = draw.permutation(3000)
    found, distance = V._nearest(x, centers, names)
    d = np.sqrt(((x[:, None] - centers[None]) ** 2).sum(axis=2))
    want = [min((d[i, j], names[j]) for j in range(3000))[1] for i in range(len(x))]
    assert found.tolist() == want and np.allclose(distance, d.min(axis=1))
    rows = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, vector array<double>"
    )
    table = spark.createDataFrame(
        [(int(n), c.tolist()) for n, c in zip(names, centers)], "cluster long, center array<double>"
    )
    got = {r["id"]: r["nearest"] for r in V.nearest_centers(rows, table).collect()}
    assert got == {**dict(enumerate(map(int, want))), 999: None}
    assert {r["nearest"] for r in V.nearest_centers(rows, table.limit(0)).collect()} == {None}


def test_twenty_thousand_centers_skip_most_blocks(monkeypatch):
    draw = np.random.default_rng(5)
    centers = draw.normal(size=(20_000, 8))
    centers *= (np.arange(20_000) / 2_000 / np.linalg.norm(centers, axis=1))[:, None]
    x = draw.normal(size=(50, 8))
    found, distance = V._nearest(x, centers, np.arange(20_000))
    for row, name, least in zip(x, found, distance):
        d = np.sqrt(((centers - row) ** 2).sum(axis=1))
        assert name == d.argmin() and least == pytest.approx(d.min())


def test_too_many_centers_are_refused(spark, monkeypatch):
    monkeypatch.setattr("palimpsest.session.BROADCAST_ROWS", 2)
    table = spark.createDataFrame([(i, [0.0]) for i in range(3)], "cluster long, center array<double>")
    with pytest.raises(ValueError):
        V.nearest_centers(spark.createDataFrame([(1, [1.0])], "id long, vector array<double>"), table)


def test_squared_silhouette_matches_the_evaluator(spark):
    draw = np.random.default_rng(6)
    rows = [(i, i % 3, (draw.normal(size=4) + i % 3).tolist()) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, cluster long, vector array<double>")
    assert ml.squared_silhouette_row(df).first()[0] == pytest.approx(ml.squared_silhouette(df))


def test_forks_are_chosen_before_any_text_moves(spark):
    changes = spark.createDataFrame(
        [("b", "a", 0, "f", "f", ["r1", "r2", "r3"]), ("b2", "a2", 0, "g", "g", ["r1"])],
        "commit_before string, commit_after string, diff_index int, file_before string, file_after string, repositories array<string>",
    )
    rows = [
        ("r1", "b", "f", 200, "x"), ("r1", "a", "f", 404, "gone"), ("r2", "b", "f", 200, "x2"), ("r2", "a", "f", 200, None),
        ("r3", "b", "f", 200, "x3"), ("r3", "a", "f", 200, "y3"), ("r1", "b2", "g", 200, "z"),
    ]
    contents = spark.createDataFrame(rows, "repository string, sha string, path string, status int, text string")
    out = mining.attach_contents_with_forks(changes, contents).collect()
    assert [(r["repository"], r["code_before"], r["code_after"]) for r in out] == [("r3", "x3", "y3")]


def test_names_of_arguments_in_calls_are_in_use(spark):
    code = "def f(a):\n    return g(kw=a, other=1)\n"
    pairs = spark.createDataFrame([(1, code, code)], "k long, before_code string, after_code string")
    tokens = A.pair_token_table(pairs, "k")
    assert A.distinct_identifiers(tokens).first()["identifiers"] == ["a", "f", "g", "kw", "other"]
