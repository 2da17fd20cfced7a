"""Paragraph vectors: likeness, unseen rows, repeatability, odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest

from palimpsest.operators import paragraphs as P

FAMILIES = [["insert", "move", "call"], ["delete", "update", "name"], ["loop", "test", "string"]]


def families(seed, n):
    draw = random.Random(seed)
    return [(i, [draw.choice(FAMILIES[i % 3]) for _ in range(draw.randrange(8, 30))]) for i in range(n)]


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.createDataFrame(families(1, 150), "id long, w array<string>")
    settings = P.Settings(vector_size=12, epochs=40, rounds=4, alpha=0.1, rows_per_part=50)
    model, vectors = P.fit(df, "id", "w", settings)
    return df, settings, model, {r["id"]: np.array(r["vector"]) for r in vectors.collect()}


def unit(v):
    return v / np.linalg.norm(v)


def nearest(vector, vectors):
    return max(vectors, key=lambda i: unit(vectors[i]) @ unit(vector))


def test_rows_lie_near_their_like(fitted):
    _, _, _, vectors = fitted
    hits = [nearest(v, {j: w for j, w in vectors.items() if j != i}) % 3 == i % 3 for i, v in vectors.items()]
    assert np.mean(hits) > 0.97


def test_unseen_rows_are_inferred_near_their_like(spark, fitted):
    _, _, model, vectors = fitted
    unseen = spark.createDataFrame(families(77, 60), "id long, w array<string>")
    found = {r["id"]: np.array(r["vector"]) for r in model.infer(unseen, "id", "w").collect()}
    assert np.mean([nearest(v, vectors) % 3 == i % 3 for i, v in found.items()]) > 0.97


def test_a_fit_is_repeated_to_the_bit_in_any_partitioning(fitted):
    df, settings, model, vectors = fitted
    again, rows = P.fit(df.repartition(7), "id", "w", settings)
    assert (again.matrix == model.matrix).all()
    assert all((np.array(r["vector"]) == vectors[r["id"]]).all() for r in rows.collect())
    other, _ = P.fit(df, "id", "w", P.Settings(**{**settings.__dict__, "seed": 5}))
    assert not (other.matrix == model.matrix).all()


def test_empty_null_and_unknown_rows(spark, fitted):
    _, _, model, _ = fitted
    rows = [(1, []), (2, None), (3, ["never seen"]), (4, ["insert", None])]
    found = {r["id"]: r["vector"] for r in model.infer(spark.createDataFrame(rows, "id long, w array<string>"), "id", "w").collect()}
    assert [any(found[i]) for i in (1, 2, 3, 4)] == [False, False, False, True]
    small = P.Settings(vector_size=4, epochs=2, rounds=2)
    model, vectors = P.fit(spark.createDataFrame(rows, "id long, w array<string>"), "id", "w", small)
    assert {r["id"]: any(r["vector"]) for r in vectors.collect()} == {1: False, 2: False, 3: True, 4: True}
    model, vectors = P.fit(spark.createDataFrame([], "id long, w array<string>"), "id", "w", small)
    assert model.words == () and vectors.collect() == []
    with pytest.raises(ValueError):
        P.fit(vectors.selectExpr("id", "array('a') w"), "id", "w", P.Settings(max_words=10**9))


def test_a_part_is_small_but_has_as_many_rows_as_words(spark):
    """Parts are tasks: few rows each, and no more matrices than rows."""
    rows = spark.createDataFrame([(i, [f"w{i % 4}"]) for i in range(5000)], "id long, w array<string>")
    seen = []
    real = P._round

    def counted(number, rates, words, noise, matrix, settings):
        train = real(number, rates, words, noise, matrix, settings)

        def run(pdf):
            assert len(pdf) < (400 if len(words) == 4 else 2500)
            return train(pdf)

        seen.append(number)
        return run

    P._round = counted
    try:
        _, vectors = P.fit(rows, "id", "w", P.Settings(vector_size=2, epochs=2, rounds=2))
        assert vectors.count() == 5000 and seen == [0, 1]
        seen.clear()
        many = spark.createDataFrame([(i, [f"w{i}"]) for i in range(2300)], "id long, w array<string>")
        P.fit(many, "id", "w", P.Settings(vector_size=2, epochs=2, rounds=2))
        assert seen == [0]
    finally:
        P._round = real


@pytest.mark.parametrize("learn", [True, False])
def test_steps_over_cells_are_the_steps_over_pairs(monkeypatch, learn):
    rng = np.random.default_rng(2)
    rows, words = np.sort(rng.integers(0, 30, 900)), rng.integers(0, 4, 900)
    noise = np.array([0.4, 0.7, 0.9, 1.0])
    settings = P.Settings(vector_size=7, batch=64)
    monkeypatch.setattr(P, "_AHEAD", 256)

    def trained(cells):
        monkeypatch.setattr(P, "_CELLS", cells)
        docs, matrix = P._start_vectors(np.arange(30), 7), np.full((4, 7), 0.1) * np.arange(1, 5)[:, None]
        P._train(rows, words, docs, matrix, noise, np.linspace(0.3, 0.1, 5), np.random.default_rng(9), settings, learn)
        return docs, matrix

    for found, expected in zip(trained(1 << 12), trained(0)):
        assert np.abs(found - expected).max() < 1e-12
    met = []
    monkeypatch.setattr(P, "_add", lambda *a: met.append(a))
    trained(1 << 12)
    assert not met


def test_noise_words_are_drawn_alike_however_found():
    shares = np.concatenate((np.random.default_rng(0).random(500), [0.0, 0.25, 0.5]))
    for noise in (np.array([0.25, 0.5, 1.0]), np.linspace(0.04, 1, 25), np.ones(1)):
        assert (P._drawn(noise, shares) == np.searchsorted(noise, shares, "right")).all()
