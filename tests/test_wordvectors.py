"""Word vectors trained in parts: likeness, repeatability, odd rows."""

from __future__ import annotations

import random

import numpy as np

from palimpsest.operators import ml
from palimpsest.operators import wordvectors as W

FAMILIES = [["insert", "move", "call"], ["delete", "update", "name"], ["loop", "test", "string"]]


def families(n):
    draw = random.Random(2)
    return [(i, [draw.choice(FAMILIES[i % 3]) for _ in range(draw.randrange(8, 30))]) for i in range(n)]


def embedded(df, **more):
    return {r["id"]: np.array(r["vector"]) for r in ml.embed_sequences(df, "id", "w", vector_size=10, **more).collect()}


def test_parts_are_tasks_and_a_fit_is_repeated_to_the_bit(spark):
    """Fails on a fit in one partition, whose result follows the order of the rows."""
    rows, real = spark.createDataFrame(families(240), "id long, w array<string>"), W._PART
    W._PART = 500
    seen, packer = [], W._packer
    try:
        def noted(words):
            seen.append(words)
            return packer(words)

        W._packer = noted
        one = embedded(rows.repartition(1), epochs=8)
        two = embedded(rows.repartition(7), epochs=8)
    finally:
        W._PART, W._packer = real, packer
    assert len(seen) == 2 and len(one) == 240
    assert all((one[i] == two[i]).all() for i in one)
    centred = np.stack([one[i] for i in range(240)])
    centred -= centred.mean(0)
    unit = centred / np.linalg.norm(centred, axis=1, keepdims=True)
    like = unit @ unit.T - 2 * np.eye(240)
    assert np.mean(like.argmax(1) % 3 == np.arange(240) % 3) > 0.97


def test_few_words_take_the_same_steps_as_many(monkeypatch):
    draw = np.random.default_rng(4)
    ids, sizes = draw.choice(6, 900, p=[0.4, 0.3, 0.1, 0.1, 0.05, 0.05]), np.array([0, 400, 1, 499])
    paths, found = W.tree(np.bincount(ids).tolist()), []
    for few in (32, 1):
        monkeypatch.setattr(W, "_FEW", few)
        syn0, syn1 = (np.random.default_rng(1).random((6, 8)) - 0.5) / 8, np.zeros((5, 8))
        part = lambda i: (ids[i:], sizes - [0, i, 0, 0], np.random.default_rng(9 + i))
        both = list(W.train([part(0), part(300)], paths, syn0, syn1, (0.025, 0.02)))
        # Parts that are trained at once do not see each other.
        alone = [*W.train([part(0)], paths, syn0, syn1, (0.025, 0.02)), *W.train([part(300)], paths, syn0, syn1, (0.025, 0.02))]
        assert all((x == y).all() for a, b in zip(both, alone) for x, y in zip(a, b))
        found.append(both[0])
    assert np.allclose(found[0][0], found[1][0], atol=1e-12) and np.allclose(found[0][1], found[1][1], atol=1e-12)
    assert np.abs(found[0][1]).max() > 0.01


def test_tree_has_shortest_paths():
    paths = W.tree([50, 20, 15, 10, 5])
    lengths = paths.there.sum(1).astype(int).tolist()
    assert lengths[0] == 1 and sum(n * c for n, c in zip(lengths, [50, 20, 15, 10, 5])) == 195
    codes = ["".join(f"{int(t)}" for t in row[:n][::-1]) for row, n in zip(paths.turns, lengths)]
    assert not any(a != b and b.startswith(a) for a in codes for b in codes)


def test_pairs_stay_in_their_sequence():
    sizes = np.array([3, 0, 1, W.LONGEST + 2])
    word, other = W._pairs(sizes, np.random.default_rng(0))
    owner = np.repeat(np.arange(4), sizes)
    assert (owner[word] == owner[other]).all() and (word != other).all() and np.abs(word - other).max() == W.WINDOW
    start = 4 + W.LONGEST
    assert not ((word < start) & (other >= start)).any()
    assert {(0, 1), (1, 0)} <= set(zip(word.tolist(), other.tolist())) and 3 not in word


def test_empty_null_and_rare(spark):
    rows = spark.createDataFrame([(1, []), (2, None), (3, ["a", "b", "a"]), (4, ["b", "c"])], "id long, w array<string>")
    found = embedded(rows, epochs=2)
    assert [bool(found[i].any()) for i in (1, 2, 3, 4)] == [False, False, True, True]
    rare = embedded(rows, epochs=2, min_count=2)
    assert len(rare) == 4 and rare[4].any()
    assert all(not v.any() for v in embedded(rows.filter("id < 3")).values())
    assert embedded(rows.filter("id = 0")) == {}
    assert embedded(spark.createDataFrame([(1, ["a", "a"])], "id long, w array<string>"))[1].any()
