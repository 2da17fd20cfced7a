"""Edit actions of a batch of pairs at once."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from palimpsest.functions import alignment, script
from palimpsest.operators import edits as E

LISTS = pa.list_(pa.string())


def _draw(seed, count, longest, letters):
    rng = random.Random(seed)

    def one():
        return [rng.choice(letters) for _ in range(rng.randrange(longest + 1))]

    rows = [(one(), one()) for _ in range(count)]
    for _ in range(count // 2):
        before = one()
        after = [w for w in before if rng.random() > 0.1]
        if len(after) > 1:
            after.insert(rng.randrange(len(after)), after.pop())
        rows.append((before, after))
    return rows


def _both(rows):
    sides = [pa.array([r[s] for r in rows], LISTS) for s in (0, 1)]
    return script._actions_batch(*sides).to_pylist(), [[e["action"] for e in script.edit_script(b, a)] for b, a in rows]


@pytest.mark.parametrize("fewest", [1, 10**9])
@pytest.mark.parametrize(("count", "longest", "letters"), [(400, 6, "abc"), (300, 20, "abcdef"), (60, 70, "abcd"), (20, 280, "abcdefghij")])
def test_actions_of_a_batch_are_those_of_each_script(monkeypatch, fewest, count, longest, letters):
    monkeypatch.setattr(alignment, "_FEWEST", fewest)
    monkeypatch.setattr(script, "_BATCH_TOKENS", 1000)
    found, expected = _both(_draw(longest, count, longest, letters))
    assert found == expected


def test_odd_rows_and_slices():
    rows = [(None, ["a"]), (["a"], None), (None, None), ([], []), ([None, "a"], ["a", None, "b"]), (["a"], ["a"]),
            (["a", "b"] * 64, ["b", "a"] * 64), (["a"] * 65, ["b"] + ["a"] * 64 + ["c"])]
    found, expected = _both(rows)
    assert found == expected
    sides = [pa.array([r[s] for r in rows], LISTS).slice(3, 4) for s in (0, 1)]
    assert script._actions_batch(*sides).to_pylist() == expected[3:7]
    assert script._actions_batch(pa.array([], LISTS), pa.array([], LISTS)).to_pylist() == []


def test_pairs_are_not_aligned_one_by_one(spark, monkeypatch):
    def alone(*_):
        raise AssertionError("one by one")

    monkeypatch.setattr(script, "edit_script", alone)
    monkeypatch.setattr(script, "_common", alone)
    rows = [(i, ["def", f"f{i}", "(", "a", ")"], ["def", "g", "(", "a", f"b{i}", ")"]) for i in range(200)]
    pairs = spark.createDataFrame(rows, "pair_id long, before array<string>, after array<string>").coalesce(1)
    found = E.edit_sequences(pairs, "pair_id", "before", "after").collect()
    assert len(found) == 200 and {tuple(r["edit_actions"]) for r in found} == {("update-node", "insert-node")}
