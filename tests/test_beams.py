import math

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.scores import length_penalty
from palimpsest.operators import beams as G


def test_gather_tree(spark):
    ids = [[1, 2, 3], [4, 5, 6], [7, 8, 9]]
    parents = [[0, 0, 0], [0, 1, 1], [2, 1, 2]]
    rows = [(0, s, b, ids[s][b], parents[s][b]) for s in range(3) for b in range(3)]
    df = spark.createDataFrame(rows, "example_id long, step long, beam long, token_id long, parent long")
    paths = {r["beam"]: r["path"] for r in G.gather_tree(df).collect()}
    assert [[paths[b][s] for b in range(3)] for s in range(3)] == [[2, 2, 2], [6, 5, 6], [7, 8, 9]]


def test_length_penalty(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "n int")
    values = [r[0] for r in df.orderBy("n").select(length_penalty("n", 0.6)).collect()]
    assert values == pytest.approx([1.0, 1.0969027, 1.1884017], abs=1e-4)


def step(spark, changed, lengths, finished):
    logits = [(0, b, v, changed.get((b, v), 0.0001)) for b in range(3) for v in range(5)]
    state = [(0, b, -math.log(3), lengths[b], finished[b]) for b in range(3)]
    out = G.beam_step(
        spark.createDataFrame(logits, "example_id long, beam long, token_id long, logit double"),
        spark.createDataFrame(
            state, "example_id long, beam long, log_prob double, length int, finished boolean"
        ),
        width=3, eos=0, penalty_weight=0.6,
    )
    rows = out.orderBy("beam").collect()
    return [[r[c] for r in rows] for c in ("token_id", "parent", "length", "finished")]


def test_beam_step(spark):
    logits = {(0, 2): 1.9, (0, 3): 2.1, (1, 3): 3.1, (1, 4): 0.9}
    assert step(spark, logits, [2, 2, 2], [False] * 3) == [
        [3, 3, 2], [1, 0, 0], [3, 3, 3], [False] * 3]


def test_beam_step_with_finished_beam(spark):
    logits = {(0, 2): 1.1, (1, 2): 1.0, (2, 2): 1.0}
    assert step(spark, logits, [2, 1, 2], [False, True, False]) == [
        [0, 2, 2], [1, 0, 2], [1, 3, 3], [True, False, False]]


def test_beam_step_with_new_end(spark):
    logits = {(0, 0): 1.9, (0, 3): 2.1, (1, 3): 3.1, (1, 4): 0.9}
    assert step(spark, logits, [2, 2, 2], [False] * 3) == [
        [3, 3, 0], [1, 0, 0], [3, 3, 2], [False, False, True]]


def test_finished_mask(spark):
    df = spark.createDataFrame([(0, -0.3, True), (3, 3.0, True), (3, 6.0, False)], "t int, p double, f boolean")
    values = [r[0] for r in df.select(G.masked_log_prob("p", "t", "f", 0)).collect()]
    assert values == [0.0, G.FLOAT32_MIN, 6.0]


def test_unknown_is_never_the_end_marker(spark):
    att = spark.createDataFrame(
        [(0, 0, s, v, 3) for s, v in enumerate([0.2, 0.2, 0.9])],
        "example_id long, target_pos long, source_pos long, score double, source_len int")
    assert G.strongest_source(att).first()["source_pos"] == 0
