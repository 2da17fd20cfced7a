"""Rows that once broke an operator."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.pycode import _plain_tokens, _values_of
from palimpsest.functions.text import split_tokens
from palimpsest.operators.classify import outcome
from palimpsest.operators.graph import pagerank
from palimpsest.operators.vectors import cosine_distance, unit


def test_a_zero_vector_is_far_from_everything(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 2.0], [2.0, 4.0])], "a array<double>, b array<double>")
    rows = df.select(cosine_distance("a", "b").alias("d"), unit("a").alias("u")).collect()
    assert rows[0]["d"] == 1.0 and rows[0]["u"] == [0.0, 0.0] and rows[1]["d"] == pytest.approx(0.0)


def test_only_the_ends_of_a_prediction_are_stripped(spark):
    df = spark.createDataFrame([("a\tb", "x", "a b"), (" a b\f", "x", "a b"), ("x\n", " x", "y")], "h string, s string, t string")
    assert [r[0] for r in df.select(outcome("h", "s", "t")).collect()] == ["changed", "perfect", "bad"]


@pytest.mark.parametrize("sign", ["^", "\\", "]", "-", "."])
def test_any_sign_may_part_tokens(spark, sign):
    df = spark.createDataFrame([(f"a{sign}b{sign}{sign}c",)], "t string")
    assert df.select(split_tokens(F.col("t"), sign)).first()[0] == ["a", "b", "c"]


def test_pagerank_says_when_it_does_not_converge(spark):
    rows = [(0, i, [1.0, float(i), float(i * i % 7)]) for i in range(12)]
    df = spark.createDataFrame(rows, "cluster int, id int, vector array<double>")
    with pytest.raises(RuntimeError, match="still move"):
        pagerank(df, max_iterations=1, tolerance=1e-12)


def test_a_huge_number_is_an_error_of_its_row():
    found = _values_of("x = 0x" + "f" * 20000)
    assert found["error"] and found["items"] == []


def test_a_form_feed_ends_no_line():
    code = "\f\na = 1\nb = f'{a}'\n"
    assert any("f'{a}'" in str(t) for t in _plain_tokens(code))
