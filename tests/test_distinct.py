"""N-grams by name: the same numbers as by text, in chunks and ranges."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from palimpsest.operators import bleu
from palimpsest.operators import distinct as D


def texts(n, seed=3):
    draw = random.Random(seed)
    rows = [(i, [f"w{int(draw.paretovariate(0.7)) % 400}" for _ in range(draw.randrange(0, 40))]) for i in range(n)]
    return [*rows, (n, None), (n + 1, []), (n + 2, ["a"]), (n + 3, ["a", "b", "a", "b", "a"]), (n + 4, ["b", "a", "é"]),
            (n + 5, ["a"] * 300)]


def totals(spark, rows, most):
    df = spark.createDataFrame(rows, "id long, w array<string>")
    return {r["n"]: (r["occurrences"], r["distinct_ngrams"]) for r in D.count_names(bleu.ngram_rows(df, "w", named=most)).collect()}


def expected(rows):
    grams = [(n, tuple(w[i : i + n])) for _, w in rows if w for n in range(1, 5) for i in range(len(w) - n + 1)]
    return {n: (sum(g[0] == n for g in grams), len({g for g in grams if g[0] == n})) for n in {g[0] for g in grams}}


def test_names_count_like_texts(spark):
    rows = texts(400)
    assert totals(spark, rows, 1) == expected(rows)
    # Many ranges, some of them empty.
    assert totals(spark, rows, 3000 * D._RANGE) == expected(rows)
    by_text = bleu.ngram_rows(spark.createDataFrame(rows, "id long, w array<string>"), "w").groupBy("n").agg(
        F.count("*").alias("c"), F.count_distinct("ngram").alias("d"))
    assert {r["n"]: (r["c"], r["d"]) for r in by_text.collect()} == expected(rows)


def test_no_ngram_gives_no_row(spark):
    assert totals(spark, [(1, None), (2, [])], 0) == {}
    assert totals(spark, [(1, ["a", "b"])], 3) == {1: (2, 2), 2: (1, 1)}


def test_ngrams_may_cross_a_chunk(spark):
    rows, real = texts(60), D._CHUNK
    D._CHUNK = 7
    try:
        assert totals(spark, rows, 1) == expected(rows)
    finally:
        D._CHUNK = real


def test_names_of_equal_high_bits_are_told_apart():
    import numpy as np
    import pyarrow as pa

    def column(*names):
        return pa.chunked_array([pa.array([np.array(names, np.uint64).tobytes()], pa.binary())])

    high = 5 << 32
    # Two names that share the first low half, and one repeat.
    table = pa.table({"n": pa.chunked_array([pa.array([2], pa.int32())]), "range": pa.chunked_array([pa.array([0], pa.int32())]),
                      "occurrences": pa.chunked_array([pa.array([4])]),
                      "first": column(high | 1, high | 1, high | 1, 9 << 32), "second": column(high | 7, high | 8, high | 8, 9 << 32)})
    assert D._count_range(table).to_pylist() == [{"n": 2, "occurrences": 4, "names": 3}]


def test_counting_shuffles_no_text(spark):
    """Fails on a plan that sends n-grams as strings to be grouped."""
    from palimpsest.plans import all_queries

    plan = all_queries()["ngram_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "ngram" not in plan.replace("distinct_ngrams", "") and "FlatMapGroupsInArrow" in plan
