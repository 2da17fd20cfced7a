"""Numbered pairs as texts, distances of texts and numbers of merged chunks."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest import session
from palimpsest.functions import distance as D
from palimpsest.functions.literals import literal_classes
from palimpsest.operators import abstraction as A
from palimpsest.operators import edits as E
from palimpsest.sources import sinks as S


@pytest.mark.parametrize("limit", [1000, 0])
def test_texts_are_those_of_the_numbered_table(spark, monkeypatch, limit):
    rng = random.Random(4)
    words = ["def", "f", "IDENTIFIER_0", "INT_1", "IDENTIFIER_12", "7", "8", "1.5", "'s'", "f'x'", "$NEWLINE", "+", "é", "", None]
    rows = [(i, *([rng.choice(words) for _ in range(rng.randrange(9))] for _ in "ba")) for i in range(300)]
    pairs = spark.createDataFrame(rows, "pair_id long, b array<string>, a array<string>")
    idioms = spark.createDataFrame([("identifier", "f", 9), ("int", "8", 2), ("string", "7", 1)], "cls string, value string, count long")
    table = A.pair_table(pairs, "b", "a", lambda w: literal_classes(w, "$"))
    expected = sorted(map(tuple, A.pair_texts(A.number_pairs(table, idioms, 3)).collect()))
    monkeypatch.setattr(session, "BROADCAST_ROWS", limit)
    found = A.number_texts(pairs, "b", "a", idioms, 3, "$")
    assert sorted(map(tuple, found.collect())) == expected
    if limit:
        # One step from words to texts.
        assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def _table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


@pytest.mark.parametrize("fewest", [1, 10**9])
def test_distances_are_those_of_the_whole_table(monkeypatch, fewest):
    monkeypatch.setattr(D, "_FEWEST", fewest)
    monkeypatch.setattr(D, "_BATCH_CHARACTERS", 2000)
    rng = random.Random(6)
    pairs = [("", ""), ("a", ""), ("é", "e"), ("日本語", "日語"), ("kitten", "sitting"), ("a" * 64, "b" * 64), ("a" * 65, "b" * 129)]
    for longest, signs in ((9, "ab"), (70, "abé"), (140, "abcd日"), (270, "abc")):
        pairs += [tuple("".join(rng.choice(signs) for _ in range(rng.randrange(longest))) for _ in "ba") for _ in range(40)]
    found = D.distances(*(pa.array([p[s] for p in pairs] + [None]) for s in (0, 1))).to_pylist()
    assert found == [*(_table(*p) for p in pairs), None]
    assert D.distances(pa.array(["a", None]), pa.array([None, "a"])).to_pylist() == [None, None]


def test_far_texts_are_not_met_in_tables_of_characters(spark):
    df = spark.createDataFrame([("x" * 50, "y" * 50), (None, "a")], "b string, a string")
    out = df.select(E.change_size(df, "b", "a").alias("n"))
    assert [r["n"] for r in out.collect()] == [50, None] and out.schema["n"].dataType.simpleString() == "int"
    assert "levenshtein" not in out._jdf.queryExecution().executedPlan().toString()


def test_merged_chunks_without_gaps_are_not_sorted(spark):
    rows = [(c, n, f"{c}-{n}", "a") for c in (10, 2, 0) for n in range(3 + c)]
    kind = "chunk int, line long, before_code_normalized string, after_code_normalized string"

    def merged(rows):
        data = spark.createDataFrame(rows, kind).repartition(5)
        sides = [data.select("chunk", "line", F.col(f"{s}_code_normalized").alias("value")) for s in ("before", "after")]
        out = S.merge_chunks(data, *sides)
        assert out.columns == [*data.columns, "idx"]
        return out, [(r["chunk"], r["line"], r["idx"]) for r in out.orderBy("idx").collect()]

    out, found = merged(rows)
    assert found == [(c, n, i) for i, (c, n) in enumerate(sorted((r[0], r[1]) for r in rows))]
    # What is read from the shared folder are sizes of chunks, not their texts.
    assert not any("before_code_normalized" in spark.read.parquet(f).columns for f in out.inputFiles())
    _, found = merged([r for r in rows if (r[0], r[1]) != (2, 1)])
    assert [f[:2] for f in found] == sorted((r[0], r[1]) for r in rows if (r[0], r[1]) != (2, 1))
    assert [f[2] for f in found] == list(range(len(rows) - 1))
