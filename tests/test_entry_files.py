"""Files of entries: how often entries are made and how aligned lines meet."""

import pytest
from pyspark.sql import functions as F

from palimpsest.sources import lines as L
from palimpsest.sources import records as R
from palimpsest.sources import sinks as S


def test_aligned_lines_are_not_broadcast(spark, tmp_path):
    for name in "st":
        (tmp_path / f"{name}.txt").write_text(f"{name}\n" * 50)
    rows = L.read_parallel(spark, str(tmp_path / "s.txt"), str(tmp_path / "t.txt"))
    assert [(r["source"], r["target"]) for r in rows.collect()] == [("s", "t")] * 50
    assert "SortMergeJoin [pair_id" in rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("clusters", [False, True])
def test_entries_are_made_once(spark, tmp_path, clusters):
    made = spark.sparkContext.accumulator(0)

    def name(i):
        made.add(1)
        return f"n{i:03}"

    named = F.udf(name, "string").asNondeterministic()
    texts = ["before_code", "after_code", "before_code_normalized", "after_code_normalized"]
    maps = F.from_json(F.lit("{}"), R.MAP_SCHEMA).alias("replacement_map")
    entries = spark.range(40).select(
        named("id").alias("name"), *[F.lit(c).alias(c) for c in texts], F.array(F.lit("update-node")).alias("edit_actions"),
        maps, (F.col("id") % 3).alias("cluster"))
    if clusters:
        S.write_cluster_corpora(entries, str(tmp_path / "c"))
        found = [r["line"] for r in spark.read.parquet(str(tmp_path / "c/text")).filter("cluster = 0").collect()]
        assert sorted(found) == list(range(14))
    else:
        S.write_entries(entries.drop("cluster"), str(tmp_path / "e"))
        data = L.read_lines(spark, str(tmp_path / "e/data")).select(F.get_json_object("value", "$.name").alias("n"), "idx")
        assert [r["n"] for r in data.orderBy("idx").collect()] == [f"n{i:03}" for i in range(40)]
    assert made.value == 40
