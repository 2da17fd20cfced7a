import pytest
from pyspark.sql import functions as F

from palimpsest.operators import mining as M
from palimpsest.sources import lines as L
from palimpsest.sources import records as R
from palimpsest.sources import sinks as S
from palimpsest.streaming import jobs as J


def test_line_numbers_over_many_splits(spark, tmp_path):
    for name, n in (("b", 400), ("a", 700), ("c", 1)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name} {i}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = L.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert all(r["value"].split()[1] == str(r["line"]) for r in rows)
    ordered = [r["value"] for r in sorted(rows, key=lambda r: r["idx"])]
    assert [r["idx"] for r in sorted(rows, key=lambda r: r["idx"])] == list(range(1101))
    assert ordered[0] == "a 0" and ordered[700] == "b 0" and ordered[1100] == "c 0"


def test_parallel_lines_must_agree(spark, tmp_path):
    (tmp_path / "s.txt").write_text("a\nb\n")
    (tmp_path / "t.txt").write_text("x\ny\n")
    (tmp_path / "u.txt").write_text("x\n")
    rows = L.read_parallel(spark, str(tmp_path / "s.txt"), str(tmp_path / "t.txt")).orderBy("pair_id").collect()
    assert [tuple(r) for r in rows] == [(0, "a", "x"), (1, "b", "y")]
    with pytest.raises(ValueError):
        L.read_parallel(spark, str(tmp_path / "s.txt"), str(tmp_path / "u.txt"))


def test_chunks(spark, tmp_path):
    path = str(tmp_path / "chunks")
    S.write_chunks(spark.range(250), path, [F.col("id")], lines=100)
    sizes = spark.read.text(path).groupBy(R.chunk_number().alias("c")).count().orderBy("c").collect()
    assert [tuple(r) for r in sizes] == [(0, 100), (1, 100), (2, 50)]


def test_merge_finds_misaligned_chunks(spark):
    data = spark.createDataFrame([(0, 0, "b", "a"), (10, 0, "b", "a"), (2, 0, "b", "a")],
                                 "chunk int, line long, before_code_normalized string, after_code_normalized string")
    side = lambda v: data.select("chunk", "line", F.lit(v).alias("value"))
    merged = S.merge_chunks(data, side("b "), side("a"))
    assert [r["chunk"] for r in merged.orderBy("idx").collect()] == [0, 2, 10]
    with pytest.raises(ValueError, match="after_differs"):
        S.merge_chunks(data, side("b"), side("x"))


def test_cluster_folders_are_not_overwritten(spark, tmp_path):
    df = spark.createDataFrame([("n", "b", "a", 1)], "name string, before_code_normalized string, after_code_normalized string, cluster int")
    S.write_cluster_corpora(df, str(tmp_path / "c"))
    with pytest.raises(Exception, match="(?i)exist"):
        S.write_cluster_corpora(df, str(tmp_path / "c"))


def test_commit_rules(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text(
        '{"commit":"1","subject":"prefix","repo_name":["r"],"parent":["p","q"],"difference":[{"old_path":"a","new_path":"a.py","old_mode":"1","new_mode":"1"},{"old_path":"b","new_path":"b.md","old_mode":"1","new_mode":"1"},{"new_path":"n.py","new_mode":"1"}]}\n'
        '{"commit":"2","subject":"Fix","repo_name":["r","r"],"parent":[],"difference":[]}\n')
    c = R.read_commits(spark, str(tmp_path / "c.jsonl"))
    assert [r["new_path"] for r in M.mine_commits(c).first()["difference"]] == ["a.py", "n.py"]
    rows = M.file_changes(c).orderBy("diff_index").collect()
    assert [(r["commit_before"], r["diff_index"], r["file_after"]) for r in rows] == [("p", 0, "a.py"), ("p", 1, "b.md")]
    assert [(r["commit"], r["violation"]) for r in M.repository_violations(c).collect()] == [("2", "repeated")]
    assert M.file_changes(c, max_files=2).count() == 0


def test_resuming_a_stream_adds_nothing_twice(spark, tmp_path):
    source, out, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    rows = spark.range(100).selectExpr("id", "timestamp_seconds(id) AS ts")
    rows.repartition(5).write.parquet(source)
    done = spark.range(10)

    def run():
        stream = J.file_stream(spark, f"{source}/*.parquet", rows.schema, files_per_batch=2)
        twice = stream.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).drop("k")
        return J.drain(J.resume(twice, done, ["id"], "ts", "1 hour"), path=out, offsets=offsets)

    assert sorted(r["id"] for r in run().collect()) == list(range(10, 100))
    assert run().count() == 90


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    from palimpsest import session

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        session.shared_dir(Session())


def test_registered_queries():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 120
