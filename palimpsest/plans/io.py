"""Source, sink and streaming queries: each writes, reads back, and returns
what it read."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import metric
from palimpsest.operators.beams import cut_attention
from palimpsest.operators.mining import file_changes
from palimpsest.operators.vocab import build_vocab
from palimpsest.plans import beams as beam_plans
from palimpsest.plans import code as code_plans
from palimpsest.plans import metrics as metric_plans
from palimpsest.plans import text as text_plans
from palimpsest.plans.registry import query
from palimpsest.plans.views import (
    ATTENTION_SQL, BEAMS_SQL, CODE_TOKENS_SQL, COMMITS_SQL, PAIRS_SQL, PREDICTIONS_SQL, VECTORS_SQL, attention,
    beams, commits, pairs, predictions, vectors,
)
from palimpsest.session import materialize, scratch_path
from palimpsest.sources import lines as L
from palimpsest.sources import records as R
from palimpsest.sources import sinks as S
from palimpsest.streaming import jobs as J
from palimpsest.streaming.pairing import keyed_state, pair_or_expire


@query("commits_from_json", f"""WITH {COMMITS_SQL}
SELECT commit_after, diff_index, file_before, file_after, c.subject FROM changes JOIN commits c ON c.commit = changes.commit_after""")
def commits_from_json(t):
    path = scratch_path(t.spark, "commits")
    commits(t).write.option("compression", "gzip").json(path)
    back = R.read_commits(t.spark, path)
    subjects = back.select(F.col("commit").alias("commit_after"), "subject")
    return file_changes(back).join(subjects, "commit_after").select(
        "commit_after", "diff_index", "file_before", "file_after", "subject")


@query("file_changes_from_json", f"WITH {COMMITS_SQL} SELECT commit_after, diff_index, file_before, file_after FROM changes")
def file_changes_from_json(t):
    path = scratch_path(t.spark, "changes")
    file_changes(commits(t)).drop("repositories").write.json(path)
    return R.read_file_changes(t.spark, path).select("commit_after", "diff_index", "file_before", "file_after")


@query("chunked_commits", """
WITH c AS (SELECT 'c' || o_orderkey AS commit, row_number() OVER (ORDER BY 'c' || o_orderkey) - 1 AS idx FROM orders)
SELECT commit, (idx // 1000)::INT AS chunk FROM c""")
def chunked_commits(t):
    path = scratch_path(t.spark, "chunks")
    S.write_chunks(commits(t), path, [F.col("commit")], lines=1000, width=4)
    raw = t.spark.read.text(path).select(R.chunk_number().alias("chunk"), "value")
    return raw.select(F.get_json_object("value", "$.commit").alias("commit"), "chunk")


@query("parallel_lines", f"""WITH {PAIRS_SQL}
SELECT row_number() OVER (ORDER BY pair_id) - 1 AS pair_id, source, target FROM pairs""")
def parallel_lines(t):
    path = scratch_path(t.spark, "parallel")
    rows = materialize(pairs(t), "pairs")
    S.write_text(rows, "source", f"{path}/source", [F.col("pair_id")])
    S.write_text(rows, "target", f"{path}/target", [F.col("pair_id")])
    return L.read_parallel(t.spark, f"{path}/source", f"{path}/target")


@query("entries_written", f"""WITH e AS ({code_plans._ENTRY_SQL})
SELECT row_number() OVER (ORDER BY name) - 1 AS idx, name, before AS source, after AS target, actions AS edit_actions FROM e""")
def entries_written(t):
    path = scratch_path(t.spark, "entries")
    S.write_entries(code_plans.entries(t), path)
    text = L.read_parallel(t.spark, f"{path}/before", f"{path}/after").withColumnRenamed("pair_id", "idx")
    data = L.read_lines(t.spark, f"{path}/data").select("idx", F.from_json("value", R.CHANGE_ENTRIES).alias("e"))
    return text.join(data.hint("merge"), "idx").select(
        "idx", "e.name", "source", "target", F.concat_ws(",", "e.edit_actions").alias("edit_actions"))


@query("entries_read_back", f"WITH e AS ({code_plans._ENTRY_SQL}) SELECT name, before, after, actions AS edit_actions FROM e")
def entries_read_back(t):
    path = scratch_path(t.spark, "entries")
    S.write_entries(code_plans.entries(t), path)
    return R.read_change_entries(t.spark, f"{path}/data").select(
        "name", F.col("before_code_normalized").alias("before"), F.col("after_code_normalized").alias("after"),
        F.concat_ws(",", "edit_actions").alias("edit_actions"))


def _entry_chunks(t):
    """Entries in three chunks, as data and as text lines."""
    from palimpsest.operators.ordering import with_group_index

    lines = code_plans.changed_lines(t).select(
        "pair_id", F.col("before").alias("before_code_normalized"), F.col("after").alias("after_code_normalized"))
    # Frozen before the range sort, which reads its input twice.
    rows = materialize(lines.withColumn("chunk", (F.col("pair_id") % 3).cast("int")), "lines")
    data = with_group_index(rows, ["chunk"], [F.col("pair_id")], "line")
    side = [data.select("chunk", "line", F.concat(f"{s}_code_normalized", F.lit(" ")).alias("value")) for s in ("before", "after")]
    return data, *side


@query("merged_chunks", f"""WITH {CODE_TOKENS_SQL}
SELECT pair_id, row_number() OVER (ORDER BY pair_id % 3, pair_id) - 1 AS idx FROM sides WHERE before <> after""")
def merged_chunks(t):
    return S.merge_chunks(*_entry_chunks(t)).select("pair_id", "idx")


@query("merge_report", f"""WITH {CODE_TOKENS_SQL}
SELECT count(*) AS rows, count(*) FILTER (pair_id % 3 = 1) AS unaligned, 0 AS before_differs,
  count(*) FILTER (pair_id % 3 <> 1) AS after_differs FROM sides WHERE before <> after""")
def merge_report(t):
    data, before, after = _entry_chunks(t)
    short = before.filter("chunk <> 1")
    wrong = after.withColumn("value", F.concat(F.lit("x"), "value")).filter("chunk <> 1").unionByName(after.filter("chunk = 1"))
    return S.merge_report(data, short, wrong).withColumn("before_differs", F.col("before_differs").cast("int"))


@query("vocab_file", f"{text_plans._VOCAB} SELECT id, token, count FROM vocab")
def vocab_file(t):
    path = scratch_path(t.spark, "vocab")
    S.write_vocab(text_plans._vocab(t), path)
    return S.read_vocab(t.spark, path)


@query("idiom_file", f"WITH {CODE_TOKENS_SQL} SELECT cls, value, n AS count FROM idioms")
def idiom_file(t):
    path = scratch_path(t.spark, "idioms")
    S.write_idioms(code_plans.code_idioms(t), path)
    return S.read_idioms(t.spark, path)


@query("cluster_corpora", f"""WITH e AS ({code_plans._ENTRY_SQL}), c AS (SELECT *, len(name) % 3 AS cluster FROM e)
SELECT cluster::INT AS cluster, row_number() OVER (PARTITION BY cluster ORDER BY name) - 1 AS line, before, after FROM c""")
def cluster_corpora(t):
    path = scratch_path(t.spark, "clusters")
    S.write_cluster_corpora(code_plans.entries(t).withColumn("cluster", F.length("name") % 3), path)
    return t.spark.read.parquet(f"{path}/text")


@query("cluster_entries", f"""WITH e AS ({code_plans._ENTRY_SQL}), c AS (SELECT *, len(name) % 3 AS cluster FROM e)
SELECT cluster::INT AS cluster, row_number() OVER (PARTITION BY cluster ORDER BY name) - 1 AS line, name, actions AS edit_actions FROM c""")
def cluster_entries(t):
    path = scratch_path(t.spark, "clusters")
    S.write_cluster_corpora(code_plans.entries(t).withColumn("cluster", F.length("name") % 3), path)
    return S.read_cluster_entries(t.spark, path).select(
        "cluster", "line", "name", F.concat_ws(",", "edit_actions").alias("edit_actions"))


@query("paired_records", f"WITH {PAIRS_SQL} SELECT pair_id, source, target FROM pairs")
def paired_records(t):
    path = scratch_path(t.spark, "records")
    pairs(t).withColumnsRenamed({"source": "question", "target": "answer"}).write.json(path)
    return R.read_pairs(t.spark, path, "question", "answer", fmt="json",
                        schema="pair_id long, question string, answer string")


@query("beam_line_file", f"""{beam_plans._TEXTS}, l AS (SELECT example_id, string_agg(text, ' <SEP> ' ORDER BY beam) AS value FROM texts GROUP BY example_id)
SELECT row_number() OVER (ORDER BY example_id) - 1 AS idx, value FROM l""")
def beam_line_file(t):
    path = scratch_path(t.spark, "beams")
    S.write_beam_lines(beam_plans.beam_lines(t), path)
    return L.read_lines(t.spark, path).select("idx", "value")


@query("beam_block_file", f"""{beam_plans._TEXTS}, l AS (
  SELECT example_id, beam, text FROM texts UNION ALL SELECT DISTINCT example_id, 3, '' FROM texts)
SELECT row_number() OVER (ORDER BY example_id, beam) - 1 AS idx, text AS value FROM l""")
def beam_block_file(t):
    path = scratch_path(t.spark, "beam-blocks")
    S.write_beam_blocks(beam_plans.beam_texts(t), path)
    return L.read_lines(t.spark, path).select("idx", "value")


@query("aligner_file", f"""WITH {PAIRS_SQL}
SELECT row_number() OVER (ORDER BY pair_id) - 1 AS idx, source || ' ||| ' || target AS value FROM pairs""")
def aligner_file(t):
    path = scratch_path(t.spark, "aligner")
    S.write_aligner_lines(pairs(t), path)
    return L.read_lines(t.spark, path).select("idx", "value")


@query("beam_dump", f"WITH {BEAMS_SQL} SELECT example_id, step, beam, token_id, parent, score FROM beams")
def beam_dump(t):
    path = scratch_path(t.spark, "beam-dump")
    S.write_array_dump(beams(t), path)
    return t.spark.read.parquet(path)


@query("attention_dump", f"WITH {ATTENTION_SQL} SELECT example_id, target_pos, source_pos, score FROM att WHERE target_pos < target_len AND source_pos < source_len")
def attention_dump(t):
    path = scratch_path(t.spark, "attention-dump")
    cut = cut_attention(attention(t))
    S.write_array_dump(cut.select("example_id", "target_pos", "source_pos", "score"), path)
    return t.spark.read.parquet(path)


@query("embedding_dump", f"WITH {VECTORS_SQL} SELECT id, unnest(range(len(vector))) AS dim, unnest(vector) AS value FROM vectors")
def embedding_dump(t):
    path = scratch_path(t.spark, "embedding-dump")
    S.write_array_dump(vectors(t).select("id", F.posexplode("vector").alias("dim", "value")), path)
    return t.spark.read.parquet(path).withColumn("dim", F.col("dim").cast("long"))


# ---- streaming -------------------------------------------------------------

def _events(t):
    stream = J.file_stream(t.spark, t.path("events"), t.events.schema)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_paired_arrivals", """
SELECT a.event_id // 2 AS change_id, a.value AS before_value, b.value AS after_value FROM events a JOIN events b
  ON a.event_id // 2 = b.event_id // 2 AND a.event_id % 2 = 0 AND b.event_id % 2 = 1
WHERE b.ts BETWEEN a.ts - INTERVAL 2 HOUR AND a.ts + INTERVAL 2 HOUR""")
def stream_paired_arrivals(t):
    def side(odd):
        rows = _events(t).filter(F.col("event_id") % 2 == odd)
        return rows.select(F.expr("event_id div 2").alias("change_id"), "ts", "value")

    out = J.pair_arrivals(side(0), side(1), "change_id", "ts", "2 hours")
    return J.drain(out).select("change_id", "before_value", "after_value")


@query("stream_expired_arrivals", """
WITH e AS (SELECT event_id // 2 AS change_id, event_id % 2 AS odd, ts::TIMESTAMP AS ts, round(value * 100)::BIGINT::VARCHAR AS v FROM events),
p AS (SELECT a.change_id, a.v AS before_value, b.v AS after_value FROM e a JOIN e b ON a.change_id = b.change_id AND a.odd = 0 AND b.odd = 1
  WHERE b.ts BETWEEN a.ts - INTERVAL 3 MINUTE AND a.ts + INTERVAL 3 MINUTE)
SELECT change_id, before_value, after_value, 'paired' AS outcome FROM p
UNION ALL SELECT change_id, CASE odd WHEN 0 THEN v END, CASE odd WHEN 1 THEN v END, CASE odd WHEN 0 THEN 'no after' ELSE 'no before' END
FROM e ANTI JOIN p USING (change_id) WHERE epoch_ms(ts) + 360000 <= (SELECT min(m) FROM (SELECT max(epoch_ms(ts)) AS m FROM e GROUP BY odd))""")
def stream_expired_arrivals(t):
    def side(odd):
        rows = _events(t).filter(F.col("event_id") % 2 == odd)
        cents = F.round(F.col("value") * 100).cast("long")
        return rows.select(F.expr("event_id div 2").alias("change_id"), "ts", cents.alias("value"))

    with keyed_state(t.spark):
        return J.drain(pair_or_expire(side(0), side(1), "change_id", "ts", "value", 180))


@query("stream_resumed", "SELECT event_id FROM events WHERE event_id % 4 <> 0")
def stream_resumed(t):
    twice = _events(t).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    done = t.events.filter("event_id % 4 = 0")
    return J.drain(J.resume(twice, done, ["event_id"], "ts", "31 days").select("event_id"))


@query("stream_running_mean", """
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, round(sum(value), 4) AS total, count(*) AS n, round(avg(value), 6) AS mean
FROM events GROUP BY ALL""")
def stream_running_mean(t):
    out = J.running_mean(_events(t), "value", "ts", "1 day", "31 days", "event_type")
    table = J.drain(out, "update", ["start", "event_type"])
    return table.select(
        F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type",
        F.round("total", 4).alias("total"), "n", F.round("mean", 6).alias("mean"))


def _prediction_stream(t, files=3):
    """The predictions as files that arrive in several batches."""
    path = scratch_path(t.spark, "arrivals")
    rows = predictions(t)
    rows.repartition(files, "pair_id").write.parquet(path)
    return J.file_stream(t.spark, f"{path}/*.parquet", rows.schema, files_per_batch=1)


@query("stream_bleu", metric_plans._bleu_sql(metric_plans._bleu_counts()))
def stream_bleu(t):
    out = J.running_metric(_prediction_stream(t), metric.bleu_metric(), "hyp", "target")
    return metric_plans._rounded(J.drain(out, "complete"))


@query("stream_token_counter", f"""WITH {PREDICTIONS_SQL}
SELECT sum(len(string_split(source, ' ')) + len(string_split(target, ' ')))::BIGINT AS num_tokens FROM predictions""")
def stream_token_counter(t):
    lens = _prediction_stream(t).select(
        F.size(tx.words("source")).alias("s"), F.size(tx.words("target")).alias("g"))
    return J.drain(J.token_counter(lens, "s", "g"), "complete")


@query("stream_samples", f"""WITH {PAIRS_SQL}, f AS (
  SELECT pair_id, string_split(source, ' ') AS s, list_concat(['SEQUENCE_START'], string_split(target, ' '), ['SEQUENCE_END']) AS g FROM pairs WHERE pair_id % 4 = 0)
SELECT pair_id, array_to_string(s[1:len(g) - 1], ' ') AS prediction, array_to_string(g[2:len(g)], ' ') AS target FROM f""")
def stream_samples(t):
    rows = _prediction_stream(t).select(
        "pair_id", tx.words("source").alias("predicted_tokens"), tx.wrap_start_end(tx.words("target")).alias("target_tokens"))
    rows = rows.withColumn("target_len", F.size("target_tokens"))
    return J.sample_stream(rows, "pair_id", 4).select("pair_id", "prediction", "target")
