"""Beam, attention and decoding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.functions.scores import length_penalty
from palimpsest.operators import batching, beams as G
from palimpsest.operators.vocab import build_vocab
from palimpsest.plans.registry import query
from palimpsest.plans.views import (
    ATTENTION_SQL, BEAMS_SQL, DOC_TOKENS_SQL, LOGITS_SQL, PAIRS_SQL, attended_predictions, attended_sources,
    attention, beam_state, beams, document_tokens, logits, pairs,
)

_PATHS = f"""WITH RECURSIVE {BEAMS_SQL}, walk AS (
  SELECT example_id, beam, step, token_id, parent FROM beams WHERE step = 5
  UNION ALL
  SELECT w.example_id, w.beam, b.step, b.token_id, b.parent FROM walk w JOIN beams b
    ON b.example_id = w.example_id AND b.step = w.step - 1 AND b.beam = w.parent)"""


@query("beam_paths", f"{_PATHS} SELECT example_id, beam, step, token_id FROM walk")
def beam_paths(t):
    return G.path_rows(G.gather_tree(beams(t))).withColumn("step", F.col("step").cast("long"))


@query("first_beam", f"{_PATHS} SELECT example_id, string_agg(token_id::VARCHAR, ' ' ORDER BY step) AS path FROM walk WHERE beam = 0 GROUP BY example_id")
def first_beam(t):
    paths = G.first_beam(G.gather_tree(beams(t)))
    return paths.select("example_id", F.concat_ws(" ", F.col("path").cast("array<string>")).alias("path"))


_TEXTS = f"""{_PATHS}, {DOC_TOKENS_SQL}, vocab AS (
  SELECT row_number() OVER (ORDER BY count(*) DESC, token DESC) - 1 AS id, token FROM doc_tokens GROUP BY token
  QUALIFY row_number() OVER (ORDER BY count(*) DESC, token DESC) <= 8),
ends AS (SELECT example_id, beam, min(step) AS cut FROM walk WHERE token_id = 10 GROUP BY ALL),
texts AS (SELECT w.example_id, w.beam, coalesce(string_agg(coalesce(v.token, 'UNK'), ' ' ORDER BY w.step) FILTER (e.cut IS NULL OR w.step < e.cut), '') AS text
  FROM walk w LEFT JOIN ends e ON e.example_id = w.example_id AND e.beam = w.beam LEFT JOIN vocab v ON v.id = w.token_id GROUP BY ALL)"""


def _texts(t):
    vocab = build_vocab(document_tokens(t), "tokens", max_size=8)
    return G.beam_texts(G.gather_tree(beams(t)), vocab, end_id=10, rows_at_most=8)


@query("beam_texts", f"{_TEXTS} SELECT example_id, beam, text FROM texts")
def beam_texts(t):
    return _texts(t)


@query("beam_lines", f"{_TEXTS} SELECT example_id, string_agg(text, ' <SEP> ' ORDER BY beam) AS line FROM texts GROUP BY example_id")
def beam_lines(t):
    return G.beam_lines(_texts(t))


@query("beam_nodes", f"""WITH {BEAMS_SQL} SELECT example_id, step + 1 AS level, beam AS node, token_id::VARCHAR AS name, score FROM beams
UNION ALL SELECT DISTINCT example_id, 0::BIGINT, 0::BIGINT, 'START', NULL::DOUBLE FROM beams""")
def beam_nodes(t):
    return G.beam_nodes(beams(t))


@query("beam_edges", f"WITH {BEAMS_SQL} SELECT example_id, step AS level, parent, beam AS node FROM beams")
def beam_edges(t):
    return G.beam_edges(beams(t))


@query("log_softmax", f"WITH {LOGITS_SQL} SELECT example_id, beam, token_id, round(lp, 6) AS log_prob FROM soft")
def log_softmax(t):
    out = G.with_log_softmax(logits(t), "logit", ["example_id", "beam"])
    return out.select("example_id", "beam", "token_id", F.round("log_prob", 6).alias("log_prob"))


_STEP = """, c AS (
  SELECT s.example_id, s.beam AS parent, token_id, finished OR token_id = 0 AS fin,
    state.log_prob + CASE WHEN finished THEN CASE WHEN token_id = 0 THEN 0 ELSE -3.4028234663852886e38 END ELSE lp END AS total,
    length + CASE WHEN NOT finished AND token_id <> 0 THEN 1 ELSE 0 END AS len
  FROM soft s JOIN state ON state.example_id = s.example_id AND state.beam = s.beam WHERE {where}),
k AS (SELECT *, total / pow((5.0 + len) / 6, 0.6) AS score FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY score DESC, parent, token_id) - 1 AS beam FROM k)
SELECT example_id, beam, token_id, parent, round(score, 6) AS score, round(total, 6) AS log_prob, len AS length, fin AS finished FROM r WHERE beam < 3"""


def _stepped(t, first):
    out = G.beam_step(logits(t), beam_state(t), width=3, eos=0, penalty_weight=0.6, first=first)
    return out.withColumns({
        "beam": F.col("beam").cast("long"), "score": F.round("score", 6), "log_prob": F.round("log_prob", 6)})


@query("beam_step", f"WITH {LOGITS_SQL}" + _STEP.format(where="TRUE"))
def beam_step(t):
    return _stepped(t, False)


@query("beam_first_step", f"WITH {LOGITS_SQL}" + _STEP.format(where="s.beam = 0"))
def beam_first_step(t):
    return _stepped(t, True)


@query("beam_step_longest_first", f"WITH {LOGITS_SQL}" + _STEP.format(where="TRUE").replace(
    "ORDER BY score DESC, parent", "ORDER BY len DESC, score DESC, parent"))
def beam_step_longest_first(t):
    out = G.beam_step(
        logits(t), beam_state(t), width=3, eos=0, penalty_weight=0.6,
        successors=lambda: [F.desc("length"), *G.by_score()])
    return out.withColumns({
        "beam": F.col("beam").cast("long"), "score": F.round("score", 6), "log_prob": F.round("log_prob", 6)})


@query("length_penalty", "SELECT event_id, round(pow((5.0 + user_id % 30) / 6, 0.6), 6) AS penalty FROM events")
def penalties(t):
    return t.events.select("event_id", F.round(length_penalty(F.col("user_id") % 30, 0.6), 6).alias("penalty"))


_CUT = f"""WITH {PAIRS_SQL}, w AS (SELECT pair_id, string_split(target, ' ') AS ws, pair_id % 12 AS k FROM pairs)
SELECT pair_id, array_to_string(ws[1:k], ' ') AS kept, least(k, len(ws)) + 1 AS predicted_len FROM w WHERE pair_id % 2 = 0
UNION ALL SELECT pair_id, array_to_string(ws, ' '), len(ws) FROM w WHERE pair_id % 2 = 1"""


@query("cut_at_end", _CUT)
def cut_at_end(t):
    w = tx.words("target")
    k = (F.col("pair_id") % 12).cast("int")
    ended = F.concat(F.slice(w, F.lit(1), k), F.array(F.lit("SEQUENCE_END")), F.slice(w, k + 1, F.size(w)))
    rows = pairs(t).select("pair_id", F.when(F.col("pair_id") % 2 == 0, ended).otherwise(w).alias("tokens"))
    return rows.select("pair_id", F.concat_ws(" ", tx.cut_at_end("tokens")).alias("kept"),
                       tx.predicted_length("tokens").cast("long").alias("predicted_len"))


@query("strongest_source", f"WITH {ATTENTION_SQL} SELECT example_id, target_pos, source_pos FROM best")
def strongest_source(t):
    return G.strongest_source(attention(t))


@query("cut_attention", f"""WITH {ATTENTION_SQL} SELECT example_id, count(*) AS cells, round(sum(score), 6) AS total
FROM att WHERE target_pos < target_len AND source_pos < source_len GROUP BY example_id""")
def cut_attention(t):
    return G.cut_attention(attention(t)).groupBy("example_id").agg(
        F.count("*").alias("cells"), F.round(F.sum("score"), 6).alias("total"))


_REPLACED = """SELECT p.example_id, p.target_pos, CASE WHEN p.token = 'UNK' THEN {new} ELSE p.token END AS token FROM pred p
JOIN best b ON b.example_id = p.example_id AND b.target_pos = p.target_pos
JOIN src s ON s.example_id = b.example_id AND s.source_pos = b.source_pos"""


@query("unknown_replaced", f"WITH {ATTENTION_SQL} {_REPLACED.format(new='s.source_token')}")
def unknown_replaced(t):
    return G.replace_unknown(attended_predictions(t), attention(t), attended_sources(t))


@query("unknown_replaced_mapped", f"WITH {ATTENTION_SQL} " + _REPLACED.format(
    new="CASE WHEN substr(s.source_token, 2)::INT % 2 = 0 THEN 'm' || substr(s.source_token, 2) ELSE s.source_token END"))
def unknown_replaced_mapped(t):
    number = F.expr("substring(source, 2)").try_cast("int")
    mapping = (
        attended_sources(t).select(F.col("source_token").alias("source")).distinct()
        .filter(number % 2 == 0)
        .select("source", F.concat(F.lit("m"), number.cast("string")).alias("target")))
    return G.replace_unknown(attended_predictions(t), attention(t), attended_sources(t), mapping)


@query("best_targets", f"""WITH {PAIRS_SQL}, al AS (
  SELECT unnest(s[1:least(len(s), len(g))]) AS source, unnest(g[1:least(len(s), len(g))]) AS target
  FROM (SELECT string_split(source, ' ') AS s, string_split(target, ' ') AS g FROM pairs)),
lex AS (SELECT source, target, count(*) / sum(count(*)) OVER (PARTITION BY source) AS prob FROM al GROUP BY source, target)
SELECT source, target FROM lex QUALIFY row_number() OVER (PARTITION BY source ORDER BY prob DESC, target) = 1""")
def best_targets(t):
    words = pairs(t).select(tx.words("source").alias("source"), tx.words("target").alias("target"))
    al = batching.unbatch(words, ["source", "target"]).filter("source IS NOT NULL AND target IS NOT NULL")
    counts = al.groupBy("source", "target").agg(F.count("*").alias("n"))
    totals = counts.groupBy("source").agg(F.sum("n").alias("total"))
    lexicon = counts.join(totals, "source").select("source", "target", (F.col("n") / F.col("total")).alias("prob"))
    return G.best_targets(lexicon)


@query("sampled_predictions", f"""WITH {PAIRS_SQL}, f AS (
  SELECT pair_id, string_split(source, ' ') AS s, list_concat(['SEQUENCE_START'], string_split(target, ' '), ['SEQUENCE_END']) AS g FROM pairs WHERE pair_id % 4 = 0)
SELECT pair_id, array_to_string(s[1:len(g) - 1], ' ') AS prediction, array_to_string(g[2:len(g)], ' ') AS target FROM f""")
def sampled_predictions(t):
    from palimpsest.operators.report import sample_every

    rows = pairs(t).select(
        "pair_id", tx.words("source").alias("predicted_tokens"), tx.wrap_start_end(tx.words("target")).alias("target_tokens"))
    rows = rows.withColumn("target_len", F.size("target_tokens"))
    return sample_every(rows, "pair_id", 4).select("pair_id", "prediction", "target")
