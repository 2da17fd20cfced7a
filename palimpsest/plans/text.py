"""Vocabulary, encoding, batching and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import batching as B
from palimpsest.operators import vocab as V
from palimpsest.plans.registry import query
from palimpsest.plans.views import DOC_TOKENS_SQL, PAIRS_SQL, document_tokens, pairs

SIZE = V.RECOMMENDED_VOCAB_SIZE

_COUNTS = f"WITH {DOC_TOKENS_SQL}, counts AS (SELECT token, count(*) AS n FROM doc_tokens GROUP BY token)"
_VOCAB = f"""{_COUNTS}, vocab AS (
  SELECT row_number() OVER (ORDER BY n DESC, token DESC) - 1 AS id, token, n AS count
  FROM counts QUALIFY row_number() OVER (ORDER BY n DESC, token DESC) <= {SIZE})"""


def _vocab(t):
    return V.build_vocab(document_tokens(t), "tokens", max_size=SIZE)


@query("vocabulary", f"{_VOCAB} SELECT id, token, count FROM vocab")
def vocabulary(t):
    return _vocab(t)


@query("vocabulary_unbounded", f"""{_COUNTS}
SELECT row_number() OVER (ORDER BY n DESC, token DESC) - 1 AS id, token, n AS count FROM counts""")
def vocabulary_unbounded(t):
    return V.build_vocab(document_tokens(t), "tokens", max_size=None)


@query("token_frequency", f"{_COUNTS} SELECT token, n AS count FROM counts")
def token_frequency(t):
    return V.token_counts(document_tokens(t), "tokens")


@query("token_frequency_downcase", """
SELECT token, count(*) AS count FROM (
  SELECT unnest(string_split(lower(regexp_replace(line, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g')), ' ')) AS token FROM (
    SELECT unnest(string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10))) AS line
    FROM documents)) WHERE token <> '' GROUP BY token""")
def token_frequency_downcase(t):
    lines = t.documents.select(F.explode(F.split("text", "\n")).alias("line"))
    return V.token_counts(lines, tx.split_tokens("line", " ", downcase=True))


@query("character_frequency", """
SELECT token, count(*) AS count FROM (
  SELECT unnest(string_split(regexp_replace(line, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g'), '')) AS token FROM (
    SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE token <> '' GROUP BY token""")
def character_frequency(t):
    lines = t.documents.select(F.explode(F.split("text", "\n")).alias("line"))
    return V.token_counts(lines, tx.characters("line"))


@query("min_frequency", f"{_COUNTS} SELECT token, n AS count FROM counts WHERE n > 5")
def min_frequency(t):
    return V.token_counts(document_tokens(t), "tokens", min_frequency=5)


@query("vocab_specials", f"""{_VOCAB}
SELECT n + k AS id, token FROM (SELECT count(*) AS n FROM vocab),
  (VALUES (0, 'UNK'), (1, 'SEQUENCE_START'), (2, 'SEQUENCE_END')) s(k, token)""")
def vocab_specials(t):
    return V.special_tokens(_vocab(t))


@query("token_positions", f"WITH {DOC_TOKENS_SQL} SELECT doc_id, pos, token FROM doc_tokens")
def token_positions(t):
    return V.token_rows(document_tokens(t), "tokens", "doc_id").withColumn(
        "pos", F.col("pos").cast("long"))


@query("token_to_id", f"""{_VOCAB}
SELECT doc_id, pos, d.token, coalesce(v.id, {SIZE}) AS token_id
FROM doc_tokens d LEFT JOIN vocab v ON d.token = v.token""")
def token_to_id(t):
    rows = V.token_rows(document_tokens(t), "tokens", "doc_id").withColumn(
        "pos", F.col("pos").cast("long"))
    return V.lookup_ids(rows, _vocab(t), SIZE, rows_at_most=SIZE)


@query("id_to_token", f"""{_VOCAB}
SELECT doc_id, pos, CASE WHEN v.id IS NULL THEN 'UNK' ELSE d.token END AS token,
  coalesce(v.id, {SIZE}) AS token_id
FROM doc_tokens d LEFT JOIN vocab v ON d.token = v.token""")
def id_to_token(t):
    vocab = _vocab(t)
    return V.lookup_tokens(token_to_id(t).drop("token"), vocab, rows_at_most=SIZE)


@query("token_to_count", f"""{_VOCAB}
SELECT doc_id, pos, d.token, coalesce(v.count, -1) AS token_count
FROM doc_tokens d LEFT JOIN vocab v ON d.token = v.token""")
def token_to_count(t):
    rows = V.token_rows(document_tokens(t), "tokens", "doc_id").withColumn(
        "pos", F.col("pos").cast("long"))
    return V.lookup_counts(rows, _vocab(t), rows_at_most=SIZE)


@query("encode_documents", f"""{_VOCAB}
SELECT doc_id, coalesce(e.ids, '') AS ids FROM documents LEFT JOIN (
  SELECT doc_id, string_agg(coalesce(v.id, (SELECT count(*) FROM vocab))::VARCHAR, ' ' ORDER BY pos) AS ids
  FROM doc_tokens d LEFT JOIN vocab v ON d.token = v.token GROUP BY doc_id) e USING (doc_id)""")
def encode_documents(t):
    ids = V.encode(document_tokens(t), "doc_id", "tokens", _vocab(t), rows_at_most=SIZE)
    return ids.select("doc_id", F.concat_ws(" ", F.col("ids").cast("array<string>")).alias("ids"))


def _features(t):
    return pairs(t).select(
        "pair_id",
        tx.append_end(tx.words("source")).alias("source_tokens"),
        tx.wrap_start_end(tx.words("target")).alias("target_tokens"),
    )


@query("feature_rows", f"""WITH {PAIRS_SQL}
SELECT pair_id, source || ' SEQUENCE_END' AS source_text,
  'SEQUENCE_START ' || target || ' SEQUENCE_END' AS target_text,
  len(string_split(source, ' ')) + 1 AS source_len, len(string_split(target, ' ')) + 2 AS target_len
FROM pairs""")
def feature_rows(t):
    return _features(t).select(
        "pair_id",
        F.concat_ws(" ", "source_tokens").alias("source_text"),
        F.concat_ws(" ", "target_tokens").alias("target_text"),
        F.size("source_tokens").cast("long").alias("source_len"),
        F.size("target_tokens").cast("long").alias("target_len"),
    )


@query("truncate_reverse", f"""WITH {PAIRS_SQL}, f AS (
  SELECT pair_id, list_concat(string_split(source, ' '), ['SEQUENCE_END'])[1:20] AS s FROM pairs)
SELECT pair_id, array_to_string(list_reverse(s), ' ') AS reversed, len(s) AS source_len FROM f""")
def truncate_reverse(t):
    cut = _features(t).select("pair_id", tx.truncate("source_tokens", 20).alias("s"))
    return cut.select(
        "pair_id",
        F.concat_ws(" ", tx.reverse_prefix("s", F.size("s"))).alias("reversed"),
        F.size("s").cast("long").alias("source_len"),
    )


_LENGTHS = f"""WITH {PAIRS_SQL}, lens AS (
  SELECT pair_id, source, len(string_split(source, ' ')) AS n FROM pairs WHERE source <> ''),
buckets AS (SELECT *, (n >= 10)::INT + (n >= 20)::INT + (n >= 30)::INT + (n >= 40)::INT AS bucket FROM lens),
numbered AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY
  ('0x' || substr(md5('7:' || pair_id), 1, 15))::BIGINT, pair_id) - 1 AS k FROM buckets)"""


@query("length_buckets", f"{_LENGTHS} SELECT pair_id, n, bucket FROM buckets")
def length_buckets(t):
    return (
        pairs(t).select("pair_id", F.size(tx.words("source")).cast("long").alias("n"))
        .filter("n >= 1").withColumn("bucket", B.bucket_id("n"))
    )


def _batched(t, keep_short):
    rows = pairs(t).select("pair_id", tx.words("source").alias("tokens")).withColumn(
        "n", F.size("tokens").cast("long"))
    return B.assign_batches(
        rows, "n", B.shuffle_order("pair_id", 7), batch_size=8, keep_short=keep_short)


@query("bucketed_batches", f"""{_LENGTHS}
SELECT pair_id, bucket, k // 8 AS batch, k % 8 AS slot,
  max(n) OVER (PARTITION BY bucket, k // 8) AS width,
  rtrim(source || repeat(' <pad>', (max(n) OVER (PARTITION BY bucket, k // 8) - n)::INT)) AS padded
FROM numbered""")
def bucketed_batches(t):
    out = B.pad_batches(_batched(t, True), "tokens", "<pad>")
    return out.select(
        "pair_id", "bucket", "batch", F.col("slot").cast("long").alias("slot"),
        F.col("width").cast("long").alias("width"), F.concat_ws(" ", "padded").alias("padded"))


@query("full_batches_only", f"""{_LENGTHS}
SELECT bucket, k // 8 AS batch, count(*) AS n FROM numbered GROUP BY ALL HAVING count(*) = 8""")
def full_batches_only(t):
    return _batched(t, False).groupBy("bucket", "batch").agg(F.count("*").alias("n"))


@query("corpus_split", f"""WITH {PAIRS_SQL}, h AS (
  SELECT pair_id, ('0x' || substr(md5('0:' || pair_id), 1, 15))::BIGINT % 10 AS tenth FROM pairs)
SELECT pair_id, CASE WHEN tenth < 8 THEN 'train' WHEN tenth < 9 THEN 'eval' ELSE 'test' END AS split FROM h""")
def corpus_split(t):
    return B.with_split(pairs(t), "pair_id").select("pair_id", "split")


@query("direction_switch", f"WITH {PAIRS_SQL} SELECT pair_id, target AS source, source AS target FROM pairs")
def direction_switch(t):
    raw = pairs(t).withColumnsRenamed({"source": "before", "target": "after"})
    return B.with_direction(raw, "before", "after", reverse=True).select("pair_id", "source", "target")


@query("shuffled_epochs", f"""WITH {PAIRS_SQL}
SELECT pair_id, e AS epoch, row_number() OVER (ORDER BY e,
  ('0x' || substr(md5('3:' || pair_id), 1, 15))::BIGINT, pair_id) - 1 AS position
FROM pairs, (VALUES (1), (2), (3)) v(e)""")
def shuffled_epochs(t):
    from palimpsest.operators.ordering import with_index

    rows = B.repeat_epochs(pairs(t).select("pair_id"), 3)
    return with_index(rows, [F.col("epoch"), *B.shuffle_order("pair_id", 3)], "position")


_TOY = """
WITH ids AS (SELECT o_orderkey AS id, 5 + ('0x' || substr(md5('1:' || o_orderkey), 1, 15))::BIGINT % 36 AS n FROM orders),
w AS (SELECT id, i, ('0x' || substr(md5('1:' || id || ':' || i), 1, 15))::BIGINT % 100 AS v
      FROM (SELECT id, unnest(range(1, n + 1)) AS i FROM ids)),
s AS (SELECT id, i, CASE WHEN v = 99 THEN '笑' ELSE v::VARCHAR END AS word FROM w)
SELECT id, string_agg(word, ' ' ORDER BY i) AS source, string_agg(word, ' ' ORDER BY i {0}) AS target FROM s GROUP BY id"""


@query("toy_copy", _TOY.format(""))
def toy_copy(t):
    return B.toy_pairs(t.orders.select(F.col("o_orderkey").alias("id")), "id", kind="copy", seed=1)


@query("toy_reverse", _TOY.format("DESC"))
def toy_reverse(t):
    return B.toy_pairs(t.orders.select(F.col("o_orderkey").alias("id")), "id", kind="reverse", seed=1)


@query("unbatch_rows", f"""WITH {PAIRS_SQL}
SELECT pair_id, unnest(range(least(len(s), len(g)))) AS slot, unnest(s[1:least(len(s), len(g))]) AS source_token,
  unnest(g[1:least(len(s), len(g))]) AS target_token
FROM (SELECT pair_id, string_split(source, ' ') AS s, string_split(target, ' ') AS g FROM pairs)""")
def unbatch_rows(t):
    batch = pairs(t).select(
        "pair_id", tx.words("source").alias("source_token"), tx.words("target").alias("target_token"))
    return (
        B.unbatch(batch, ["source_token", "target_token"], "pair_id")
        .filter("source_token IS NOT NULL AND target_token IS NOT NULL")
        .withColumn("slot", F.col("slot").cast("long"))
    )


@query("slice_text", f"""WITH {PAIRS_SQL}
SELECT pair_id, target AS sliced FROM pairs""")
def slice_text(t):
    marked = pairs(t).select("pair_id", F.concat(
        F.lit("noise SEQUENCE_START "), "target", F.lit(" SEQUENCE_END tail")).alias("x"))
    return marked.select("pair_id", tx.slice_text("x").alias("sliced"))


@query("strip_subwords", f"""WITH {PAIRS_SQL}
SELECT pair_id, source AS from_bpe, source AS from_pieces FROM pairs""")
def strip_subwords(t):
    # Break every word after its second letter, the way each scheme marks it.
    halves = F.transform(tx.words("source"), lambda w: F.when(
        F.length(w) > 2, F.concat(F.substring(w, 1, 2), F.lit("@@ "),
                              F.substr(w, F.lit(3)))).otherwise(w))
    pieces = F.transform(tx.words("source"), lambda w: F.concat(
        F.lit(tx.SENTENCEPIECE_SPACE), F.when(F.length(w) > 2, F.concat(
            F.substring(w, 1, 2), F.lit(" "), F.substr(w, F.lit(3)))).otherwise(w)))
    marked = pairs(t).select(
        "pair_id", F.concat_ws(" ", halves).alias("b"), F.concat_ws(" ", pieces).alias("p"))
    return marked.select(
        "pair_id", tx.strip_bpe("b").alias("from_bpe"),
        tx.decode_sentencepiece("p").alias("from_pieces"))
