"""Metric and classification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import bleu, classify, metric, rouge
from palimpsest.operators.distinct import count_names
from palimpsest.plans.registry import query
from palimpsest.plans.views import DOC_TOKENS_SQL, PAIRS_SQL, PREDICTIONS_SQL, document_tokens, pairs, predictions


def _rounded(df, digits=6):
    return df.select(*[
        F.round(c, digits).alias(c) if dtype == "double" else F.col(c) for c, dtype in df.dtypes])


def _grams(name, table, key, col):
    return f"""{name} AS (
  SELECT {key} AS k, n, array_to_string(w[i:i + n - 1], ' ') AS g, count(*) AS c FROM (
    SELECT {key}, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (
      SELECT {key}, list_filter(string_split({col}, ' '), lambda x: x <> '') AS w FROM {table}), (VALUES (1), (2), (3), (4)) o(n)
    WHERE len(w) >= n) GROUP BY ALL)"""


def _bleu_counts(hyp="hyp", refs=("target",)):
    union = " UNION ALL ".join(f"SELECT k, n, g, c FROM r{i}" for i in range(len(refs)))
    closest = ", ".join(
        f"{{'d': abs(len(list_filter(string_split({r}, ' '), lambda x: x <> '')) - len(list_filter(string_split({hyp}, ' '), lambda x: x <> ''))), "
        f"'n': len(list_filter(string_split({r}, ' '), lambda x: x <> ''))}}" for r in refs)
    return ",\n".join([
        _grams("h", "predictions", "pair_id", hyp),
        *[_grams(f"r{i}", "predictions", "pair_id", r) for i, r in enumerate(refs)],
        f"r AS (SELECT k, n, g, max(c) AS c FROM ({union}) GROUP BY ALL)",
        """matches AS (SELECT h.k, h.n, sum(h.c) AS total, sum(least(h.c, coalesce(r.c, 0))) AS hit
  FROM h LEFT JOIN r ON h.k = r.k AND h.n = r.n AND h.g = r.g GROUP BY ALL)""",
        f"""lens AS (SELECT pair_id AS k, len(list_filter(string_split({hyp}, ' '), lambda x: x <> '')) AS hl,
  list_min([{closest}]).n AS rl FROM predictions)""",
    ])


_CLOSE = """
  round(100 * bp * CASE WHEN least(p1, p2, p3, p4) <= 0 THEN 0 ELSE exp((ln(greatest(p1, 1e-300)) + ln(greatest(p2, 1e-300)) + ln(greatest(p3, 1e-300)) + ln(greatest(p4, 1e-300))) / 4) END, 6) AS bleu,
  round(100 * p1, 6) AS p1, round(100 * p2, 6) AS p2, round(100 * p3, 6) AS p3, round(100 * p4, 6) AS p4,
  round(bp, 6) AS brevity_penalty, round(hyp_len / ref_len, 6) AS length_ratio, hyp_len, ref_len"""
_P = ", ".join(f"coalesce(m{n} / nullif(t{n}, 0), 0) AS p{n}" for n in (1, 2, 3, 4))
_BP = "CASE WHEN hyp_len = 0 THEN 0 WHEN hyp_len < ref_len THEN exp(1 - ref_len / hyp_len) ELSE 1 END AS bp"
_SUMS = ", ".join(
    f"coalesce(sum(hit) FILTER (n = {n}), 0)::DOUBLE AS m{n}, coalesce(sum(total) FILTER (n = {n}), 0)::DOUBLE AS t{n}"
    for n in (1, 2, 3, 4))


def _bleu_sql(counts):
    return f"""WITH {PREDICTIONS_SQL}, {counts},
s AS (SELECT {_SUMS} FROM matches), l AS (SELECT sum(hl)::BIGINT AS hyp_len, sum(rl)::BIGINT AS ref_len FROM lens),
p AS (SELECT hyp_len, ref_len, {_P}, {_BP} FROM s, l)
SELECT {_CLOSE} FROM p"""


@query("corpus_bleu", _bleu_sql(_bleu_counts()))
def corpus_bleu(t):
    return _rounded(bleu.corpus_bleu(predictions(t), "hyp", ["target"]))


@query("corpus_bleu_two_references", _bleu_sql(_bleu_counts(refs=("target", "source"))))
def corpus_bleu_two_references(t):
    return _rounded(bleu.corpus_bleu(predictions(t), "hyp", ["target", "source"]))


@query("corpus_bleu_lowercase", _bleu_sql(_bleu_counts(hyp="lower(hyp)", refs=("lower(target)",))))
def corpus_bleu_lowercase(t):
    return _rounded(bleu.corpus_bleu(predictions(t), "hyp", ["target"], lowercase=True))


_RUN = ", ".join(
    f"sum(coalesce((SELECT hit FROM matches m WHERE m.k = lens.k AND m.n = {n}), 0)) OVER w::DOUBLE AS m{n}, "
    f"sum(greatest(hl - {n} + 1, 0)) OVER w::DOUBLE AS t{n}" for n in (1, 2, 3, 4)).replace(
        ") OVER w::DOUBLE", ") OVER w").replace("sum(", "sum(1.0 * ")


@query("running_bleu", f"""WITH {PREDICTIONS_SQL}, {_bleu_counts()},
s AS (SELECT k, {_RUN}, (sum(hl) OVER w) AS hyp_len, (sum(rl) OVER w) AS ref_len FROM lens WINDOW w AS (ORDER BY k)),
q AS (SELECT k, m1::DOUBLE AS m1, t1::DOUBLE AS t1, m2::DOUBLE AS m2, t2::DOUBLE AS t2, m3::DOUBLE AS m3, t3::DOUBLE AS t3,
  m4::DOUBLE AS m4, t4::DOUBLE AS t4, hyp_len::BIGINT AS hyp_len, ref_len::BIGINT AS ref_len FROM s),
p AS (SELECT k AS pair_id, hyp_len, ref_len, {_P}, {_BP} FROM q)
SELECT pair_id, {_CLOSE} FROM p""")
def running_bleu(t):
    return _rounded(bleu.running_bleu(predictions(t), "pair_id", "hyp", ["target"]))


@query("pluggable_metric_bpe", f"""WITH {PREDICTIONS_SQL}, {_bleu_counts()},
s AS (SELECT {_SUMS} FROM matches), l AS (SELECT sum(hl)::BIGINT AS hyp_len, sum(rl)::BIGINT AS ref_len FROM lens),
p AS (SELECT hyp_len, ref_len, {_P}, {_BP} FROM s, l)
SELECT {_CLOSE} FROM p""")
def pluggable_metric_bpe(t):
    broken = predictions(t).withColumns({
        c: F.replace(F.col(c), F.lit("eau"), F.lit("ea@@ u")) for c in ("hyp", "target")})
    return _rounded(metric.bleu_metric(tx.strip_bpe).corpus(broken, "hyp", "target"))


@query("ngram_counts", f"""WITH {DOC_TOKENS_SQL}, w AS (SELECT token AS a, lead(token, 1) OVER o AS b, lead(token, 2) OVER o AS c, lead(token, 3) OVER o AS d
  FROM doc_tokens WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
g AS (SELECT 1 AS n, a AS ngram FROM w UNION ALL SELECT 2, a || ' ' || b FROM w WHERE b IS NOT NULL
  UNION ALL SELECT 3, a || ' ' || b || ' ' || c FROM w WHERE c IS NOT NULL
  UNION ALL SELECT 4, a || ' ' || b || ' ' || c || ' ' || d FROM w WHERE d IS NOT NULL)
SELECT n, count(*) AS occurrences, count(DISTINCT ngram) AS distinct_ngrams FROM g GROUP BY n""")
def ngram_counts(t):
    docs = document_tokens(t)
    # Counted before the n-grams are made: so many ranges of them there will be.
    n = docs.agg(F.sum(F.size("tokens"))).first()[0] or 0
    return count_names(bleu.ngram_rows(docs, "tokens", named=bleu.MAX_ORDER * n))


def _rouge_sets(n):
    def grams(c):
        return (f"list_distinct(CASE WHEN len(string_split({c}, ' ')) >= {n} THEN list_transform(range(1, len(string_split({c}, ' ')) - {n} + 2), "
                f"lambda i: array_to_string(string_split({c}, ' ')[i:i + {n} - 1], ' ')) ELSE []::VARCHAR[] END)")
    return f"""SELECT pair_id, p, r, 2 * p * r / (p + r + 1e-8) AS f FROM (
  SELECT pair_id, CASE WHEN len(h) = 0 THEN 0 ELSE b / len(h) END AS p, CASE WHEN len(g) = 0 THEN 0 ELSE b / len(g) END AS r FROM (
    SELECT pair_id, h, g, len(list_intersect(h, g)) AS b FROM (
      SELECT pair_id, {grams('hyp')} AS h, {grams('target')} AS g FROM predictions)))"""


for _n in (1, 2):
    @query(f"rouge_{_n}", f"""WITH {PREDICTIONS_SQL}
SELECT pair_id, round(p, 6) AS rouge_{_n}_p, round(r, 6) AS rouge_{_n}_r, round(f, 6) AS rouge_{_n}_f FROM ({_rouge_sets(_n)})""")
    def rouge_n(t, n=_n):
        out = rouge.with_rouge_n(predictions(t), "hyp", "target", n)
        return _rounded(out.select("pair_id", f"rouge_{n}_p", f"rouge_{n}_r", f"rouge_{n}_f"))


# One row of the alignment table per step: row i follows from row i - 1 by a
# running maximum, the textbook recurrence.
_LCS = """
w AS (SELECT pair_id, string_split(hyp, ' ') AS h, string_split(target, ' ') AS g FROM predictions),
dp AS (
  SELECT pair_id, 0 AS i, list_transform(range(0, len(g) + 1), lambda x: 0::BIGINT) AS cells, h, g FROM w
  UNION ALL
  SELECT pair_id, i + 1, list_reduce(range(1, len(g) + 1),
    lambda acc, j: list_append(acc, CASE WHEN h[i + 1] = g[j] THEN cells[j] + 1 ELSE greatest(acc[len(acc)], cells[j + 1]) END),
    [0::BIGINT]) AS cells, h, g
  FROM dp WHERE i < len(h)
),
lcs AS (SELECT pair_id, cells[len(cells)] AS lcs, len(h) AS n, len(g) AS m FROM dp WHERE i = len(h)),
pr AS (SELECT pair_id, lcs, lcs / n AS p, lcs / m AS r FROM lcs),
fl AS (SELECT pair_id, lcs, p, r, (1 + pow(p / (r + 1e-12), 2)) * r * p / (r + pow(p / (r + 1e-12), 2) * p + 1e-12) AS f FROM pr)"""


@query("rouge_l", f"""WITH RECURSIVE {PREDICTIONS_SQL}, {_LCS}
SELECT pair_id, lcs, round(p, 6) AS rouge_l_p, round(r, 6) AS rouge_l_r, round(f, 6) AS rouge_l_f FROM fl""")
def rouge_l(t):
    out = rouge.with_rouge_l(predictions(t), "hyp", "target")
    return _rounded(out.select("pair_id", "lcs", "rouge_l_p", "rouge_l_r", "rouge_l_f"))


# The words of one common subsequence a pair of sentences, walked back from the
# ends: a match is taken, else the longer side is kept, else a step along y.
_UNION = """
texts AS (SELECT pair_id, list_filter(list_transform(string_split(hyp, '.'), lambda x: trim(x, ' ')), lambda x: x <> '') AS hs,
  list_filter(list_transform(string_split(target, '.'), lambda x: trim(x, ' ')), lambda x: x <> '') AS gs FROM predictions),
refs AS (SELECT pair_id, unnest(gs) AS g, unnest(range(len(gs))) AS r, hs FROM texts),
cells_of AS (SELECT pair_id, r, unnest(range(len(hs))) AS h, string_split(g, ' ') AS x, string_split(unnest(hs), ' ') AS y FROM refs),
dp AS (
  SELECT pair_id, r, h, 0::BIGINT AS i, list_transform(range(0, len(y) + 1), lambda z: 0::BIGINT) AS cells, x, y FROM cells_of
  UNION ALL
  SELECT pair_id, r, h, i + 1, list_reduce(range(1, len(y) + 1),
    lambda acc, j: list_append(acc, CASE WHEN x[i + 1] = y[j] THEN cells[j] + 1 ELSE greatest(acc[len(acc)], cells[j + 1]) END),
    [0::BIGINT]) AS cells, x, y
  FROM dp WHERE i < len(x)
),
table_rows AS MATERIALIZED (SELECT pair_id, r, h, i, cells FROM dp),
back AS (
  SELECT pair_id, r, h, len(x)::BIGINT AS i, len(y)::BIGINT AS j, x, y, NULL::VARCHAR AS word FROM cells_of
  UNION ALL
  SELECT b.pair_id, b.r, b.h, CASE WHEN b.x[b.i] = b.y[b.j] OR up.cells[b.j + 1] > own.cells[b.j] THEN b.i - 1 ELSE b.i END,
    CASE WHEN b.x[b.i] <> b.y[b.j] AND up.cells[b.j + 1] > own.cells[b.j] THEN b.j ELSE b.j - 1 END, b.x, b.y,
    CASE WHEN b.x[b.i] = b.y[b.j] THEN b.x[b.i] END
  FROM back b JOIN table_rows own ON own.pair_id = b.pair_id AND own.r = b.r AND own.h = b.h AND own.i = b.i
    JOIN table_rows up ON up.pair_id = b.pair_id AND up.r = b.r AND up.h = b.h AND up.i = b.i - 1
  WHERE b.i > 0 AND b.j > 0
),
found AS (SELECT DISTINCT pair_id, r, h, word FROM back WHERE word IS NOT NULL),
per_ref AS (SELECT pair_id, r, count(DISTINCT word) / count(*) AS v FROM found GROUP BY pair_id, r),
totals AS (SELECT pair_id, sum(v) AS v FROM per_ref GROUP BY pair_id),
sized AS (SELECT pair_id, coalesce(v, 0) AS v, list_sum(list_transform(hs, lambda z: len(string_split(z, ' ')))) AS n,
  list_sum(list_transform(gs, lambda z: len(string_split(z, ' ')))) AS m FROM texts LEFT JOIN totals USING (pair_id)),
pr AS (SELECT pair_id, coalesce(v / nullif(n, 0), 0) AS p, coalesce(v / nullif(m, 0), 0) AS q FROM sized)"""


@query("rouge_l_summary", f"""WITH RECURSIVE {PREDICTIONS_SQL}, {_UNION}
SELECT pair_id, round(p, 6) AS rouge_lsum_p, round(q, 6) AS rouge_lsum_r,
  round((1 + pow(p / (q + 1e-12), 2)) * q * p / (q + pow(p / (q + 1e-12), 2) * p + 1e-12), 6) AS rouge_lsum_f FROM pr""")
def rouge_l_summary(t):
    def sentences(c):
        return F.array_remove(F.transform(F.split(c, "[.]"), lambda x: F.trim(x)), "")

    rows = predictions(t).select("pair_id", sentences("hyp").alias("h"), sentences("target").alias("g"))
    out = rouge.with_rouge_l_summary(rows, "h", "g")
    return _rounded(out.select("pair_id", "rouge_lsum_p", "rouge_lsum_r", "rouge_lsum_f"))


@query("rouge_report", f"""WITH RECURSIVE {PREDICTIONS_SQL}, {_LCS}, r1 AS ({_rouge_sets(1)}), r2 AS ({_rouge_sets(2)})
SELECT round(avg(r1.f), 6) AS rouge_1_f, round(avg(r1.r), 6) AS rouge_1_r, round(avg(r1.p), 6) AS rouge_1_p,
  round(avg(r2.f), 6) AS rouge_2_f, round(avg(r2.r), 6) AS rouge_2_r, round(avg(r2.p), 6) AS rouge_2_p,
  round(avg(fl.f), 6) AS rouge_l_f, round(avg(fl.r), 6) AS rouge_l_r, round(avg(fl.p), 6) AS rouge_l_p
FROM r1 JOIN r2 USING (pair_id) JOIN fl USING (pair_id)""")
def rouge_report(t):
    return _rounded(rouge.rouge_report(predictions(t), "hyp", "target"))


@query("running_rouge", f"""WITH {PREDICTIONS_SQL}, r1 AS ({_rouge_sets(1)})
SELECT pair_id, round(avg(f) OVER (ORDER BY pair_id), 6) AS rouge_1_f FROM r1""")
def running_rouge(t):
    return _rounded(metric.rouge_n_metric(1).running(predictions(t), "pair_id", "hyp", "target"))


_KIND = """SELECT *, CASE WHEN trim(hyp) = trim(target) THEN 'perfect' WHEN trim(hyp) = trim(source) THEN 'bad' ELSE 'changed' END AS kind
  FROM predictions"""


@query("greedy_classification", f"""WITH {PREDICTIONS_SQL}, k AS ({_KIND})
SELECT count(*) FILTER (kind = 'perfect') AS perfect, count(*) FILTER (kind = 'changed') AS changed,
  count(*) FILTER (kind = 'bad') AS bad, count(*) AS total,
  floor(count(*) FILTER (kind = 'perfect') * 10000 / count(*)) / 100 AS perfect_rate FROM k""")
def greedy_classification(t):
    return classify.classify_greedy(predictions(t), "hyp", "source", "target")


def _beam_texts(t):
    w = tx.words("target")
    beams = F.concat_ws(tx.BEAM_SEPARATOR, "hyp", "source", F.concat_ws(" ", F.slice(w, 1, 5)))
    return predictions(t).withColumn("beams", F.when(
        F.col("pair_id") % 5 == 0, F.concat_ws(tx.BEAM_SEPARATOR, "source", "source")).otherwise(beams))


@query("beam_classification", f"""WITH {PREDICTIONS_SQL}, b AS (
  SELECT pair_id, source, target, CASE WHEN pair_id % 5 = 0 THEN [source, source]
    ELSE [hyp, source, array_to_string(string_split(target, ' ')[1:5], ' ')] END AS hs FROM predictions),
x AS (SELECT pair_id, source, target, unnest(hs) AS h FROM b),
e AS (SELECT pair_id, bool_or(h = target) AS perfect, count(*) FILTER (h <> target AND h <> source) AS potential,
  count(*) FILTER (h <> target AND h = source) AS same, count(*) AS n FROM x GROUP BY pair_id)
SELECT count(*) FILTER (perfect) AS perfect, sum(potential)::BIGINT AS potential, sum(same)::BIGINT AS same,
  round(sum(potential) / count(*), 6) AS potential_per_example, count(*) FILTER (same = n) AS all_same FROM e""")
def beam_classification(t):
    return _rounded(classify.classify_beams(_beam_texts(t), "beams", "source", "target"))


@query("masked_loss", """
WITH k AS (SELECT l_discount AS loss FROM lineitem WHERE l_linenumber - 1 < l_orderkey % 7)
SELECT count(*) AS positions, round(sum(loss) / count(*), 6) AS log_perplexity,
  round(exp(sum(loss) / count(*)), 6) AS perplexity FROM k""")
def masked_loss(t):
    rows = t.lineitem.select(
        F.col("l_discount").alias("loss"), (F.col("l_linenumber") - 1).alias("pos"),
        (F.col("l_orderkey") % 7 + 1).alias("target_len"))
    return _rounded(classify.masked_mean_loss(rows, "loss", "pos", "target_len"))


@query("masked_loss_arrays", """
WITH r AS (SELECT l_orderkey % 4 + 1 AS target_len, [l_discount, l_tax, l_discount + l_tax] AS losses FROM lineitem),
k AS (SELECT target_len, unnest(losses) AS loss, unnest(range(3)) AS pos FROM r),
m AS (SELECT loss FROM k WHERE pos < target_len - 1)
SELECT count(*) AS positions, round(sum(loss) / count(*), 6) AS log_perplexity,
  round(exp(sum(loss) / count(*)), 6) AS perplexity FROM m""")
def masked_loss_arrays(t):
    rows = t.lineitem.select(
        F.array("l_discount", "l_tax", F.col("l_discount") + F.col("l_tax")).alias("losses"),
        (F.col("l_orderkey") % 4 + 1).alias("target_len"))
    return _rounded(classify.masked_loss_of_arrays(rows, "losses", "target_len"))


@query("token_throughput", f"""WITH {PAIRS_SQL}
SELECT sum(len(string_split(source, ' ')) + len(string_split(target, ' ')))::BIGINT AS num_tokens FROM pairs""")
def token_throughput(t):
    lens = pairs(t).select(
        F.size(tx.words("source")).alias("s"), F.size(tx.words("target")).alias("g"))
    return classify.token_throughput(lens, "s", "g")


@query("length_histogram", f"""WITH {PAIRS_SQL}
SELECT len(string_split(target, ' ')) // 25 * 25 AS lower, count(*) AS n FROM pairs GROUP BY ALL""")
def length_histogram(t):
    lens = pairs(t).select(F.size(tx.words("target")).alias("n"))
    return classify.length_histogram(lens, "n", 25)


@query("run_report", """
SELECT event_type, count(*) AS examples, sum(1 + user_id % 5)::BIGINT AS hypotheses, round(sum(value), 4) AS seconds,
  round(sum(value) / count(*), 6) AS sec_per_example, round(sum(value) / sum(1 + user_id % 5), 6) AS sec_per_hypothesis
FROM events GROUP BY event_type""")
def run_report(t):
    log = t.events.select("event_type", "value", (F.col("user_id") % 5 + 1).alias("hyps"))
    out = _rounded(classify.run_report(log, "value", "hyps", "event_type"))
    return out.withColumn("seconds", F.round("seconds", 4))


@query("hypothesis_alignment", f"""WITH {PREDICTIONS_SQL}
SELECT pair_id, trim(hyp) = trim(target) AS hit, len(hyp) AS hyp_chars, len(target) AS target_chars FROM predictions""")
def hypothesis_alignment(t):
    p = predictions(t)
    hyps = p.select("pair_id", "hyp")
    joined = hyps.join(pairs(t), "pair_id")
    return joined.select(
        "pair_id", (F.trim("hyp") == F.trim("target")).alias("hit"),
        F.length("hyp").cast("long").alias("hyp_chars"),
        F.length("target").cast("long").alias("target_chars"))
