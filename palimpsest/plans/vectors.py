"""Distance, cluster, graph and embedding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import edits as E
from palimpsest.operators import graph as R
from palimpsest.operators import ml, paragraphs
from palimpsest.operators import vectors as V
from palimpsest.functions.text import words
from palimpsest.plans.aligned import ALIGNED_SQL
from palimpsest.plans.registry import query
from palimpsest.plans.views import PAIRS_SQL, VECTORS_SQL, pairs, vectors
from palimpsest.session import materialize

_W = f"WITH {VECTORS_SQL}"
_COS = "1 - list_dot_product(a.vector, b.vector) / (sqrt(list_dot_product(a.vector, a.vector)) * sqrt(list_dot_product(b.vector, b.vector)))"
_DIST = f"d AS (SELECT a.cluster, a.id AS a, b.id AS b, {_COS} AS distance FROM vectors a JOIN vectors b ON a.cluster = b.cluster AND a.id <> b.id)"


@query("cosine_distance", f"""{_W} SELECT a.id, round({_COS}, 6) AS distance FROM vectors a JOIN vectors b ON b.id = a.id + 1""")
def cosine_distance(t):
    v = vectors(t)
    following = v.select((F.col("id") - 1).alias("id"), F.col("vector").alias("next"))
    return v.join(following, "id").select("id", F.round(V.cosine_distance("vector", "next"), 6).alias("distance"))


@query("distant_pairs", f"{_W}, {_DIST} SELECT cluster, a AS id_a, b AS id_b, round(distance, 6) AS distance FROM d WHERE a < b AND distance > 1.35")
def distant_pairs(t):
    return V.distant_pairs(vectors(t), 1.35).withColumn("distance", F.round("distance", 6))


def _strength_sql(theta, weight):
    return f"""{_W}, {_DIST} SELECT cluster, a AS id, count(*) FILTER (distance > {theta}) AS degree,
  round(coalesce(sum({weight}) FILTER (distance > {theta}), 0), 6) AS strength FROM d GROUP BY cluster, a"""


@query("graph_strengths", _strength_sql(0.4, "distance"))
def graph_strengths(t):
    return R.node_strengths(vectors(t)).withColumn("strength", F.round("strength", 6))


@query("graph_strengths_unweighted", _strength_sql("1.0", "1.0::DOUBLE"))
def graph_strengths_unweighted(t):
    return R.node_strengths(vectors(t), 1.0, weighted=False).withColumn("strength", F.round("strength", 6))


def _rank_sql(theta, weight):
    return f"""WITH RECURSIVE {VECTORS_SQL}, {_DIST}, e AS (SELECT cluster, a, b, {weight} AS w FROM d WHERE distance > {theta}),
s AS (SELECT a, sum(w) AS s FROM e GROUP BY a), n AS (SELECT cluster, count(*) AS n FROM vectors GROUP BY cluster),
x AS (SELECT e.cluster, e.a, e.b, e.w / s.s AS p FROM e JOIN s ON s.a = e.a),
r AS (
  SELECT 0 AS it, v.cluster, v.id, 1.0::DOUBLE / n AS rank FROM vectors v JOIN n ON n.cluster = v.cluster
  UNION ALL
  SELECT r.it + 1, x.cluster, x.b, 0.15 / max(n.n) + 0.85 * sum(r.rank * x.p) FROM r JOIN x ON x.a = r.id JOIN n ON n.cluster = x.cluster
  WHERE r.it < 15 GROUP BY r.it, x.cluster, x.b
), last AS (SELECT cluster, id, rank FROM r WHERE it = 15)"""


@query("pagerank", f"{_rank_sql(0.4, 'distance')} SELECT cluster, id, round(rank, 6) AS rank FROM last")
def pagerank(t):
    return R.pagerank(vectors(t), tolerance=1e-9).withColumn("rank", F.round("rank", 6))


@query("representatives", f"{_rank_sql(0.4, 'distance')} SELECT cluster, arg_min(id, (-rank, id)) AS id FROM last GROUP BY cluster")
def representatives(t):
    return R.representatives(R.pagerank(vectors(t)))


@query("representatives_unweighted", f"{_rank_sql('1.0', '1.0')} SELECT cluster, arg_min(id, (-round(rank, 12), id)) AS id FROM last GROUP BY cluster")
def representatives_unweighted(t):
    ranks = R.pagerank(vectors(t), 1.0, weighted=False, tolerance=1e-13)
    return R.representatives(ranks.withColumn("rank", F.round("rank", 12)))


_SIL = """, p AS (SELECT a.id, a.cluster AS own, b.cluster AS other, sum({dist}) AS total, count(*) AS n
  FROM vectors a JOIN vectors b ON a.id <> b.id GROUP BY ALL),
q AS (SELECT id, own, max(total / n) FILTER (own = other) AS a, min(total / n) FILTER (own <> other) AS b FROM p GROUP BY id, own),
s AS (SELECT id, own AS cluster, coalesce((b - a) / greatest(a, b), 0) AS silhouette FROM q)"""
_EUCLID = _SIL.format(dist="list_distance(a.vector, b.vector)")


@query("silhouette", f"{_W}{_EUCLID} SELECT id, cluster, round(silhouette, 6) AS silhouette FROM s")
def silhouette(t):
    return V.silhouette(vectors(t)).withColumn("silhouette", F.round("silhouette", 6))


@query("mean_silhouette", f"{_W}{_EUCLID} SELECT round(avg(silhouette), 6) AS silhouette FROM s")
def mean_silhouette(t):
    return V.mean_silhouette(vectors(t)).withColumn("silhouette", F.round("silhouette", 6))


@query("squared_silhouette", f"""{_W}{_SIL.format(dist="pow(list_distance(a.vector, b.vector), 2)")}
SELECT round(avg(silhouette), 6) AS silhouette FROM s""")
def squared_silhouette(t):
    return ml.squared_silhouette_row(vectors(t)).withColumn("silhouette", F.round("silhouette", 6))


@query("nearest_centroid", f"""{_W}, u AS (SELECT cluster, unnest(vector) AS x, unnest(range(len(vector))) AS i FROM vectors),
m AS (SELECT cluster, i, avg(x) AS x FROM u GROUP BY cluster, i), c AS (SELECT cluster, list(x ORDER BY i) AS center FROM m GROUP BY cluster)
SELECT v.id, arg_min(c.cluster, (list_distance(v.vector, c.center), c.cluster)) AS nearest FROM vectors v, c GROUP BY v.id""")
def nearest_centroid(t):
    v = vectors(t)
    return V.nearest_centers(v, V.centroids(v)).select("id", "nearest")


@query("cluster_sizes", f"{_W} SELECT cluster, count(*) AS n FROM vectors GROUP BY cluster")
def cluster_sizes(t):
    return ml.cluster_sizes(vectors(t))


@query("cluster_members", f"{_W} SELECT cluster, id, count(*) OVER (PARTITION BY cluster) AS n FROM vectors")
def cluster_members(t):
    return ml.cluster_members(vectors(t), "id")


@query("labels_attached", """SELECT doc_id, d.lang, quality, toxic, n_chars FROM documents d JOIN labels USING (doc_id)""")
def labels_attached(t):
    return ml.attach(t.documents.select("doc_id", "lang", "n_chars"), t.labels, "doc_id")


def sequences(t):
    lists = pairs(t).select("pair_id", words("source").alias("before"), words("target").alias("after"))
    return E.edit_sequences(lists, "pair_id", "before", "after")


_ACTIONS = f"""WITH RECURSIVE {PAIRS_SQL}, lists AS (SELECT pair_id, string_split(source, ' ') AS s, string_split(target, ' ') AS g FROM pairs), {ALIGNED_SQL}"""
_LABELS = [E.INSERT, E.DELETE, E.UPDATE, E.MOVE]
_COUNTS = ", ".join(f"count(*) FILTER (action = '{a}') AS {a.replace('-', '_')}" for a in _LABELS)


@query("text_edit_sequences", f"{_ACTIONS} SELECT pair_id, string_agg(action, ' ' ORDER BY step) AS edit_actions FROM script GROUP BY pair_id")
def text_edit_sequences(t):
    return sequences(t).withColumn("edit_actions", F.concat_ws(" ", "edit_actions"))


@query("cluster_action_histogram", f"{_ACTIONS} SELECT pair_id % 5 AS cluster, action, count(*) AS count FROM script GROUP BY ALL")
def cluster_action_histogram(t):
    return E.action_histogram(sequences(t).withColumn("cluster", F.col("pair_id") % 5), "cluster")


@query("cluster_action_pivot", f"{_ACTIONS} SELECT pair_id % 5 AS cluster, {_COUNTS} FROM script GROUP BY ALL")
def cluster_action_pivot(t):
    return ml.action_pivot(sequences(t).withColumn("cluster", F.col("pair_id") % 5), "cluster", _LABELS)


@query("count_embedding", f"""{_ACTIONS}, c AS (SELECT pair_id, {_COUNTS} FROM script GROUP BY pair_id),
v AS (SELECT pair_id, [insert_node, delete_node, update_node, move_tree] AS v FROM c)
SELECT pair_id, round(list_sum(v) / sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[])), 6) AS total,
  round(list_max(v) / sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[])), 6) AS largest FROM v""")
def count_embedding(t):
    out = ml.count_sequences(sequences(t), "pair_id")
    return out.select(
        "pair_id", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
        F.round(F.array_max("vector"), 6).alias("largest"))


@query("word2vec_embedding")
def word2vec_embedding(t):
    return ml.embed_sequences(sequences(t), "pair_id")


@query("kmeans_clusters")
def kmeans_clusters(t):
    return ml.kmeans_clusters(vectors(t).drop("cluster"), 5).select("id", "cluster")


@query("kmeans_facts", "SELECT count(*) AS rows, 5 AS k, 0 AS misplaced FROM embeddings")
def kmeans_facts(t):
    """Every row of a fit lies at its nearest fitted center."""
    v = materialize(vectors(t).drop("cluster"), "vectors")
    model = ml.kmeans_model(v, 5)
    centers = t.spark.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, center array<double>")
    out = V.nearest_centers(model.transform(ml.with_features(v)).drop("features"), centers)
    return out.agg(F.count("*").alias("rows"), F.count_distinct("cluster").cast("int").alias("k"),
                   F.count_if(F.col("cluster") != F.col("nearest")).cast("int").alias("misplaced"))


@query("gaussian_facts", "SELECT count(*) AS rows, true AS within, 0 AS misplaced FROM embeddings")
def gaussian_facts(t):
    """Shares of the components add up to one and the label has the largest."""
    out = ml.gaussian_shares(vectors(t).drop("cluster"), 3)
    total = F.aggregate("shares", F.lit(0.0), lambda a, x: a + x)
    best = F.get("shares", F.col("cluster"))
    return out.agg(F.count("*").alias("rows"), F.bool_and(F.abs(total - 1) < 1e-6).alias("within"),
                   F.count_if(best < F.array_max("shares")).cast("int").alias("misplaced"))


@query("gaussian_clusters")
def gaussian_clusters(t):
    return ml.gaussian_clusters(vectors(t).drop("cluster"), 3).select("id", "cluster")


@query("paragraph_vectors", f"{_ACTIONS} SELECT DISTINCT pair_id, pair_id % 10 <> 0 AS fitted, 50 AS n, true AS directed FROM script")
def paragraph_vectors(t):
    """Vectors of all pairs from a model that saw nine tenths of them."""
    rows = materialize(sequences(t), "sequences")
    model, _ = paragraphs.fit(rows.filter("pair_id % 10 <> 0"), "pair_id")
    fitted = (F.col("pair_id") % 10 != 0).alias("fitted")
    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    return model.infer(rows, "pair_id").select(
        "pair_id", fitted, F.size("vector").alias("n"), ((length > 0) & (length < 1e6)).alias("directed"))


# Learned scores have no SQL; the cells and their bounds do.
@query("silhouette_grid")
def silhouette_grid(t):
    return ml.grid_silhouettes(materialize(sequences(t), "sequences"), "pair_id")


@query("labeling_silhouettes", f"""{_W}, l AS (SELECT id, cluster AS a, id % 3 AS b FROM vectors),
d AS (SELECT x.id AS i, y.id AS j, list_distance(x.vector, y.vector) AS d FROM vectors x JOIN vectors y ON x.id <> y.id),
u AS (SELECT 'cluster' AS labeling, id, a AS own FROM l UNION ALL SELECT 'third', id, b FROM l),
m AS (SELECT p.labeling, d.i, p.own, q.own AS other, avg(d) AS e, avg(d * d) AS s FROM u p JOIN d ON d.i = p.id JOIN u q ON q.labeling = p.labeling AND q.id = d.j GROUP BY ALL),
r AS (SELECT labeling, i, max(e) FILTER (own = other) AS ae, min(e) FILTER (own <> other) AS be, max(s) FILTER (own = other) AS asq, min(s) FILTER (own <> other) AS bsq FROM m GROUP BY ALL)
SELECT labeling, count(*) AS rows, round(avg(CASE WHEN ae IS NULL THEN 0 ELSE (be - ae) / greatest(ae, be) END), 6) AS silhouette,
  round(avg(CASE WHEN asq IS NULL THEN 0 ELSE (bsq - asq) / greatest(asq, bsq) END), 6) AS squared_silhouette FROM r GROUP BY labeling""")
def labeling_silhouettes(t):
    rows = vectors(t).withColumn("third", F.col("id") % 3)
    out = V.silhouettes_of_labelings(rows, {"cluster": 10, "third": 3})
    return out.withColumns({c: F.round(c, 6) for c in ("silhouette", "squared_silhouette")})


# Signs and ties of components are free; with all of them a row keeps its length.
@query("principal_components", f"""{_W}, e AS (SELECT id, unnest(vector) AS x, unnest(range(len(vector))) AS d FROM vectors),
m AS (SELECT d, avg(x) AS mean FROM e GROUP BY d)
SELECT id, 64 AS n, round(sum((x - mean) * (x - mean)), 4) AS squared_norm FROM e JOIN m USING (d) GROUP BY id""")
def principal_components(t):
    c = "components"
    out = ml.principal_components(vectors(t))
    return out.select("id", F.size(c).alias("n"), F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x), 4).alias("squared_norm"))
