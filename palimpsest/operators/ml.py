"""Embeddings of action sequences, clustering, model grid and projection,
with Spark ML."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, CountVectorizer, Normalizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import paragraphs, wordvectors
from palimpsest.operators.vectors import dot, silhouettes_of_labelings
from palimpsest.session import fits_broadcast, materialize

# Fixed values of the study.
SEED = 96
VECTOR_SIZE = 50
STEP_SIZE = 0.025
GRID_SIZES = (5, 10, 20, 40, 50)
GRID_CLUSTERS = (2, 3, 4, 5, 6, 7)
GRID_EPOCHS = 40


def embed_sequences(
    sequences: DataFrame, key: str, actions: str = "edit_actions", *, vector_size: int = VECTOR_SIZE,
    min_count: int = 1, epochs: int = 20, seed: int = SEED,
) -> DataFrame:
    """``(key, vector)``: the mean of learned action vectors."""
    sequences = materialize(sequences.select(key, actions), "sequences")
    model = wordvectors.fit(
        sequences, key, actions, vector_size=vector_size, min_count=min_count, epochs=epochs, rate=STEP_SIZE, seed=seed)
    return model.transform(sequences, key, actions)


def count_sequences(sequences: DataFrame, key: str, actions: str = "edit_actions") -> DataFrame:
    """``(key, vector)``: action counts scaled to unit length; repeatable."""
    sequences = materialize(sequences.select(key, actions), "sequences")
    counted = CountVectorizer(inputCol=actions, outputCol="_c").fit(sequences).transform(sequences)
    unit = Normalizer(inputCol="_c", outputCol="_v").transform(counted)
    return unit.select(key, vector_to_array("_v").alias("vector"))


def with_features(df: DataFrame, vector: str = "vector") -> DataFrame:
    return df.withColumn("features", array_to_vector(vector))


def kmeans_model(df: DataFrame, k: int, seed: int = SEED):
    return KMeans(k=k, seed=seed, predictionCol="cluster").fit(with_features(df))


def kmeans_clusters(df: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """Add ``cluster``."""
    return kmeans_model(df, k, seed).transform(with_features(df)).drop("features")


def gaussian_clusters(df: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """Add ``cluster`` from a full-covariance mixture."""
    features = with_features(df)
    model = GaussianMixture(k=k, seed=seed, predictionCol="cluster").fit(features)
    return model.transform(features).drop("features", "probability")


def gaussian_shares(df: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """Add ``cluster`` and ``shares``, the row's share of each component."""
    features = with_features(df)
    model = GaussianMixture(k=k, seed=seed, predictionCol="cluster").fit(features)
    shares = vector_to_array("probability")
    return model.transform(features).withColumn("shares", shares).drop("features", "probability")


def squared_silhouette_row(df: DataFrame, cluster: str = "cluster", vector: str = "vector") -> DataFrame:
    """``silhouette``: the mean one with squared distances, one row, in linear
    work. The squared distances of a row to a cluster follow from the cluster's
    size, vector sum and sum of squared lengths."""
    row = df.select(F.col(cluster).alias("own"), F.col(vector).alias("v"), dot(vector, vector).alias("s"))
    sums = row.select("own", "s", F.posexplode("v").alias("i", "x")).groupBy("own", "i").agg(F.sum("x").alias("x"))
    sums = sums.groupBy("own").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("u")
    )
    sizes = row.groupBy("own").agg(F.count("*").alias("n"), F.sum("s").alias("q"))
    clusters = materialize(sizes.join(sums, "own"), "clusters")
    if not fits_broadcast(clusters):
        raise ValueError("too many clusters")
    every = clusters.agg(F.collect_list(F.struct("own", "n", "q", "u")).alias("c"))

    def mean(c: Column, others: bool) -> Column:
        total = c["n"] * F.col("s") - 2 * dot("v", c["u"]) + c["q"]
        return total / (c["n"] if others else F.greatest(c["n"] - 1, F.lit(1)))

    # One row of bounded size beside every row.
    rows = row.join(F.broadcast(every))
    mine = F.get(F.filter("c", lambda c: c["own"] == F.col("own")), F.lit(0))
    least = F.array_min(F.transform(F.filter("c", lambda c: c["own"] != F.col("own")), lambda c: mean(c, True)))
    rows = rows.select(mean(mine, False).alias("a"), least.alias("b"), mine["n"].alias("n"))
    most = F.greatest("a", "b")
    value = F.when((F.col("n") == 1) | (most == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.when(most > 0, most))
    return rows.agg(F.avg(value).alias("silhouette"))


def squared_silhouette(df: DataFrame, cluster: str = "cluster") -> float:
    """Silhouette with squared distances: linear work, another number than the
    Euclidean one."""
    evaluator = ClusteringEvaluator(predictionCol="_p", featuresCol="features")
    return evaluator.evaluate(with_features(df).withColumn("_p", F.col(cluster).cast("int")))


def grid_silhouettes(
    sequences: DataFrame, key: str, sizes: Iterable[int] = GRID_SIZES,
    clusters: Iterable[int] = GRID_CLUSTERS, epochs: int = GRID_EPOCHS, seed: int = SEED,
) -> DataFrame:
    """``(vector_size, k, silhouette, squared_silhouette)`` over the grid.

    Paragraph vectors are learned once per size; all numbers of clusters are
    fitted on them and scored in one pass over the distances. Every fit is a
    distributed job; what comes back is one row per cell.
    """
    clusters, cells = sorted(set(clusters)), []
    for size in sizes:
        settings = paragraphs.Settings(vector_size=size, epochs=epochs, seed=seed)
        _, vectors = paragraphs.fit(sequences, key, settings=settings)
        labelled = with_features(vectors)
        for k in clusters:
            model = KMeans(k=k, seed=seed, predictionCol=f"k{k}").fit(with_features(vectors))
            labelled = model.transform(labelled)
        labelled = materialize(labelled.drop("features"), "labelled")
        scores = silhouettes_of_labelings(labelled, {f"k{k}": k for k in clusters}, key)
        cells += [
            (int(size), int(r["labeling"][1:]), r["silhouette"], r["squared_silhouette"])
            for r in scores.collect()
        ]
    return sequences.sparkSession.createDataFrame(
        cells, "vector_size int, k int, silhouette double, squared_silhouette double"
    )


def principal_components(df: DataFrame, k: int | None = None, vector: str = "vector") -> DataFrame:
    """Add ``components``: the first k principal components of centred vectors,
    all of them without ``k``. A table without rows has none."""
    k = k or df.agg(F.max(F.size(vector))).first()[0]
    if not k:
        return df.withColumn("components", F.array().cast("array<double>"))
    features = with_features(df, vector)
    centred = (
        StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="_m")
        .fit(features)
        .transform(features)
    )
    out = PCA(k=k, inputCol="_m", outputCol="_p").fit(centred).transform(centred)
    return out.withColumn("components", vector_to_array("_p")).drop("features", "_m", "_p")


def cluster_sizes(labels: DataFrame, cluster: str = "cluster") -> DataFrame:
    return labels.groupBy(cluster).agg(F.count("*").alias("n"))


def cluster_members(labels: DataFrame, key: str, cluster: str = "cluster") -> DataFrame:
    """Members as rows with their size; a cluster's list may not fit one row."""
    from palimpsest.session import dictionary_join

    return dictionary_join(
        labels.select(cluster, key), cluster_sizes(labels, cluster), [cluster], "inner"
    )


def attach(entries: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Vectors or labels joined to their entries by id."""
    return entries.join(labels, key)


def action_pivot(sequences: DataFrame, cluster: str, labels: Iterable[str]) -> DataFrame:
    """One row per cluster with a count column per action label."""
    rows = sequences.select(cluster, F.explode("edit_actions").alias("action"))
    return rows.groupBy(cluster).agg(
        *[F.count_if(F.col("action") == a).alias(a.replace("-", "_")) for a in labels]
    )
