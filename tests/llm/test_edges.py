"""Edges of op3 and op10 come from all held-out documents, however many labels."""

import numpy as np
import pytest
from palimpsest import session
from palimpsest.llm import importance, ngrams, quality
from pyspark.sql import functions as F


@pytest.mark.parametrize("n", [1, 2, 7, 3000])
def test_the_quantile_is_exact(spark, n):
    values = np.random.default_rng(n).normal(size=n)
    values[: n // 3] = values[0]
    keys = spark.createDataFrame([(float(v),) for v in values], "key double")
    for share in (0.0, 0.002, 0.3, 0.5, 1.0):
        assert importance.lower_quantile(keys, share) == np.quantile(values, share, method="lower")
    assert importance.lower_quantile(keys.limit(0), 0.5) == float("-inf")


def test_all_labels_count_when_they_fit_no_broadcast(spark, monkeypatch):
    words = F.concat_ws(" ", *[F.concat(F.lit("w"), ((F.col("id") * k) % 31).cast("string")) for k in range(1, 61)])
    docs = spark.range(400).select(F.col("id").alias("doc_id"), words.alias("text"))
    good = docs.select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("good"))
    held = ngrams.flagged(docs, ngrams.parts(good)).filter(F.col("good") == ngrams.HELD)
    found = []
    for limit in (session.BROADCAST_ROWS, 20):
        monkeypatch.setattr(session, "BROADCAST_ROWS", limit)
        model, rules = importance.fit(docs, good), quality.fit(docs, good)
        keys = importance.weights(held, model).toPandas()["key"]
        edge = importance.target_edge(docs, good, model)
        assert edge == np.quantile(keys, model.settings.tail, method="lower") and len(keys) > 40
        scores = quality.judge(held, rules).filter("n_words >= 50").toPandas()["ratio"]
        lowest = np.quantile(scores, rules.rules.tail, method="lower")
        assert rules.threshold == pytest.approx(lowest - rules.rules.margin, abs=1e-12)
        found.append((edge, rules.threshold))
    assert found[0] == pytest.approx(found[1], abs=1e-12)
    assert not hasattr(importance.Settings(), "sample") and not hasattr(quality.Rules(), "sample")
