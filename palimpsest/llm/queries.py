"""One registered query per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import (
    crossalign,
    dac,
    decontaminate,
    importance,
    lmscore,
    minhash,
    packing,
    pagediff,
    periodic,
    quality,
    repeats,
    sharding,
    urltree,
)
from palimpsest.llm.common import good_labels, table

SHARDS = 24
RULES = [
    urltree.Rule("net", "/", "block"),
    urltree.Rule("example.net", "/en/", "allow"),
    urltree.Rule("example.com", "/de/", "block"),
    urltree.Rule("org", "/fr/", "allow"),
]


def minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    shards = sharding.kd_shards(docs, SHARDS, ["lang", "source", "n_chars", "doc_id"])
    return sharding.numbered(shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def importance_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, good = table(spark, sf_dir, "documents"), good_labels(table(spark, sf_dir, "labels"))
    model = importance.fit(docs, good)
    edge = importance.target_edge(docs, good, model)
    return importance.weights(docs, model).withColumn("kept", F.col("key") >= F.lit(edge))


def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, good = table(spark, sf_dir, "documents"), good_labels(table(spark, sf_dir, "labels"))
    return lmscore.score(docs, lmscore.fit(docs, good))


def ffd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagediff.main_text(table(spark, sf_dir, "pages"))


def dac_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.through_files(table(spark, sf_dir, "documents"))


def url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.filter_urls(table(spark, sf_dir, "pages"), RULES)


def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, good = table(spark, sf_dir, "documents"), good_labels(table(spark, sf_dir, "labels"))
    return quality.judge(docs, quality.fit(docs, good))


def byte_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"))


def cross_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossalign.align(table(spark, sf_dir, "documents"))


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(table(spark, sf_dir, "documents"), plant=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": minhash_dedup,
    "op2_kd_sharding": kd_sharding,
    "op3_importance_classifier": importance_classifier,
    "op4_lm_scores": lm_scores,
    "op5_ffd_packing": ffd_packing,
    "op6_page_text": page_text,
    "op7_dac_tokens": dac_tokens,
    "op8_url_templates": url_templates,
    "op9_benchmark_leaks": benchmark_leaks,
    "op10_quality_rules": quality_rules,
    "op11_byte_repeats": byte_repeats,
    "op12_cross_alignment": cross_alignment,
    "op13_periodic_runs": periodic_runs,
}

# Hashed models, alignments, tokenizers and clusterings have no SQL; they are
# tested against brute force in tests/llm.
SQL: dict[str, str] = {}
