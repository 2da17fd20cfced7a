"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores.
Each query runs in full into a sink that discards its rows. ``control`` is a job
that uses none of this library, so that a slower machine can be told from slower
code; ``ratios`` compare each query with the tables of a tenth of the size, where
those lie beside the given ones.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from palimpsest.plans import all_queries
from palimpsest.session import local_session

HEADLINE = [
    "vocabulary",
    "vocabulary_unbounded",
    "token_to_id",
    "encode_documents",
    "bucketed_batches",
    "corpus_bleu",
    "running_bleu",
    "rouge_report",
    "greedy_classification",
    "beam_classification",
    "mined_commits",
    "file_changes",
    "pending_changes",
    "attached_contents",
    "function_table",
    "change_entries",
    "top_idioms",
    "numbered_placeholders",
    "bag_edits",
    "positional_edits",
    "beam_paths",
    "beam_step",
    "unknown_replaced",
    "silhouette",
    "pagerank",
    "stream_running_mean",
]


def control(spark) -> float:
    """Seconds of a fixed job: hash, group and sort generated numbers."""
    start = time.perf_counter()
    rows = spark.range(10_000_000).selectExpr("xxhash64(id) % 1000003 AS k", "id")
    rows.groupBy("k").count().orderBy("count", "k").write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def run(spark, query, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    names = sys.argv[1:] or HEADLINE
    # One run of a Python-backed query starts the workers and the JVM warms up.
    queries["unreadable_files"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    control(spark)
    machine = control(spark)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    smaller = f"{os.path.dirname(sf_dir.rstrip('/'))}/sf{float(sf) / 10:g}" if sf.replace(".", "").isdigit() else ""
    seconds, ratios = {}, {}
    for name in names:
        small = run(spark, queries[name], smaller) if smaller and os.path.isdir(smaller) else None
        seconds[name] = run(spark, queries[name], sf_dir)
        if small:
            ratios[name] = round(seconds[name] / small, 2)
        print(name, seconds[name], ratios.get(name), file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf,
                "control": machine,
                "ratios": ratios,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
