"""Incremental forms: pairing arrivals, resuming, running metrics, samples.

State is bounded by watermarks. A drained stream leaves a table in the shared
folder; offsets and state live there too, so a restart goes on where it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.metric import TextMetric
from palimpsest.operators.report import sample_every
from palimpsest.session import scratch_path


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A stream over the parquet files at ``path`` (a file, folder or glob)."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    head, _, name = path.rpartition("/")
    # A plain file name is not accepted as a stream path; a pattern is.
    return reader.parquet(path if any(c in path for c in "*[{") else f"{head}/[{name[0]}]{name[1:]}")


def drain(
    stream: DataFrame, mode: str = "append", keys: list[str] | None = None,
    path: str | None = None, offsets: str | None = None,
) -> DataFrame:
    """Process what is there and return the resulting table.

    ``append`` goes to the exactly-once file sink. ``update`` and ``complete``
    write each batch to its own folder (a repeated batch overwrites itself);
    the result is the latest row per key, or the last batch.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, "stream")
    writer = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", offsets or scratch_path(spark, "offsets"))
        .trigger(availableNow=True)
    )
    if mode == "append":
        writer.format("parquet").option("path", path).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer.foreachBatch(save).start().awaitTermination()
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("batch"))
        return rows.join(F.broadcast(last), "batch", "left_semi").drop("batch")
    rest = [c for c in stream.columns if c not in (keys or [])]
    latest = rows.groupBy(*(keys or [])).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return latest.select(*(keys or []), "_r.*")


def pair_arrivals(
    before: DataFrame, after: DataFrame, key: str, time: str, within: str
) -> DataFrame:
    """Join the two answers of a change that arrive at most ``within`` apart;
    an answer whose partner never comes leaves the state after that time."""
    b = before.select(
        F.col(key), F.col(time).alias("before_time"), *[F.col(c).alias(f"before_{c}") for c in before.columns if c not in (key, time)]
    ).withWatermark("before_time", within)
    a = after.select(
        F.col(key).alias("_key"), F.col(time).alias("after_time"), *[F.col(c).alias(f"after_{c}") for c in after.columns if c not in (key, time)]
    ).withWatermark("after_time", within)
    gap = F.expr(
        f"after_time BETWEEN before_time - INTERVAL {within} AND before_time + INTERVAL {within}"
    )
    return b.join(a, (F.col(key) == F.col("_key")) & gap).drop("_key")


def resume(stream: DataFrame, done: DataFrame, keys: list[str], time: str, within: str) -> DataFrame:
    """New rows only: repeats within the watermark and rows already in the
    stored table are left out."""
    fresh = stream.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)
    return fresh.join(done.select(*keys).distinct(), keys, "left_anti")


def running_mean(stream: DataFrame, value: str, time: str, window: str, within: str, *by: str) -> DataFrame:
    """Sum, count and mean per event-time window, updated as rows arrive."""
    return (
        stream.withWatermark(time, within)
        .groupBy(F.window(time, window).alias("w"), *by)
        .agg(F.sum(value).alias("total"), F.count("*").alias("n"), F.avg(value).alias("mean"))
        .select(F.col("w.start").alias("start"), *by, "total", "n", "mean")
    )


def running_metric(stream: DataFrame, metric: TextMetric, hyp: str, ref: str) -> DataFrame:
    """A text metric over everything seen so far (complete mode)."""
    return metric.corpus(stream, hyp, ref)


def token_counter(stream: DataFrame, source_len: str, target_len: str) -> DataFrame:
    """Tokens processed so far (complete mode)."""
    return stream.groupBy().agg(
        F.sum(F.col(source_len) + F.col(target_len)).alias("num_tokens")
    )


def sample_stream(
    stream: DataFrame, step: str, every: int, path: str | None = None, offsets: str | None = None,
    seconds: int | None = None,
) -> DataFrame:
    """Save the sampled rows of each batch in its own folder and return them.
    ``seconds`` samples on a clock and runs until stopped; else the stream is
    drained once."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, "samples")

    def save(batch: DataFrame, number: int) -> None:
        sample_every(batch, step, every).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.option(
        "checkpointLocation", offsets or scratch_path(spark, "offsets")
    ).foreachBatch(save)
    if seconds is not None:
        return writer.trigger(processingTime=f"{seconds} seconds").start()
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")
