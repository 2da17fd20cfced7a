"""Token counts, vocabularies, and dictionary lookups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.rows import element_rows
from palimpsest.functions.text import UNK
from palimpsest.operators.ordering import with_index
from palimpsest.session import (
    BROADCAST_ROWS, counted_dictionary_join, dictionary_join, fits_broadcast, materialize,
)

# The corpus guide recommends a vocabulary of at most 1000 tokens.
RECOMMENDED_VOCAB_SIZE = 1000

# Specials follow the vocabulary: UNK, SEQUENCE_START, SEQUENCE_END.
SPECIALS = ("UNK", "SEQUENCE_START", "SEQUENCE_END")


def token_rows(df: DataFrame, tokens: Column | str, *keep: str) -> DataFrame:
    """One row per token with its position."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    return element_rows(df, tokens, "token", *keep, pos="pos")


def token_counts(
    df: DataFrame, tokens: Column | str, min_frequency: int = 0
) -> DataFrame:
    """``(token, count)``; a positive threshold keeps strictly greater counts."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    counts = element_rows(df, tokens, "token").groupBy("token").count()
    return counts.filter(F.col("count") > min_frequency) if min_frequency > 0 else counts


def build_vocab(
    df: DataFrame,
    tokens: Column | str,
    *,
    max_size: int | None = RECOMMENDED_VOCAB_SIZE,
    min_frequency: int = 0,
) -> DataFrame:
    """``(id, token, count)``, ids by count then token, both descending.

    A bounded vocabulary is a distributed top-k numbered after the cut; an
    unbounded one is numbered by range partitions.
    """
    counts = token_counts(df, tokens, min_frequency)
    order = [F.desc("count"), F.desc("token")]
    if max_size is not None and max_size <= BROADCAST_ROWS:
        top = counts.orderBy(*order).limit(max_size)
        numbered = top.withColumn("id", F.row_number().over(Window.orderBy(*order)) - 1)
    else:
        numbered = with_index(counts, order, "id")
        if max_size is not None:
            numbered = numbered.filter(F.col("id") < max_size)
    return numbered.select(F.col("id").cast("long"), "token", "count")


def special_tokens(vocab: DataFrame) -> DataFrame:
    """The special markers with the ids that follow the vocabulary."""
    size = vocab.agg(F.count("*").alias("n"))
    return size.select(
        F.posexplode(F.array(*[F.lit(s) for s in SPECIALS])).alias("k", "token"), "n"
    ).select((F.col("n") + F.col("k")).cast("long").alias("id"), "token")


def _look_up(
    rows: DataFrame, vocab: DataFrame, keys: list[str], value: Column, rows_at_most: int | None
) -> DataFrame:
    """Rows with ``value`` of their vocabulary entry, null without one. Where
    the vocabulary has counts, they tell which tokens are too frequent to be
    shuffled."""
    if "count" not in vocab.columns:
        return dictionary_join(rows, vocab.select(*keys, value), keys, rows_at_most=rows_at_most)
    weighted = vocab.select(*keys, value, F.col("count").alias("_weight"))
    return counted_dictionary_join(rows, weighted, keys, "_weight", rows_at_most)


def lookup_ids(
    rows: DataFrame, vocab: DataFrame, unk_id: int, rows_at_most: int | None = None
) -> DataFrame:
    """Add ``token_id``; a token outside the vocabulary gets ``unk_id``."""
    joined = _look_up(rows, vocab, ["token"], F.col("id").alias("_id"), rows_at_most)
    return joined.withColumn("token_id", F.coalesce("_id", F.lit(unk_id))).drop("_id")


def lookup_tokens(
    rows: DataFrame, vocab: DataFrame, rows_at_most: int | None = None
) -> DataFrame:
    """Add ``token`` for ``token_id``; ids outside the vocabulary give UNK."""
    names = vocab.withColumn("token_id", F.col("id"))
    joined = _look_up(rows, names, ["token_id"], F.col("token").alias("_token"), rows_at_most)
    return joined.withColumn("token", F.coalesce("_token", F.lit(UNK))).drop("_token")


def lookup_counts(
    rows: DataFrame, vocab: DataFrame, rows_at_most: int | None = None
) -> DataFrame:
    """Add ``token_count``; -1 outside the vocabulary."""
    joined = _look_up(rows, vocab, ["token"], F.col("count").alias("_count"), rows_at_most)
    return joined.withColumn("token_count", F.coalesce("_count", F.lit(-1))).drop("_count")


def _encoded(rows: DataFrame, known: pa.Table, unk_id: int) -> DataFrame:
    """Ids of ``_tokens`` by hashed lookup in a dictionary of checked size."""
    sent = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value.column("token").combine_chunks()
        ids = sent.value.column("id").combine_chunks()
        for batch in batches:
            lists = batch.column("_tokens")
            flat = lists.flatten().cast(words.type)
            found = pc.fill_null(ids.take(pc.index_in(flat, value_set=words)), unk_id)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ends = pa.array([0, *lengths.cumsum().tolist()], pa.int32())
            out = pa.ListArray.from_arrays(ends, found)
            yield pa.RecordBatch.from_arrays([batch.column("_key"), out], ["_key", "ids"])

    key_type = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(run, f"_key {key_type}, ids array<bigint>")


def encode(
    df: DataFrame,
    key: str,
    tokens: str,
    vocab: DataFrame,
    unk_id: int | None = None,
    rows_at_most: int | None = None,
) -> DataFrame:
    """``(key, ids)``: each row's token array as ids, order kept.

    Rows without tokens, null among them, have empty ids; keys may repeat.
    Without ``unk_id`` it is the size of the vocabulary, the first id after it.
    A vocabulary of checked size is sent to every task and no token is shuffled.
    Beyond that (row, position, id) rows are regrouped; each group came out of
    one input row, so its size is bounded by that row.
    """
    if unk_id is None:
        unk_id = vocab.count()
    rows = df.select(F.col(key).alias("_key"), F.col(tokens).alias("_tokens"))
    if fits_broadcast(vocab, rows_at_most):
        known = vocab.select("token", F.col("id").cast("long").alias("id")).toArrow()
        return _encoded(rows, known, unk_id).withColumnRenamed("_key", key)
    none = F.array().cast("array<bigint>")
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = lookup_ids(token_rows(rows, "_tokens", "_row"), vocab, unk_id)
    grouped = found.groupBy("_row").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", F.col("token_id").cast("long").alias("token_id")))),
            lambda x: x["token_id"],
        ).alias("ids")
    )
    return rows.drop("_tokens").join(grouped, "_row", "left").select(
        F.col("_key").alias(key), F.coalesce("ids", none).alias("ids")
    )
