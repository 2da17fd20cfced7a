"""Benchmark decontamination by SimHash of item-sized windows.

DataFrame functions only. Every benchmark item is a bag of word shingles
(weights: occurrences) and a 64-bit SimHash of them. In the documents, every
shingle that also occurs in an item places a window of the item's size; a
window that shares no shingle with an item cannot be similar to it, so nothing
is lost. The window's fingerprint is looked up in a multi-index of the items:
8 blocks of 8 bits, each stored with all values within 2 bits. If two
fingerprints differ in at most ``radius`` = 23 bits, some block differs in at
most 2 (pigeonhole), so every fingerprint within the radius is found. Found
pairs are verified exactly: the weight of the item's shingles that the window
holds, as a share of the item's weight, must reach ``similarity``.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.session import BROADCAST_ROWS, materialize

_BLOCKS, _BLOCK_BITS = 8, 8
_LANES = 0x0000000100000001  # two counters of 32 bits in a long


@dataclass(frozen=True)
class Settings:
    words: int = 5
    similarity: float = 0.8
    radius: int = 23


def _words(text: Column) -> Column:
    whole = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    return F.regexp_extract_all(whole, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shingles(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words; empty if there are fewer."""

    def runs(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        return _let(
            hashes,
            lambda h: F.when(F.size(h) < size, F.array().cast("array<long>")).otherwise(
                F.transform(
                    F.sequence(F.lit(0), F.size(h) - size),
                    lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(size)]),
                )
            ),
        )

    return _let(words, runs)


def _simhash(shingles: Column) -> Column:
    """Bit b is set if more than half of the shingle hashes have it.

    Counters of 32 bits, two in a long: 32 sums give all 64 bits.
    """
    half = F.size(shingles) / 2

    def sums(shift: int) -> Column:
        return F.aggregate(
            shingles,
            F.lit(0).cast("long"),
            lambda acc, h: acc + F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(_LANES)),
        )

    def bits(shift: int):
        def of(counts: Column) -> Column:
            low = F.when(counts.bitwiseAND(F.lit(0xFFFFFFFF)) > half, F.lit(_signed(1 << shift)))
            high = F.when(
                F.shiftrightunsigned(counts, 32) > half, F.lit(_signed(1 << (32 + shift)))
            )
            none = F.lit(0).cast("long")
            return F.coalesce(low, none).bitwiseOR(F.coalesce(high, none))

        return of

    out = F.lit(0).cast("long")
    for shift in range(32):
        out = out.bitwiseOR(_let(sums(shift), bits(shift)))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _block(fingerprint: Column, number: Column) -> Column:
    moved = F.call_function("shiftrightunsigned", fingerprint, (number * _BLOCK_BITS).cast("int"))
    return moved.bitwiseAND(F.lit((1 << _BLOCK_BITS) - 1)).cast("int")


def _small(df: DataFrame) -> DataFrame:
    """A broadcast hint if the rows (counted, stopping past the limit) are few."""
    few = df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(df) if few else df


def _items(benchmark: DataFrame, settings: Settings) -> DataFrame:
    """``item_id, n, size, grams``: words, shingle size and shingles of every
    item with words. Equal texts are an item each."""
    counted = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), _words(F.col("text")).alias("words")
    ).filter(F.size("words") > 0)
    counted = materialize(counted, "items")
    n = F.size("words")
    grams = F.when(n >= settings.words, _shingles(F.col("words"), settings.words))
    for size in range(1, settings.words):
        grams = grams.when(n == size, _shingles(F.col("words"), size))
    return materialize(
        counted.select(
            "item_id", n.alias("n"), F.least(n, F.lit(settings.words)).alias("size"), grams.alias("grams")
        ).withColumn("item", F.monotonically_increasing_id()),
        "items",
    )


def leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``key1, key2, item_id, start, similarity``: for each text (named by two
    hashes, see ``with_text_keys``) and item the best window, by its first
    word. Texts or items without words, null among them, match nothing; an
    item of fewer than five words is one shingle, its whole."""
    settings = settings or Settings()
    spark = docs.sparkSession
    items = _items(benchmark, settings)
    sizes = [r["size"] for r in items.select("size").distinct().collect()]  # five at most
    texts = with_text_keys(docs.select(F.col("text").cast("string").alias("text"))).select(
        F.col("text"), "key1", "key2"
    )
    gram_index = items.select("item", "n", "size", F.posexplode("grams").alias("at", "gram"))
    first = gram_index.groupBy("item", "n", "size", "gram").agg(
        F.min("at").alias("at"), F.count("*").alias("weight")
    )
    first = materialize(first, "grams")
    placed = None
    for size in sizes:
        grams = texts.select(
            "key1", "key2", F.posexplode(_shingles(_words(F.col("text")), size)).alias("pos", "gram")
        )
        found = grams.join(_small(first.filter(F.col("size") == size)), "gram").select(
            "key1", "key2", "item", "n", "size", (F.col("pos") - F.col("at")).alias("start")
        )
        placed = found if placed is None else placed.union(found)
    if placed is None:
        return spark.createDataFrame(
            [], "key1 long, key2 long, item_id long, start int, similarity double"
        )
    placed = materialize(placed.distinct(), "windows")
    hit = placed.select("key1", "key2").distinct()
    # One row of each text that has a window, with its words.
    bodies = (
        texts.join(hit, ["key1", "key2"], "left_semi")
        .groupBy("key1", "key2")
        .agg(F.first("text").alias("text"))
        .withColumn("words", _words(F.col("text")))
        .drop("text")
    )
    window = F.slice(
        F.col("words"), F.greatest(F.col("start"), F.lit(0)) + 1, F.col("n") + F.least(F.col("start"), F.lit(0))
    )
    # A window that would begin before the text keeps its end.
    cut = bodies.join(placed, ["key1", "key2"]).select(
        "key1", "key2", "item", "n", "size", "start", window.alias("words")
    )
    grams = F.lit(None).cast("array<long>")
    for size in sizes:
        grams = F.when(F.col("size") == size, _shingles(F.col("words"), size)).otherwise(grams)
    windows = materialize(
        cut.select("key1", "key2", "item", "start", grams.alias("grams"))
        .filter(F.size("grams") > 0)
        .withColumn("window", F.monotonically_increasing_id()),
        "windows",
    )
    prints = windows.select("window", "item", _simhash(F.col("grams")).alias("print"))
    blocks = F.explode(F.sequence(F.lit(0), F.lit(_BLOCKS - 1)))
    probes = (
        prints.withColumn("block", blocks)
        .withColumn("value", _block(F.col("print"), F.col("block")))
    )
    near = F.array(*[F.lit(m) for m in _masks(settings.radius // _BLOCKS)])
    index = (
        items.select("item", _simhash(F.col("grams")).alias("item_print"))
        .withColumn("block", blocks)
        .withColumn("mask", F.explode(near))
        .select(
            "item", "item_print", "block",
            _block(F.col("item_print"), F.col("block")).bitwiseXOR(F.col("mask")).alias("value"),
        )
    )
    index = materialize(index, "index")
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    candidates = (
        probes.join(_small(index), ["item", "block", "value"])
        .filter(distance <= settings.radius)
        .select("window", "item")
        .distinct()
    )
    held = (
        windows.join(candidates.select("window"), "window", "left_semi")
        .select("window", "item", F.explode("grams").alias("gram"))
        .groupBy("window", "item", "gram")
        .agg(F.count("*").alias("held"))
        .join(_small(first.select("item", "gram", "weight")), ["item", "gram"])
        .groupBy("window", "item")
        .agg(F.sum(F.least("held", "weight")).alias("common"))
    )
    whole = items.select("item", "item_id", F.size("grams").alias("whole"))
    verified = (
        held.join(_small(whole), "item")
        .withColumn("similarity", F.col("common") / F.col("whole"))
        .filter(F.col("similarity") >= settings.similarity)
        .select("window", "item_id", "similarity")
    )
    best = F.struct("similarity", -F.greatest("start", F.lit(0)))
    return (
        windows.select("window", "key1", "key2", "start")
        .join(verified, "window")
        .groupBy("key1", "key2", "item_id")
        .agg(F.max(best).alias("best"))
        .select(
            "key1", "key2", "item_id", (-F.col("best")["col2"]).alias("start"),
            F.col("best")["similarity"].alias("similarity"),
        )
    )


def _masks(most: int) -> list[int]:
    """Bit patterns of a block with at most ``most`` ones."""
    return [
        sum(1 << b for b in bits)
        for k in range(most + 1)
        for bits in combinations(range(_BLOCK_BITS), k)
    ]


def with_text_keys(docs: DataFrame) -> DataFrame:
    """Adds ``key1, key2``: two 64-bit hashes that name a row's text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("key1", F.xxhash64(text)).withColumn(
        "key2", F.xxhash64(F.lit("second"), text)
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``doc_id, item_id, start, similarity``: a row for each row of ``docs``
    and each item found in it. Rows of equal text match alike; ids are carried
    as they are, null or repeated."""
    found = materialize(leaks(docs, benchmark, settings), "leaks")
    named = with_text_keys(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ).drop("text")
    return named.join(found, ["key1", "key2"]).select("doc_id", "item_id", "start", "similarity")


def decontaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    found = materialize(leaks(docs, benchmark, settings).select("key1", "key2").distinct(), "leaks")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    keyed = with_text_keys(whole.select("_doc", F.col("_doc.text").alias("text")))
    return keyed.join(found, ["key1", "key2"], "left_anti").select("_doc.*")
