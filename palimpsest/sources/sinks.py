"""Writers, and the readers that check what they wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import ALIGNER_SEPARATOR, WHITE
from palimpsest.operators.ordering import with_group_index, with_index, with_running_sums
from palimpsest.session import dictionary_join, fits_broadcast, materialize
from palimpsest.sources.lines import read_lines
from palimpsest.sources.records import CHANGE_ENTRIES

# Fixed value: lines per chunk.
CHUNK_LINES = 100_000


def write_chunks(
    df: DataFrame, path: str, order: list[Column], lines: int = CHUNK_LINES, width: int = 2
) -> None:
    """JSON Lines in folders ``chunk=00``, ``chunk=01``, ..., one gzip file of
    at most ``lines`` rows each, numbered in the given order."""
    numbered = with_index(df, order, "_idx")
    chunk = F.lpad(F.floor(F.col("_idx") / lines).cast("string"), width, "0")
    body = F.to_json(F.struct(*df.columns))
    # Numbers of more digits than the padding keep all of them.
    wide = F.when(F.col("_idx") >= lines * 10**width, F.floor(F.col("_idx") / lines).cast("string"))
    (
        numbered.select(F.coalesce(wide, chunk).alias("chunk"), "_idx", body.alias("value"))
        .repartition("chunk")
        .sortWithinPartitions("chunk", "_idx")
        .select("chunk", "value")
        .write.partitionBy("chunk")
        .option("compression", "gzip")
        .text(path)
    )


def write_text(df: DataFrame, column: str, path: str, order: list[Column]) -> None:
    """One line per row; files in path order keep the row order."""
    df.orderBy(*order).select(F.col(column).alias("value")).write.text(path)


def write_entries(entries: DataFrame, path: str) -> None:
    """``data`` (JSON Lines), ``before`` and ``after`` (text), aligned by line.

    The entries are frozen first: a range sort reads its input twice, and these
    are parsed while they are read.
    """
    rows = with_index(materialize(entries, "entries"), [F.col("name")], "_idx")
    write_text(
        rows.withColumn("_json", F.to_json(F.struct(*entries.columns))), "_json", f"{path}/data", [F.col("_idx")]
    )
    write_text(rows, "before_code_normalized", f"{path}/before", [F.col("_idx")])
    write_text(rows, "after_code_normalized", f"{path}/after", [F.col("_idx")])


def merge_report(data: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row counting what is wrong between aligned chunks.

    ``data``: chunk, line, before_code_normalized, after_code_normalized;
    ``before`` and ``after``: chunk, line, value.
    """
    keys = ["chunk", "line"]
    b = before.select(*keys, F.col("value").alias("_b"), F.lit(True).alias("_hb"))
    a = after.select(*keys, F.col("value").alias("_a"), F.lit(True).alias("_ha"))
    joined = data.withColumn("_hd", F.lit(True)).join(b, keys, "full").join(a, keys, "full")

    def differs(text: str, line: str) -> Column:
        return F.rtrim(text, F.lit(WHITE)) != F.rtrim(line, F.lit(WHITE))

    return joined.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("_hd").isNull() | F.col("_hb").isNull() | F.col("_ha").isNull()).alias("unaligned"),
        F.count_if(differs("before_code_normalized", "_b")).alias("before_differs"),
        F.count_if(differs("after_code_normalized", "_a")).alias("after_differs"),
    )


def merge_chunks(data: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """All chunks in numeric order with a global ``idx``; misaligned chunks are
    an error.

    Where the lines of every chunk are 0.. without gaps, a line's ``idx`` is its
    number behind the chunks before it and no text is sorted.
    """
    report = merge_report(data, before, after).first()
    wrong = {k: report[k] for k in ("unaligned", "before_differs", "after_differs") if report[k]}
    if wrong:
        raise ValueError(f"chunks do not agree: {wrong}")
    lines = data.groupBy("chunk", "line").agg(F.count(F.lit(1)).alias("n"))
    sizes = lines.groupBy("chunk").agg(F.sum("n").alias("n"), F.min("line").alias("low"), F.max("line").alias("high"), F.max("n").alias("most"))
    sizes = materialize(sizes, "sizes")
    whole = F.coalesce((F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("most") == 1) & F.col("chunk").isNotNull(), F.lit(False))
    if sizes.filter(~whole).limit(1).count():
        return with_index(data, [F.col("chunk"), F.col("line")], "idx")
    starts = with_running_sums(sizes.select("chunk", "n"), [F.col("chunk")], {"_end": "n"})
    starts = starts.select("chunk", (F.col("_end") - F.col("n")).alias("_start"))
    rows = dictionary_join(data, starts, ["chunk"], "inner").withColumn("idx", F.col("_start") + F.col("line"))
    return rows.select(*data.columns, "idx")


def write_vocab(vocab: DataFrame, path: str) -> None:
    """``token<TAB>count`` per line, in id order."""
    write_text(vocab.withColumn("_l", F.concat_ws("\t", "token", "count")), "_l", path, [F.col("id")])


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """``(id, token, count)``; the id is the line number, a missing count is null."""
    parts = F.split("value", "\t")
    return read_lines(spark, path).select(
        F.col("idx").alias("id"),
        F.get(parts, F.lit(0)).alias("token"),
        F.get(parts, F.lit(1)).try_cast("long").alias("count"),
    )


# Names of the classes in the idiom file.
_IDIOM_FIELDS = {"identifiers": "identifier", "float": "float", "int": "int", "str": "string"}


def write_idioms(idioms: DataFrame, path: str) -> None:
    """One JSON object with a list of {value, count} per class. The lists are
    top-k cuts; a table too large for one row is an error."""
    if not fits_broadcast(idioms):
        raise ValueError("too many idioms for one object; cut them to the most frequent first")

    def entries(cls: str) -> Column:
        mine = F.when(F.col("cls") == cls, F.struct((-F.col("count")).alias("_o"), "value", "count"))
        return F.transform(
            F.array_sort(F.collect_list(mine)), lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count"))
        )

    one = idioms.agg(*[entries(cls).alias(f) for f, cls in _IDIOM_FIELDS.items()])
    one.select(F.to_json(F.struct(*_IDIOM_FIELDS)).alias("value")).write.text(path)


def read_idioms(spark: SparkSession, path: str) -> DataFrame:
    """``(cls, value, count)``."""
    item = "array<struct<value:string,count:bigint>>"
    schema = ", ".join(f"`{f}` {item}" for f in _IDIOM_FIELDS)
    doc = spark.read.schema(schema).json(path)
    lists = [
        F.struct(F.lit(cls).alias("cls"), F.col(f).alias("items")) for f, cls in _IDIOM_FIELDS.items()
    ]
    return doc.select(F.explode(F.array(*lists)).alias("g")).select(
        "g.cls", F.explode("g.items").alias("i")
    ).select("cls", "i.value", "i.count")


def write_cluster_corpora(entries: DataFrame, path: str) -> None:
    """A folder per cluster with the entries (``data``) and the two abstract
    texts (``text``, columns before and after). An existing folder is an error.

    The sides keep neutral names; which one is the source is chosen on reading.
    The entries are frozen before they are sorted, as in ``write_entries``.
    """
    numbered = with_group_index(materialize(entries, "entries"), ["cluster"], [F.col("name")], "line")
    numbered.write.partitionBy("cluster").mode("errorifexists").json(f"{path}/data")
    numbered.select(
        "cluster",
        "line",
        F.col("before_code_normalized").alias("before"),
        F.col("after_code_normalized").alias("after"),
    ).write.partitionBy("cluster").mode("errorifexists").parquet(f"{path}/text")


def read_cluster_entries(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all cluster folders, with ``line`` and ``cluster``."""
    return spark.read.schema(f"{CHANGE_ENTRIES}, line long, cluster int").json(f"{path}/data")


def write_beam_lines(lines: DataFrame, path: str) -> None:
    """The hypotheses of one example per line, by example."""
    write_text(lines, "line", path, [F.col("example_id")])


def write_beam_blocks(texts: DataFrame, path: str) -> None:
    """One hypothesis per line, examples separated by a blank line."""
    last = F.max("beam").over(Window.partitionBy("example_id"))
    rows = texts.withColumn(
        "_l", F.when(F.col("beam") == last, F.concat("text", F.lit("\n"))).otherwise(F.col("text"))
    )
    write_text(rows, "_l", path, [F.col("example_id"), F.col("beam")])


def write_aligner_lines(pairs: DataFrame, path: str, key: str = "pair_id") -> None:
    """``source ||| target`` per line."""
    rows = pairs.withColumn("_l", F.concat_ws(ALIGNER_SEPARATOR, "source", "target"))
    write_text(rows, "_l", path, [F.col(key)])


def write_array_dump(rows: DataFrame, path: str) -> None:
    """Beams, attention or embeddings as a long columnar table."""
    rows.write.mode("errorifexists").parquet(path)
