"""Beam search tables: one search step, back-tracking, trees and text.

A beam table has one row per ``example_id, step, beam`` with ``token_id,
parent, score``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.rows import element_rows
from palimpsest.functions.scores import length_penalty
from palimpsest.functions.text import BEAM_SEPARATOR, UNK
from palimpsest.session import dictionary_join

# Fixed value: lowest 32-bit float, the log-probability of an impossible token.
FLOAT32_MIN = -3.4028234663852886e38


def with_log_softmax(df: DataFrame, value: str, group: list[str], name: str = "log_prob") -> DataFrame:
    """Add x - max - log(sum(exp(x - max))); a group is one row of a
    vocabulary-sized matrix."""
    w = Window.partitionBy(*group)
    shifted = df.withColumn("_x", F.col(value) - F.max(value).over(w))
    return shifted.withColumn(name, F.col("_x") - F.log(F.sum(F.exp("_x")).over(w))).drop("_x")


def masked_log_prob(log_prob: str, token: str, finished: str, eos: int) -> Column:
    """A finished beam puts all probability on the end token."""
    on_end = F.when(F.col(token) == eos, F.lit(0.0)).otherwise(F.lit(FLOAT32_MIN))
    return F.when(F.col(finished), on_end).otherwise(F.col(log_prob))


def by_score() -> list[Column]:
    """Default choice of successors: best score, then lowest index."""
    return [F.desc("score"), F.col("parent"), F.col("token_id")]


def beam_step(
    logits: DataFrame,
    state: DataFrame,
    *,
    width: int,
    eos: int,
    penalty_weight: float = 0.0,
    first: bool = False,
    successors: Callable[[], list[Column]] = by_score,
) -> DataFrame:
    """One search step for all examples at once.

    ``logits``: example_id, beam, token_id, logit. ``state``: example_id, beam,
    log_prob, length, finished. On the first step all beams are equal, so only
    beam 0 competes. The constant cut on the rank is applied before the
    shuffle as well as after it.
    """
    scored = with_log_softmax(logits, "logit", ["example_id", "beam"], "_lp")
    total = F.col("log_prob") + masked_log_prob("_lp", "token_id", "finished", eos)
    grows = (~F.col("finished") & (F.col("token_id") != eos)).cast("int")
    candidates = (
        scored.join(state, ["example_id", "beam"])
        .filter((F.col("beam") == 0) if first else F.lit(True))
        .select(
            "example_id",
            F.col("beam").alias("parent"),
            "token_id",
            total.alias("log_prob"),
            (F.col("length") + grows).alias("length"),
            (F.col("finished") | (F.col("token_id") == eos)).alias("finished"),
        )
        .withColumn("score", F.col("log_prob") / length_penalty("length", penalty_weight))
    )
    rank = F.row_number().over(Window.partitionBy("example_id").orderBy(*successors()))
    return (
        candidates.withColumn("_rank", rank)
        .filter(F.col("_rank") <= width)
        .withColumn("beam", F.col("_rank") - 1)
        .select("example_id", "beam", "token_id", "parent", "score", "log_prob", "length", "finished")
    )


def gather_tree(beams: DataFrame) -> DataFrame:
    """``(example_id, beam, path)``: the tokens of each final beam, first to
    last, following the parents up from the last step.

    One example has steps x width rows, a bounded group; the walk happens
    inside its row.
    """
    cells = F.array_sort(F.collect_list(F.struct("step", "beam", "token_id", "parent")))
    trees = beams.groupBy("example_id").agg(
        cells.alias("_c"), (F.max("beam") + 1).cast("int").alias("_w"), F.max("step").cast("int").alias("_last")
    )
    rows = trees.select(
        "example_id", "_c", "_w", "_last",
        F.explode(F.sequence(F.lit(0), F.col("_w") - 1)).alias("beam"),
    )
    empty = F.array().cast("array<bigint>")
    start = F.struct(F.col("beam").cast("long").alias("at"), empty.alias("path"))

    def up(a: Column, level: Column) -> Column:
        cell = F.get("_c", (level * F.col("_w") + a["at"]).cast("int"))
        return F.struct(
            cell["parent"].cast("long").alias("at"),
            F.concat(F.array(cell["token_id"].cast("long")), a["path"]).alias("path"),
        )

    levels = F.reverse(F.sequence(F.lit(0), F.col("_last")))
    return rows.select(
        "example_id",
        F.col("beam").cast("long").alias("beam"),
        F.aggregate(levels, start, up, lambda a: a["path"]).alias("path"),
    )


def path_rows(paths: DataFrame) -> DataFrame:
    """Long form of :func:`gather_tree`: example_id, beam, step, token_id."""
    return element_rows(paths, "path", "token_id", "example_id", "beam", pos="step")


def first_beam(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("beam") == 0)


def beam_texts(
    paths: DataFrame, vocab: DataFrame, end_id: int, rows_at_most: int | None = None
) -> DataFrame:
    """``(example_id, beam, text)``: words up to the first end id; ids outside
    the vocabulary become UNK."""
    at = F.array_position("path", F.lit(end_id).cast("long")).cast("int")
    cut = paths.withColumn("path", F.when(at == 0, F.col("path")).otherwise(
        F.slice("path", F.lit(1), F.greatest(at - 1, F.lit(0)))))
    rows = cut.select("example_id", "beam", F.posexplode_outer("path").alias("step", "token_id"))
    names = vocab.select(F.col("id").alias("token_id"), F.col("token").alias("_t"))
    named = dictionary_join(rows, names, ["token_id"], rows_at_most=rows_at_most)
    word = F.when(F.col("step").isNotNull(), F.coalesce("_t", F.lit(UNK)))
    ordered = F.array_sort(F.collect_list(F.when(word.isNotNull(), F.struct("step", word.alias("w")))))
    return named.groupBy("example_id", "beam").agg(
        F.concat_ws(" ", F.transform(ordered, lambda x: x["w"])).alias("text")
    )


def beam_lines(texts: DataFrame, separator: str = BEAM_SEPARATOR) -> DataFrame:
    """One line per example: its hypotheses in beam order."""
    ordered = F.array_sort(F.collect_list(F.struct("beam", "text")))
    return texts.groupBy("example_id").agg(
        F.concat_ws(separator, F.transform(ordered, lambda x: x["text"])).alias("line")
    )


def beam_nodes(beams: DataFrame, name: Column | None = None) -> DataFrame:
    """Tree nodes: the root at level 0, then one node per step and beam."""
    label = F.col("token_id").cast("string") if name is None else name
    inner = beams.select(
        "example_id",
        (F.col("step") + 1).cast("long").alias("level"),
        F.col("beam").cast("long").alias("node"),
        label.alias("name"),
        "score",
    )
    root = beams.select("example_id").distinct().select(
        "example_id",
        F.lit(0).cast("long").alias("level"),
        F.lit(0).cast("long").alias("node"),
        F.lit("START").alias("name"),
        F.lit(None).cast("double").alias("score"),
    )
    return root.unionByName(inner)


def beam_edges(beams: DataFrame) -> DataFrame:
    """Tree edges from (level, parent) to (level + 1, node)."""
    return beams.select(
        "example_id",
        F.col("step").cast("long").alias("level"),
        F.col("parent").cast("long").alias("parent"),
        F.col("beam").cast("long").alias("node"),
    )


def cut_attention(attention: DataFrame) -> DataFrame:
    """Cells inside ``target_len`` x ``source_len``."""
    return attention.filter(
        (F.col("target_pos") < F.col("target_len")) & (F.col("source_pos") < F.col("source_len"))
    )


def strongest_source(attention: DataFrame) -> DataFrame:
    """``(example_id, target_pos, source_pos)`` of the highest score, first on
    ties; the last source token, the end marker, is never chosen."""
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("source_pos")))["source_pos"]
    inside = attention.filter(F.col("source_pos") < F.col("source_len") - 1)
    return inside.groupBy("example_id", "target_pos").agg(best.alias("source_pos"))


def replace_unknown(
    predicted: DataFrame,
    attention: DataFrame,
    sources: DataFrame,
    mapping: DataFrame | None = None,
    rows_at_most: int | None = None,
) -> DataFrame:
    """Predicted tokens with every UNK replaced by the source token it attends
    to most, or by what ``mapping`` (source, target) gives for that token.

    ``predicted``: example_id, target_pos, token. ``sources``: example_id,
    source_pos, source_token. Only positions that hold UNK reach the joins.
    """
    unknown = predicted.filter(F.col("token") == UNK).select("example_id", "target_pos")
    chosen = (
        strongest_source(attention.join(unknown, ["example_id", "target_pos"], "left_semi"))
        .join(sources, ["example_id", "source_pos"])
        .select("example_id", "target_pos", F.col("source_token").alias("source"))
    )
    if mapping is not None:
        chosen = dictionary_join(chosen, mapping, ["source"], rows_at_most=rows_at_most)
        chosen = chosen.withColumn("source", F.coalesce("target", "source"))
    return (
        predicted.join(
            chosen.select("example_id", "target_pos", F.col("source").alias("_new")),
            ["example_id", "target_pos"],
            "left",
        )
        .withColumn(
            "token",
            F.when(F.col("token") == UNK, F.coalesce("_new", "token")).otherwise(F.col("token")),
        )
        .drop("_new")
    )


def best_targets(lexicon: DataFrame) -> DataFrame:
    """``(source, target)`` of the highest probability per source word, ties by
    target; ``lexicon``: source, target, prob."""
    best = F.min(F.struct((-F.col("prob")).alias("p"), F.col("target")))["target"]
    return lexicon.groupBy("source").agg(best.alias("target"))
