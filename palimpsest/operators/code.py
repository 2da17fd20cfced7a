"""Functions and tokens of source files, paired before and after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.pycode import functions_of, lines_of, paired_functions_of, tokens_of, values_of
from palimpsest.functions.rows import element_rows
from palimpsest.functions.text import one_line

# Fixed value: the longest side of a kept pair.
MAX_TOKENS = 50


def function_table(files: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per function of each readable file: ``name``, ``code``."""
    rows = files.select(*keep, functions_of(text).alias("f"))
    return element_rows(rows, "f.functions", "x", *keep).select(*keep, "x.name", "x.code")


def unreadable_files(files: DataFrame, text: str, *keep: str) -> DataFrame:
    """The quarantine: files that cannot be parsed, with the reason."""
    rows = files.select(*keep, functions_of(text)["error"].alias("error"))
    return rows.filter("error IS NOT NULL")


def _both_sides(changes: DataFrame, *keep: str) -> DataFrame:
    return changes.select(
        *keep,
        functions_of("code_before").alias("b"),
        functions_of("code_after").alias("a"),
    ).filter("b.error IS NULL AND a.error IS NULL")


def pair_functions(changes: DataFrame, *keep: str) -> DataFrame:
    """One row per function present before and after: ``func_name``,
    ``before_code``, ``after_code``.

    Both texts sit in one row, so pairing needs no shuffle; each is parsed once.
    A change with an unreadable side is dropped whole.
    """
    both = changes.select(*keep, paired_functions_of("code_before", "code_after").alias("p"))
    return element_rows(both, "p", "x", *keep).select(*keep, "x.*")


def created_and_removed(changes: DataFrame, *keep: str) -> DataFrame:
    """Functions on one side only: ``func_name``, ``event``."""
    names = _both_sides(changes, *keep).select(
        *keep, F.col("b.functions.name").alias("b"), F.col("a.functions.name").alias("a")
    )

    def only(x: str, y: str, event: str) -> Column:
        return F.transform(
            F.array_except(x, y),
            lambda n: F.struct(n.alias("func_name"), F.lit(event).alias("event")),
        )

    both = F.concat(only("b", "a", "removed"), only("a", "b", "created"))
    return names.select(*keep, F.explode(both).alias("e")).select(*keep, "e.*")


def token_table(
    rows: DataFrame, code: str, *keep: str, max_tokens: int | None = None, keep_nl: bool = False
) -> DataFrame:
    """One row per token: ``pos``, ``token``, ``cls``, ``value``, ``visit``, ``gap``."""
    tokens = tokens_of(code, max_tokens, keep_nl)
    out = rows.select(*keep, tokens.alias("t"))
    return element_rows(out, "t.tokens", "x", *keep, pos="pos").select(*keep, "pos", "x.*")


def one_line_code(code: Column | str, max_tokens: int | None = None) -> Column:
    """The code as blank-separated tokens; null if unreadable or too long."""
    return lines_of(code, max_tokens)


def spaced_one_line(code: Column | str) -> Column:
    """One line that keeps comments, blank lines and the blanks between tokens."""
    t = tokens_of(code, None, True)["tokens"]

    def piece(x: Column) -> Column:
        marker = x["token"].isin("$NEWLINE", "$INDENT", "$DEDENT")
        return F.when(marker, F.concat(F.lit(" "), x["token"], F.lit(" "))).otherwise(
            F.concat(F.repeat(F.lit(" "), x["gap"]), x["token"])
        )

    return F.array_join(F.transform(t, piece), "")


def within_ceiling(tokens: Column | str, limit: int = MAX_TOKENS) -> Column:
    return F.size(tokens) <= limit


def identifier_and_literal_rows(files: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per identifier or literal occurrence of each readable file."""
    rows = files.select(*keep, values_of(text).alias("v"))
    return element_rows(rows, "v.items", "x", *keep).select(*keep, "x.cls", "x.value")


def first_definitions(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """One row per key: that with the lowest position."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), pos).alias("_r")).select(*keys, "_r.*")


def change_name(repository: str, sha: str, path: str, func: str) -> Column:
    """``repository:sha:path:function``."""
    return F.concat_ws(":", repository, sha, path, func)


def text_tokens(c: Column | str) -> Column:
    """Tokens of text that is already one token per word."""
    return F.split(one_line(c), " ")
