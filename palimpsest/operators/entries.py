"""From file changes to function change entries, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.script import edit_actions_of
from palimpsest.operators import abstraction as A
from palimpsest.operators import code as C
from palimpsest.session import materialize


def change_entries(
    changes: DataFrame,
    idioms: DataFrame,
    *,
    idiom_rows_at_most: int | None = None,
    max_tokens: int = C.MAX_TOKENS,
) -> DataFrame:
    """File changes (repository, commit_after, file_after, code_before,
    code_after) to change entries.

    Unreadable files, long functions and pairs equal after abstraction drop
    out, in that order, before the edit actions are derived. Each text is
    parsed once: the paired functions are written to the shared folder. A
    function whose code stays is equal after abstraction too, so it is not
    abstracted. A pair is numbered, compared and mapped inside its one row.
    """
    keep = ["repository", "commit_after", "file_after"]
    found = C.pair_functions(changes, *keep).select(
        C.change_name("repository", "commit_after", "file_after", "func_name").alias("name"),
        "before_code",
        "after_code",
    )
    found = found.filter("before_code <> after_code")
    # Rows are told apart by a number, since a name may occur more than once.
    found = found.withColumn("pair_id", F.monotonically_increasing_id())
    pairs = materialize(found, "function-pairs")
    keep = ("name", "before_code", "after_code")
    tokens = A.code_pair_table(pairs, "pair_id", max_tokens=max_tokens, keep=keep)
    numbered = A.number_pairs(tokens, idioms, idiom_rows_at_most, ("normalized", "entries"))
    sides = A.side_arrays(numbered, "token", *keep, "n_before", "normalized", "entries")
    sides = sides.withColumnsRenamed({"before": "b", "after": "a"})
    lines = A.pair_texts(sides, "normalized", *keep, "b", "a", "entries").filter("before <> after")
    return lines.select(
        *keep,
        F.col("before").alias("before_code_normalized"),
        F.col("after").alias("after_code_normalized"),
        edit_actions_of("b", "a").alias("edit_actions"),
        A.entry_maps().alias("replacement_map"),
    )
