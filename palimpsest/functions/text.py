"""Tokens, special markers and post-processing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the corpus format.
SEQUENCE_START = "SEQUENCE_START"
SEQUENCE_END = "SEQUENCE_END"
UNK = "UNK"
BEAM_SEPARATOR = " <SEP> "
ALIGNER_SEPARATOR = " ||| "
BPE_JOINER = "@@ "
WHITE = " \t\n\r\v\f"
SENTENCEPIECE_SPACE = "▁"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def words(c: Column | str) -> Column:
    """Tokens between runs of blanks, tabs and line ends; no empty token."""
    flat = _col(c)
    # Whole runs are copied; translate looks up every character.
    for white in "\t\n\r":
        flat = F.replace(flat, F.lit(white), F.lit(" "))
    return F.array_remove(F.split(flat, " "), "")


def one_line(c: Column | str) -> Column:
    """The same words joined by single blanks."""
    return F.concat_ws(" ", words(c))


def split_tokens(c: Column | str, delimiter: str = " ", downcase: bool = False) -> Column:
    """Tokens of one line: strip, split on one delimiter ("" = characters),
    drop empty tokens."""
    text = F.lower(_col(c)) if downcase else _col(c)
    text = F.regexp_replace(text, r"^\s+|\s+$", "")
    if delimiter == "":
        return F.array_remove(F.split(text, ""), "")
    literal = "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.array_remove(F.split(text, literal), "")


def characters(c: Column | str) -> Column:
    return split_tokens(c, "")


def append_end(tokens: Column | str) -> Column:
    return F.concat(_col(tokens), F.array(F.lit(SEQUENCE_END)))


def wrap_start_end(tokens: Column | str) -> Column:
    return F.concat(
        F.array(F.lit(SEQUENCE_START)), _col(tokens), F.array(F.lit(SEQUENCE_END))
    )


def truncate(tokens: Column | str, max_len: int | None) -> Column:
    return _col(tokens) if max_len is None else F.slice(_col(tokens), 1, max_len)


def reverse_prefix(ids: Column | str, length: Column | str) -> Column:
    """Reverse the first ``length`` items, keep the padding behind them."""
    ids, length = _col(ids), _col(length)
    head = F.reverse(F.slice(ids, F.lit(1), length))
    return F.concat(head, F.slice(ids, length + 1, F.size(ids)))


def cut_at_end(tokens: Column | str, end: str = SEQUENCE_END) -> Column:
    """Tokens before the first end marker."""
    tokens = _col(tokens)
    at = F.array_position(tokens, end)
    return F.when(at == 0, tokens).otherwise(
        F.slice(tokens, F.lit(1), F.greatest(at.cast("int") - 1, F.lit(0)))
    )


def predicted_length(tokens: Column | str, end: str = SEQUENCE_END) -> Column:
    """Length up to and including the first end marker, else the full length."""
    tokens = _col(tokens)
    at = F.array_position(tokens, end).cast("int")
    return F.when(at > 0, at).otherwise(F.size(tokens))


def slice_text(
    text: Column | str, start: str = SEQUENCE_START, end: str = SEQUENCE_END
) -> Column:
    """The text behind the first start marker and before the first end marker."""
    text = _col(text)
    after = F.when(
        F.instr(text, start) > 0,
        F.substring(text, F.instr(text, start) + len(start), F.length(text)),
    ).otherwise(text)
    return F.trim(F.substring_index(after, end, 1))


def strip_bpe(text: Column | str) -> Column:
    return F.replace(_col(text), F.lit(BPE_JOINER), F.lit(""))


def decode_sentencepiece(text: Column | str) -> Column:
    joined = F.replace(_col(text), F.lit(" "), F.lit(""))
    return F.ltrim(F.replace(joined, F.lit(SENTENCEPIECE_SPACE), F.lit(" ")))


def strip_nul(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit("\0"), F.lit(""))


def stable_hash(*cols: Column | str) -> Column:
    """A 60-bit hash of the text forms of ``cols`` that any engine can repeat."""
    joined = F.concat_ws(":", *[_col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 15), 16, 10).cast("long")
