"""Numbers of placeholders inside the row of a pair, as an Arrow-batched function."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.literals import PREFIXES, class_of
from palimpsest.functions.shipping import ship

ship(__name__)

_USED = "^(?P<prefix>(?:" + "|".join(PREFIXES.values()) + "))(?P<n>0|[1-9][0-9]{0,8})$"
_WIDE = 1 << 32

FIELDS = {
    "placeholder": ("array<string>", pa.list_(pa.string())),
    "normalized": ("array<string>", pa.list_(pa.string())),
    "entries": (
        "array<struct<cls:string,placeholder:string,value:string>>",
        pa.list_(pa.struct([("cls", pa.string()), ("placeholder", pa.string()), ("value", pa.string())])),
    ),
}


def _lists(rows: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """One list per row; ``rows`` is ascending."""
    ends = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values)


def _listed(cls: np.ndarray, value: pa.DictionaryArray, codes: np.ndarray, idioms: dict[str, list[str]]) -> np.ndarray:
    """Which tokens have their class and value among the idioms."""
    out = np.zeros(len(cls), bool)
    for code, name in enumerate(PREFIXES):
        if idioms.get(name):
            found = pc.is_in(value.dictionary, value_set=pa.array(idioms[name], pa.string()))
            out |= (cls == code) & np.append(found.to_numpy(zero_copy_only=False), False)[codes]
    return out


def _codes(names: pa.DictionaryArray) -> np.ndarray:
    """The number of each text, that behind the last for null."""
    return names.indices.fill_null(len(names.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)


def _flat(lists: pa.Array, kind: pa.DataType) -> pa.Array:
    flat = lists.flatten().cast(kind)
    return flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat


def _rows(lists: pa.Array) -> np.ndarray:
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))


def _classes(lists: pa.Array) -> np.ndarray:
    codes = pc.index_in(_flat(lists, pa.string()), value_set=pa.array(list(PREFIXES)))
    return codes.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _taken(names: pa.DictionaryArray, codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``(row and class) * _WIDE + number - place`` of the numbers whose names a
    pair already uses, ascending; the place is that among its numbers."""
    parts = pc.extract_regex(names.dictionary, pattern=_USED)
    hit = np.flatnonzero(parts.is_valid().to_numpy(zero_copy_only=False))
    if not len(hit):
        return np.zeros(0, np.int64)
    prefixes = list(PREFIXES.values())
    code = np.full(len(names.dictionary) + 1, -1, np.int64)
    for at in hit:
        part = parts[at].as_py()
        code[at] = prefixes.index(part["prefix"]) * _WIDE + int(part["n"])
    mine = code[codes]
    some = mine >= 0
    used = np.unique(rows[some] * len(PREFIXES) * _WIDE + mine[some])
    group = used // _WIDE
    return used - (np.arange(len(used)) - np.searchsorted(group, group))


def number_batch(
    cls: pa.Array, value: pa.Array, token: pa.Array, order: pa.Array | None, idioms: dict[str, list[str]], want: tuple[str, ...]
) -> pa.Array:
    """Lists of each pair's tokens, both sides, to the wanted of ``FIELDS``.

    Values are numbered per class by first appearance (``order``, or the place
    in the list); numbers whose name the pair already uses are skipped. Idioms
    and tokens without a class keep their text.
    """
    n, rows, classes = len(cls), _rows(cls), _classes(cls)
    values, tokens = (_flat(x, pa.string()).dictionary_encode() for x in (value, token))
    places = np.arange(len(rows)) if order is None else _flat(order, pa.int64()).to_numpy(zero_copy_only=False)
    which, texts, live, first, key = _numbers(rows, classes, values, tokens, places, idioms)
    out = {}
    if "entries" in want:
        at = live[first]
        out["entries"] = _lists(rows[at], n, pa.StructArray.from_arrays(
            [pa.array(list(PREFIXES)).take(pa.array(classes[at])), texts.take(pa.array(which)), values.take(pa.array(at)).cast(pa.string())],
            ["cls", "placeholder", "value"]))
    if "placeholder" in want or "normalized" in want:
        index = np.full(len(rows), -1, np.int64)
        index[live] = which[key]
        out["placeholder"] = _lists(rows, n, texts.take(pa.array(index, mask=index < 0)))
        out["normalized"] = _lists(rows, n, _normalized(tokens, texts, index))
    return pa.StructArray.from_arrays([out[w].cast(FIELDS[w][1]) for w in want], list(want))


def _normalized(tokens: pa.DictionaryArray, texts: pa.Array, index: np.ndarray) -> pa.Array:
    """The placeholder of each token that has one, else the token."""
    codes = _codes(tokens)
    null = (index < 0) & (codes == len(tokens.dictionary))
    at = np.where(index < 0, codes, len(tokens.dictionary) + index)
    return pa.concat_arrays([tokens.dictionary, texts]).take(pa.array(at, mask=null))


def _numbers(
    rows: np.ndarray, classes: np.ndarray, values: pa.DictionaryArray, tokens: pa.DictionaryArray, places: np.ndarray,
    idioms: dict[str, list[str]],
) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Placeholders of a batch: which text each key has, the texts, the tokens
    that are replaced, the first of each key among them and the key of each.
    A key is a pair, a class and a value."""
    codes = _codes(values)
    live = np.flatnonzero((classes >= 0) & ~_listed(classes, values, codes, idioms))
    group = rows[live] * len(PREFIXES) + classes[live]
    # One key per pair, class and value; its first place orders it in its group.
    _, first, key = np.unique(group * (len(values.dictionary) + 1) + codes[live], return_index=True, return_inverse=True)
    start = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(start, key, places[live])
    group = group[first]
    by_place = np.lexsort((start, group))
    rank = np.empty(len(first), np.int64)
    rank[by_place] = np.arange(len(first)) - np.searchsorted(group[by_place], group[by_place])
    taken = _taken(tokens, codes if tokens is values else _codes(tokens), rows)
    low = group * _WIDE
    # The r-th free number is r plus the used numbers t_j with t_j - j <= r.
    number = rank + np.searchsorted(taken, low + rank, "right") - np.searchsorted(taken, low)
    made, which = np.unique(group % len(PREFIXES) * _WIDE + number, return_inverse=True)
    prefixes = list(PREFIXES.values())
    text = pa.array([f"{prefixes[m // _WIDE]}{m % _WIDE}" for m in made.tolist()], pa.string())
    return which, text, live, first, key


TEXT_FIELDS = {"before": "string", "after": "string", "before_len": "bigint", "after_len": "bigint"}


def text_batch(token: pa.Array, n_before: pa.Array, idioms: dict[str, list[str]], unclassed: str) -> pa.Array:
    """Both sides of each pair as a text of ``normalized`` tokens, and their
    lengths in tokens. A token's class is that of its text, which is its value."""
    tokens = _flat(token, pa.string()).dictionary_encode()
    n, rows = len(token), _rows(token)
    sizes = pc.list_value_length(token).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    split = np.minimum(n_before.fill_null(0).to_numpy(zero_copy_only=False), sizes)
    one, names = class_of(unclassed), list(PREFIXES)
    kinds = [names.index(c) if (c := one(t)) else -1 for t in tokens.dictionary.to_pylist()]
    classes = np.array([*kinds, -1], np.int64)[_codes(tokens)]
    which, texts, live, _, key = _numbers(rows, classes, tokens, tokens, np.arange(len(rows)), idioms)
    index = np.full(len(rows), -1, np.int64)
    index[live] = which[key]
    words = _normalized(tokens, texts, index)
    # A null has a place but no word.
    there = words.is_valid().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    ends = np.concatenate(([0], np.stack((starts + split, starts + sizes), axis=1).ravel()))
    ends = np.concatenate(([0], np.cumsum(there)))[ends]
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.drop_null()), " ")
    columns = [lines.take(pa.array(np.arange(side, 2 * n, 2))) for side in (0, 1)]
    lengths = [pa.array(x, pa.int64()) for x in (split, sizes - split)]
    return pa.StructArray.from_arrays([*columns, *lengths], list(TEXT_FIELDS))


def texts_of(token: Column | str, n_before: Column | str, idioms: dict[str, list[str]], unclassed: str) -> Column:
    """``struct`` of ``TEXT_FIELDS`` for the token arrays of a pair."""

    def run(token: pa.Array, n_before: pa.Array) -> pa.Array:
        return text_batch(token, n_before, idioms, unclassed)

    kind = "struct<" + ",".join(f"{f}:{t}" for f, t in TEXT_FIELDS.items()) + ">"
    return F.arrow_udf(run, kind).asNondeterministic()(token, n_before)


def numbered_of(
    cls: Column | str, value: Column | str, token: Column | str, order: Column | str | None,
    idioms: dict[str, list[str]], want: tuple[str, ...],
) -> Column:
    """``struct`` of the wanted of ``FIELDS`` for the token arrays of a pair."""
    kind = "struct<" + ",".join(f"{w}:{FIELDS[w][0]}" for w in want) + ">"
    if order is None:
        def run(cls: pa.Array, value: pa.Array, token: pa.Array) -> pa.Array:
            return number_batch(cls, value, token, None, idioms, want)

        return F.arrow_udf(run, kind).asNondeterministic()(cls, value, token)

    def ordered(cls: pa.Array, value: pa.Array, token: pa.Array, order: pa.Array) -> pa.Array:
        return number_batch(cls, value, token, order, idioms, want)

    return F.arrow_udf(ordered, kind).asNondeterministic()(cls, value, token, order)


def flags_of(cls: Column | str, value: Column | str, idioms: dict[str, list[str]]) -> Column:
    """``array<boolean>``: which tokens of the arrays are idioms."""

    def run(cls: pa.Array, value: pa.Array) -> pa.Array:
        values = _flat(value, pa.string()).dictionary_encode()
        found = _listed(_classes(cls), values, _codes(values), idioms)
        return _lists(_rows(cls), len(cls), pa.array(found))

    return F.arrow_udf(run, "array<boolean>").asNondeterministic()(cls, value)
