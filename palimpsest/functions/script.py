"""Edit scripts between two token lists, as an Arrow-batched function."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from itertools import pairwise, zip_longest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.alignment import common_places_of_rows, ragged, trimmed
from palimpsest.functions.lcs import common_places
from palimpsest.functions.shipping import ship

ship(__name__)

# Action labels.
INSERT, DELETE, UPDATE, MOVE = "insert-node", "delete-node", "update-node", "move-tree"


# Up to this many edits the frontier of each is kept, the square of it at most.
_FEW_EDITS = 200


def _common(x: list, y: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence.

    Lists that differ by few edits are aligned by growing the number of edits,
    in time that grows with their length. Beyond that, bit rows of lengths are
    swept, which need little memory however unlike the lists are. Both walk
    back by the same rule: a token of ``y`` is left out where that keeps the
    length, else one of ``x``, else they are a pair.
    """
    n, m = len(x), len(y)
    reach, past = {1: 0}, []
    for edits in range(min(n + m, _FEW_EDITS) + 1):
        past.append(dict(reach))
        for k in range(-edits, edits + 1, 2):
            down = k == -edits or (k != edits and reach[k - 1] < reach[k + 1])
            i = reach[k + 1] if down else reach[k - 1] + 1
            while i < n and 0 <= i - k < m and x[i] == y[i - k]:
                i += 1
            reach[k] = i
            if i >= n and i - k >= m:
                return _walked_back(past, n, m)
    return common_places(x, y)


def _walked_back(past: list[dict[int, int]], i: int, j: int) -> list[tuple[int, int]]:
    pairs = []
    for edits in range(len(past) - 1, -1, -1):
        reach, k = past[edits], i - j
        down = k == -edits or (k != edits and reach[k - 1] < reach[k + 1])
        from_i = reach[k + 1] if down else reach[k - 1]
        start = (from_i if down else from_i + 1) if edits else 0
        while i > start:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        if edits:
            i, j = from_i, from_i - (k + 1 if down else k - 1)
    return pairs[::-1]


def edit_script(before: list | None, after: list | None) -> list[dict]:
    """Ordered edits that turn ``before`` into ``after``; null counts as empty.

    The lists are aligned at a longest common subsequence. A token deleted in
    one place and inserted in another moves; of what is left between two common
    tokens, deletes and inserts are updates in order, and the surplus stays.
    """
    x, y = list(before or ()), list(after or ())
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    inner = _common(x[head : len(x) - tail], y[head : len(y) - tail])
    ends = [*((i + head, j + head) for i, j in inner), (len(x) - tail, len(y) - tail)]
    gaps, i, j = [], head, head
    for next_i, next_j in ends:
        gaps.append((list(range(i, next_i)), list(range(j, next_j))))
        i, j = next_i + 1, next_j + 1
    spare = defaultdict(deque)
    for gone, _ in gaps:
        for p in gone:
            spare[x[p]].append(p)
    moved = {q: spare[y[q]].popleft() for _, new in gaps for q in new if spare.get(y[q])}
    left = set(moved.values())
    script = []
    for gone, new in gaps:
        kept = [p for p in gone if p not in left]
        fresh = [q for q in new if q not in moved]
        edits = [(q, MOVE, moved[q], q) for q in new if q in moved]
        for p, q in zip_longest(kept, fresh):
            action = INSERT if p is None else DELETE if q is None else UPDATE
            edits.append((len(y) if q is None else q, action, p, q))
        for _, action, p, q in sorted(edits, key=lambda e: e[0]):
            script.append(
                {
                    "action": action,
                    "before_pos": p,
                    "after_pos": q,
                    "before": None if p is None else x[p],
                    "after": None if q is None else y[q],
                }
            )
    return script


_TYPE = pa.list_(
    pa.struct(
        [
            ("action", pa.string()),
            ("before_pos", pa.int32()),
            ("after_pos", pa.int32()),
            ("before", pa.string()),
            ("after", pa.string()),
        ]
    )
)


# Tokens of a batch that are Python objects at a time.
_SLICE_TOKENS = 1 << 16


def _slices(before: pa.Array, after: pa.Array) -> Iterator[Iterator[tuple[list | None, list | None]]]:
    """The pairs of a batch a few at a time, so that a batch of long texts is
    never whole in Python objects."""
    sizes = sum(np.nan_to_num(a.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)) for a in (before, after))
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // _SLICE_TOKENS)) + 1
    for start, end in pairwise([0, *cuts.tolist(), len(before)]):
        sides = [a.slice(start, end - start).to_pylist() for a in (before, after)]
        yield zip(*sides, strict=True)


def _scripts(before: pa.Array, after: pa.Array) -> pa.Array:
    return pa.concat_arrays(
        [pa.array([edit_script(b, a) for b, a in some], _TYPE) for some in _slices(before, after)]
    )


_LABELS = [INSERT, DELETE, UPDATE, MOVE]


def _side(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The tokens of all rows, and where each row's begin and how many they are."""
    sizes = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten(), np.cumsum(sizes) - sizes, sizes


def _nth(keys: np.ndarray) -> np.ndarray:
    """How many equal keys stand before each."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.arange(len(keys)) - np.searchsorted(ranked, ranked)
    return out


def _counts(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """How often each wanted key occurs."""
    ranked = np.sort(keys)
    return np.searchsorted(ranked, wanted, "right") - np.searchsorted(ranked, wanted)


def _unpaired(row: np.ndarray, place: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, places and gaps of the tokens that are not common; a gap is the
    number of common tokens before it."""
    ends = np.cumsum(size)
    common = np.zeros(ends[-1] if len(ends) else 0, np.int64)
    common[(ends - size)[row] + place] = 1
    rows, places = np.repeat(np.arange(len(size)), size), ragged(start, size)
    before = np.cumsum(common) - common
    left = np.flatnonzero(common == 0)
    first = np.concatenate((before, [0]))[(ends - size)[rows[left]]]
    return rows[left], places[left], before[left] - first


def _actions(before: pa.Array, after: pa.Array) -> pa.Array:
    """The actions of ``edit_script`` for all pairs of a batch together."""
    (b, i, n), (a, j, m) = _side(before), _side(after)
    codes = pa.concat_arrays([b, a]).dictionary_encode()
    kinds = len(codes.dictionary) + 1
    codes = codes.indices.fill_null(kinds - 1).to_numpy(zero_copy_only=False).astype(np.int64)
    x, y = codes[: len(b)], codes[len(b) :]
    head, tail = trimmed(x, y, i, j, n, m)
    i, j, n, m = i + head, j + head, n - head - tail, m - head - tail
    row, p, q = common_places_of_rows(x, y, i, j, n, m, _common)
    gone_row, gone, gone_gap = _unpaired(row, p, i, n)
    new_row, new, new_gap = _unpaired(row, q, j, m)
    # The nth of a token that goes is the nth of it that comes.
    gone_key, new_key = gone_row * kinds + x[gone], new_row * kinds + y[new]
    moved = _nth(new_key) < _counts(gone_key, new_key)
    left = _nth(gone_key) >= _counts(new_key, gone_key)
    fresh = np.flatnonzero(~moved)
    gone_row, gone, gone_gap = gone_row[left], gone[left], gone_gap[left]
    widest = max(1, int(n.max(initial=0)), int(m.max(initial=0))) + 1
    kept_at, fresh_at = gone_row * widest + gone_gap, new_row[fresh] * widest + new_gap[fresh]
    action = np.full(len(new), _LABELS.index(MOVE), np.int8)
    updated = _nth(fresh_at) < _counts(kept_at, fresh_at)
    action[fresh] = np.where(updated, _LABELS.index(UPDATE), _LABELS.index(INSERT))
    cut = _nth(kept_at) >= _counts(fresh_at, kept_at)
    # In a gap what comes is in the order of its places, then what goes.
    rows = np.concatenate((new_row, gone_row[cut]))
    gaps = np.concatenate((new_gap, gone_gap[cut]))
    late = np.repeat([0, 1], [len(new), int(cut.sum())])
    places = np.concatenate((new, gone[cut]))
    action = np.concatenate((action, np.full(int(cut.sum()), _LABELS.index(DELETE), np.int8)))
    order = np.lexsort((places, late, rows * widest + gaps))
    ends = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(before)))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_LABELS).take(pa.array(action[order])))


# Tokens of a batch that are aligned together.
_BATCH_TOKENS = 1 << 19


def _actions_batch(before: pa.Array, after: pa.Array) -> pa.Array:
    sizes = _side(before)[2] + _side(after)[2]
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // _BATCH_TOKENS)) + 1
    ends = pairwise([0, *cuts.tolist(), len(before)])
    return pa.concat_arrays([_actions(before.slice(s, e - s), after.slice(s, e - s)) for s, e in ends])


def edit_actions_of(before: Column | str, after: Column | str) -> Column:
    """``array<string>``: the actions of the edit script alone, in order."""
    return F.arrow_udf(_actions_batch, "array<string>")(before, after)


def edit_script_of(before: Column | str, after: Column | str) -> Column:
    """``array<struct<action, before_pos, after_pos, before, after>>``."""
    kind = "array<struct<action:string,before_pos:int,after_pos:int,before:string,after:string>>"
    return F.arrow_udf(_scripts, kind)(before, after)


def moved_tokens(before: list | None, after: list | None) -> list[dict]:
    """Tokens that occur as often on both sides, but at other places."""
    places: tuple[dict, dict] = ({}, {})
    for found, tokens in zip(places, (before or (), after or ()), strict=True):
        for at, token in enumerate(tokens):
            found.setdefault(token, []).append(at)
    b, a = places
    return [
        {"token": token, "n": len(at)}
        for token, at in b.items()
        if token in a and len(a[token]) == len(at) and a[token] != at
    ]


_MOVED = pa.list_(pa.struct([("token", pa.string()), ("n", pa.int64())]))


def _moved(before: pa.Array, after: pa.Array) -> pa.Array:
    return pa.concat_arrays(
        [pa.array([moved_tokens(b, a) for b, a in some], _MOVED) for some in _slices(before, after)]
    )


def moved_tokens_of(before: Column | str, after: Column | str) -> Column:
    """``array<struct<token, n>>``."""
    return F.arrow_udf(_moved, "array<struct<token:string,n:bigint>>")(before, after)
