"""Literal classes of tokens."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.shipping import ship

ship(__name__)

# The language's keywords, which are never replaced.
KEYWORDS = (
    "False None True and as assert async await break class continue def del elif else "
    "except finally for from global if import in is lambda nonlocal not or pass raise "
    "return try while with yield"
).split()

# Placeholder prefix of each class.
PREFIXES = {
    "identifier": "IDENTIFIER_",
    "float": "FLOAT_",
    "int": "INT_",
    "string": "STR_",
    "f_string": "F_STR_",
}


# The first pattern that a token meets names its class.
_PATTERNS = {
    "identifier": "^[A-Za-z_][A-Za-z_0-9]*$",
    "int": "^[0-9][0-9_]*$",
    "float": r"^([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][-+]?[0-9]+)?$",
    "f_string": "^([rR]?[fF]|[fF][rR])['\"]",
    "string": "^[rRuU]?['\"]",
}


def literal_class(token: Column | str) -> Column:
    """identifier, int, float, string, f_string, or null."""
    t = F.col(token) if isinstance(token, str) else token
    out = F.when(t.isin(*KEYWORDS), None)
    for name, pattern in _PATTERNS.items():
        out = out.when(t.rlike(pattern), name)
    return out


def class_of(unclassed: str = "") -> Callable[[str | None], str | None]:
    """``literal_class`` of one token; those that begin with ``unclassed`` have none."""
    patterns = [(name, re.compile(pattern)) for name, pattern in _PATTERNS.items()]
    keywords = frozenset(KEYWORDS)

    def one(token: str | None) -> str | None:
        if token is None or token in keywords or (unclassed and token.startswith(unclassed)):
            return None
        return next((name for name, p in patterns if p.search(token)), None)

    return one


def literal_classes(tokens: Column | str, unclassed: str = "") -> Column:
    """``literal_class`` of the tokens of an array; those that begin with
    ``unclassed`` have none. Each text is judged once a batch."""
    one = class_of(unclassed)

    def run(lists: pa.Array) -> pa.Array:
        texts = lists.flatten().dictionary_encode()
        classes = pa.array([one(t) for t in texts.dictionary.to_pylist()], pa.string())
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), classes.take(texts.indices))

    return F.arrow_udf(run, "array<string>")(tokens)
