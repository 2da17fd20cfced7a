"""Row helpers that read Python source: functions of a file, tokens of a
function, literals and identifiers of a file.

They are Arrow-batched column functions returning arrays of structs. Pairing,
counting, numbering, filtering and assembly happen in Spark on those arrays.
A row that cannot be read comes back with ``error`` set instead.
"""

from __future__ import annotations

import ast
import contextlib
import gc
import io
import re
import tokenize
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.shipping import ship
from palimpsest.functions.text import strip_nul

ship(__name__)

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_BLOCKS = ("body", "orelse", "finalbody")
_UNREADABLE = (SyntaxError, ValueError, RecursionError, MemoryError)


def _kernel(fn, result: str):
    """An Arrow-batched function Spark must not evaluate twice: declared
    non-deterministic, it is neither copied into inferred filters nor moved."""
    return F.arrow_udf(fn, result).asNondeterministic()


@contextlib.contextmanager
def _unswept() -> Iterator[None]:
    """Without sweeps for cycles: syntax trees are freed by their counts."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def _parse(text: str):
    """``(tree, None)`` or ``(None, reason)``."""
    try:
        return ast.parse(text), None
    except _UNREADABLE as e:
        return None, type(e).__name__


class _Fields(dict):
    """The fields of a kind of node that may hold wanted nodes, in order."""

    def __init__(self, wanted):
        self._wanted = wanted

    def __missing__(self, kind: type) -> tuple[str, ...]:
        self[kind] = found = tuple(f for f in kind._fields if self._wanted(kind, f))
        return found


# Fields with names, numbers, operators or contexts, which have no nodes inside.
_LEAVES = frozenset({
    "id", "attr", "arg", "ctx", "op", "ops", "conversion", "type_comment", "kind", "module", "level", "asname",
    "simple", "is_async"})
_NODES = _Fields(lambda kind, field: field not in _LEAVES and kind is not ast.Constant)

# Fields with statements, or with the handlers and cases that hold them.
_STATEMENTS = _Fields(
    lambda kind, field: field in (*_BLOCKS, "handlers", "cases")
    and kind not in (ast.Lambda, ast.IfExp, ast.Expression))


def _children(node: ast.AST) -> list[ast.AST]:
    out = []
    for field in _NODES[node.__class__]:
        value = getattr(node, field, None)
        if value.__class__ is list:
            out += [x for x in value if isinstance(x, ast.AST)]
        elif isinstance(value, ast.AST):
            out.append(value)
    return out


# ---- functions of a file --------------------------------------------------

def _bare(s: ast.AST) -> bool:
    """Whether a statement is only a str, bytes or number literal."""
    return (
        isinstance(s, ast.Expr)
        and isinstance(s.value, ast.Constant)
        and type(s.value.value) in (str, bytes, int, float, complex)
    )


def _drop_literal_statements(root: ast.AST) -> None:
    """Remove statements that are only a literal; only statements hold others."""
    todo = [root]
    while todo:
        node = todo.pop()
        for block in _STATEMENTS[node.__class__]:
            statements = getattr(node, block)
            if block in _BLOCKS:
                kept = [s for s in statements if not _bare(s)]
                if block == "body" and not kept:
                    kept = [ast.Pass()]
                if len(kept) != len(statements) or kept[:1] != statements[:1]:
                    setattr(node, block, kept)
                statements = kept
            todo.extend(statements)


def _named_functions(root: ast.AST) -> dict[str, ast.AST]:
    """Qualified name -> node, first definition wins. Functions are not
    entered; classes prefix the names of their members."""
    found: dict[str, ast.AST] = {}
    todo = [("", root)]
    while todo:
        prefix, node = todo.pop()
        if isinstance(node, _FUNCTIONS):
            found.setdefault(prefix + node.name, node)
            continue
        if isinstance(node, ast.ClassDef):
            prefix += node.name + "."
        for block in reversed(_STATEMENTS[node.__class__]):
            todo.extend([(prefix, s) for s in reversed(getattr(node, block))])
    return found


def _code_of(name: str, node: ast.AST) -> str | None:
    """The code of a function without its literal statements; null if it cannot
    be written or, for a lone surrogate, not be stored."""
    _drop_literal_statements(node)
    try:
        code = ast.unparse(node)
        if not (code.isascii() and name.isascii()):
            (name + code).encode("utf-8")
    except (ValueError, RecursionError):
        return None
    return code


def _functions_of(text: str | None) -> dict:
    if text is None:
        return {"error": "missing", "functions": [], "skipped": 0}
    tree, error = _parse(text)
    if error:
        return {"error": error, "functions": [], "skipped": 0}
    found = [{"name": name, "code": _code_of(name, node)} for name, node in _named_functions(tree).items()]
    rows = [f for f in found if f["code"] is not None]
    return {"error": None, "functions": rows, "skipped": len(found) - len(rows)}


_FUNCTIONS_TYPE = pa.struct(
    [
        ("error", pa.string()),
        ("functions", pa.list_(pa.struct([("name", pa.string()), ("code", pa.string())]))),
        ("skipped", pa.int32()),
    ]
)


def _functions_batch(text: pa.Array) -> pa.Array:
    with _unswept():
        return pa.array([_functions_of(x) for x in text.to_pylist()], _FUNCTIONS_TYPE)


def functions_of(text: Column | str) -> Column:
    """``struct<error, functions: array<struct<name, code>>, skipped>``."""
    kernel = _kernel(
        _functions_batch,
        "error string, functions array<struct<name:string,code:string>>, skipped int",
    )
    return kernel(strip_nul(text))


_LINE_ENDS = re.compile(r"\r\n|\r|\n")


def _written(node: ast.AST, lines: list[str]) -> tuple:
    """The lines a function is written in and where it begins and ends in them;
    functions that agree in it are the same."""
    first = min(node.lineno, *(d.lineno for d in node.decorator_list)) if node.decorator_list else node.lineno
    return lines[first - 1 : node.end_lineno], node.lineno - first, node.col_offset, node.end_col_offset


def _paired_of(before: str | None, after: str | None) -> list[dict] | None:
    """Functions of both texts; null if one of the texts cannot be read. Code is
    written out for those alone, and once for a function that stays."""
    if before is None or after is None:
        return None
    trees = [_parse(text)[0] for text in (before, after)]
    if None in trees:
        return None
    old, new = (_named_functions(tree) for tree in trees)
    was, now = (_LINE_ENDS.split(text) for text in (before, after))
    rows = []
    for name, node in old.items():
        other = new.get(name)
        code = None if other is None else _code_of(name, node)
        if code is not None:
            later = code if _written(node, was) == _written(other, now) else _code_of(name, other)
            if later is not None:
                rows.append({"func_name": name, "before_code": code, "after_code": later})
    return rows


_PAIRED_TYPE = pa.list_(pa.struct([(f, pa.string()) for f in ("func_name", "before_code", "after_code")]))


def _paired_batch(before: pa.Array, after: pa.Array) -> pa.Array:
    with _unswept():
        both = zip(before.to_pylist(), after.to_pylist(), strict=True)
        return pa.array([_paired_of(b, a) for b, a in both], _PAIRED_TYPE)


def paired_functions_of(before: Column | str, after: Column | str) -> Column:
    """``array<struct<func_name, before_code, after_code>>``: the functions of two
    texts that both have; null if one cannot be read."""
    kernel = _kernel(_paired_batch, "array<struct<func_name:string,before_code:string,after_code:string>>")
    return kernel(strip_nul(before), strip_nul(after))


# ---- tokens of a function -------------------------------------------------

def _marks(tree: ast.AST, code: str) -> dict:
    """(row, column) of a token -> (visit order, class, values).

    Visit order is preorder with a node's own name before its children, so an
    attribute comes before its object. Names behind a keyword (def, class,
    global, nonlocal) are marked at that keyword.
    """
    marks: dict = {}
    lines = None if code.isascii() else _LINE_ENDS.split(code)

    def put(row: int, byte: int, order: int, cls: str, values: list[str]) -> None:
        col = byte if lines is None else len(lines[row - 1].encode()[:byte].decode())
        marks[row, col] = (order, cls, values)

    todo, order = [tree], 0
    while todo:
        node = todo.pop()
        kind = node.__class__
        order += 1
        if kind is ast.Name:
            put(node.lineno, node.col_offset, order, "identifier", [node.id])
            continue
        if kind is ast.Attribute:
            width = len(node.attr.encode())
            put(node.end_lineno, node.end_col_offset - width, order, "identifier", [node.attr])
            todo.append(node.value)
            continue
        if kind is ast.Constant:
            literal = _KINDS.get(type(node.value))
            if literal:
                value = node.value if literal == "string" else repr(node.value)
                put(node.lineno, node.col_offset, order, literal, [value])
            continue
        if kind is ast.JoinedStr:
            put(node.lineno, node.col_offset, order, "f_string", [""])
            continue
        if isinstance(node, (*_FUNCTIONS, ast.ClassDef)):
            put(node.lineno, node.col_offset, order, "named", [node.name])
        elif isinstance(node, (ast.Global, ast.Nonlocal)):
            put(node.lineno, node.col_offset, order, "listed", list(node.names))
            order += len(node.names)
        elif isinstance(node, ast.arg):
            put(node.lineno, node.col_offset, order, "identifier", [node.arg])
        inside = _children(node)
        inside.reverse()
        todo += inside
    return marks


_OPENING = frozenset(getattr(tokenize, n, -1) for n in ("FSTRING_START", "TSTRING_START"))
_CLOSING = frozenset(getattr(tokenize, n, -1) for n in ("FSTRING_END", "TSTRING_END"))


def _plain_tokens(code: str):
    """Tokens with each f-string as one token."""
    depth, start = 0, None
    for kind, text, begin, end, _ in tokenize.generate_tokens(io.StringIO(code).readline):
        if kind in _OPENING:
            start = start if depth else begin
            depth += 1
        elif kind in _CLOSING:
            depth -= 1
            if depth == 0:
                (r0, c0), (r1, c1) = start, end
                body = io.StringIO(code).readlines()[r0 - 1 : r1]
                body[-1] = body[-1][:c1]
                body[0] = body[0][c0:]
                yield tokenize.STRING, "".join(body), start, end
        elif depth == 0:
            yield kind, text, begin, end


_MARKERS = {
    tokenize.NEWLINE: "$NEWLINE",
    tokenize.INDENT: "$INDENT",
    tokenize.DEDENT: "$DEDENT",
}
_TOKEN_FIELDS = ("token", "cls", "value", "visit", "gap")


def _scan(code: str | None, max_tokens: int | None, keep_nl: bool) -> tuple[str | None, list[tuple]]:
    """The reason why not, or the tokens as tuples of ``_TOKEN_FIELDS``."""
    if code is None:
        return "missing", []
    tree, error = _parse(code)
    if error:
        return error, []
    out: list[tuple] = []
    pending: list[tuple] = []
    last = None
    try:
        marks = _marks(tree, code)
        for kind, text, start, end in _plain_tokens(code):
            if kind in (tokenize.NL, tokenize.COMMENT) and not keep_nl:
                continue
            if max_tokens is not None and len(out) == max_tokens:
                return "TooManyTokens", []
            marker = "$NEWLINE" if kind == tokenize.NL else _MARKERS.get(kind)
            if marker:
                out.append((marker, None, None, None, 0))
                last = end
                continue
            gap = 0 if last is None else 1 if start[0] > last[0] else start[1] - last[1]
            cls = value = visit = None
            mark = marks.get(start)
            if mark and mark[1] in ("named", "listed"):
                pending = [(mark[0] + k, v) for k, v in enumerate(mark[2])]
            elif mark:
                visit, cls, value = mark[0], mark[1], text if mark[1] == "f_string" else mark[2][0]
            elif pending and kind == tokenize.NAME and text == pending[0][1]:
                visit, cls, value = pending.pop(0)[0], "identifier", text
            out.append((text, cls, value, visit, gap))
            last = end
    except (tokenize.TokenError, *_UNREADABLE) as e:
        return type(e).__name__, []
    if not keep_nl and any("\n" in r[0] for r in out):
        return "MultilineToken", []
    values = "".join([r[2] for r in out if r[2]])
    try:
        if not values.isascii():
            values.encode("utf-8")
    except UnicodeEncodeError:
        return "UnicodeEncodeError", []
    return None, out


def _tokens_of(code: str | None, max_tokens: int | None, keep_nl: bool) -> dict:
    error, tokens = _scan(code, max_tokens, keep_nl)
    return {"error": error, "tokens": [dict(zip(_TOKEN_FIELDS, t, strict=True)) for t in tokens]}


_TOKEN_TYPE = pa.struct(
    [("token", pa.string()), ("cls", pa.string()), ("value", pa.string()), ("visit", pa.int32()), ("gap", pa.int32())]
)


def _tokens_batch(codes: pa.Array, max_tokens: int | None, keep_nl: bool) -> pa.Array:
    with _unswept():
        found = [_scan(c, max_tokens, keep_nl) for c in codes.to_pylist()]
        ends, rows = [0], []
        for _, tokens in found:
            rows += tokens
            ends.append(len(rows))
        columns = list(zip(*rows, strict=True)) or [()] * len(_TOKEN_FIELDS)
        fields = [pa.array(c, t.type) for c, t in zip(columns, _TOKEN_TYPE, strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_TOKEN_TYPE)))
        errors = pa.array([error for error, _ in found], pa.string())
        return pa.StructArray.from_arrays([errors, lists], ["error", "tokens"])


def tokens_of(
    code: Column | str, max_tokens: int | None = None, keep_nl: bool = False
) -> Column:
    """``struct<error, tokens: array<struct<token, cls, value, visit, gap>>>``.

    Line ends and indentation become markers; comments and blank lines are
    dropped unless ``keep_nl``, which also keeps strings of several lines as
    they are. ``gap`` counts the blanks before a token.
    Longer code than ``max_tokens`` comes back with error TooManyTokens.
    """

    def batch(codes: pa.Array) -> pa.Array:
        return _tokens_batch(codes, max_tokens, keep_nl)

    kernel = _kernel(
        batch,
        "error string, tokens array<struct<token:string,cls:string,value:string,"
        "visit:int,gap:int>>",
    )
    return kernel(code)


def lines_of(code: Column | str, max_tokens: int | None = None) -> Column:
    """The tokens of ``tokens_of`` joined by blanks; null if they have an error."""

    def batch(codes: pa.Array) -> pa.Array:
        with _unswept():
            found = [_scan(c, max_tokens, False) for c in codes.to_pylist()]
            return pa.array([None if error else " ".join([t[0] for t in tokens]) for error, tokens in found], pa.string())

    return _kernel(batch, "string")(code)


# ---- identifiers and literals of a file ----------------------------------

_KINDS = {int: "int", float: "float", str: "string"}


def _values_of(text: str | None) -> dict:
    try:
        return _found_values(text)
    except ValueError as error:  # a number of too many digits to be written
        return {"error": str(error), "items": []}


def _found_values(text: str | None) -> dict:
    if text is None:
        return {"error": "missing", "items": []}
    tree, error = _parse(text)
    if error:
        return {"error": error, "items": []}
    items, queue = [], [tree]
    for node in queue:
        kind = node.__class__
        if kind is ast.Name:
            items.append(("identifier", node.id))
            continue
        if kind is ast.Constant:
            literal = _KINDS.get(type(node.value))
            if literal:
                items.append((literal, node.value if literal == "string" else repr(node.value)))
            continue
        if kind is ast.Attribute:
            items.append(("identifier", node.attr))
        elif isinstance(node, (*_FUNCTIONS, ast.ClassDef)):
            items.append(("identifier", node.name))
        elif isinstance(node, ast.arg):
            items.append(("identifier", node.arg))
        elif isinstance(node, (ast.Global, ast.Nonlocal)):
            items.extend(("identifier", n) for n in node.names)
        queue += _children(node)
    good = []
    for cls, value in items:
        try:
            if not value.isascii():
                value.encode("utf-8")
            good.append({"cls": cls, "value": value})
        except UnicodeEncodeError:
            continue
    return {"error": None, "items": good}


_VALUES_TYPE = pa.struct(
    [
        ("error", pa.string()),
        ("items", pa.list_(pa.struct([("cls", pa.string()), ("value", pa.string())]))),
    ]
)


def _values_batch(text: pa.Array) -> pa.Array:
    with _unswept():
        return pa.array([_values_of(x) for x in text.to_pylist()], _VALUES_TYPE)


def values_of(text: Column | str) -> Column:
    """``struct<error, items: array<struct<cls, value>>>`` of a whole file."""
    kernel = _kernel(
        _values_batch, "error string, items array<struct<cls:string,value:string>>"
    )
    return kernel(strip_nul(text))
