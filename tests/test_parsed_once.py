"""Source texts are parsed, written out and cut into tokens no more than needed."""

import ast

from pyspark.sql import functions as F

from palimpsest.functions import pycode as P
from palimpsest.operators import code as C
from palimpsest.operators.entries import change_entries

BEFORE = """
import os

@property
def same(x):
    "text"
    return [x, 'é']

class A:
    def same(self):
        return 1.0
    async def changed(self, k=1):
        if k:
            "only text"
        else:
            return f'{k!r:>{k}}'
    def same(self):
        return 'second'

def gone():
    pass
"""
AFTER = BEFORE.replace("k=1", "k=2").replace("gone", "came").replace("import os\n", "import os, sys\n\n\n")


def _pairs(before, after):
    b, a = ({f["name"]: f["code"] for f in P._functions_of(x)["functions"]} for x in (before, after))
    return [{"func_name": n, "before_code": c, "after_code": a[n]} for n, c in b.items() if n in a]


def test_functions_that_stay_are_written_out_once(monkeypatch):
    want, written, unparse = _pairs(BEFORE, AFTER), [], ast.unparse
    monkeypatch.setattr(ast, "unparse", lambda node: written.append(node.name) or unparse(node))
    assert P._paired_of(BEFORE, AFTER) == want and [p["func_name"] for p in want] == ["same", "A.same", "A.changed"]
    assert written == ["same", "same", "changed", "changed"]


def test_functions_that_only_look_alike_are_told_apart():
    # The same lines at another depth, and another decorator above them.
    moved = "class A:\n    def f(self):\n        return 1\n"
    for before, after in ((moved, moved.replace("return 1", "return 2")), ("@a\ndef f():\n    x()\n", "@b\ndef f():\n    x()\n"),
                          ("def f(): return 'a'; y\n", "def f(): return 'a'; z\n")):
        assert P._paired_of(before, after) == _pairs(before, after)
        assert all(p["before_code"] != p["after_code"] for p in P._paired_of(before, after))
    assert P._paired_of("def f(:", moved) is None and P._paired_of(None, moved) is None


def test_code_of_one_line_is_cut_once(spark):
    rows = spark.createDataFrame([("def f(a):\n    return a",), ("def f(",), (None,)], "code string")
    out = rows.select(C.one_line_code("code").alias("line"))
    assert [r["line"] for r in out.collect()] == [
        "def f ( a ) : $NEWLINE $INDENT return a $NEWLINE $DEDENT ", None, None]
    assert "pythonUDF1" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_number_too_long_to_write_is_an_error_of_its_row():
    assert P._tokens_of("x = 0x" + "f" * 20000, None, False) == {"error": "ValueError", "tokens": []}


def test_functions_that_stay_are_not_cut_into_tokens(spark):
    changes = spark.createDataFrame([("r", "c", "f.py", BEFORE, AFTER)],
                                    "repository string, commit_after string, file_after string, code_before string, code_after string")
    idioms = spark.createDataFrame([], "cls string, value string, count long, rank int")
    out = change_entries(changes, idioms, idiom_rows_at_most=0)
    stored = [f for f in out.inputFiles() if "function-pairs" in f]
    assert [r["name"] for r in out.collect()] == ["r:c:f.py:A.changed"]
    assert spark.read.parquet(*stored).select(F.col("name")).count() == 1
