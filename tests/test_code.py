from palimpsest.functions import pycode as P
from palimpsest.operators import abstraction as A
from palimpsest.operators import code as C
from palimpsest.operators import edits as E
from palimpsest.operators.entries import change_entries

SOURCE = '''
"""doc"""
if True:
    def early(): return 1
async def early(x): pass
class Out:
    "doc"
    class In:
        def m(self):
            "doc"
            3
            ...
            def hidden(): pass
            return lambda: 0
    def early(self): 1.5
'''


def test_functions_of_a_file():
    found = {f["name"]: f["code"] for f in P._functions_of(SOURCE)["functions"]}
    assert set(found) == {"early", "Out.In.m", "Out.early"}
    assert found["early"] == "def early():\n    return 1"
    assert found["Out.early"] == "def early(self):\n    pass"
    assert '"doc"' not in found["Out.In.m"] and "..." in found["Out.In.m"]


def test_quarantine(spark):
    rows = [(1, "def f(:"), (2, "def f(): pass\0"), (3, None), (4, "x = " + "(" * 500)]
    df = spark.createDataFrame(rows, "id long, text string")
    assert {r["id"] for r in C.unreadable_files(df, "text", "id").collect()} == {1, 3, 4}
    assert [r["id"] for r in C.function_table(df, "text", "id").collect()] == [2]


def test_tokens():
    code = "def f(a):\n    # note\n\n    return a + f'{a} {b!r}' % 'é' . join(g.h)"
    out = P._tokens_of(code, None, False)["tokens"]
    assert [t["token"] for t in out] == [
        "def", "f", "(", "a", ")", ":", "$NEWLINE", "$INDENT", "return", "a", "+", "f'{a} {b!r}'", "%",
        "'é'", ".", "join", "(", "g", ".", "h", ")", "$NEWLINE", "$DEDENT", ""]
    named = {t["value"]: t for t in out if t["cls"] == "identifier"}
    # An attribute is visited before its object.
    assert named["h"]["visit"] < named["g"]["visit"]
    assert next(t for t in out if t["token"] == "'é'")["cls"] == "string"
    assert next(t for t in out if t["token"].startswith("f'"))["cls"] == "f_string"
    assert P._tokens_of(code, 24, False)["error"] is None
    assert P._tokens_of(code, 23, False)["error"] == "TooManyTokens"


def test_names_that_are_not_abstracted():
    code = "def f(x):\n    import os.path as p\n    global q\n    return g(key=x, flag=True, raw=b'1')"
    out = P._tokens_of(code, None, False)["tokens"]
    marked = [(t["token"], t["cls"]) for t in out if t["cls"]]
    assert marked == [("f", "identifier"), ("x", "identifier"), ("q", "identifier"), ("g", "identifier"), ("x", "identifier")]


def test_spaced_line(spark):
    df = spark.createDataFrame([("def f(a):\n    # c\n    return a\n",)], "code string")
    line = df.select(C.spaced_one_line("code")).first()[0]
    assert line == "def f(a): $NEWLINE  # c $NEWLINE  $INDENT return a $NEWLINE  $DEDENT "


def table(spark, before, after):
    df = spark.createDataFrame([("p", before, after)], "k string, before_code string, after_code string")
    return A.pair_token_table(df, "k")


def idioms(spark, *rows):
    return spark.createDataFrame(list(rows), "cls string, value string, count long")


def test_placeholders_skip_used_names_and_share_sides(spark):
    tokens = table(spark, "def IDENTIFIER_1(a):\n    return a.b(INT_0, 1)", "def IDENTIFIER_1(a):\n    return c.b(INT_0, 2, 1)")
    # 1 as an identifier idiom does not cover the number 1, nor does the string.
    flagged = A.with_idiom_flag(tokens, idioms(spark, ("identifier", "1", 9), ("string", "1", 9)), 2)
    lines = A.pair_lines(A.number_placeholders(flagged)).first()
    assert lines["before"] == (
        "def IDENTIFIER_0 ( IDENTIFIER_2 ) : $NEWLINE $INDENT return IDENTIFIER_2 . IDENTIFIER_3 ( IDENTIFIER_4 , INT_1 ) $NEWLINE $DEDENT ")
    assert lines["after"] == (
        "def IDENTIFIER_0 ( IDENTIFIER_2 ) : $NEWLINE $INDENT return IDENTIFIER_5 . IDENTIFIER_3 ( IDENTIFIER_4 , INT_2 , INT_1 ) $NEWLINE $DEDENT ")


def test_restore_gives_the_tokens_back(spark):
    tokens = table(spark, "def f(a):\n    return 1.5 + g(a, 7)", "def f(a):\n    return 2.5 + g(a, 7)")
    numbered = A.number_placeholders(A.with_idiom_flag(tokens, idioms(spark, ("int", "7", 1)), 1))
    maps = A.replacement_maps(A.replacement_rows(numbered))
    rows = numbered.filter("side = 'after'").join(maps, "pair_id").selectExpr("*", "array(normalized) AS n")
    for r in rows.select("token", A.restore("n", "replacement_map").alias("r")).collect():
        assert r["r"] == [r["token"]]


def test_string_idioms_with_blanks_are_ignored(spark):
    kept = A.usable_idioms(idioms(spark, ("string", "a b", 1), ("string", "ab", 1), ("identifier", "x", 1)))
    assert {r["value"] for r in kept.collect()} == {"ab", "x"}


def test_change_entries_drop_rules(spark):
    def changed(name, before, after):
        return ("r", "c", name, before, after)

    long = "def f():\n    return [" + "a, " * 40 + "]"
    df = spark.createDataFrame(
        [
            changed("ok", "def f(x):\n    return x + 1", "def f(x):\n    return x - 1\ndef new(): pass"),
            changed("same", "def f(x):\n    return x", "def f(x):\n    'doc'\n    return x  # note"),
            changed("long", long, long.replace("[", "[b, ")),
            changed("broken", "def f(:", "def f(): pass"),
        ],
        "repository string, commit_after string, file_after string, code_before string, code_after string",
    )
    rows = change_entries(df, idioms(spark, ("identifier", "zz", 1)), idiom_rows_at_most=1).collect()
    assert [r["name"] for r in rows] == ["r:c:ok:f"]
    assert rows[0]["edit_actions"] == ["update-node"]
    assert rows[0]["replacement_map"]["ints"] == {"INT_0": "1"}


def test_edits(spark):
    rows = [("before", p, w) for p, w in enumerate("a b c".split())] + [
        ("after", p, w) for p, w in enumerate("b a c d".split())]
    df = spark.createDataFrame([(1, *r) for r in rows], "pair_id long, side string, pos int, token string")
    assert {(r["token"], r["action"]) for r in E.bag_edits(df).collect()} == {("d", "insert-node")}
    arrays = E.token_arrays(df)
    assert arrays.first().asDict() == {"pair_id": 1, "before": ["a", "b", "c"], "after": ["b", "a", "c", "d"]}
    actions = E.edit_sequences(arrays, "pair_id", "before", "after").first()["edit_actions"]
    assert actions == ["move-tree", "insert-node"]
    assert {r["token"] for r in E.moves(df).collect()} == {"a", "b"}
