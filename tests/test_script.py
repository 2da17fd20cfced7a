"""Edit scripts, and rows that operators must keep."""

from __future__ import annotations

import time

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import script
from palimpsest.functions.lcs import lcs_length
from palimpsest.functions.script import DELETE, INSERT, MOVE, UPDATE, edit_script
from palimpsest.operators import abstraction as A
from palimpsest.operators import code as C
from palimpsest.operators import rouge, vocab
from palimpsest.operators.entries import change_entries
from palimpsest.session import fits_broadcast
from palimpsest.sources.lines import read_mapping

words = st.lists(st.sampled_from("abcd"), max_size=14)


@given(words, words)
def test_a_script_turns_one_list_into_the_other(before, after):
    script = edit_script(before, after)
    gone = {e["before_pos"] for e in script if e["before_pos"] is not None}
    new = {e["after_pos"] for e in script if e["after_pos"] is not None}
    assert [t for i, t in enumerate(before) if i not in gone] == [
        t for j, t in enumerate(after) if j not in new
    ]
    assert len(before) - len(gone) == lcs_length(before, after)
    for e in script:
        assert e["before"] == (None if e["before_pos"] is None else before[e["before_pos"]])
        assert e["after"] == (None if e["after_pos"] is None else after[e["after_pos"]])
        assert (e["before"] == e["after"]) == (e["action"] == MOVE)
        assert (e["before"] is None) == (e["action"] == INSERT)
        assert (e["after"] is None) == (e["action"] == DELETE)


def test_known_scripts():
    def actions(b, a):
        return [e["action"] for e in edit_script(b.split(), a.split())]

    assert actions("a b c", "n a b c") == [INSERT]
    assert actions("a b c", "c a b") == [MOVE]
    assert actions("a b c", "a x c") == [UPDATE]
    assert actions("a b c", "b c") == [DELETE]
    assert actions("a b c", "a b c") == []
    assert edit_script(None, ["a"])[0]["action"] == INSERT


@pytest.mark.parametrize("limit", [1000, 1])
def test_encode_keeps_every_row(spark, monkeypatch, limit):
    monkeypatch.setattr("palimpsest.session.BROADCAST_ROWS", limit)
    v = vocab.build_vocab(spark.createDataFrame([("a a b",)], "t string").select(F.split("t", " ").alias("w")), "w")
    rows = [(1, ["b", "a", "z"]), (2, []), (3, None), (4, ["a", None]), (4, ["a"]), (None, ["b"])]
    df = spark.createDataFrame(rows, "k long, w array<string>")
    found = vocab.encode(df, "k", "w", v).collect()
    assert sorted(((r["k"] or 0), r["ids"]) for r in found) == [
        (0, [1]), (1, [1, 0, 2]), (2, []), (3, []), (4, [0]), (4, [0, 2]),
    ]


def test_a_pair_without_placeholders_has_empty_maps(spark):
    pairs = spark.createDataFrame([("p",), ("q",)], "pair_id string")
    rows = spark.createDataFrame([("p", "int", "INT_0", "7")], "pair_id string, cls string, placeholder string, value string")
    maps = A.replacement_maps(rows, pairs).withColumn("t", F.array(F.lit("INT_0"), F.lit("x")))
    out = {r["pair_id"]: r["t"] for r in maps.select("pair_id", A.restore("t", "replacement_map").alias("t")).collect()}
    assert out == {"p": ["7", "x"], "q": ["INT_0", "x"]}


def test_entries_of_one_name_stay_apart(spark):
    def change(after):
        return ("r", "s", "f.py", "def f(a):\n    return 1\n", f"def f(a):\n    return {after}\n")

    schema = "repository string, commit_after string, file_after string, code_before string, code_after string"
    changes = spark.createDataFrame([change("a, 1"), change("2, 3, 4"), change("2, 3, 4")], schema)
    none = spark.createDataFrame([], "cls string, value string, count long")
    rows = change_entries(changes, none).collect()
    assert len(rows) == 3 and {r["name"] for r in rows} == {"r:s:f.py:f"}
    assert sorted(len(r["edit_actions"]) for r in rows) == [4, 7, 7]  # the texts are unparsed trees: (a, 1)


def test_one_line_keeps_strings_of_several_lines(spark):
    df = spark.createDataFrame([('x = """a\nb"""\n',)], "code string")
    assert df.select(C.spaced_one_line("code")).first()[0] == 'x = """a\nb""" $NEWLINE  '


def test_many_functions_and_long_texts_take_linear_time(spark):
    def code(n):
        return "".join(f"def f{i}():\n    return {i}\n" for i in range(n))

    def pairs(n):
        df = spark.createDataFrame([(code(n), code(n))], "code_before string, code_after string")
        start = time.time()
        assert C.pair_functions(df).count() == n
        return time.time() - start

    pairs(10)
    assert pairs(4000) < 3 * pairs(2000) + 1

    def bigrams(n):
        text = " ".join(f"w{i}" for i in range(n))
        df = spark.createDataFrame([(text, text)], "h string, r string")
        start = time.time()
        assert rouge.with_rouge_n(df, "h", "r", 2).first()["rouge_2_p"] == 1.0
        return time.time() - start

    bigrams(10)
    assert bigrams(8000) < 3 * bigrams(4000) + 1


def test_an_empty_side_scores_zero(spark):
    df = spark.createDataFrame([([], ["a b"]), (["a"], []), (["a b"], ["a b"])], "h array<string>, r array<string>")
    rows = rouge.with_rouge_l_summary(df, "h", "r").collect()
    assert [round(r["rouge_lsum_f"], 3) for r in rows][:2] == [0.0, 0.0]


def test_a_mapping_file_is_read(spark, tmp_path):
    (tmp_path / "map.txt").write_text("a\t x \n b \ty\tmore\na\tz\n")
    rows = read_mapping(spark, str(tmp_path / "map.txt")).collect()
    assert sorted((r["source"], r["target"]) for r in rows) == [("a", "z"), ("b", "y")]


def test_few_rows_of_many_bytes_are_not_sent(spark, monkeypatch):
    df = spark.createDataFrame([("x" * 500, b"y"), (None, None)], "t string, b binary")
    assert fits_broadcast(df) and fits_broadcast(df.limit(0))
    monkeypatch.setattr("palimpsest.session.BROADCAST_BYTES", 400)
    assert not fits_broadcast(df)


@given(words, words)
def test_both_ways_to_align_agree(before, after):
    from palimpsest.functions import lcs, script

    table = [[0] * (len(after) + 1) for _ in range(len(before) + 1)]
    for i, x in enumerate(before):
        for j, y in enumerate(after):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    found = lcs.common_places(before, after)
    assert found == script._common(before, after)
    assert len(found) == table[-1][-1]
    kept, i, j = set(), len(before), len(after)
    while i and j:
        if before[i - 1] == after[j - 1]:
            kept.add(before[i - 1])
            i, j = i - 1, j - 1
        elif table[i - 1][j] > table[i][j - 1]:
            i -= 1
        else:
            j -= 1
    assert lcs.lcs_words(before, after) == kept


def test_long_unlike_lists_take_little_time_and_memory():
    import random
    import tracemalloc

    from palimpsest.functions.lcs import lcs_words

    draw = random.Random(1)
    unlike = [str(i) for i in range(20_000)], [str(-i - 1) for i in range(20_000)]
    mixed = tuple([str(draw.randrange(500)) for _ in range(20_000)] for _ in range(2))
    for before, after in (unlike, mixed):
        start = time.perf_counter()
        tracemalloc.start()
        script = edit_script(before, after)
        lcs_words(before, after)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 200 << 20 and time.perf_counter() - start < 60
        gone = {e["before_pos"] for e in script if e["before_pos"] is not None}
        new = {e["after_pos"] for e in script if e["after_pos"] is not None}
        assert [t for i, t in enumerate(before) if i not in gone] == [
            t for j, t in enumerate(after) if j not in new
        ]


def test_a_batch_is_met_a_few_pairs_at_a_time(monkeypatch):
    monkeypatch.setattr(script, "_SLICE_TOKENS", 5)
    before = pa.array([["a", "b"], None, ["c"] * 9, [], ["d"], ["a", "b", "c"]], pa.list_(pa.string()))
    after = pa.array([["a"], ["x", "y"], ["c"], [], ["e"], ["c", "a", "b"]], pa.list_(pa.string()))
    pairs = list(zip(before.to_pylist(), after.to_pylist(), strict=True))
    some = [list(s) for s in script._slices(before, after)]
    assert len(some) > 2 and sum(some, []) == pairs
    whole = [script.edit_script(b, a) for b, a in pairs]
    assert script._scripts(before, after).to_pylist() == whole
    assert script._actions(before, after).to_pylist() == [[e["action"] for e in s] for s in whole]
    assert len(script._actions(before[:0], after[:0])) == 0
    # A slice of a larger batch and a batch without a null.
    assert script._actions(before[2:], after[2:]).to_pylist() == [[e["action"] for e in s] for s in whole[2:]]
