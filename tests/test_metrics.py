import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.lcs import lcs_length, lcs_words
from palimpsest.functions.text import strip_bpe
from palimpsest.operators import bleu, classify, metric, rouge

HYPS = ["The brown fox jumps over the dog 笑", "The brown fox jumps over the dog 2 笑"]
REF = "The quick brown fox jumps over the lazy dog 笑"


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, h, r) for i, (h, r) in enumerate(rows)], "id long, hyp string, ref string"
    )


def test_corpus_bleu(spark):
    df = frame(spark, [(h, REF) for h in HYPS])
    assert bleu.corpus_bleu(df, "hyp", ["ref"]).first()["bleu"] == pytest.approx(46.51, abs=0.005)


def test_corpus_bleu_lowercase(spark):
    df = frame(spark, [(h.replace("the dog", "The Dog"), REF) for h in HYPS])
    score = bleu.corpus_bleu(df, "hyp", ["ref"], lowercase=True).first()["bleu"]
    assert score == pytest.approx(46.51, abs=0.005)


@pytest.mark.parametrize("rows", [[], [("", "a b c d")], [("A", "B")]])
def test_bleu_of_nothing_in_common(spark, rows):
    assert bleu.corpus_bleu(frame(spark, rows), "hyp", ["ref"]).first()["bleu"] == 0.0


def test_bleu_of_equal_text(spark):
    assert bleu.corpus_bleu(frame(spark, [(REF, REF)]), "hyp", ["ref"]).first()["bleu"] == pytest.approx(100)


def test_bleu_reference_length_tie_takes_the_shorter(spark):
    df = spark.createDataFrame([("a b c", "a b", "a b c d")], "hyp string, r1 string, r2 string")
    assert bleu.pair_counts(df, "hyp", ["r1", "r2"]).first()["ref_len"] == 2


def test_running_bleu(spark):
    df = frame(spark, [("A B C D E F", "A B C D E F"), ("A B C D E F", "A B A D E F")])
    scores = [r["bleu"] for r in bleu.running_bleu(df, "id", "hyp", ["ref"]).orderBy("id").collect()]
    assert scores == pytest.approx([100.0, 69.19], abs=0.005)


def test_rouge_running_and_zero(spark):
    df = frame(spark, [("A B C D E F", "A B C D E F"), ("A B C D E F", "A B A D E F")])
    for n, expected in ((1, 0.954), (2, 0.8)):
        rows = metric.rouge_n_metric(n).running(df, "id", "hyp", "ref").orderBy("id").collect()
        assert [r[1] for r in rows] == pytest.approx([1.0, expected], abs=0.005)
    none = rouge.rouge_report(frame(spark, [("A", "B")]), "hyp", "ref").first()
    assert all(v == 0 for v in none)


def test_rouge_report(spark):
    row = rouge.rouge_report(frame(spark, [(h, REF) for h in HYPS]), "hyp", "ref").first()
    assert row["rouge_1_f"] == pytest.approx(0.865, abs=0.005)
    assert row["rouge_2_f"] == pytest.approx(0.548, abs=0.005)
    assert row["rouge_l_f"] == pytest.approx(0.852, abs=0.005)


def textbook_lcs(x, y):
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_lcs_against_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        x = [rng.choice("abcd") for _ in range(rng.randint(0, 20))]
        y = [rng.choice("abcd") for _ in range(rng.randint(0, 20))]
        assert lcs_length(x, y) == lcs_length(y, x) == textbook_lcs(x, y)
        assert len(lcs_words(x, y)) <= textbook_lcs(x, y)


def test_rouge_l_summary_union(spark):
    # The union of "w1 w2" and "w1 w3 w5" has 4 words; the sequences have 5.
    df = spark.createDataFrame(
        [(["w1 w2 w6 w7 w8", "w1 w3 w8 w9 w5"], ["w1 w2 w3 w4 w5"]), (["x"], ["y"])],
        "h array<string>, r array<string>",
    )
    rows = rouge.with_rouge_l_summary(df, "h", "r").collect()
    assert rows[0]["rouge_lsum_r"] == pytest.approx(0.8 / 5)
    assert rows[0]["rouge_lsum_p"] == pytest.approx(0.8 / 10)
    assert rows[1]["rouge_lsum_f"] == 0


def test_postprocessing_hook(spark):
    df = frame(spark, [("th@@ e cat sat do@@ wn", "the c@@ at sat down")])
    score = metric.bleu_metric(strip_bpe).corpus(df, "hyp", "ref").first()["bleu"]
    assert score == pytest.approx(100)


def test_classification(spark):
    df = spark.createDataFrame(
        [("t", "s", "t "), ("s", "s", "t"), ("x", "s", "t")], "hyp string, src string, tgt string"
    )
    row = classify.classify_greedy(df, "hyp", "src", "tgt").first()
    assert (row["perfect"], row["bad"], row["changed"], row["perfect_rate"]) == (1, 1, 1, 33.33)
    beams = spark.createDataFrame(
        [("t <SEP> s <SEP> x", "s", "t"), ("s <SEP> s", "s", "t")], "b string, src string, tgt string"
    )
    row = classify.classify_beams(beams, "b", "src", "tgt").first()
    assert tuple(row) == (1, 1, 3, 0.5, 1)


def test_masked_loss(spark):
    df = spark.createDataFrame([([1.0, 2.0, 9.0], 3), ([4.0, 9.0, 9.0], 2)], "l array<double>, n int")
    row = classify.masked_loss_of_arrays(df, "l", "n").first()
    assert row["positions"] == 3 and row["log_perplexity"] == pytest.approx(7 / 3)
