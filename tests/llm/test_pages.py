"""Operators on pages, and the pipeline, against brute force."""

from __future__ import annotations

import random

import pytest

from palimpsest.llm import markup, pagediff, urltree
from palimpsest.llm.queries import QUERIES, RULES


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")


def test_common_lines_are_a_longest_common_subsequence():
    draw = random.Random(4)
    for _ in range(300):
        a, b = ([draw.randint(0, 6) for _ in range(draw.randint(0, 14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = pagediff.common_lines(a, b)
        at = 0
        for i in got:
            at = b.index(a[i], at) + 1
        assert got == sorted(set(got)) and len(got) == best[-1][-1]


def text(html):
    return [x.text for x in markup.lines(html)]


def test_marked_blocks_are_left_out():
    html = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav>Menu</nav><div class="cookie-notice">We use cookies</div>
    <article><header><h1>A &amp; B</h1><span>by X</span></header><p><b>One  <i>two</i><br>three<p>Four
    &lt;five&gt; a < b</p><script>var t="</p>";</script><form><p>Sign up</p></form><!-- no <p>x</p> -->
    <ul><li>item<li>next</ul><div class="ad">Buy</div><section id="comments"><p>Nice</p></section></article>
    <aside>More</aside><footer>&copy;</footer></body>"""
    assert text(html) == ["A & B", "One two three", "Four <five> a < b", "item", "next"]
    assert text(None) == text("") == text("<div hidden>x</div>") == []
    assert text("plain &eacute; text<p>more<p class=") == ["plain é text", "more"]
    assert text('<div class="main-banner-wrap"><p>All there is</p></div>') == ["All there is"]


def test_main_text_stays_beside_an_article():
    html = """<body><div>Site</div><main><h1>Head</h1><p>The whole body of the page.</p>
    <article><p>A teaser card</p></article></main></body>"""
    assert text(html) == ["Head", "The whole body of the page.", "A teaser card"]
    assert [x.prose for x in markup.lines(html)] == [False, False, True]
    assert text('<div class="post-content"><p>One</p><main><p>Two</p></main></div>out') == ["One", "Two"]


def test_shared_lines_go_but_not_from_articles_or_copies(spark):
    def plain(i):
        return f"<div>Home of things</div><p>Only page {i} says so, at some length.</p><p>Follow us all day here</p>"

    rows = [(i, f"http://h.org/a/{i}", plain(i)) for i in range(6)]
    rows += [(10 + i, f"http://g.org/{i}", "<article><p>The same passage twice</p><div>Share</div></article>" + "x" * i) for i in range(2)]
    rows += [(20 + i, "http://c.org/same", "<div>A copied page of some words</div><div>Go</div>") for i in range(3)]
    rows += [(30, None, None), (31, "no host", ""), (None, "http://h.org/a/0", plain(0))]
    got = pagediff.main_text(pages(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    found = {r["page_id"]: r["text"] for r in got}
    for i in range(6):
        assert found[i] == f"Only page {i} says so, at some length."
    assert found[10].startswith("The same passage twice") and found[30] == found[31] == ""
    assert "A copied page of some words" in found[20]
    assert pagediff.main_text(pages(spark, [])).count() == 0


def plain_verdict(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    rest = rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [
        (len(r.name), r.name, r.verdict)
        for r in RULES
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    _, name, verdict = max(fits, default=(0, None, None))
    return host, path, name, verdict


URLS = [
    None, "", "nohost", "http://", "HTTP://A.ÉX.NET/x?y#z", "http://example.net/en/1", "http://a.example.net/en",
    "http://example.com/de/2#q", "http://m.example.com/de/x://y", "https://org/fr/", "https://x.org/fr/a/b?c=/d",
    "https://xorg/fr/", "ftp://badexample.com/de/", "http://example.net?x=/en/", "http://x.org#/fr/", "a://b://c.net/",
]


def test_rules_against_plain_python(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)] * 2
    got = urltree.filter_urls(pages(spark, rows), RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, name, verdict = plain_verdict(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, name)
        assert r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)
    assert urltree.filter_urls(pages(spark, []), RULES).count() == 0


def test_templates_reject_by_smoothed_purity(spark):
    rows = [(i, f"http://h.org/shop/{i}/buy", None) for i in range(40)]
    rows += [(100 + i, f"http://h.org/news/title-{i}", None) for i in range(40)]
    rows += [(200 + i, f"http://h.org/news/{chr(97 + i)}{chr(110 - i)}x", None) for i in range(25)]
    labels = spark.createDataFrame(
        [(f"http://h.org/shop/{i}/buy", 1) for i in range(10)]
        + [(f"http://h.org/news/title-{i}", 0) for i in range(10)] + [(None, 1), ("http://h.org/news/q", None)],
        "url string, rejected int",
    )
    got = {r["page_id"]: r for r in urltree.filter_urls(pages(spark, rows), [], labels=labels).collect()}
    assert {got[i]["verdict"] for i in range(40)} == {"block"}
    assert got[0]["purity"] == pytest.approx((10 + 2 * 0.1) / (10 + 2)) and got[0]["template"] == "/shop/{n}/buy"
    assert {r["verdict"] for i, r in got.items() if i >= 100} == {"allow"}


def test_every_stage_keeps_the_columns_of_documents(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "quality_classifier", "near_dedup", "decontamination", "packing"
    ]
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns
        docs = spark.createDataFrame(after.toPandas(), docs.schema)
        assert 0 < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == before


def test_all_ten_are_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)]
