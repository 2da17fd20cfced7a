"""Earlier passages, runs and token links against brute force."""

from __future__ import annotations

import functools
import hashlib
import random
import zlib

import numpy as np
import pytest

from palimpsest.llm import crossalign, periodic, repeats

COLUMNS = "doc_id long, text string, batch string, ord int, h int, key string"


def documents(spark, texts, ids=None):
    """A documents table with further columns whose names operators use."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "b", 3, 4, "k") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, COLUMNS)


def plain_removal(texts, size):
    """Kept bytes, removed bytes and spans, documents in order."""
    seen, out = set(), []
    for text in texts:
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - size + 1):
            window = data[i : i + size]
            if window in seen:
                gone[i : i + size] = [True] * size
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def awkward_texts(seed):
    draw = random.Random(seed)
    words = ["ab", "the", "é", "x", "日本", "tion", "of"]

    def prose(n):
        return " ".join(draw.choice(words) + draw.choice("abcdefghij") for _ in range(n))

    long = prose(400)
    passages = [prose(40) for _ in range(4)]
    texts = [None, "", "short", "x" * 99, "y" * 100, "y" * 100, "z" * 700, "ab" * 300, long, long, long]
    for _ in range(40):
        parts = [prose(draw.randrange(60)) for _ in range(3)]
        for _ in range(draw.randrange(4)):
            p = draw.choice(passages)
            a = draw.randrange(20)
            parts.insert(draw.randrange(len(parts)), p[a : a + draw.randrange(20, 200)])
        texts.append(" ".join(parts))
    edited = list(long)
    for at in (100, 250, 251, 700):
        edited[at] = "#"
    return [*texts, "".join(edited), long[150:] + long[:300], prose(9000)]


@pytest.mark.parametrize("batch_bytes", [1 << 11, 1 << 21])
def test_earlier_passages_match_a_set_of_windows(spark, monkeypatch, batch_bytes):
    monkeypatch.setattr(repeats, "BATCH_BYTES", batch_bytes)
    texts = awkward_texts(3)
    got = repeats.without_repeats(documents(spark, texts), whole=True).collect()
    rows = {r.doc_id: r for r in got}
    assert len(got) == len(texts)
    for i, want in enumerate(plain_removal(texts, 100)):
        r = rows[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want, i
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256


def test_passages_of_repeated_null_and_unordered_ids(spark):
    passage = "".join(random.Random(1).choices("abcdefgh ", k=150))
    ids = [5, None, 2, 5, 9]
    texts = [passage, "lead " + passage, passage, passage, passage[:99]]
    got = repeats.without_repeats(documents(spark, texts, ids)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_removed) for r in got) == [
        (False, 0, 0), (True, 2, 150), (True, 5, 150), (True, 5, 150), (True, 9, 0),
    ]
    assert repeats.without_repeats(documents(spark, [], [])).collect() == []


def test_windows_of_another_size(spark):
    texts = awkward_texts(9)
    settings = repeats.Settings(size=40, runs=(12, 40))
    got = {r.doc_id: r for r in repeats.without_repeats(documents(spark, texts), settings).collect()}
    for i, want in enumerate(plain_removal(texts, 40)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want


def plain_runs(words, least=6, times=4):
    found = set()
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(least, times * q):
                stretch = words[s : i + q]
                smaller = any(
                    all(stretch[t] == stretch[t + r] for t in range(len(stretch) - r))
                    for r in range(1, q)
                )
                if not smaller:
                    found.add((s, i + q - s, q))
            i += i == s
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_judgement(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is not None and words and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g, n = zlib.crc32(str(doc_id).encode()) // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    dropped = {i for s, l, q in found for i in range(s + q, s + l)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    head = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    lines = "".join(f"{s},{l},{q}\n" for s, l, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (len(found), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def periodic_texts(seed, count):
    draw = random.Random(seed)
    texts = [None, "", " \t\n", "one", "a " * 500, "a b " * 40 + "c", "é\x0bé\x0cé é é é é"]
    for _ in range(count):
        words = [draw.choice("abcdefg"[: draw.choice([1, 2, 3, 7])]) for _ in range(draw.randrange(90))]
        if words and draw.random() < 0.5:
            a, p = draw.randrange(len(words)), draw.randrange(1, 9)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        texts.append(draw.choice([" ", "\n", "  "]).join(words))
    return texts


def test_runs_match_a_scan_of_all_periods(spark, monkeypatch):
    monkeypatch.setattr(periodic, "BATCH_WORDS", 150)
    texts = periodic_texts(4, 250)
    ids = [*range(len(texts) - 2), None, 7]
    got = periodic.periodic_runs(documents(spark, texts, ids), plant=True, whole=True).collect()
    assert len(got) == len(texts)
    want = sorted(
        ((i is not None, i or 0, *map(str, plain_judgement(i, t))) for i, t in zip(ids, texts, strict=True))
    )
    assert want == sorted((r.doc_id is not None, r.doc_id or 0, *map(str, tuple(r)[1:8])) for r in got)
    for r in got:
        assert r.n_runs == len(r.runs)
        assert hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256
    assert periodic.periodic_runs(documents(spark, [], [])).collect() == []


def test_long_periodic_documents_stay_cheap():
    words = np.zeros(60_000, np.int64)
    bounds = np.array([0, 30_000, 60_000])
    start, length, period = periodic.runs(words, bounds, periodic.Settings())
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0, 30_000], [30_000] * 2, [1, 1])
    words = np.tile(np.arange(997), 40)
    start, length, period = periodic.runs(words, np.array([0, len(words)]), periodic.Settings())
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [len(words)], [997])


@pytest.fixture(scope="module")
def pair():
    return crossalign.Pair(crossalign.default_path(), crossalign.default_pieces())


@functools.cache
def plain_tokenizer():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(crossalign.default_path())
    found.encode_special_tokens = True
    return found


def plain_alignment(pair, text):
    """Ids of both sides, links and the group text, pair by pair."""
    if not text:
        return [], [], [], ""
    a = plain_tokenizer().encode(" " + text, add_special_tokens=False).ids
    b = pair._b.encode(text)
    plain = (" " + text).encode()
    if any(
        b"".join(names[i] for i in ids) != plain
        for ids, names in ((a, pair.bytes_a), (b, pair.bytes_b))
    ):
        return [], [], [], ""

    def spans(ids, names):
        ends = np.cumsum([len(names[i]) for i in ids]).tolist()
        return list(zip([0, *ends[:-1]], ends, ids, strict=True))

    x, y = spans(a, pair.bytes_a), spans(b, pair.bytes_b)
    links = [(i, j) for s, e, i in x for t, f, j in y if s < f and t < e]
    groups, begin = [], 0
    for cut in sorted({e for _, e, _ in x} & {e for _, e, _ in y}):
        sides = [",".join(str(i) for s, e, i in z if begin < e <= cut) for z in (x, y)]
        groups.append("|".join(sides))
        begin = cut
    return a, b, links, ";".join(groups)


def token_texts(seed, count):
    draw = random.Random(seed)
    letters = "abcdefghtionéß日本\n  .,'0129\t"
    pieces = ["the ", "ing ", "\nword ", "<|endoftext|>", "<s>", "tion ", "naïve ", " ", "▁"]
    texts = [None, "", "a", " lead", "a\n\nb", "x▁y", "<|endoftext|> x", "日本語 の text", "w" * 3000]
    for _ in range(count):
        n = draw.randrange(1, 80)
        texts.append(
            "".join(
                draw.choice(letters) if draw.random() < 0.6 else draw.choice(pieces[: draw.choice([6, 9])])
                for _ in range(n)
            )
        )
    return [*texts, " ".join(draw.choice(["alpha", "beta,", "gamma."]) for _ in range(4000))]


def test_links_and_counts_match_all_pairs_of_tokens(spark, monkeypatch, pair):
    monkeypatch.setattr(crossalign, "BATCH_BYTES", 3000)
    texts = token_texts(6, 150)
    plain = [plain_alignment(pair, t) if t is None or len(t) < 5000 else None for t in texts]
    whole = crossalign.align(documents(spark, texts[:-1]), None).collect()
    counts = {}
    for _, _, links, _ in plain[:-1]:
        for link in links:
            counts[link] = counts.get(link, 0) + 1
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    rows = {r.doc_id: r for r in whole}
    assert len(rows) == len(texts) - 1
    for i, (a, b, links, groups) in enumerate(plain[:-1]):
        want = (
            i, len(a), len(b), groups.count(";") + 1 if groups else 0, len(links),
            sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
            hashlib.sha256(groups.encode()).hexdigest() if groups else "",
        )
        assert tuple(rows[i]) == want, texts[i]
    assert sum(len(p[0]) > 0 for p in plain[:-1]) > 60
    assert crossalign.align(documents(spark, [], [])).collect() == []


def test_lanes_of_any_length_give_the_same_links(pair):
    parts = [pair.encode(t) for t in token_texts(8, 20)]
    a, b = ([p[k] for p in parts] for k in (0, 1))
    bounds = crossalign._bounds(a)
    ends = [np.cumsum(n[np.concatenate(x)]) for n, x in ((pair.length_a, a), (pair.length_b, b))]
    first = crossalign.lockstep(*ends, bounds, 3)
    for other in (1, 64, 1 << 20):
        again = crossalign.lockstep(*ends, bounds, other)
        assert all((x == y).all() for x, y in zip(first, again, strict=True))


@pytest.mark.parametrize("bits", [5, 7, 24])
def test_the_least_of_every_window_in_slices(monkeypatch, bits):
    monkeypatch.setattr(repeats, "_PLACE_BITS", bits)
    rng = np.random.default_rng(3)
    values = rng.integers(0, 40, 500).astype(np.uint64) << np.uint64(40)
    for width in (1, 2, 7, 17):
        got = repeats._least(values, width)
        want = [i + int(np.argmin(values[i : i + width])) for i in range(len(values) - width + 1)]
        assert got.tolist() == want
    assert repeats._least(values[:3], 4).tolist() == []
