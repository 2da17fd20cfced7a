"""Near-duplicate classes by DartMinHash signatures.

Each shingle of weight w owns the strip [0, w) of an area whose other side is
a rank. Darts fall on that area as a Poisson process that is a pure function
of the shingle, so equal strips hold equal darts. A dart has a rank and a
coordinate; the earliest dart of each coordinate is the signature, and two
texts agree on a coordinate with the probability of their weighted Jaccard
similarity. A text needs about ``k ln k + 2k`` darts, however long it is.

Signatures are cut into bands. Texts that share a band are compared with one
leader of the band's bucket, by exact weighted Jaccard of their shingles;
buckets whose members still lie in several classes are dealt again with a few
other leaders, until a round finds no new link or few pairs are left. A member
that has led has met all of its bucket and leaves it, so no bucket compares a pair twice. Every round
is linear in the members of the buckets that are left. In the buckets that still
hold several classes then, all pairs of different classes are compared, so every
pair that shares a band has been met or lies in one class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernels
from palimpsest.llm.common import text_key, trimmed
from palimpsest.llm.components import components
from palimpsest.session import discard, fits_broadcast, materialize

LEADERS = 8  # of a bucket, in every round but the first
PAIRS = 256  # of different classes for each member that are met without more rounds
BLOCK = 512  # members of a bucket that are compared with as many others at once

DARTS = 1 << 21  # of the texts signed together, about

# Bits of a band's hash that travel with a text; bands are compared in place.
_BAND_BITS = (1 << 31) - 1

_LOWEST = -12  # ranks below 2 ** _LOWEST are one level
_SEED = np.uint64(0xD1B54A32D192ED03)
# Per byte, how many of its four bit pairs are zero.
_ALIKE = sum((np.arange(256) >> (2 * j) & 3 == 0).astype(np.uint8) for j in range(4))


@dataclass(frozen=True)
class Settings:
    """``bands * rows`` coordinates. At similarity 0.8 a pair misses all 30
    bands of 5 with probability 7e-6. Texts that share a band are told apart by
    a second signature of ``marks`` coordinates (a multiple of 4) first.
    ``weighting`` is "set" (every distinct shingle weighs 1) or "count" (its
    occurrences)."""

    words: int = 5
    similarity: float = 0.8
    bands: int = 30
    rows: int = 5
    marks: int = 1200
    weighting: str = "set"

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows


def _poisson_steps(area: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, .. darts on an area."""
    most = int(area + 12 * math.sqrt(area) + 24)
    k = np.arange(most + 1)
    log_factorial = np.concatenate(([0.0], np.cumsum(np.log(np.maximum(k[1:], 1)))))
    return np.cumsum(np.exp(k * math.log(area) - area - log_factorial))


def _throw(elements: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts on unit strips inside one rank level: owner, dart, rank."""
    low = 0.0 if level == 0 else 2.0 ** (_LOWEST + level - 1)
    high = 2.0 ** (_LOWEST + level)
    seeded = kernels.mix(elements ^ np.uint64(int(_SEED) * (2 * level + 1) % 2**64))
    number = np.searchsorted(_poisson_steps(high - low), kernels.unit(seeded), side="right")
    owner = np.repeat(np.arange(len(elements)), number)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
    dart = kernels.mix(seeded[owner] + (nth.astype(np.uint64) + np.uint64(1)) * _SEED)
    return owner, dart, low + (high - low) * kernels.unit(dart)


def signatures(
    texts: list[bytes], settings: Settings, coordinates: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """A ``len(texts) x coordinates`` array, and each text's shingle weight."""
    k, n = coordinates or settings.coordinates, len(texts)
    text, element, count = kernels.shingles(texts, settings.words)
    weight = np.ones_like(count) if settings.weighting == "set" else count
    strip = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
    text = np.repeat(text, weight)
    element = kernels.mix(np.repeat(element, weight) + strip.astype(np.uint64) * _SEED)
    total = np.bincount(text, minlength=n)
    used = total > 0
    darts = k * math.log(k) + 2 * k
    enough = np.zeros(n, np.int64)
    enough[used] = np.maximum(0, np.ceil(np.log2(darts / total[used])) - _LOWEST)
    best = np.full(n * k, np.inf)
    signature = np.zeros(n * k, np.uint64)
    active, level = used.copy(), 0
    while active.any():
        on = active[text]
        owner, dart, rank = _throw(element[on], level)
        cell = text[on][owner] * k + (
            (kernels.mix(dart + _SEED) >> np.uint64(33)).astype(np.int64) % k
        )
        np.minimum.at(best, cell, rank)
        won = rank == best[cell]
        signature[cell[won]] = dart[won]
        level += 1
        full = np.isfinite(best.reshape(n, k)).all(axis=1)
        active &= (level <= enough) | ~full
    return signature.reshape(n, k), total


def _groups(texts: list[bytes], coordinates: int) -> Iterator[tuple[int, int]]:
    """Index ranges of texts whose darts and bytes are bounded together: a text
    has about as many darts whether it is short or long."""
    most = max(1, int(DARTS / (coordinates * math.log(coordinates) + 2 * coordinates)))
    for lo, hi in kernels.groups(texts):
        for at in range(lo, hi, most):
            yield at, min(at + most, hi)


def _band_hashes(signature: np.ndarray, settings: Settings) -> np.ndarray:
    parts = signature.reshape(len(signature), settings.bands, settings.rows)
    out = np.broadcast_to(
        np.arange(1, settings.bands + 1, dtype=np.uint64) * _SEED, parts.shape[:2]
    )
    for j in range(settings.rows):
        out = kernels.mix(out + parts[:, :, j])
    return out.astype(np.int64)


def _banded(rows: DataFrame, settings: Settings) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = kernels.as_bytes(batch.column("text"))
            for lo, hi in _groups(texts, settings.coordinates):
                signature, weight = signatures(texts[lo:hi], settings)
                used = weight > 0
                bands = _band_hashes(signature[used], settings)
                offsets = np.concatenate(([0], np.cumsum(used * settings.bands))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.ravel()))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), pa.array(weight), lists],
                    ["doc_id", "key", "weight", "bands"],
                )

    return rows.mapInArrow(trimmed(run), "doc_id long, key binary, weight long, bands array<long>")


def _marked(texts: DataFrame, settings: Settings) -> DataFrame:
    """``id, marks``: two bits of each of ``settings.marks`` coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = kernels.as_bytes(batch.column("text"))
            for lo, hi in _groups(rows, settings.marks):
                signature, _ = signatures(rows[lo:hi], settings, settings.marks)
                pairs = (signature & np.uint64(3)).astype(np.uint8)
                whole = sum(pairs[:, j::4] << (2 * j) for j in range(4))
                marks = [row.tobytes() for row in whole]
                ids = batch.slice(lo, hi - lo).column("id")
                yield pa.RecordBatch.from_arrays([ids, pa.array(marks, pa.binary())], ["id", "marks"])

    return texts.mapInArrow(trimmed(run), "id long, marks binary")


def _similarities(a: list[bytes], b: list[bytes], settings: Settings) -> np.ndarray:
    """Exact weighted Jaccard similarity of each pair of texts."""
    parts = [kernels.shingles(side, settings.words) for side in (a, b)]
    pair = np.concatenate([p[0] for p in parts])
    element = np.concatenate([p[1] for p in parts])
    weight = np.concatenate([p[2] for p in parts])
    if settings.weighting == "set":
        weight = np.ones_like(weight)
    order = np.lexsort((element, pair))
    pair, element, weight = pair[order], element[order], weight[order]
    same = (pair[1:] == pair[:-1]) & (element[1:] == element[:-1])
    common = np.bincount(
        pair[1:][same], np.minimum(weight[1:], weight[:-1])[same], minlength=len(a)
    )
    whole = np.bincount(pair, weight, minlength=len(a)) - common
    return np.divide(common, whole, out=np.zeros(len(a)), where=whole > 0)


def _verified(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Of ``u, v`` pairs of text ids those that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (kernels.as_bytes(batch.column(c)) for c in ("text_u", "text_v"))
            for lo, hi in kernels.groups([x + y for x, y in zip(a, b, strict=True)]):
                close = _similarities(a[lo:hi], b[lo:hi], settings) >= settings.similarity
                yield batch.slice(lo, hi - lo).select(["u", "v"]).filter(pa.array(close))

    sides = pairs.join(texts.toDF("u", "text_u"), "u").join(texts.toDF("v", "text_v"), "v")
    return sides.select("u", "v", "text_u", "text_v").mapInArrow(trimmed(run), "u long, v long")


def _sent(few: DataFrame) -> DataFrame:
    """``few``, broadcast if its counted rows and bytes are within the limit, so
    that the rows it meets, which carry marks, are not shuffled."""
    return F.broadcast(few) if fits_broadcast(few) else few


def _draws(members: DataFrame, round_: int, root: str = "root") -> list[Column]:
    """By what the leaders of a bucket are chosen: in the first round the text
    with the most company in all its buckets, so that a group of near copies
    meets few leaders, those in its middle; later ``LEADERS`` draws by
    class first, so that a large class does not take all of them. Each bucket
    draws on its own: texts that share several buckets meet other leaders in
    each, not the same ones again."""
    if round_ == 0:
        return [F.struct(*[-F.col(c) for c in ("company",) if c in members.columns], F.col("id"))]
    salts = [[F.col("bucket"), F.lit(round_), F.lit(j)] for j in range(LEADERS)]
    return [F.struct(F.xxhash64(root, *s), F.xxhash64("id", *s), F.col("id")) for s in salts]


def _drawn(leader: str | Column, draws: list[Column]) -> Column:
    return F.array_distinct(F.array(*[F.min_by(leader, d) for d in draws]))


def _mixed(members: DataFrame, roots: DataFrame, round_: int) -> DataFrame:
    """What is left of ``members``, with their new ``root``: buckets that are in
    several classes without the leaders of ``round_``, which have met all the
    others of their bucket and leave it."""
    placed = members.withColumnRenamed("root", "was").join(_sent(roots), "id", "left")
    placed = placed.withColumn("root", F.coalesce("root", "id"))
    draws = [F.struct(d.alias("draw"), "id") for d in _draws(placed, round_, "was")]
    classes = placed.groupBy("bucket", "root").agg(
        F.count("*").alias("n"), *[F.min(d).alias(f"d{j}") for j, d in enumerate(draws)]
    )
    led = [F.min(F.struct(f"d{j}.draw", f"d{j}.id", "root", "n")) for j in range(len(draws))]
    buckets = classes.groupBy("bucket").agg(
        F.count("*").alias("classes"), F.array(*led).alias("led")
    )
    led = F.array_distinct(F.transform("led", lambda x: F.struct(x["id"], x["root"], x["n"])))
    buckets = buckets.filter("classes > 1").withColumn("led", led)
    # Classes of the bucket that consist of leaders.
    gone = F.filter(
        "led", lambda x: x["n"] == F.size(F.filter("led", lambda y: y["root"] == x["root"]))
    )
    left = F.col("classes") - F.size(F.array_distinct(F.transform(gone, lambda x: x["root"])))
    several = buckets.filter(left > 1).select("bucket", F.transform("led", lambda x: x["id"]).alias("led"))
    several = materialize(several, "several")
    rest = placed.join(_sent(several), "bucket").filter(~F.array_contains("led", F.col("id")))
    mixed = materialize(rest.drop("led", "was"), "members")
    discard(several)
    return mixed


def _few_pairs(members: DataFrame) -> bool:
    """Whether all pairs of different classes in the buckets are at most
    ``PAIRS`` for each member, so that meeting them is linear in the members."""
    classes = members.groupBy("bucket", "root").agg(F.count("*").cast("double").alias("n"))
    buckets = classes.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n") ** 2).alias("own"))
    total = buckets.agg(F.sum("n").alias("n"), F.sum((F.col("n") ** 2 - F.col("own")) / 2).alias("pairs")).first()
    return (total["pairs"] or 0) <= PAIRS * (total["n"] or 0)


def _leaders(members: DataFrame, round_: int) -> DataFrame:
    """``bucket, leaders``, see ``_draws``."""
    leader = F.struct("id", "root", "weight", "marks")
    return members.groupBy("bucket").agg(_drawn(leader, _draws(members, round_)).alias("leaders"))


def _least_alike(settings: Settings) -> float:
    """Marks of a pair at the similarity agree with probability ``p``; pairs more
    than 5 standard deviations below go, which loses one in 3 million."""
    k, s = settings.marks, settings.similarity
    p = s + (1 - s) / 4
    return k * p - 5 * math.sqrt(k * p * (1 - p))


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.stack((np.maximum(a, b), np.minimum(a, b)), axis=1)
    u, v = np.unique(pairs, axis=0).reshape(-1, 2).T
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _candidates(members: DataFrame, round_: int, settings: Settings) -> DataFrame:
    """``u, v``: every member with the leaders of its bucket that are of another
    class and may be similar. Weights too far apart rule a pair out, and so do
    marks, see ``_least_alike``.
    """
    k, s = settings.marks, settings.similarity
    least = _least_alike(settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                yield _near(batch.slice(lo, 2000))

    def _near(part: pa.RecordBatch) -> pa.RecordBatch:
        def marks(column: pa.Array) -> np.ndarray:
            return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, k // 4)

        lists = part.column("leaders")
        each = lists.flatten()
        owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        own = {n: part.column(n).to_numpy()[owner] for n in ("id", "root", "weight")}
        other = {n: each.field(n).to_numpy() for n in ("id", "root", "weight")}
        lighter = np.minimum(own["weight"], other["weight"])
        heavier = np.maximum(own["weight"], other["weight"])
        at = np.flatnonzero((own["root"] != other["root"]) & (lighter >= s * heavier))
        apart = marks(part.column("marks"))[owner[at]] ^ marks(each.field("marks"))[at]
        at = at[_ALIKE[apart].sum(axis=1) >= least]
        return _pairs(own["id"][at], other["id"][at])

    met = members.join(_leaders(members, round_), "bucket")
    columns = met.select("id", "root", "weight", "marks", "leaders")
    return columns.mapInArrow(trimmed(run), "u long, v long").distinct()


def _blocked(members: DataFrame) -> DataFrame:
    """``members`` once for each pair ``i <= j`` of blocks of their bucket that
    their ``block`` is in.

    Members of the bucket's largest class have blocks of their own, which are
    paired only with those of the other members: a large class with a few
    strays costs in proportion to its members.
    """
    classes = members.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    sizes = classes.groupBy("bucket").agg(
        F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("root", F.struct("n", "root")).alias("main")
    )
    whole = F.col("n") <= BLOCK
    sizes = sizes.filter("most < n").select(
        "bucket",
        F.when(whole, None).otherwise(F.col("main")).alias("main"),
        F.when(whole, 1).otherwise(F.ceil((F.col("n") - F.col("most")) / BLOCK)).alias("others"),
        F.when(whole, 0).otherwise(F.ceil(F.col("most") / BLOCK)).alias("mains"),
    )
    draw = F.xxhash64("id", "bucket")
    is_main = F.coalesce(F.col("root") == F.col("main"), F.lit(False))
    block = F.when(is_main, F.col("others") + F.pmod(draw, "mains")).otherwise(F.pmod(draw, "others"))
    met = F.when(is_main, F.col("others")).otherwise(F.col("others") + F.col("mains"))
    dealt = members.join(_sent(materialize(sizes, "sizes")), "bucket")
    dealt = dealt.withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0), met - 1)))
    return dealt.select(
        "bucket", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"),
        "block", "id", "root", "weight", "marks", *[c for c in ("bands",) if c in members.columns],
    )


def _all_candidates(members: DataFrame, settings: Settings) -> DataFrame:
    """``u, v``: all pairs of members of a bucket that are of different classes
    and may be similar, by the rules of ``_candidates``."""
    k, s = settings.marks, settings.similarity
    unlike = k - _least_alike(settings)
    low = np.uint64(0x5555555555555555)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted; a batch may end inside of a pair of blocks.
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            rows = pa.Table.from_batches([*rest, batch]).combine_chunks()
            keys = np.stack([rows.column(c).to_numpy() for c in ("bucket", "i", "j")], axis=1)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            bounds = np.concatenate(([0], edges))
            yield from _met(rows, bounds)
            rest = rows.slice(bounds[-1]).to_batches()
        if rest:
            rows = pa.Table.from_batches(rest).combine_chunks()
            yield from _met(rows, np.array([0, rows.num_rows]))

    def _met(rows: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = int(bounds[-1])
        if not n:
            return
        own = {c: rows.column(c).to_numpy()[:n] for c in ("id", "root", "weight", "block", "i", "j")}
        bands = None
        if "bands" in rows.column_names:
            bands = rows.column("bands").slice(0, n).combine_chunks().flatten().to_numpy().reshape(n, -1)
            here = (rows.column("bucket").to_numpy()[:n] & _BAND_BITS).astype(np.int32)
        data = b"".join(rows.column("marks").slice(0, n).to_pylist())
        marks = np.zeros((n, -(-k // 32) * 8), np.uint8)
        marks[:, : k // 4] = np.frombuffer(data, np.uint8).reshape(n, k // 4)
        marks = marks.view(np.uint64)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            same = own["i"][lo] == own["j"][lo]
            for at in range(lo, hi, 64):
                one = np.arange(at, min(at + 64, hi))[:, None]
                two = np.arange(lo, hi)[None, :]
                light = np.minimum(own["weight"][one], own["weight"][two])
                heavy = np.maximum(own["weight"][one], own["weight"][two])
                open_ = (own["root"][one] != own["root"][two]) & (light >= s * heavy)
                open_ &= (one < two) if same else (own["block"][one] < own["block"][two])
                x, y = np.nonzero(open_)
                if not len(x):
                    continue
                x, y = x + at, y + lo
                apart = marks[x] ^ marks[y]
                apart = np.bitwise_count((apart | apart >> np.uint64(1)) & low)
                near = apart.sum(axis=1, dtype=np.int64) <= unlike
                x, y = x[near], y[near]
                if bands is not None and len(x):
                    # Once a pair: in the first of the bands that both have.
                    # It was met there if one of them led that bucket.
                    first = (bands[x] == bands[y]).argmax(axis=1)
                    once = bands[x, first] == here[x]
                    x, y = x[once], y[once]
                if len(x):
                    yield _pairs(own["id"][x], own["id"][y])

    dealt = _blocked(members).repartition("bucket", "i", "j")
    dealt = dealt.sortWithinPartitions("bucket", "i", "j")
    return dealt.mapInArrow(trimmed(run), "u long, v long").distinct()


def text_classes(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc_id, key, class_id, class_key``, narrow.

    ``key`` stands for the row's text, ``class_id`` is the least id in the
    class and ``class_key`` the text it goes with. Rows of equal text share a
    class. Texts without words, null among them, have no shingles: they are
    in a class only with equal texts (null counts as empty). Ids may be null
    or repeat; a class in which all ids are null has a null ``class_id``.
    """
    settings = settings or Settings()
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        text_key(F.col("text")).alias("key"),
    )
    rows = materialize(_banded(named, settings), "banded")
    distinct = materialize(
        rows.groupBy("key")
        .agg(
            F.min("doc_id").alias("first_doc"),
            F.first("weight").alias("weight"),
            F.first("bands").alias("bands"),
        )
        .withColumn("id", F.monotonically_increasing_id()),
        "texts",
    )
    ids = distinct.select("id", "key", "first_doc")
    bucket = distinct.select("id", F.explode("bands").alias("bucket"))
    shared = bucket.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    # Only rows of buckets with company.
    members = materialize(bucket.join(shared, "bucket"), "buckets")
    involved = members.groupBy("id").agg(F.sum("n").alias("company"))
    wanted = ids.join(involved, "id").select("id", "key", "first_doc", "company")
    # One row per wanted text: the row of its least id, so copies are not moved.
    # Wanted rows have 32 bytes; up to the limit they are broadcast.
    wanted = materialize(wanted, "wanted")
    texts = materialize(
        named.alias("d")
        .join(
            _sent(wanted).alias("w"),
            (F.col("d.key") == F.col("w.key"))
            & F.col("d.doc_id").eqNullSafe(F.col("w.first_doc")),
        )
        .select(F.col("w.id").alias("id"), F.col("d.text").alias("text"))
        .dropDuplicates(["id"]),
        "texts",
    )
    low = F.transform("bands", lambda b: b.bitwiseAND(F.lit(_BAND_BITS)).cast("int"))
    known = distinct.select("id", "weight", low.alias("bands")).join(_marked(texts, settings), "id")
    known = known.join(_sent(wanted.select("id", "company")), "id")
    left = members.drop("n").join(materialize(known, "marks"), "id").withColumn("root", F.col("id"))
    left = materialize(left, "members")
    discard(members)
    tried = materialize(_candidates(left, 0, settings), "pairs")
    links = materialize(_verified(tried, texts, settings), "links")
    round_ = 0
    while True:
        roots = materialize(components(links), "roots")
        mixed = _mixed(left, roots, round_)
        discard(left)
        left = mixed
        if _few_pairs(left):
            break
        round_ += 1
        fresh = _candidates(left, round_, settings).join(tried, ["u", "v"], "left_anti")
        fresh = materialize(fresh, "pairs")
        found = materialize(_verified(fresh, texts, settings), "links")
        tried = tried.union(fresh)
        if found.isEmpty():
            # A round without a link has only met its leaders.
            mixed = _mixed(left, roots, round_)
            discard(left)
            left = mixed
            break
        discard(roots)
        links = links.union(found)
    if not left.isEmpty():
        fresh = _all_candidates(left, settings).join(tried, ["u", "v"], "left_anti")
        found = materialize(_verified(materialize(fresh, "pairs"), texts, settings), "links")
        if not found.isEmpty():
            discard(roots)
            roots = materialize(components(links.union(found)), "roots")
    discard(left, texts)
    placed = ids.join(roots, "id", "left").select(
        "key", "first_doc", F.coalesce("root", "id").alias("root")
    )
    heads = placed.groupBy("root").agg(
        F.min("first_doc").alias("class_id"),
        F.min_by("key", F.struct(F.col("first_doc").isNull(), "first_doc", "key")).alias(
            "class_key"
        ),
    )
    classes = materialize(
        placed.join(heads, "root").select("key", "class_id", "class_key"), "classes"
    )
    return rows.select("doc_id", "key").join(classes, "key")


def near_duplicates(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``doc_id, class_id``, one row per row of ``docs``; see ``text_classes``."""
    return text_classes(docs, settings).select("doc_id", "class_id")


def without_near_duplicates(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row of each class with all columns of ``docs``: the row with the
    least id. Equal rows count once. Where all ids of a class are null, one of
    its rows stays."""
    classes = text_classes(docs, settings)
    kept = classes.filter(
        (F.col("key") == F.col("class_key")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    ).select(F.col("key").alias("_kept_key"), F.col("class_id").alias("_kept_id"))
    kept = kept.distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    keyed = packed.select(
        "_doc",
        text_key(F.col("_doc.text")).alias("_key"),
        F.col("_doc.doc_id").cast("long").alias("_id"),
    )
    return (
        keyed.join(
            kept,
            (F.col("_key") == F.col("_kept_key")) & F.col("_id").eqNullSafe(F.col("_kept_id")),
            "left_semi",
        )
        .groupBy("_key", "_id")
        .agg(F.first("_doc").alias("_doc"))
        .select("_doc.*")
    )
