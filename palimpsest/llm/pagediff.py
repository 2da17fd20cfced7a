"""Main text by differencing a page with its nearest page.

Different pages of a host (copies count once) are sorted by URL path and paired
with the neighbour that shares the longer path prefix. The lines of both are aligned by a longest
common subsequence, and shared lines go: they belong to the site, not to the
page. Two things stay although shared. Paragraphs inside the page's own article
element, since a passage may be published twice; and the lines of a page whose
neighbours are copies of it, where only link-like shared lines go.

Only line hashes are sorted and compared; texts are shuffled once at most, to
meet the verdict on their lines (counted few verdicts are broadcast). A host that holds a third of all pages is sorted over
many tasks, and neighbours across the border of two tasks are found through a
table with one row per task.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import markup
from palimpsest.llm.urls import host, path
from palimpsest.session import BROADCAST_ROWS, materialize

# Of a page's characters, the part that must be its own for a neighbour to
# count as another page.
OWN_SHARE = 0.1

# Verdicts that are sent to every task have at most so many lines together.
BROADCAST_LINES = 16_000_000


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of one longest common subsequence with ``b``.

    Common ends first, then a longest chain through the matching places.
    """
    low, high_a, high_b = 0, len(a), len(b)
    while low < min(high_a, high_b) and a[low] == b[low]:
        low += 1
    while high_a > low and high_b > low and a[high_a - 1] == b[high_b - 1]:
        high_a, high_b = high_a - 1, high_b - 1
    places: dict[int, list[int]] = {}
    for j in range(high_b - 1, low - 1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []  # ends[n]: least place in b that ends a chain of n + 1
    links: list[tuple] = []
    for i in range(low, high_a):
        for j in places.get(a[i], ()):
            n = bisect_left(ends, j)
            link = (i, links[n - 1] if n else None)
            if n == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[n] = j
                links[n] = link
    chain: list[int] = []
    link = links[-1] if links else None
    while link:
        chain.append(link[0])
        link = link[1]
    return [*range(low), *reversed(chain), *range(high_a, len(a))]


_LINE = "array<struct<hash: long, chars: int, prose: boolean, weak: boolean>>"


def kept_lines(own: list[dict], neighbours: list[list[dict]]) -> list[bool]:
    """Which lines of a page stay, given its neighbours' lines, nearest first."""
    if not own:
        return []
    mine = [x["hash"] for x in own]
    chars = sum(x["chars"] for x in own)
    copies: set[int] = set()
    for other in neighbours:
        shared = set(common_lines(mine, [x["hash"] for x in other]))
        unshared = sum(x["chars"] for i, x in enumerate(own) if i not in shared)
        if unshared >= OWN_SHARE * chars:
            return [x["prose"] or i not in shared for i, x in enumerate(own)]
        copies |= shared
    return [x["prose"] or not x["weak"] or i not in copies for i, x in enumerate(own)]


def _prefix(a: Column, b: Column) -> Column:
    """How far two paths agree, in segments."""
    x, y = F.split(a, "/"), F.split(b, "/")
    same = F.zip_with(x, y, lambda p, q: p.eqNullSafe(q))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1)


def _content_key(host_: str, found: list[markup.Line]) -> bytes:
    """Stands for a host and all lines of a page; copies on a host share it."""
    import hashlib

    whole = "\n".join([host_, *(f"{x.prose:d}{x.text}" for x in found)])
    return hashlib.blake2b(whole.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _line_hashes(pages: DataFrame) -> DataFrame:
    """``key, host, path, lines`` of every content once, by its least path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        kind = pa.list_(
            pa.struct([("hash", pa.int64()), ("chars", pa.int32()), ("prose", pa.bool_()), ("weak", pa.bool_())])
        )
        for batch in batches:
            keys, rows = [], []
            for at, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                found = markup.lines(html)
                keys.append(_content_key(at, found))
                rows.append(
                    [
                        {
                            "hash": xxhash.xxh64_intdigest(x.text) - (1 << 63),
                            "chars": len(x.text),
                            "prose": x.prose,
                            "weak": x.weak,
                        }
                        for x in found
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), batch.column("host"), batch.column("path"), pa.array(rows, kind)],
                ["key", "host", "path", "lines"],
            )

    found = pages.select("host", path(F.col("url")).alias("path"), "html").mapInArrow(
        run, f"key binary, host string, path string, lines {_LINE}"
    )
    return found.groupBy("key").agg(
        F.min("path").alias("path"), F.first("host").alias("host"), F.first("lines").alias("lines")
    )


def _neighbours(lines: DataFrame) -> DataFrame:
    """``key, lines, near, far``: the lines of the two neighbouring pages of
    the host, the one with the longer common path prefix first."""
    marked = lines.orderBy("host", "path", "key").withColumn("_mid", F.monotonically_increasing_id())
    sorted_ = materialize(marked, "pages").withColumn("_part", F.shiftright("_mid", 33))
    side = F.struct("host", "path", "lines")
    ends = sorted_.groupBy("_part").agg(
        F.min_by(side, "_mid").alias("first"), F.max_by(side, "_mid").alias("last")
    )
    across = Window.orderBy("_part")
    borders = ends.select(
        "_part", F.lag("last").over(across).alias("_before"), F.lead("first").over(across).alias("_after")
    )
    inside = Window.partitionBy("_part").orderBy("_mid")
    placed = sorted_.withColumn("_lag", F.lag(side).over(inside)).withColumn("_lead", F.lead(side).over(inside))
    # A row per task that sorted.
    placed = placed.join(F.broadcast(borders), "_part").select(
        "key",
        "host",
        "path",
        "lines",
        F.coalesce("_lag", "_before").alias("prev"),
        F.coalesce("_lead", "_after").alias("next"),
    )
    for n in ("prev", "next"):
        placed = placed.withColumn(n, F.when(F.col(f"{n}.host") == F.col("host"), F.col(n)))
    far = {n: F.coalesce(_prefix(F.col("path"), F.col(f"{n}.path")), F.lit(-1)) for n in ("prev", "next")}
    swap = far["next"] > far["prev"]
    return placed.select(
        "key",
        "lines",
        F.when(swap, F.col("next.lines")).otherwise(F.col("prev.lines")).alias("near"),
        F.when(swap, F.col("prev.lines")).otherwise(F.col("next.lines")).alias("far"),
    )


def _verdicts(neighbours: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [
                kept_lines(row["lines"] or [], [x for x in (row["near"], row["far"]) if x])
                for row in batch.to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(kept, pa.list_(pa.bool_()))], ["key", "kept"]
            )

    return neighbours.mapInArrow(run, "key binary, kept array<boolean>")


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``.

    ``text`` joins the kept lines by one line feed; it is empty for a null or
    empty page and for one without main text. Pages whose url has no host are
    paired with each other. Copies on a host get the same text; ids and urls
    may be null or repeat. An empty table gives no row.
    """
    named = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    ).withColumn("host", host(F.col("url")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [markup.lines(h) for h in batch.column("html").to_pylist()]
            hosts = batch.column("host").to_pylist()
            keys = [_content_key(at, x) for at, x in zip(hosts, found, strict=True)]
            texts = [[x.text for x in page] for page in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(keys, pa.binary())]
                + [pa.array(texts, pa.list_(pa.string()))],
                ["page_id", "url", "key", "lines"],
            )

    lines = _line_hashes(named)
    # Most pages lose no line; only the others need to meet their verdict.
    cut = F.exists("kept", lambda stays: ~stays)
    verdicts = materialize(_verdicts(_neighbours(lines)).filter(cut), "verdicts")
    found = verdicts.agg(F.count("*").alias("n"), F.sum(F.size("kept")).alias("lines")).first()
    if found["n"] <= BROADCAST_ROWS and (found["lines"] or 0) <= BROADCAST_LINES:
        verdicts = F.broadcast(verdicts)
    texts = named.mapInArrow(run, "page_id long, url string, key binary, lines array<string>")
    kept = F.filter("lines", lambda _, i: F.get("kept", i))
    text = F.array_join(F.when(F.col("kept").isNull(), F.col("lines")).otherwise(kept), "\n")
    return (
        texts.join(verdicts, "key", "left")
        .select("page_id", "url", text.alias("text"))
        .withColumn("n_chars", F.length("text").cast("long"))
    )
