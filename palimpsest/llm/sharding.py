"""K-d tree sharding of a table by its metadata.

A node that must become ``m`` leaves is split along the dimension in which its
rows are spread widest, at the weighted quantile that gives the left child
``floor(m / 2) / m`` of its bytes, until every node is one leaf of about the
target bytes. All nodes of a level are split together. The quantile is found by
narrowing histograms that Spark sums, so only a few thousand counts a level
reach the driver; the order inside a dimension ends in a hash of the row, so a
value that holds a third of all bytes is split like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.ordering import with_group_index
from palimpsest.session import materialize

# A place in a dimension: 21 bits of coordinate, then 18 bits of row hash.
_GRID_BITS, _TIE_BITS = 21, 18
_PLACE_BITS = _GRID_BITS + _TIE_BITS
_STEP_BITS = 13  # bits of place found by one pass


@dataclass
class Node:
    """A part of the table that becomes leaves ``first`` to ``first + leaves - 1``."""

    first: int
    leaves: int
    axis: int = 0
    low: int = 0  # leading bits of the cut found so far
    below: int = 0  # bytes before them
    wanted: float = 0.0


def _grid(docs: DataFrame, dimensions: list[str]) -> list[Column]:
    """Each dimension as an integer of ``_GRID_BITS`` bits: numbers by their
    place between the least and the largest, other types by a hash, so that
    equal values stay together. Null is 0."""
    top = (1 << _GRID_BITS) - 1
    numeric = [
        c for c in dimensions if docs.schema[c].dataType.typeName() in _NUMBERS
    ]
    bounds = (
        docs.agg(*[f(F.col(f"`{c}`").cast("double")) for c in numeric for f in (F.min, F.max)]).first()
        if numeric
        else ()
    )
    out = []
    for c in dimensions:
        value = F.col(f"`{c}`")
        if c in numeric:
            low, high = bounds[2 * numeric.index(c)], bounds[2 * numeric.index(c) + 1]
            width = (high - low) if low is not None and high > low else 1.0
            scaled = (value.cast("double") - F.lit(low or 0.0)) / F.lit(width)
            cell = F.floor(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)) * F.lit(float(top)))
        else:
            cell = F.pmod(F.xxhash64(value.cast("string")), F.lit(top)) + 1
        out.append(F.when(value.isNull(), F.lit(0)).otherwise(cell).cast("long"))
    return out


_NUMBERS = {"byte", "short", "integer", "long", "float", "double", "decimal"}


def _by_node(values: dict[int, int], shards: int, default: int) -> Column:
    """A value per node, looked up by the row's node; one entry per shard."""
    listed = [values.get(n, default) for n in range(shards)]
    return F.get(F.array(*[F.lit(v).cast("long") for v in listed]), F.col("node").cast("int"))


def _place(nodes: list[Node], shards: int, dimensions: int) -> Column:
    """The row's place in the dimension that its node is split along."""
    axis = _by_node({n.first: n.axis for n in nodes}, shards, 0)
    return F.get(F.array(*[F.col(f"p{a}") for a in range(dimensions)]), axis.cast("int"))


def _widest(rows: DataFrame, nodes: list[Node], dimensions: int) -> None:
    """Give each node the axis with the largest range between the 5 % and 95 %
    rows of its grid, so that a few odd rows do not make an axis wide."""
    grids = [F.shiftright(f"p{a}", _TIE_BITS) for a in range(dimensions)]
    spread = rows.groupBy("node").agg(
        *[F.percentile_approx(g, [0.05, 0.95], 200).alias(f"a{a}") for a, g in enumerate(grids)]
    )
    found = {row["node"]: row for row in spread.collect()}  # a row per node
    for node in nodes:
        if row := found.get(node.first):
            ranges = [row[f"a{a}"][1] - row[f"a{a}"][0] for a in range(dimensions)]
            node.axis = max(range(dimensions), key=lambda a: (ranges[a], -a))


def _cuts(rows: DataFrame, nodes: list[Node], shards: int, dimensions: int) -> dict[int, int]:
    """Per node the first place of its right child, by narrowing histograms."""
    placed = rows.select("node", "size", _place(nodes, shards, dimensions).alias("at"))
    for shift in range(_PLACE_BITS - _STEP_BITS, -1, -_STEP_BITS):
        low = _by_node({n.first: n.low for n in nodes}, shards, -1)
        counts = (
            placed.filter(F.shiftright("at", shift + _STEP_BITS) == low)
            .groupBy("node", F.shiftright("at", shift).alias("cell"))
            .agg(F.sum("size").alias("size"))
            .collect()  # 2 ** _STEP_BITS rows a node at most
        )
        for node in nodes:
            cells = sorted((c["cell"], c["size"]) for c in counts if c["node"] == node.first)
            if not node.wanted:
                node.wanted = node.leaves // 2 / node.leaves * sum(size for _, size in cells)
            for cell, size in cells:
                node.low = cell
                if node.below + size >= node.wanted:
                    break
                node.below += size
    return {n.first: n.low + 1 for n in nodes}


def kd_shards(docs: DataFrame, shards: int, dimensions: list[str]) -> DataFrame:
    """``doc_id, size, text_crc32, shard`` of every row of ``docs``.

    ``size`` is the text's UTF-8 bytes (null: none) plus 8. Shards 0 to
    ``shards - 1`` have nearly equal bytes unless single rows outweigh them;
    with fewer rows than shards some stay empty. Null ids and metadata are a
    value like any other; equal rows are told apart by a stored row number.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tie = F.shiftrightunsigned(
        F.xxhash64("doc_id", text, F.monotonically_increasing_id()), 64 - _TIE_BITS
    )
    # Stored, since the row number in the tie must not change between passes.
    rows = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.lit(0).cast("long").alias("node"),
            *[
                (F.shiftleft(g, _TIE_BITS) + tie).alias(f"p{a}")
                for a, g in enumerate(_grid(docs, dimensions))
            ],
        ),
        "shards",
    )
    many = len(dimensions)
    level = [Node(0, shards)]
    while nodes := [n for n in level if n.leaves > 1]:
        _widest(rows, nodes, many)
        cuts = _cuts(rows, nodes, shards, many)
        right = {n.first: n.first + n.leaves // 2 for n in nodes}
        moves = _place(nodes, shards, many) >= _by_node(cuts, shards, 1 << 62)
        node = F.when(moves, _by_node(right, shards, 0)).otherwise(F.col("node"))
        rows = materialize(rows.withColumn("node", node), "shards")
        level = [
            child
            for n in nodes
            for child in (
                Node(n.first, n.leaves // 2),
                Node(n.first + n.leaves // 2, n.leaves - n.leaves // 2),
            )
        ]
    return rows.select("doc_id", "size", "text_crc32", F.col("node").cast("int").alias("shard"))


def numbered(shards: DataFrame) -> DataFrame:
    """The rows with ``slot``, 0.. in each shard by id, then text."""
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    return with_group_index(shards, ["shard"], order, "slot")


def leaves_for(docs: DataFrame, target_bytes: int) -> int:
    """How many leaves of ``target_bytes`` the table needs, 1 at least."""
    size = F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))) + 8
    total = docs.agg(F.sum(size.cast("long")).alias("n")).first()["n"] or 0
    return max(1, -(-total // target_bytes))
