"""Distances, nearest centroids and exact pairwise sums.

Whole-table pair computations go by block pairs: rows are hashed into blocks
of bounded size, each pair of blocks is one task-sized group, and a group
returns sums per row (or the few pairs asked for), never all its pairs. A
cluster that holds a third of the rows is just more blocks.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.shipping import ship
from palimpsest.operators.ordering import with_group_index
from palimpsest.session import dictionary_join, discard, fits_broadcast, materialize

ship(__name__)

# Vectors per block; two blocks and their distances fit in one task.
BLOCK_ROWS = 1024


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine; a zero vector is at distance 1 from everything."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, 1 - dot(a, b) / lengths).otherwise(F.lit(1.0))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)


def unit(a: Column | str) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = F.greatest(norm(a), F.lit(5e-324))
    return F.transform(a, lambda x: x / n)


def centroids(df: DataFrame, cluster: str = "cluster", vector: str = "vector") -> DataFrame:
    """``(cluster, center)``: the mean vector per cluster."""
    means = (
        df.select(cluster, F.posexplode(vector).alias("_i", "_x"))
        .groupBy(cluster, "_i")
        .agg(F.avg("_x").alias("_x"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("_i", "_x")))
    return means.groupBy(cluster).agg(F.transform(ordered, lambda p: p["_x"]).alias("center"))


# Centers met together by a block of rows.
CENTER_BLOCK = 512


def _nearest(x: np.ndarray, centers: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Name and distance of the nearest center, the least name on ties.

    Centers are ordered by length. Two vectors are at least as far apart as
    their lengths differ, so a row skips all blocks of centers whose lengths
    lie further from its own than the best center found so far.
    """
    lengths, own = np.linalg.norm(centers, axis=1), np.linalg.norm(x, axis=1)
    order = np.lexsort((names, lengths))
    centers, names, lengths = centers[order], names[order], lengths[order]
    starts = np.arange(0, len(centers), CENTER_BLOCK)
    low, high = lengths[starts], lengths[np.minimum(starts + CENTER_BLOCK, len(centers)) - 1]
    gap = np.maximum(0, np.maximum(low[None] - own[:, None], own[:, None] - high[None]))
    best, found = np.full(len(x), np.inf), np.zeros(len(x), names.dtype)
    # Nearest blocks first, so that most others need not be met.
    turn = np.argsort(gap, axis=1, kind="stable")
    for nth in range(len(starts)):
        block = turn[:, nth]
        open_ = gap[np.arange(len(x)), block] <= best * (1 + 1e-12)
        if not open_.any():
            break
        for b in np.unique(block[open_]):
            rows = np.flatnonzero(open_ & (block == b))
            c = centers[starts[b] : starts[b] + CENTER_BLOCK]
            d = np.empty((len(rows), len(c)))
            for i, row in enumerate(x[rows]):
                d[i] = np.sqrt(((c - row) ** 2).sum(axis=1))
            least = d.min(axis=1)
            name = np.where(d == least[:, None], names[starts[b] : starts[b] + CENTER_BLOCK], names.max()).min(axis=1)
            better = (least < best[rows]) | ((least == best[rows]) & (name < found[rows]))
            best[rows[better]], found[rows[better]] = least[better], name[better]
    return found, best


def nearest_centers(
    df: DataFrame, centers: DataFrame, cluster: str = "cluster", vector: str = "vector"
) -> DataFrame:
    """Add ``nearest``, the name (a whole number) of the center at the smallest
    Euclidean distance, the least on ties; null for a null vector and without
    centers.

    ``centers`` are the parameters of a model (``cluster, center``). They are
    sent to every task after a check of their size; more than that is an error.
    """
    named = centers.select(F.col(cluster).cast("long").alias("k"), F.col("center").cast("array<double>").alias("c"))
    if not fits_broadcast(named):
        raise ValueError("too many centers to send to every task")
    held = named.toArrow()
    sent = df.sparkSession.sparkContext.broadcast(
        (np.array(held.column("k").to_pylist(), np.int64), np.array(held.column("c").to_pylist(), np.float64))
    )

    def run(values: pd.Series) -> pd.Series:
        names, matrix = sent.value
        there = values.notna().to_numpy()
        out = pd.Series([None] * len(values), dtype="Int64")
        if there.any() and len(names):
            x = np.stack([np.asarray(v, np.float64) for v in values[there]])
            out[there] = _nearest(x, matrix, names)[0]
        return out

    return df.withColumn("nearest", F.pandas_udf(run, "long")(F.col(vector)))


# ---- block pairs ----------------------------------------------------------

def with_blocks(df: DataFrame, group: str, key: str, rows_per_block: int = BLOCK_ROWS) -> DataFrame:
    """Add ``blocks`` (of the group) and ``block``, spread by hash of the key."""
    blocks = df.groupBy(group).agg(
        F.ceil(F.count("*") / rows_per_block).cast("int").alias("blocks")
    )
    return dictionary_join(df, blocks, [group], "inner").withColumn(
        "block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")
    )


def with_whole_blocks(df: DataFrame, key: str, rows_per_block: int = BLOCK_ROWS) -> DataFrame:
    """The same for a table that is one group: its rows are counted first, so
    no join on a constant is planned."""
    blocks = max(1, -(-df.count() // rows_per_block))
    return df.withColumns(
        {"blocks": F.lit(blocks), "block": F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")}
    )


# Columns of sums that a task holds for the rows of a block.
_SUM_COLUMNS = 4096
# Packed blocks that travel to Python together.
_BLOCKS_A_BATCH = 16
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _packed(blocked: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """One row per block, frozen: ``group, block, rows``, its ids and fields as
    arrays in one binary."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        held = {
            f: np.stack([np.asarray(x) for x in pdf[f]]) if pdf[f].dtype == object else pdf[f].to_numpy()
            for f in ["id", *fields]
        }
        return pd.DataFrame(
            {group: pdf[group].iloc[:1], "block": pdf["block"].iloc[:1], "rows": [pickle.dumps(held)]}
        )

    kind = blocked.schema[group].dataType.simpleString()
    # A file for each of a few tasks a core, however few the blocks are.
    files = 2 * blocked.sparkSession.sparkContext.defaultParallelism
    rows = blocked.select(group, "block", "id", *fields).repartition(files, group, "block")
    packs = rows.groupBy(group, "block")
    return materialize(packs.applyInPandas(pack, f"{group} {kind}, block int, rows binary"), "blocks")


def sums_by_blocks(
    blocked: DataFrame, group: str, fields: list[str],
    kernel: Callable[[dict, dict, bool], tuple[np.ndarray, np.ndarray]],
) -> DataFrame:
    """``(group, id, other, total)``, frozen: sums over all rows of the group.

    ``kernel(low, high, same)`` meets two blocks, dictionaries of arrays of
    ``id`` and ``fields``, and returns names and a column of sums per name for
    the rows of ``low``. Blocks are packed and written once, and every task
    reads some of them beside some others, so no vector is copied by a shuffle.
    A task adds up what its blocks say about a row, so what is shuffled are a
    row's sums per task and not per block.
    """
    spark, kind = blocked.sparkSession, blocked.schema[group].dataType.simpleString()
    blocks = _packed(blocked, group, fields)
    low = blocks.select(F.col(group).alias("g"), F.col("block").alias("i"), F.col("rows").alias("low"))
    high = blocks.select(F.col(group).alias("h"), F.col("block").alias("j"), F.col("rows").alias("high"))
    # Not an equality: that would send a group to one task.
    pairs = low.join(high, (F.col("g") <= F.col("h")) & (F.col("g") >= F.col("h")))
    schema = pa.schema(
        [("g", low.select("g").limit(0).toArrow().schema.field(0).type), ("id", pa.int64()),
         ("other", pa.int64()), ("total", pa.float64())]
    )

    def sent(at: tuple, ids: np.ndarray, sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, total in sums.items():
            n = len(ids)
            columns = [pa.array([at[0]] * n, schema[0].type), ids, np.full(n, name, np.int64), total]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, sums = None, {}, {}
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in "gij"), strict=True)
            for nth, (g, i, j) in enumerate(keys):
                if at != (g, i) or len(sums) > _SUM_COLUMNS:
                    if sums:
                        yield from sent(at, held["id"], sums)
                    at, sums = (g, i), {}
                    held = pickle.loads(batch.column("low")[nth].as_buffer())
                right = held if i == j else pickle.loads(batch.column("high")[nth].as_buffer())
                names, totals = kernel(held, right, i == j)
                for name, total in zip(names.tolist(), totals.T, strict=True):
                    sums[name] = sums[name] + total if name in sums else total
        if sums:
            yield from sent(at, held["id"], sums)

    before = spark.conf.get(_BATCH_ROWS)
    spark.conf.set(_BATCH_ROWS, str(_BLOCKS_A_BATCH))
    try:
        parts = pairs.mapInArrow(run, f"g {kind}, id long, other long, total double")
        parts = materialize(parts, "sums")
    finally:
        spark.conf.set(_BATCH_ROWS, before)
    discard(blocks)
    return parts.groupBy(F.col("g").alias(group), "id", "other").agg(F.sum("total").alias("total"))


def _stack(pdf: pd.DataFrame, column: str) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in pdf[column]])


def far_weights(x: np.ndarray, y: np.ndarray, theta: float, weighted: bool) -> np.ndarray:
    """Edge weights between unit vectors: distance above theta, else no edge."""
    distance = 1.0 - x @ y.T
    far = distance > theta
    return np.where(far, distance, 0.0) if weighted else far.astype(np.float64)


# ---- threshold joins between bounded blocks ---------------------------------

# Rows whose distances bound those of whole blocks.
PIVOTS = 16
_SLACK = 1e-9


def _lifted(u: np.ndarray) -> np.ndarray:
    """Unit vectors with one more coordinate that is 1 for a zero vector, so
    that half the squared distance of two rows is their cosine distance unless
    both are zero."""
    return np.concatenate((u, (~u.any(axis=1))[:, None].astype(np.float64)), axis=1)


def pivot_blocks(
    source: DataFrame, group: str, key: str, rows_per_block: int = BLOCK_ROWS, pivots: int = PIVOTS
) -> tuple[DataFrame, DataFrame]:
    """Rows in blocks of neighbours, and bounds for all pairs of blocks.

    ``source`` has unit vectors in ``_u``. A few rows drawn by hash are pivots;
    the rows of a group are put in order of their nearest pivot and the
    distance to it and cut into blocks. Returns the rows with ``block`` and
    ``(group, _lo, _hi, least, most)``: what the distance of a row of one block
    and a row of the other is at least and at most, by the triangle inequality.
    """
    drawn = source.orderBy(F.xxhash64(key), key).limit(pivots).select("_u").collect()
    centers = _lifted(np.array([r["_u"] for r in drawn], np.float64)) if drawn else np.zeros((1, 1))
    kind = source.schema[key].dataType.simpleString()
    group_kind = source.schema[group].dataType.simpleString()

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                u = _lifted(_stack(pdf, "_u"))
                far = np.sqrt(np.maximum(0, ((u[:, None, :] - centers[None]) ** 2).sum(axis=2)))
                pdf["_far"] = list(far)
                pdf["_cell"] = far.argmin(axis=1).astype(np.int32)
                pdf["_zero"] = u[:, -1] > 0
                yield pdf

    schema = f"{group} {group_kind}, {key} {kind}, _u array<double>, _far array<double>, _cell int, _zero boolean"
    measured = source.select(group, key, "_u").mapInPandas(measure, schema)
    near = F.get("_far", F.col("_cell"))
    numbered = with_group_index(measured, [group], [F.col("_cell"), near, F.col(key)], "_nth")
    rows = numbered.withColumn("block", F.floor(F.col("_nth") / rows_per_block).cast("int"))
    ends = [F.get("_far", F.lit(i)) for i in range(len(centers))]
    bounds = rows.groupBy(group, "block").agg(
        F.array(*[F.min(e) for e in ends]).alias("low"),
        F.array(*[F.max(e) for e in ends]).alias("high"),
        F.max("_zero").alias("zero"),
    )
    bounds = materialize(bounds, "bounds")
    a, b = bounds.alias("a"), bounds.alias("b")
    both = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.block") <= F.col("b.block")))
    apart = F.zip_with("a.low", "b.high", lambda x, y: x - y)
    behind = F.zip_with("b.low", "a.high", lambda x, y: x - y)
    reach = F.zip_with("a.high", "b.high", lambda x, y: x + y)
    least = F.greatest(F.lit(0.0), F.array_max(apart), F.array_max(behind))
    most = F.array_min(reach)
    zeros = F.col("a.zero") & F.col("b.zero")
    half = [x * x / 2 for x in (least, most)]
    pairs = both.select(
        F.col(f"a.{group}").alias(group),
        F.col("a.block").alias("_lo"),
        F.col("b.block").alias("_hi"),
        (F.when(zeros, F.least(half[0], F.lit(1.0))).otherwise(half[0]) - _SLACK).alias("least"),
        (F.when(zeros, F.greatest(half[1], F.lit(1.0))).otherwise(half[1]) + _SLACK).alias("most"),
    )
    return rows.select(group, key, "_u", "block"), pairs


def threshold_pairs(
    df: DataFrame, theta: float, near: bool, group: str = "cluster", key: str = "id",
    vector: str = "vector", rows_per_block: int = BLOCK_ROWS,
) -> DataFrame:
    """``(group, id_a, id_b, distance)`` with id_a < id_b inside a group whose
    cosine distance is above ``theta``, or with ``near`` not above it.

    Only pairs of blocks whose bounds allow such a pair meet; the others are
    skipped without a distance. Keys should differ inside a group.
    """
    source = df.select(group, key, unit(vector).alias("_u"))
    rows, pairs = pivot_blocks(source, group, key, rows_per_block)
    wanted = pairs.filter(F.col("least") <= theta if near else F.col("most") > theta)
    sides = wanted.select(
        group, "_lo", "_hi", F.explode(F.array_distinct(F.array("_lo", "_hi"))).alias("block")
    )

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["_lo"].iat[0], pdf["_hi"].iat[0]
        low, right = pdf[pdf["block"] == lo], pdf[pdf["block"] == hi]
        distance = 1.0 - _stack(low, "_u") @ _stack(right, "_u").T
        hit = distance <= theta if near else distance > theta
        if lo == hi:
            hit &= np.triu(np.ones_like(hit, dtype=bool), 1)
        i, j = np.nonzero(hit)
        a, b = low[key].to_numpy()[i], right[key].to_numpy()[j]
        return pd.DataFrame(
            {
                group: np.full(len(i), low[group].iat[0]),
                "id_a": np.minimum(a, b),
                "id_b": np.maximum(a, b),
                "distance": distance[i, j],
            }
        )

    met = rows.join(sides, [group, "block"]).groupBy(group, "_lo", "_hi")
    return met.applyInPandas(kernel, f"{group} long, id_a long, id_b long, distance double")


def distant_pairs(
    df: DataFrame, theta: float, group: str = "cluster", key: str = "id", vector: str = "vector",
    rows_per_block: int = BLOCK_ROWS,
) -> DataFrame:
    """``(group, id_a, id_b, distance)`` with id_a < id_b inside a group whose
    cosine distance exceeds ``theta``. Meant for a selective threshold; the
    graph operators use sums per row instead of this table."""
    return threshold_pairs(df, theta, False, group, key, vector, rows_per_block)


# Below this share of the squared lengths a squared distance is taken anew.
_CLOSE = 1e-5
# Rows whose distances to a block are held at a time; they stay in the cache.
_STRIP = 128


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances as one product, |x|^2+|y|^2-2xy, and row by row,
    without the cancellation of that, for rows with a close neighbour."""
    own, theirs = (x * x).sum(axis=1), (y * y).sum(axis=1)
    left = np.concatenate((-2 * x, own[:, None], np.ones((len(x), 1))), axis=1)
    right = np.concatenate((y, np.ones((len(y), 1)), theirs[:, None]), axis=1)
    out = left @ right.T
    bound = _CLOSE * (own + theirs.max())
    # Written so that a nan counts as close.
    for i in np.flatnonzero(~(out.min(axis=1) >= bound)):
        near = np.flatnonzero(~(out[i] >= bound[i]))
        out[i, near] = ((y[near] - x[i]) ** 2).sum(axis=1)
    return out


def _distance_sums(x: np.ndarray, y: np.ndarray, member: np.ndarray, squares: bool = False) -> np.ndarray:
    """For each row of ``x`` its distances to the rows of ``y`` added up per
    column of ``member``, with ``squares`` also the squared ones."""
    width = member.shape[1]
    out = np.empty((len(x), width * (1 + squares)))
    for at in range(0, len(x), _STRIP):
        d = _squared(x[at : at + _STRIP], y)
        if squares:
            out[at : at + _STRIP, width:] = d @ member
        out[at : at + _STRIP, :width] = np.sqrt(d, out=d) @ member
    return out


def silhouette(
    df: DataFrame, cluster: str = "cluster", key: str = "id", vector: str = "vector",
    rows_per_block: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact Euclidean silhouette per row: ``(id, cluster, silhouette)``.

    All distances are needed by definition, so the work is quadratic; what
    leaves a block pair is one sum per row and cluster.
    """
    source = df.select(
        F.lit(0).alias("_all"), F.col(key).alias("id"), F.col(cluster).alias("own"), F.col(vector).alias("v")
    )

    def kernel(low: dict, high: dict, same: bool) -> tuple[np.ndarray, np.ndarray]:
        names, codes = np.unique(high["own"], return_inverse=True)
        return names, _distance_sums(low["v"], high["v"], np.eye(len(names))[codes])

    blocked = with_whole_blocks(source, "id", rows_per_block)
    sums = sums_by_blocks(blocked, "_all", ["own", "v"], kernel).drop("_all")
    sizes = source.groupBy("own").agg(F.count("*").alias("n"))
    own = source.select("id", "own")
    rows = sums.join(own, "id")
    rows = dictionary_join(rows, sizes.select(F.col("own").alias("other"), "n"), ["other"], "inner")
    mine = F.col("other") == F.col("own")
    per_row = rows.groupBy("id", "own").agg(
        F.max(F.when(mine, F.col("n"))).alias("n"),
        F.max(F.when(mine, F.col("total") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("a"),
        F.min(F.when(~mine, F.col("total") / F.col("n"))).alias("b"),
    )
    value = F.when(
        (F.col("n") == 1) | (F.greatest("a", "b") == 0), F.lit(0.0)
    ).otherwise((F.col("b") - F.col("a")) / F.when(F.greatest("a", "b") > 0, F.greatest("a", "b")))
    return per_row.select("id", F.col("own").alias("cluster"), value.alias("silhouette"))


def mean_silhouette(df: DataFrame, **names) -> DataFrame:
    return silhouette(df, **names).agg(F.avg("silhouette").alias("silhouette"))


def silhouettes_of_labelings(
    df: DataFrame, labelings: dict[str, int], key: str = "id", vector: str = "vector",
    rows_per_block: int = BLOCK_ROWS,
) -> DataFrame:
    """Mean silhouettes of several labelings of the same vectors in one pass.

    ``labelings`` names a column of labels from 0 and their number for each.
    One row per labeling: ``labeling, rows, silhouette`` with Euclidean and
    ``squared_silhouette`` with squared distances. The distances of a block
    pair are computed once and summed per row for all clusters of all
    labelings together. Empty labels count as no cluster; a labeling with a
    single cluster has no silhouette.
    """
    names = list(labelings)
    starts = np.cumsum([0, *labelings.values()]).tolist()
    width = starts[-1]
    source = df.select(
        F.lit(0).alias("_all"), F.col(key).alias("id"), F.col(vector).alias("v"),
        F.array(*[F.col(n).cast("int") for n in names]).alias("own"),
    )

    def kernel(low: dict, high: dict, same: bool) -> tuple[np.ndarray, np.ndarray]:
        member = np.zeros((len(high["id"]), width))
        for at, start in enumerate(starts[:-1]):
            member[np.arange(len(member)), start + high["own"][:, at]] = 1
        return np.arange(2 * width), _distance_sums(low["v"], high["v"], member, True)

    blocked = with_whole_blocks(source, "id", rows_per_block)
    parts = sums_by_blocks(blocked, "_all", ["own", "v"], kernel)
    totals = parts.groupBy("id").agg(
        F.array(*[F.sum(F.when(F.col("other") == i, F.col("total"))) for i in range(2 * width)]).alias("t")
    )
    # A number per label of each labeling: parameters, not data.
    members = df.agg(
        *[
            F.count_if(F.col(n) == k).alias(f"{n}_{k}")
            for n, count in labelings.items()
            for k in range(count)
        ]
    ).first()
    rows = totals.join(source.select("id", "own"), "id")
    scored = []
    for at, name in enumerate(names):
        n_of = [members[f"{name}_{k}"] for k in range(labelings[name])]
        own = F.get("own", F.lit(at))
        n_own = F.get(F.array(*[F.lit(n) for n in n_of]), own)

        def value(shift: int) -> Column:
            def total(k: int) -> Column:
                return F.get("t", F.lit(shift + starts[at] + k))

            a = F.get("t", F.lit(shift + starts[at]) + own) / F.greatest(n_own - 1, F.lit(1))
            others = [F.when(own != k, total(k) / n) for k, n in enumerate(n_of) if n]
            b = F.array_min(F.array(*others))
            most = F.greatest(a, b)
            return F.when(b.isNull(), None).when((n_own == 1) | (most == 0), 0.0).otherwise((b - a) / F.when(most > 0, most))

        scored.append(
            F.struct(
                F.lit(name).alias("labeling"),
                F.count(F.lit(1)).alias("rows"),
                F.avg(value(0)).alias("silhouette"),
                F.avg(value(width)).alias("squared_silhouette"),
            )
        )
    return rows.agg(F.array(*scored).alias("s")).select(F.inline("s"))

