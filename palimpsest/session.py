"""Session defaults, the shared folder, and bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side joined by broadcast never has more rows than this.
BROADCAST_ROWS = 200_000

# Nor more bytes than this, as JSON text.
BROADCAST_BYTES = 256 << 20

# Keys of a larger dictionary that are broadcast because they are frequent.
HEAVY_KEYS = 20_000

# Replicas of the dictionary side when a large dictionary is joined by shuffle.
SALTS = 16

_SHARED_KEY = "spark.checkpoint.dir"

# Folders of local sessions that name none, by application; the setting itself
# cannot be changed in a running session.
_OWN_DIRS: dict[str, str] = {}


def local_session(cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and benches; on a cluster use the one given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("palimpsest")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the session.

    Only a local session without one gets a temporary folder; on a cluster the
    setting must be there.
    """
    named = spark.conf.get(_SHARED_KEY, None)
    if not named:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local"):
            raise ValueError(f"{_SHARED_KEY} must name a folder all executors share")
        key = spark.sparkContext.applicationId
        if key not in _OWN_DIRS:
            _OWN_DIRS[key] = tempfile.mkdtemp(prefix="palimpsest-")
        named = _OWN_DIRS[key]
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage and freezes row numbers; the files outlive any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stage_path = path
    return stored


def discard(*stages: DataFrame) -> None:
    """Remove the files of tables from ``materialize`` that nothing reads any
    more: neither they nor a frame derived from them may be used again."""
    for stage in stages:
        spark = stage.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(stage.stage_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Hash the rows of a scan over the cores if its files make fewer tasks
    than there are cores (few or unsplittable files before heavy work per row).

    A scan that already has a task per core is returned as it is, so a large
    input is not shuffled. ``keys`` should be nearly unique.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, *keys)


def fits_broadcast(df: DataFrame, rows_at_most: int | None = None) -> bool:
    """Whether ``df`` is small enough to broadcast.

    ``rows_at_most`` is a bound known from how ``df`` was built (a top-k size);
    without one the rows and their bytes are counted, stopping past the limit
    of rows.
    """
    if rows_at_most is not None:
        return rows_at_most <= BROADCAST_ROWS
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    rows = df.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)).alias("n"), size.alias("size")).first()
    return rows["n"] <= BROADCAST_ROWS and (rows["size"] or 0) <= BROADCAST_BYTES


def counted_dictionary_join(
    rows: DataFrame, dictionary: DataFrame, keys: list[str], weight: str, rows_at_most: int | None = None
) -> DataFrame:
    """Left join with a dictionary that is unique on ``keys`` and knows, in
    ``weight``, how often each of its keys occurs.

    A dictionary of checked size is broadcast. Of a larger one the heaviest
    keys are, so that no frequent key is shuffled; the rows they leave are
    joined with the rest of it by one shuffle, without copies of either side.
    """
    plain = dictionary.drop(weight)
    if fits_broadcast(plain, rows_at_most):
        return rows.join(F.broadcast(plain), keys, "left")
    heavy = materialize(dictionary.orderBy(F.desc(weight), *keys).limit(HEAVY_KEYS), "heavy")
    marked = rows.join(F.broadcast(heavy.drop(weight).withColumn("_heavy", F.lit(True))), keys, "left")
    tail = plain.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    rest = marked.filter("_heavy is null").select(*rows.columns).join(tail, keys, "left")
    return marked.filter("_heavy").drop("_heavy").unionByName(rest.select(*[c for c in marked.columns if c != "_heavy"]))


def dictionary_join(
    rows: DataFrame,
    dictionary: DataFrame,
    keys: list[str],
    how: str = "left",
    rows_at_most: int | None = None,
) -> DataFrame:
    """Join many rows with a dictionary that is unique on ``keys``.

    A dictionary of checked size is broadcast. A larger one is joined by
    shuffle with the rows salted, so that a key holding a third of them is
    still spread over ``SALTS`` tasks.
    """
    if fits_broadcast(dictionary, rows_at_most):
        return rows.join(F.broadcast(dictionary), keys, how)
    salted = rows.withColumn(
        "_salt", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(SALTS)).cast("int")
    )
    copies = dictionary.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    )
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
