"""Shared helpers: the shared folder, staged tables, fresh column names, word rules."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Spark setting: the shuffle files of a query go when it ends, not when the driver collects garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables of two longs, or of little more, are broadcast up to so many rows; beyond it, Spark shuffles both sides.
BROADCAST_ROWS = 500_000

_own_dirs: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, an own one if the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return _own_dirs[app]


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/millrace/{tag}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Queries that end within give their shuffle files back; tables that outlive it must have been staged."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and a lost executor costs no more than a read.

    Written with zstd: texts take about half the disk that Spark's default would.
    """
    spark = df.sparkSession
    path = new_folder(spark, tag)
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    for paths in _open:
        paths.append(path)
    return out


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def drop(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing will read again, neither directly nor through what was made of them."""
    for table in tables:
        _delete(table.sparkSession, _paths.pop(table))


def staged_alone(make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """What make gives, staged; the tables that make staged on the way are deleted."""
    _open.append(paths := [])
    try:
        out = staged(make(), tag)
    finally:
        _open.remove(paths)
    for path in paths:
        if path != _paths[out]:
            _delete(out.sparkSession, path)
    return out


def checked(df: DataFrame) -> DataFrame:
    """A staged table for a join: broadcast up to BROADCAST_ROWS."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name like name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """df with name: the place of each row, from 0, in the order of columns that together are distinct.

    One range-partitioned sort, staged; only the row counts by partition are gathered.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at, part, of, base = (fresh(df, c) for c in ("at", "part", "of_part", "base"))
    run = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    run = staged(run.select("*", F.monotonically_increasing_id().alias(at), F.spark_partition_id().alias(part)), "numbered")
    counts = run.groupBy(F.col(part).alias(of)).agg(F.count("*").alias("n"), F.min(at).alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(of).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(of, (before - F.col("first")).alias(base))  # a row for each partition
    return run.join(F.broadcast(counts), F.col(part) == F.col(of)).withColumn(name, F.col(at) + F.col(base)).select(*df.columns, name)


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key60(value: Column) -> Column:
    """The first 60 bits of the MD5 of a string, as a long from 0 on; null counts as an empty string."""
    hexes = F.substring(F.md5(F.coalesce(value.cast("string"), F.lit(""))), 1, 15)
    return F.conv(hexes, 16, 10).cast("long")


def sorted_groups(batches, keys: int):
    """The groups of a stream of record batches sorted by their first columns (keys of them, integers), each as a table.

    Holds one group and one batch at a time.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        ends = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        cuts = [0, *ends.tolist(), batch.num_rows]
        if held and any(held[-1].column(i)[-1].as_py() != batch.column(i)[0].as_py() for i in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that each of 0 to n - 1 reaches by the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if np.array_equal(new, root):
            return root
        root = new
