"""Sharding by jump consistent hashing, with gapless slots in each shard.

A key's shard depends on the key and the number of shards alone, without a ring table; one
more shard takes its share of rows and no other row moves (Lamping and Veach, 2014).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import key60, staged

#: Multiplier of the generator in the paper on jump consistent hashing.
MULTIPLIER = 2862933555777941757


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards from 0 to shards - 1 for unsigned 64-bit keys."""
    state, at = keys.astype(np.uint64), np.zeros(len(keys), np.int64)
    ahead, live = np.zeros(len(keys), np.int64), np.arange(len(keys))
    while len(live):
        at[live] = ahead[live]
        state[live] = state[live] * np.uint64(MULTIPLIER) + np.uint64(1)
        step = float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[live] = ((at[live] + 1) * step).astype(np.int64)
        live = live[ahead[live] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key of any type that has a string form; null counts as an empty string."""

    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return of(key60(key))


def assign(docs: DataFrame, shards: int = 16, parts: int | None = None) -> DataFrame:
    """A row for each document: doc_id, size, text_crc32, shard, slot, grown_shard.

    size is the UTF-8 bytes of the whole text (null: none), however long, and 1; text_crc32 is that of the text
    (null: of nothing); grown_shard is the shard with one shard more. Slots run from 0 in each
    shard in the order of doc_id (null first), text_crc32 and size; rows alike in all three
    take neighbouring slots. Rows with the same id share a shard. Other columns are not used.

    The slots come from one range-partitioned sort of slim rows; a shard or an id of any size
    spreads over partitions, and only the row counts by partition and shard are gathered.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    slim = slim.select("*", shard_of(F.col("doc_id"), shards).alias("shard"), shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"))
    order = ["shard", "doc_id", "text_crc32", "size", "tie"]
    slim = staged(slim.withColumn("tie", F.monotonically_increasing_id()), "shard-rows")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    run = slim.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("tie")
    run = staged(run.select("*", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("part")), "shard-order")
    counts = run.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select(F.col("shard").alias("of"), F.col("part").alias("in"), (before - F.col("first")).alias("base"))
    joined = run.join(base, (F.col("shard") == F.col("of")) & (F.col("part") == F.col("in")))
    return joined.select("doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("base")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 16, files_per_shard: int = 1) -> None:
    """docs as Parquet folders shard=0, shard=1, ...; each shard's rows are dealt over files_per_shard files by hash.

    Null ids share a shard, rows alike in all columns a file; an empty table writes no folder. A column called
    shard is refused, as the folders' names would take its place.
    """
    if "shard" in map(str.lower, docs.columns):
        raise ValueError("docs has a column called shard")
    deal = F.pmod(F.xxhash64(*docs.columns), F.lit(files_per_shard))
    dealt = docs.withColumn("shard", shard_of(F.col("doc_id"), shards))
    dealt.repartition(shards * files_per_shard, "shard", deal).write.partitionBy("shard").parquet(path)
