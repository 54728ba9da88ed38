"""Frequent items: mergeable counters of bounded number with proven bounds, and exact counts of all that may be frequent."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import staged


def _shrunk(items: pa.Table, most: int) -> tuple[pa.Table, int]:
    """The counters of items (item, n) cut to most of them: the first one too many is taken off all. What was taken off comes second."""
    if items.num_rows <= most:
        return items, 0
    n = items.column("n").to_numpy()
    off = int(-np.partition(-n, most)[most])
    left = items.set_column(1, "n", pa.array(n - off))
    return left.filter(pc.greater(left.column("n"), 0)), off


def counters(df: DataFrame, item: str, most: int) -> DataFrame:
    """Misra-Gries counters of each partition: item, n, lost, rows; one row of each partition has no item and known false.

    No item occurs less often in a partition than n, nor more often than n + lost (lost where it has no counter), and (most + 1) lost are the
    partition's rows at most. Sums over partitions keep both bounds. A null item counts like any other.
    """
    kind = df.schema[item].dataType.simpleString()

    def work(batches):
        held, lost, rows = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows += batch.num_rows
            found = pa.table({"item": batch.column(0), "n": pa.array(np.ones(batch.num_rows, np.int64))}).group_by("item").aggregate([("n", "sum")]).rename_columns(["item", "n"])
            both = found if held is None else pa.concat_tables([held, found]).group_by("item").aggregate([("n", "sum")]).rename_columns(["item", "n"])
            held, off = _shrunk(both, most)
            lost += off
        if held is None:
            return
        size = held.num_rows
        yield from held.append_column("lost", pa.array(np.zeros(size, np.int64))).append_column("rows", pa.array(np.zeros(size, np.int64))).append_column("known", pa.array([True] * size)).combine_chunks().to_batches()
        none = pa.nulls(1, held.schema.field("item").type)
        yield pa.RecordBatch.from_arrays([none, pa.array([0]), pa.array([lost]), pa.array([rows]), pa.array([False])], ["item", "n", "lost", "rows", "known"])

    return df.select(item).mapInArrow(work, f"item {kind}, n long, lost long, rows long, known boolean")


def frequent_bounds(df: DataFrame, item: str, share: float, most: int | None = None) -> tuple[DataFrame, int]:
    """item, at_least, at_most of every item that may have a share of the rows (no more than 2 / share items), and the number of rows.

    most counters are held in a partition: 2 / share unless stated, and no fewer than 1 / share. One pass; two numbers come to the driver.
    """
    most = most or math.ceil(2 / share)
    if (most + 1) * share <= 1:
        raise ValueError(f"{most} counters may miss items of a share of {share}")
    found = staged(counters(df, item, most), "counters")
    rows, lost = found.filter("not known").agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("lost"), F.lit(0))).first()
    sums = found.filter("known").groupBy("item").agg(F.sum("n").alias("at_least"))
    return sums.withColumn("at_most", F.col("at_least") + lost).filter(F.col("at_most") >= max(share * rows, 1)), rows


def frequent_items(df: DataFrame, item: str, share: float, most: int | None = None) -> DataFrame:
    """item and n, its exact count, of every item that has a share of the rows or more: none is missed, none is extra.

    A first pass finds what may be frequent, 2 / share items at most, which are broadcast; a second counts them. Null counts like any other
    item, an empty table gives an empty result.
    """
    may, rows = frequent_bounds(df, item, share, most)
    counts = df.select(F.col(item).alias("of_")).join(F.broadcast(may.select("item")), F.col("of_").eqNullSafe(F.col("item"))).groupBy("item").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= max(share * rows, 1))
