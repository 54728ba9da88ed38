"""Windowed streams over files; results land in a folder that driver and executors share.

Spark drops late rows against the watermark of the batch before the last; see the tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ..scratch import folder


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The files of a table as a stream, with the schema of the table and ts as TIMESTAMP, which watermarks need.

    A table is a folder of part files or a single file; Spark streams folders only, so a single file is picked from its own.
    """
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    many = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at).isDirectory()
    df = reader.parquet(path) if many else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(df: DataFrame, mode: str, *keys: str) -> DataFrame:
    """Runs a stream over all that is there; a batch that runs again replaces what it wrote before.

    In update mode, the row of the last batch counts for each value of keys. Update and append
    modes give state back once the watermark has passed it; complete mode keeps it all.
    """
    spark, out = df.sparkSession, folder(df.sparkSession, "streams")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={0 if mode == 'complete' else number}")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    rows = spark.read.schema(StructType([*df.schema.fields, StructField("batch", LongType())])).parquet(f"{out}/rows")
    if not keys:
        return rows.select(*df.columns)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), "batch").alias("last")).select("last.*")


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums of value by window and event type."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    grouped = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def user_sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


def without_repeats(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def with_static(events: DataFrame, table: DataFrame, key: str, at: str) -> DataFrame:
    """Each event of a stream with the row of a static table of its key; events without one stay, with nulls."""
    return events.join(table, events[key] == table[at], "left")


def follow_ups(first: DataFrame, then: DataFrame, key: str, seconds: int, late: str = "1 hour") -> DataFrame:
    """Pairs of two streams with equal keys, then_ts at first_ts or up to seconds later; state goes with the watermarks.

    first has event_id, key and ts; so has then. Returns key, first_id, first_ts, then_id, then_ts.
    """
    a = first.withWatermark("ts", late).select(F.col(key), F.col("event_id").alias("first_id"), F.col("ts").alias("first_ts"))
    b = then.withWatermark("ts", late).select(F.col(key).alias("key_"), F.col("event_id").alias("then_id"), F.col("ts").alias("then_ts"))
    within = (F.col("then_ts") >= F.col("first_ts")) & (F.col("then_ts") <= F.col("first_ts") + F.expr(f"interval {seconds} seconds"))
    return a.join(b, (F.col(key) == F.col("key_")) & within).drop("key_")


def totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """Running count, sum and greatest value of each key, kept in state of our own: key, n, total, most. Null values count as rows only."""

    def update(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, most = state.get if state.exists else (0, 0.0, None)
        for pdf in batches:
            known = pdf[value].dropna()
            n, total = n + len(pdf), total + float(known.sum())
            most = most if known.empty else float(known.max()) if most is None else max(most, float(known.max()))
        state.update((n, total, most))
        yield pd.DataFrame({key: [keys[0]], "n": [n], "total": [total], "most": [most]})

    rest = "n long, total double, most double"
    kind = events.schema[key].dataType.simpleString()
    return events.select(key, F.col(value).cast("double").alias(value)).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, {rest}", rest, "update", GroupStateTimeout.NoTimeout)
