"""State of our own with timers: sessions whose state goes once the watermark has passed them, and what streams report of late rows and state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..scratch import folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROGRESS = "run long, input_rows long, late_rows long, state_rows long"


@contextmanager
def rocks_state(spark: SparkSession):
    """State beyond the memory of executors needs this state store."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


HELD = ["key", "start", "last", "n", "total", "kinds"]


def _linked(parts: list[pa.Table], gap: int) -> pa.Table:
    """Sessions (rows alone are sessions too) of the same key less than gap apart become one; kinds are lists of different strings."""
    t = pa.concat_tables(parts).combine_chunks()
    key, start, last, n, total = (t.column(c).to_numpy() for c in HELD[:5])
    codes = pd.factorize(key, use_na_sentinel=False)[0]
    order = np.lexsort((last, start, codes))
    codes, start, last = codes[order], start[order], last[order]
    reach = pd.Series(last).groupby(codes).cummax().to_numpy()
    new = np.ones(len(order), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (start[1:] - reach[:-1] >= gap)
    first, number = np.flatnonzero(new), np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    lists = t.column("kinds").combine_chunks()
    owner = np.repeat(number, lists.value_lengths().to_numpy(zero_copy_only=False))
    kinds, names = pd.factorize(lists.flatten().to_numpy(zero_copy_only=False))
    owner, kinds = np.divmod(np.unique(owner * max(1, len(names)) + kinds), max(1, len(names)))
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(first)))]).astype(np.int32)
    sums = (np.add.reduceat(x[order], first) if len(first) else x for x in (n, total))
    most = np.maximum.reduceat(last, first) if len(first) else last
    kinds = pa.ListArray.from_arrays(ends, pa.array(names, pa.string()).take(pa.array(kinds)))
    return pa.table([t.column("key").take(pa.array(order[first])), start[first], most, *sums, kinds], HELD)


def _alone(pdf: pd.DataFrame) -> pa.Table:
    """Each row as a session."""
    known = pdf["kind"].notna().to_numpy()
    kinds = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(known)]).astype(np.int32), pa.array(pdf["kind"].to_numpy()[known], pa.string()))
    at = pdf["at"].to_numpy()
    return pa.table([pa.array(pdf["key"], pa.string(), from_pandas=True), at, at, np.ones(len(at), np.int64), np.nan_to_num(pdf["value"].to_numpy(), nan=0.0, posinf=np.inf, neginf=-np.inf), kinds], HELD)


def _packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _sessions(gap: int):
    """What is done with the rows of a group of keys, and once its timer has passed: gives closed sessions out, keeps open ones in its state.

    Times are microseconds. A row joins a session that it is less than gap away from, and sessions that it links become one. A session
    is given out, and its state deleted, when the watermark reaches its end plus gap; rows come in any order.
    """

    def work(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [pa.ipc.open_stream(bytes(state.get[0])).read_all()] if state.exists else []
        now = _linked([*parts, *[_linked([_alone(pdf)], gap) for pdf in frames if len(pdf)]], gap)
        due = -(-(now.column("last").to_numpy() + gap) // 1000)
        open_ = due > state.getCurrentWatermarkMs()
        if open_.any():
            state.update((_packed(now.filter(pa.array(open_))),))
            state.setTimeoutTimestamp(int(due[open_].min()) - 1)  # a timer runs once the watermark is beyond it
        elif state.exists:
            state.remove()
        if not open_.all():
            ended = now.filter(pa.array(~open_))
            yield pd.DataFrame({c: ended.column(c).to_pandas() for c in HELD[:5]} | {"kinds": pc.list_value_length(ended.column("kinds")).to_numpy()})

    return work


def expiring_sessions(events: DataFrame, key: str, gap: int, late: str = "1 hour", groups: int = 1024) -> DataFrame:
    """Closed sessions of a stream with key, ts, value and kind: key, start, last (microseconds), n, total, kinds (how many differ).

    Rows of one key (whole numbers, strings or dates) less than gap seconds apart share a session. Null values add nothing, null kinds do
    not count, rows with null ts are left out. Keys are dealt by hash over groups, which share a row of state and a timer: a call for each
    key would cost more than its rows. All runs from one checkpoint need the same number; a group's rows of a batch are held together,
    so more rows a batch than some hundred million need more groups. Runs under rocks_state.
    """
    rows = events.withWatermark("ts", late).filter("ts is not null")
    rows = rows.select(F.pmod(F.xxhash64(key), F.lit(groups)).alias("group"), F.col(key).cast("string").alias("key"), "ts", F.unix_micros("ts").alias("at"), F.col("value").cast("double").alias("value"), F.col("kind").cast("string").alias("kind"))
    out = "key string, start long, last long, n long, total double, kinds int"
    closed = rows.groupBy("group").applyInPandasWithState(_sessions(gap * 1_000_000), out, "open binary", "append", GroupStateTimeout.EventTimeTimeout)
    return closed.select(F.col("key").cast(events.schema[key].dataType).alias(key), "start", "last", "n", "total", "kinds")


def in_runs(parts: list[DataFrame], transform: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Parts come in one after the other, each drained in a run of its own from one checkpoint, in append mode.

    Gives the rows that transform gave out (with run), and a row for each run: rows that came in, rows dropped as late, and rows of state at its end.
    """
    spark, out = parts[0].sparkSession, folder(parts[0].sparkSession, "runs")
    schema, progress, made = parts[0].schema, [], None
    for run, part in enumerate(parts):
        part.write.parquet(f"{out}/in/{run}")
        made = transform(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{out}/in"))

        def write(batch: DataFrame, number: int, run: int = run) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/rows/run={run}/batch={number}")

        query = made.writeStream.outputMode("append").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
        seen = [(p["numInputRows"], sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"]), sum(s["numRowsTotal"] for s in p["stateOperators"])) for p in query.recentProgress]
        progress.append((run, sum(s[0] for s in seen), sum(s[1] for s in seen), seen[-1][2] if seen else None))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields)
    rows = spark.read.schema(f"{fields}, run long, batch long").parquet(f"{out}/rows").drop("batch")
    return rows, spark.createDataFrame(progress, PROGRESS)
