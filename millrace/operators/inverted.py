"""Vector search by an inverted file: rows lie in the lists of their nearest centroids, queries ask the lists nearest to them.

Centroids come from a bounded sample; every row is indexed. A row crosses the shuffle once, whatever the number of queries, but for lists that
more than a block of queries asks. In exact mode a second round asks all lists that could still hold a better row: by the triangle inequality
on angles, those whose centroid is no further from the query than its k-th answer so far and the list's radius together.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import fresh, staged

#: Bounds of what goes to the driver and, as centroids, to every task: vectors of the fit, lists, and numbers of all centroids.
SAMPLE, MOST_CELLS, MOST_NUMBERS = 20_000, 4096, 8_000_000
#: Cosines that a task holds at once, and rows of vectors that it gives out at once.
AT_ONCE, GIVEN = 1 << 20, 1 << 14


def sound(vector: str, size: int | None = None) -> Column:
    """Whether a vector has a direction: not null, no null, infinite or NaN component, not zero, and of the stated size."""
    number = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    ok = number & F.exists(vector, lambda v: v != 0)
    return F.coalesce(ok & (F.size(vector) == size) if size else ok, F.lit(False))


def _units(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one size, scaled to length 1 by their largest component first, so that squares neither overflow nor vanish."""
    n = len(column)
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1 if n else 0)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True) if n else flat
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _pieces(n: int, others: int):
    """(from, to) ranges over n rows, each of which meets as many others, with about AT_ONCE meetings each."""
    step = max(1, AT_ONCE // max(1, others))
    return ((i, min(i + step, n)) for i in range(0, n, step))


def fitted(rows: DataFrame, key: str, vector: str, cells: int, sample: int = SAMPLE, rounds: int = 10, seed: int = 42) -> np.ndarray:
    """Up to so many centroids of length 1, by spherical k-means over the sample rows of least hash; their size is the most frequent one there."""
    held = rows.filter(sound(vector)).select(vector, F.xxhash64(F.lit(seed), key).alias("hash_")).orderBy("hash_").limit(sample).toArrow().column(0).combine_chunks()
    if not len(held):
        return np.zeros((0, 0))
    sizes = np.diff(held.offsets.to_numpy())
    size = int(np.bincount(sizes).argmax())
    x = _units(held.filter(pa.array(sizes == size)))
    cells = max(1, min(cells, len(x), MOST_NUMBERS // size))
    at = x[np.random.default_rng(seed).choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[i:j] @ at.T, axis=1) for i, j in _pieces(len(x), cells)])
        sums = np.zeros_like(at)
        np.add.at(sums, near, x)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        at = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), at)
    return at


def _cut(batches, cells: int):
    """Batches cut so that a task holds no more than about AT_ONCE cosines with so many centroids, however long batches are."""
    for batch in batches:
        for i, j in _pieces(batch.num_rows, cells):
            yield batch.slice(i, j - i)


def _placed(df: DataFrame, key: str, vector: str, keep: list[str], at: np.ndarray) -> DataFrame:
    """key, keep, vector, cell (its nearest centroid) and angle to that."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    names = [key, *keep, vector]

    def work(batches):
        for batch in _cut(batches, len(at)):
            sims = np.clip(_units(batch.column(len(names) - 1)) @ at.T, -1, 1)
            cell = sims.argmax(axis=1)
            angle = np.arccos(sims[np.arange(len(sims)), cell])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], [*names, "cell_", "angle_"])

    return df.filter(sound(vector, at.shape[1])).select(*names).mapInArrow(work, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", cell_ int, angle_ double")


def _asked(queries: DataFrame, key: str, vector: str, at: np.ndarray, probes: int, radius: np.ndarray | None = None, least: str | None = None) -> DataFrame:
    """query_id, vector and cell_: the probes nearest lists of each query, or, with radius, the further ones that may hold a row of cosine least or more."""
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema}
    names = [key, vector, *([least] if least else [])]

    def work(batches):
        for batch in _cut(batches, len(at)):
            sims = np.clip(_units(batch.column(1)) @ at.T, -1, 1)
            first = np.argsort(-sims, axis=1, kind="stable")[:, :probes]
            wanted = np.zeros(sims.shape, bool)
            if radius is None:
                np.put_along_axis(wanted, first, True, axis=1)
            else:
                top = np.cos(np.maximum(np.arccos(sims) - radius, 0))
                wanted = (top >= batch.column(2).to_numpy()[:, None] - 3e-6) & (radius >= 0)
                np.put_along_axis(wanted, first, False, axis=1)
            q, cell = np.nonzero(wanted)
            for i in range(0, len(q), GIVEN):
                yield pa.RecordBatch.from_arrays([*batch.select([0, 1]).take(pa.array(q[i : i + GIVEN])).columns, pa.array(cell[i : i + GIVEN].astype(np.int32))], ["query_id", vector, "cell_"])

    return queries.select(*names).mapInArrow(work, f"query_id {kinds[key]}, `{vector}` {kinds[vector]}, cell_ int")


def _best(placed: DataFrame, asked: DataFrame, key: str, vector: str, keep: list[str], k: int, block: int) -> DataFrame:
    """query_id, key, keep and sim of the k best rows of each asked list by query; lists and their queries are cut into blocks."""
    counts = placed.groupBy("cell_").agg(F.ceil(F.count("*") / block).cast("int").alias("rows_")).join(asked.groupBy("cell_").agg(F.ceil(F.count("*") / block).cast("int").alias("queries_")), "cell_")

    def dealt(df: DataFrame, by: str, mine: str, others: str) -> DataFrame:
        own = F.pmod(F.xxhash64(by), F.col(f"{mine}_")).cast("int")
        cut = df.join(F.broadcast(counts), "cell_").withColumn(f"{mine}_at_", own)  # a row for each list
        return cut.withColumn(f"{others}_at_", F.explode(F.sequence(F.lit(0), F.col(f"{others}_") - 1))).drop("rows_", "queries_")

    left = dealt(placed.drop("angle_"), key, "rows", "queries")
    right = dealt(asked, "query_id", "queries", "rows")
    kinds = {f.name: f.dataType.simpleString() for f in [*left.schema, *right.schema]}
    names = ["query_id", key, *keep]
    by = ["cell_", "rows_at_", "queries_at_"]

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        a, parts = a.sort_by(key), []
        x, y = _units(a.column(vector)), _units(b.column(vector))
        for at, to in _pieces(b.num_rows if a.num_rows else 0, a.num_rows):
            sims = np.round(y[at:to] @ x.T, 6)
            top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
            found = a.take(pa.array(top.ravel()))
            query = b.column("query_id").take(pa.array(np.repeat(np.arange(at, at + len(sims)), top.shape[1])))
            parts.append(pa.table([query, *[found.column(c) for c in names[1:]], pa.array(np.take_along_axis(sims, top, 1).ravel())], [*names, "sim"]))
        none = pa.table([b.column("query_id").slice(0, 0), *[a.column(c).slice(0, 0) for c in names[1:]], pa.array([], pa.float64())], [*names, "sim"])
        return pa.concat_tables(parts) if parts else none

    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(best, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", sim double")


def search(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, *keep: str, cells: int | None = None, probes: int = 8, exact: bool = False, sample: int = SAMPLE, block: int = 8192) -> DataFrame:
    """For each query up to k rows of greatest cosine among those of its probed lists (exact: among all): query_id, rank, key, keep, sim (to 6 places).

    key is distinct and not null. Vectors without a direction, and those of another size than most of the sample, are left out on both sides.
    Equal sims rank by key. cells is twice the square root of the rows, 4096 at most, unless stated; no rows or no queries give no answers.
    """
    cells = cells or min(MOST_CELLS, max(1, 2 * math.isqrt(rows.count())))
    at = fitted(rows, key, vector, cells, sample)
    rows, queries = (df.filter(F.col(key).isNotNull()) for df in (rows, queries))
    if not len(at):
        return rows.limit(0).select(F.col(key).alias("query_id"), F.lit(0).alias("rank"), key, *keep, F.lit(0.0).alias("sim"))
    placed = staged(_placed(rows, key, vector, list(keep), at), "lists")
    queries = queries.filter(sound(vector, at.shape[1]))
    asked = _asked(queries, key, vector, at, probes)
    order = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), key)

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", key, *keep, "sim")

    found = ranked(_best(placed, asked, key, vector, list(keep), k, block))
    if not exact:
        return found
    found = staged(found, "found")
    radius = np.full(len(at), -1.0)
    for cell, most in placed.groupBy("cell_").agg(F.max("angle_")).collect():  # a row for each list
        radius[cell] = most
    of, least = fresh(queries, "of", "least")
    kth = found.groupBy(F.col("query_id").alias(of)).agg(F.when(F.count("*") == k, F.min("sim")).otherwise(-2.0).alias(least))
    open_ = queries.join(kth, F.col(key) == F.col(of), "left").withColumn(least, F.coalesce(least, F.lit(-2.0)))
    more = _best(placed, _asked(open_, key, vector, at, probes, radius, least), key, vector, list(keep), k, block)
    return ranked(found.drop("rank").unionByName(more))
