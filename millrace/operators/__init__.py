"""Operators that compose built-in DataFrame operations."""

from __future__ import annotations

import functools
import math
import operator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import fresh
from .inverted import sound
from .ordered import asof_join, interpolated, nearest_join, ranked, running_max, sessions  # noqa: F401


#: Keys with two numbers each are broadcast up to so many rows; beyond it, Spark shuffles both sides.
BROADCAST_KEYS = 500_000


def range_join(left: DataFrame, right: DataFrame, at: str, start: str, end: str, width: float, on: list[str] | None = None) -> DataFrame:
    """Pairs with start <= at < end (and equal on columns, which right names with an r_): an equi-join on position buckets of width.

    Intervals are repeated for each bucket that they touch; choose width near their usual length.
    """
    a = left.withColumn("bucket_", F.floor(F.col(at) / width))
    b = right.withColumn("bucket__", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    same = functools.reduce(operator.and_, [F.col(c) == F.col(f"r_{c}") for c in on or []], F.col("bucket_") == F.col("bucket__"))
    return a.join(b, same & (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("bucket_", "bucket__")


def cut_at(value: str, splits: Column) -> Column:
    """The number of splits below value: a piece that depends on the value alone, 0 for null."""
    return F.coalesce(F.size(F.filter(splits, lambda x: x < F.col(value))), F.lit(0))


def in_pieces(df: DataFrame, by: str, value: str, pieces: int = 64, accuracy: int = 10_000) -> tuple[DataFrame, str]:
    """df with a further column, and its name: each group of by is cut at about equal counts of value; equal values share a piece, and pieces ascend with value.

    The cuts come from one quantile sketch for each group, so that a group of any size spreads over tasks.
    """
    piece, of, splits = fresh(df, "piece", "of", "splits")
    cuts = F.percentile_approx(value, [i / pieces for i in range(1, pieces)], accuracy)
    found = df.groupBy(F.col(by).alias(of)).agg(cuts.alias(splits))
    return df.join(found, F.col(by).eqNullSafe(F.col(of))).withColumn(piece, cut_at(value, F.col(splits))).drop(of, splits), piece


def tile(number: Column, total: Column, tiles: int) -> Column:
    """The tile, from 1, of a row number from 1: the first total % tiles of them hold one row more."""
    size, larger = F.floor(total / tiles), total % tiles
    edge = larger * (size + 1)
    return F.when(number <= edge, F.floor((number - 1) / (size + 1)) + 1).otherwise(F.floor((number - 1 - edge) / F.greatest(size, F.lit(1))) + larger + 1)


def z_scores(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """df with value less its group's mean in units of its deviation; null where that is zero. Groups are aggregated and joined back."""
    stats = df.groupBy(F.col(by).alias("by_")).agg(F.avg(value).alias("mean_"), F.stddev(value).alias("deviation_"))
    out = df.join(stats, F.col(by).eqNullSafe(F.col("by_")))
    return out.withColumn(name, F.try_divide(F.col(value) - F.col("mean_"), F.col("deviation_"))).drop("by_", "mean_", "deviation_")


def added(original: DataFrame, expanded: DataFrame, key: str) -> DataFrame:
    """expanded with state: kept (a key and row of original), changed (its key, another row) or new; columns meet by name."""
    same = [c for c in original.columns if c != key]
    known = original.select(F.col(key).alias("key_"), F.struct(*same).alias("was_"))
    state = F.when(F.col("key_").isNull(), "new").when(F.col("was_").eqNullSafe(F.struct(*same)), "kept").otherwise("changed")
    return expanded.join(known, F.col(key) == F.col("key_"), "left").withColumn("state", state).drop("key_", "was_")


def frontier(df: DataFrame, cost: str, gain: str, pieces: int) -> DataFrame:
    """The rows that no row of lower or equal cost beats in gain, nor one of lower cost equals (Pareto), in two passes without a global sort.

    Rows with a null cost or gain are on no frontier and beat nothing; rows equal in both stay or go together. Costs are cut into pieces of about
    equal count. The best gain by piece gives what lower pieces reach; only rows above that are ranked within their piece. The window
    over pieces has so many rows at most.
    """
    piece, of, reach, inside, best = fresh(df, "piece", "of", "reach", "inside", "best")
    known = df.filter(F.col(cost).isNotNull() & F.col(gain).isNotNull())
    splits = known.agg(F.percentile_approx(cost, [i / pieces for i in range(1, pieces)], 10_000)).first()[0]  # pieces - 1 numbers
    cut = known.withColumn(piece, cut_at(cost, F.array(*map(F.lit, splits))) if splits else F.lit(0))
    by = cut.groupBy(F.col(piece).alias(of)).agg(F.max(gain).alias(best))
    before = by.select(of, F.max(best).over(Window.orderBy(of).rowsBetween(Window.unboundedPreceding, -1)).alias(reach))
    left = cut.join(F.broadcast(before), F.col(piece) == F.col(of)).filter(F.col(reach).isNull() | (F.col(gain) > F.col(reach)))
    points = left.groupBy(F.col(piece), F.col(cost).alias(of)).agg(F.max(gain).alias(best))
    lower = F.max(best).over(Window.partitionBy(piece).orderBy(of).rowsBetween(Window.unboundedPreceding, -1))
    points = points.withColumn(inside, lower).filter(F.col(inside).isNull() | (F.col(best) > F.col(inside))).select(F.col(piece).alias(reach), of, best)
    met = left.drop(of, reach).join(points, (F.col(piece) == F.col(reach)) & (F.col(cost) == F.col(of)) & (F.col(gain) == F.col(best)))
    return met.select(*df.columns)


def gram(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Sums of products of the columns and a constant 1, in one aggregate; rows with a null among them are left out."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns], F.lit(1.0).alias("one_")).dropna()
    names = [*columns, "one_"]
    sums = rows.agg(*[F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]]).first()
    out, it = np.zeros((len(names), len(names))), iter(sums)
    for i in range(len(names)):
        for j in range(i, len(names)):
            out[i, j] = out[j, i] = next(it) or 0.0
    return out


def least_squares(df: DataFrame, y: str, xs: list[str]) -> dict[str, float]:
    """Coefficients by column, intercept and r2, from the Gram sums; the driver solves a system of len(xs) + 1."""
    g = gram(df, [*xs, y])
    at = [*range(len(xs)), len(xs) + 1]
    a, b, n, sy, syy = g[np.ix_(at, at)], g[at, len(xs)], g[-1, -1], g[len(xs), -1], g[len(xs), len(xs)]
    if n <= len(xs):
        return {}
    beta = np.linalg.lstsq(a, b, rcond=None)[0]
    rest = syy - 2 * beta @ b + beta @ a @ beta
    return dict(zip([*xs, "intercept"], map(float, beta))) | {"r2": float(1 - rest / (syy - sy * sy / n)), "n": float(n)}


def power_law(df: DataFrame, n: str, d: str, loss: str, grid: list[float]) -> dict[str, float]:
    """loss = e + a n^-alpha + b d^-beta over a grid of exponents, each solved in closed form; all sums come from one aggregate.

    at_edge tells that the best exponents lie on the grid's border, where they are not identified.
    """
    terms = {f"n{i}": F.pow(F.col(n), -x) for i, x in enumerate(grid)} | {f"d{i}": F.pow(F.col(d), -x) for i, x in enumerate(grid)}
    g = gram(df.filter((F.col(n) > 0) & (F.col(d) > 0)).select(*[c.alias(k) for k, c in terms.items()], F.col(loss).alias("y_")), [*terms, "y_"])
    m, y = len(grid), 2 * len(grid)
    best = None
    for i in range(m):
        for j in range(m):
            at = [i, m + j, y + 1]
            beta = np.linalg.lstsq(g[np.ix_(at, at)], g[at, y], rcond=None)[0]
            rest = g[y, y] - 2 * beta @ g[at, y] + beta @ g[np.ix_(at, at)] @ beta
            if best is None or rest < best[0]:
                best = (rest, i, j, beta)
    rest, i, j, (a, b, e) = best
    return {"e": float(e), "a": float(a), "alpha": grid[i], "b": float(b), "beta": grid[j], "sse": float(rest), "at_edge": bool({i, j} & {0, m - 1})}


def _segments(n: Column, most: int) -> list[tuple[Column, Column]]:
    """Start (from 0) and length of the most + 1 segments of a name of n letters."""
    cuts = [F.floor(n * i / (most + 1)).cast("int") for i in range(most + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def fuzzy_matches(left: DataFrame, right: DataFrame, name: str, other: str, most: int, group: int = 1024) -> DataFrame:
    """Pairs whose names, in lower case without punctuation, are within most edits; all of them, and each pair of rows once.

    Of most + 1 segments of a name, one at least stands unchanged in any name within most edits, moved by most
    letters or fewer; distinct names that share one are compared. Segments that more than group names
    have are dealt over blocks of about that many. Null names match nothing.
    """
    def plain(c: str) -> Column:
        return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")

    def key(length: Column, i: int, piece: Column) -> Column:
        return F.struct(length.alias("length"), F.lit(i).alias("i"), piece.alias("piece"))

    def moved(length: Column) -> Column:
        keys = []
        for i, (start, size) in enumerate(_segments(length, most)):
            for by in range(-most, most + 1):
                inside = (start + by >= 0) & (start + by + size <= F.length("x"))
                keys.append(F.when(inside, key(length, i, F.substring(F.col("x"), start + by + 1, size))))
        return F.filter(F.array(*keys), lambda k: k.isNotNull())

    n = F.length("x")
    a = left.select(plain(name).alias("x")).filter("x is not null").distinct()
    b = right.select(plain(other).alias("x")).filter("x is not null").distinct()
    a = a.select("x", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.greatest(n - most, F.lit(0)), n + most), moved)))).alias("k"))
    b = b.select("x", F.explode(F.array(*[key(n, i, F.substring(F.col("x"), start + 1, size)) for i, (start, size) in enumerate(_segments(n, most))])).alias("k"))

    def blocks(df: DataFrame) -> DataFrame:
        return df.groupBy("k").agg(F.ceil(F.count("*") / group).alias("n")).filter("n > 1")

    na, nb = blocks(a).select("k", F.col("n").alias("na")), blocks(b).select("k", F.col("n").alias("nb"))
    hot = na.join(nb, "k", "full").select("k", F.coalesce("na", F.lit(1)).alias("na"), F.coalesce("nb", F.lit(1)).alias("nb"))
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_KEYS else hot

    def dealt(df: DataFrame, own: str, others: str) -> DataFrame:
        cut = df.join(hot, "k", "left").fillna(1, ["na", "nb"])
        mine, theirs = F.pmod(F.xxhash64("x"), F.col(own)), F.sequence(F.lit(0).cast("long"), F.col(others) - 1)
        return cut.withColumn(f"{own}_", mine).withColumn(f"{others}_", F.explode(theirs)).drop("na", "nb")

    a, b = dealt(a, "na", "nb").withColumnRenamed("x", "plain_"), dealt(b, "nb", "na").withColumnRenamed("x", "plain__")
    near = F.levenshtein("plain_", "plain__") <= most
    pairs = a.join(b, ["k", "na_", "nb_"]).filter(near).select("plain_", "plain__").distinct()
    return left.withColumn("plain_", plain(name)).join(pairs, "plain_").join(right.withColumn("plain__", plain(other)), "plain__").drop("plain_", "plain__")


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, *keep: str, block: int = 8192) -> DataFrame:
    """For every query the k rows of greatest cosine, exactly: query_id, rank (from 1), key, keep and sim (rounded to 6 places).

    key is distinct. Vectors that are null or zero, have null or non-finite components, or another length than most rows have, are left
    out on both sides. Equal sims rank by key. Queries and rows are cut into blocks, each pair of blocks gives
    its k best rows by query, and these are merged by query: no task holds more than two blocks.
    """
    rows, queries = (df.filter(F.col(key).isNotNull() & sound(vector)) for df in (rows, queries))
    length = rows.groupBy(F.size(vector).alias("n")).agg(F.count("*").alias("rows")).orderBy(F.col("rows").desc(), "n").first()
    rows, queries = (df.filter(F.size(vector) == (length.n if length else 0)) for df in (rows, queries))
    n_rows, n_queries = max(math.ceil(rows.count() / block), 32), max(math.ceil(queries.count() / block), 1)

    def cut(number: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(number)).cast("int")

    def each(number: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(number - 1)))

    left = rows.select(key, *keep, F.col(vector).alias("v_"), cut(n_rows).alias("rb_"), each(n_queries).alias("qb_"))
    right = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("v_"), cut(n_queries).alias("qb_"), each(n_rows).alias("rb_"))
    fields = {f.name: f.dataType.simpleString() for f in [*left.schema.fields, *right.schema.fields]}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in ["query_id", key, *keep]) + ", sim double"

    def unit(table: pa.Table) -> np.ndarray:
        flat = pa.compute.list_flatten(table.column("v_")).to_numpy().astype(np.float64).reshape(table.num_rows, -1)
        return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        a = a.sort_by(key)
        names = ["query_id", key, *keep]
        if not a.num_rows or not b.num_rows:
            return pa.table([b.column("query_id").slice(0, 0), *[a.column(c).slice(0, 0) for c in names[1:]], pa.array([], pa.float64())], [*names, "sim"])
        x, y, parts = unit(a), unit(b), []
        for at in range(0, b.num_rows, 256):
            sims = np.round(y[at : at + 256] @ x.T, 6)
            top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
            found = a.take(pa.array(top.ravel()))
            query = b.column("query_id").take(pa.array(np.repeat(np.arange(at, at + len(sims)), top.shape[1])))
            parts.append(pa.table([query, *[found.column(c) for c in names[1:]], pa.array(np.take_along_axis(sims, top, 1).ravel())], [*names, "sim"]))
        return pa.concat_tables(parts)

    found = left.groupBy("rb_", "qb_").cogroup(right.groupBy("rb_", "qb_")).applyInArrow(best, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("sim").desc(), key))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", key, *keep, "sim")
