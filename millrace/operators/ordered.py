"""Operators along an order within keys, for keys of any size: as-of and nearest joins, sessions, interpolation, ranks, running maxima.

Rows are sorted by key and order over range partitions, so that a key with most of the rows spreads over most of the tasks. Windows work in
pieces, the rows of a key in one partition; what a piece needs of those before or after it (the last known value, the last time, counts)
is carried over from one summary row for each piece. Only keys that reach over a border need it, two rows for each border at most, which are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import fresh, staged

BEFORE = (Window.unboundedPreceding, 0)
AFTER = (0, Window.unboundedFollowing)


class Pieces:
    """df sorted by the columns by and the order over range partitions, about pieces of them, staged: rows has the column piece, which ascends with the order."""

    def __init__(self, df: DataFrame, by: list[str], *order: Column, pieces: int | None = None):
        pieces = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        (self.piece,) = fresh(df, "piece")
        self.by, self.order = by, order
        run = df.repartitionByRange(pieces, *by, *order).withColumn(self.piece, F.spark_partition_id())
        self.rows = staged(run, "pieces")

    def window(self, *order: Column):
        return Window.partitionBy(*self.by, self.piece).orderBy(*(order or self.order))

    def carried(self, summary: dict[str, Column], carry: dict[str, Column], step: dict[str, Column] | None = None) -> DataFrame:
        """self.rows with the columns of carry, made of the summary columns of a key's pieces in order: null for keys of one piece.

        summary holds aggregates of a piece, step what is made of them for carry to use; both may use the windows _ahead and _behind.
        """
        key = F.struct(*self.by)
        own = self.rows.groupBy(key.alias("k"), F.col(self.piece).alias("at")).agg(*[c.alias(n) for n, c in summary.items()])
        many = own.withColumn("pieces_of_key", F.count("*").over(Window.partitionBy("k"))).filter("pieces_of_key > 1").withColumns(step or {})
        k, at = fresh(self.rows, "k", "at")
        made = many.select(F.col("k").alias(k), F.col("at").alias(at), *[c.alias(n) for n, c in carry.items()])
        return self.rows.join(F.broadcast(made), (F.col(self.piece) == F.col(at)) & key.eqNullSafe(F.col(k)), "left").drop(k, at)


def _ahead() -> Window:
    return Window.partitionBy("k").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)


def _behind() -> Window:
    return Window.partitionBy("k").orderBy("at").rowsBetween(1, Window.unboundedFollowing)


def _both(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str) -> tuple[DataFrame, str, str]:
    """The rows of left (side 1) and those of right with their at and value as known (side 0)."""
    known, side = fresh(left, "known", "side")
    other = right.select(*by, at, F.struct(F.col(at).alias("at"), F.col(value).alias("value")).alias(known), F.lit(0).alias(side))
    return left.withColumn(side, F.lit(1)).unionByName(other, allowMissingColumns=True), known, side


def _last(p: Pieces, known: str, position: Column, name: str) -> tuple[dict, dict]:
    return {f"last_{name}": F.max_by(known, F.when(F.col(known).isNotNull(), position))}, {name: F.last(f"last_{name}", ignorenulls=True).over(_ahead())}


def _first(p: Pieces, known: str, position: Column, name: str) -> tuple[dict, dict]:
    return {f"first_{name}": F.min_by(known, F.when(F.col(known).isNotNull(), position))}, {name: F.first(f"first_{name}", ignorenulls=True).over(_behind())}


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, name: str, pieces: int | None = None) -> DataFrame:
    """left with name: the value of the latest right row of its keys at or before it, null where there is none; no pairs.

    at is distinct by key in right, and right rows with a null value do not count. Null keys are one key. A left row with a null at meets right rows with a null at only.
    """
    both, known, side = _both(left, right.filter(F.col(value).isNotNull()), by, at, value)
    p = Pieces(both, by, F.col(at), F.col(side), pieces=pieces)
    (before,) = fresh(p.rows, "before")
    rows = p.carried(*_last(p, known, F.struct(at, side), before))
    latest = F.coalesce(F.last(known, ignorenulls=True).over(p.window().rowsBetween(*BEFORE)), F.col(before))
    found = F.when(latest["at"].isNull() == F.col(at).isNull(), latest["value"])
    return rows.withColumn(known, F.struct(found.alias("value"))).filter(F.col(side) == 1).select(*left.columns, F.col(known)["value"].alias(name))


def nearest_join(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, name: str, pieces: int | None = None) -> DataFrame:
    """left with name: the value of the right row of its keys whose at is nearest, the earlier one of two as near; null where there is none.

    at is a number, distinct by key in right; rows with a null at have no neighbours.
    """
    both, known, side = _both(left, right.filter(F.col(at).isNotNull()), by, at, value)
    p = Pieces(both, by, F.col(at), F.col(side), pieces=pieces)
    a, b = fresh(p.rows, "before", "after")
    position = F.struct(at, side)
    (s1, c1), (s2, c2) = _last(p, known, position, a), _first(p, known, position, b)
    rows = p.carried(s1 | s2, c1 | c2)
    rows = rows.withColumns({a: F.coalesce(F.last(known, ignorenulls=True).over(p.window().rowsBetween(*BEFORE)), F.col(a)), b: F.coalesce(F.first(known, ignorenulls=True).over(p.window().rowsBetween(*AFTER)), F.col(b))})
    first = F.col(b).isNull() | (F.col(at) - F.col(a)["at"] <= F.col(b)["at"] - F.col(at))
    found = F.when(F.col(at).isNull(), F.lit(None)).when(F.col(a).isNotNull() & first, F.col(a)["value"]).otherwise(F.col(b)["value"])
    return rows.filter(F.col(side) == 1).select(*left.columns, found.alias(name))


def sessions(events: DataFrame, by: str, at: Column, gap_s: int, *tie: str, pieces: int | None = None) -> DataFrame:
    """events with session, numbered from 1 for each key; a new one starts after a gap of more than gap_s seconds. Rows with a null at come first, each a session of its own."""
    when, new, first, base = fresh(events, "when", "new", "first_new", "sessions_before")
    p = Pieces(events.withColumn(when, at), [by], F.col(when), *map(F.col, tie), pieces=pieces)
    order = p.window()
    apart = F.coalesce(F.col(when) - F.lag(when).over(order) > gap_s, F.lit(True))
    p.rows = p.rows.withColumn(new, F.when(F.row_number().over(order) == 1, 0).otherwise(apart.cast("int")))
    reach = F.max("latest").over(_ahead())
    starts = F.when(F.col("unknown") | reach.isNull() | (F.col("earliest") - reach > gap_s), 1).otherwise(0)
    summary = {"earliest": F.min(when), "latest": F.max(when), "unknown": F.max(F.col(when).isNull()), "news": F.sum(new)}
    starts_before = F.sum(F.col("news") + F.col("starts")).over(_ahead())
    rows = p.carried(summary, {first: F.col("starts"), base: F.coalesce(starts_before, F.lit(0))}, {"starts": starts})
    number = F.sum(new).over(p.window().rowsBetween(*BEFORE)) + F.coalesce(F.col(first), F.lit(1)) + F.coalesce(F.col(base), F.lit(0))
    return rows.select(*events.columns, number.alias("session"))


def interpolated(df: DataFrame, by: str, x: str, y: str, *tie: str, pieces: int | None = None) -> DataFrame:
    """df with y filled between its known neighbours on a straight line over x, as y_filled; outside them it stays null. Rows with a null x are no neighbours."""
    known, a, b = fresh(df, "known", "before", "after")
    point = F.when(F.col(y).isNotNull() & F.col(x).isNotNull(), F.struct(F.col(x).cast("double").alias("x"), F.col(y).alias("y")))
    p = Pieces(df.withColumn(known, point), [by], F.col(x), *map(F.col, tie), pieces=pieces)
    position = F.struct(x, *tie)
    (s1, c1), (s2, c2) = _last(p, known, position, a), _first(p, known, position, b)
    rows = p.carried(s1 | s2, c1 | c2)
    rows = rows.withColumns({a: F.coalesce(F.last(known, ignorenulls=True).over(p.window().rowsBetween(*BEFORE)), F.col(a)), b: F.coalesce(F.first(known, ignorenulls=True).over(p.window().rowsBetween(*AFTER)), F.col(b))})
    (x0, y0), (x1, y1) = ((F.col(c)["x"], F.col(c)["y"]) for c in (a, b))
    line = y0 + (y1 - y0) * F.try_divide(F.col(x) - x0, x1 - x0)
    return rows.select(*df.columns, F.coalesce(y, line).alias(f"{y}_filled"))


def ranked(df: DataFrame, by: str, value: str, *tie: str, pieces: int | None = None) -> DataFrame:
    """df with its ranks in each group of by, value descending, nulls last: rank, dense, number (by tie too), cume, total.

    cume is the number of rows with the same or a greater value. A value that most rows have spreads over tasks too: it goes on from piece to
    piece, and takes its rank from the piece in which it begins, its cume from that in which it ends.
    """
    rank, dense, number, cume, above, distinct, begun, ended, on, over, total, first, last, k, at = fresh(
        df, "own_rank", "own_dense", "own_number", "own_cume", "above", "distinct", "begun", "ended", "goes_on", "goes_over", "all", "first", "last", "k", "at"
    )
    p = Pieces(df, [by], F.col(value).desc(), *map(F.col, tie), pieces=pieces)
    peers, mine = p.window(F.col(value).desc()), F.struct(F.col(value).alias("v"))
    rows = p.rows.select("*", F.rank().over(peers).alias(rank), F.dense_rank().over(peers).alias(dense), F.row_number().over(p.window()).alias(number), F.count("*").over(peers).alias(cume))
    own = rows.groupBy(F.struct(by).alias("k"), F.col(p.piece).alias("at")).agg(
        F.count("*").alias("n"), F.max(dense).alias("values"), F.max(rank).alias("rank_last"), F.max(F.when(F.col(dense) == 1, F.col(cume))).alias("n_first"), F.min_by(mine, dense).alias("first"), F.max_by(mine, dense).alias("last")
    )
    order = Window.partitionBy("k").orderBy("at")
    own = own.withColumns({
        "on": F.coalesce(F.col("first") == F.lag("last").over(order), F.lit(False)), "over": F.coalesce(F.col("last") == F.lead("first").over(order), F.lit(False)),
        "above": F.coalesce(F.sum("n").over(_ahead()), F.lit(0)), "all": F.sum("n").over(Window.partitionBy("k")),
    })
    own = own.withColumns({
        "begins": F.when(~F.col("on") | (F.col("values") > 1), F.col("above") + F.col("rank_last")), "ends": F.when(~F.col("over") | (F.col("values") > 1), F.col("above") + F.col("n_first")),
        "distinct": F.coalesce(F.sum(F.col("values") - F.col("on").cast("int")).over(_ahead()), F.lit(0)),
    })
    named = {"k": k, "at": at, "above": above, "distinct": distinct, "on": on, "over": over, "all": total, "first": first, "last": last}
    made = own.select(*[F.col(c).alias(n) for c, n in named.items()], F.last("begins", ignorenulls=True).over(_ahead()).alias(begun), F.first("ends", ignorenulls=True).over(_behind()).alias(ended))
    met = rows.join(made, (F.col(p.piece) == F.col(at)) & F.struct(by).eqNullSafe(F.col(k)))
    return met.select(
        *df.columns,
        F.when(F.col(on) & (mine == F.col(first)), F.col(begun)).otherwise(F.col(rank) + F.col(above)).alias("rank"),
        (F.col(dense) + F.col(distinct) - F.col(on).cast("int")).alias("dense"),
        (F.col(number) + F.col(above)).alias("number"),
        F.when(F.col(over) & (mine == F.col(last)), F.col(ended)).otherwise(F.col(cume) + F.col(above)).alias("cume"),
        F.col(total).alias("total"),
    )


def running_max(df: DataFrame, by: str, at: str, value: str, name: str, *tie: str, pieces: int | None = None) -> DataFrame:
    """df with the greatest value of its group so far in the order of at and tie, its own included."""
    p = Pieces(df, [by], F.col(at), *map(F.col, tie), pieces=pieces)
    (before,) = fresh(p.rows, "before")
    rows = p.carried({"best": F.max(value)}, {before: F.max("best").over(_ahead())})
    inside = F.max(value).over(p.window().rowsBetween(*BEFORE))
    return rows.select(*df.columns, F.greatest(inside, before).alias(name))
