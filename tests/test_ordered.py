"""Operators along an order, held against plain windows where one key has most rows and one value most of those."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace import operators
from millrace.operators import ordered


@pytest.fixture(scope="module")
def hot(spark):
    """900 of 1000 rows of one key; half of its values are equal; columns are named as helpers might be."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(1000):
        k = "hot" if i % 10 else ["a", "b", None][i // 10 % 3]
        at = None if i % 97 == 0 else int(rng.integers(0, 4000))
        v = None if i % 13 == 0 else 7.0 if rng.random() < 0.5 else float(rng.integers(0, 30))
        rows.append((i, k, at, v, "side", "piece", "known"))
    return spark.createDataFrame(rows, "id int, k string, at int, v double, side string, piece string, known string").repartition(4).cache()


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("pieces", [1, 7, 40])
def test_ranks(hot, pieces):
    w, tied = Window.partitionBy("k").orderBy(F.col("v").desc()), Window.partitionBy("k").orderBy(F.col("v").desc(), "id")
    want = hot.select("id", F.rank().over(w), F.dense_rank().over(w), F.row_number().over(tied), F.count("*").over(w), F.count("*").over(Window.partitionBy("k")), "piece")
    got = operators.ranked(hot, "k", "v", "id", pieces=pieces)
    assert rows(got, "id", "rank", "dense", "number", "cume", "total", "piece") == rows(want, "*")


def test_ranks_of_one_value_alone(spark):
    df = spark.range(500).select(F.lit(1).alias("k"), F.lit(3.0).alias("v"), "id")
    got = operators.ranked(df, "k", "v", "id", pieces=20)
    assert rows(got, "id", "rank", "dense", "number", "cume") == sorted(((i, 1, 1, i + 1, 500) for i in range(500)), key=repr)


@pytest.mark.parametrize("pieces", [1, 7, 40])
def test_running_maxima_sessions_and_interpolation(hot, pieces):
    w = Window.partitionBy("k").orderBy("at", "id")
    upto, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    assert rows(operators.running_max(hot, "k", "at", "v", "best", "id", pieces=pieces), "id", "best", "side") == rows(hot.select("id", F.max("v").over(upto), "side"), "*")
    new = F.coalesce(F.col("at") - F.lag("at").over(w) > 5, F.lit(True)).cast("int")
    want = hot.withColumn("new", new).select("id", F.sum("new").over(upto), "known")
    assert rows(operators.sessions(hot, "k", F.col("at"), 5, "id", pieces=pieces), "id", "session", "known") == rows(want, "*")
    known = F.when(F.col("v").isNotNull() & F.col("at").isNotNull(), F.struct("at", "v"))
    both = hot.withColumns({"x": F.last(known, ignorenulls=True).over(upto), "y": F.first(known, ignorenulls=True).over(on)})
    line = F.col("x.v") + (F.col("y.v") - F.col("x.v")) * F.try_divide(F.col("at") - F.col("x.at"), F.col("y.at") - F.col("x.at"))
    got = operators.interpolated(hot, "k", "at", "v", "id", pieces=pieces)
    assert rows(got.select("id", F.round("v_filled", 9), "piece"), "*") == rows(both.select("id", F.round(F.coalesce("v", line), 9), "piece"), "*")


@pytest.mark.parametrize("pieces", [1, 7, 40])
def test_as_of_and_nearest(hot, pieces):
    right = hot.filter("at is not null and id % 2 = 1").groupBy("k", "at").agg(F.max("id").alias("value"))
    left = hot.filter("id % 2 = 0")
    known = {}
    for r in right.collect():
        known.setdefault(r.k, []).append((r.at, r.value))

    def latest(k, at):
        return max((p for p in known.get(k, []) if at is not None and p[0] <= at), default=(0, None))[1]

    def nearest(k, at):
        return min(((abs(p[0] - at), p[0], p[1]) for p in known.get(k, [])), default=(0, 0, None))[2] if at is not None else None

    for f, name in ((operators.asof_join, latest), (operators.nearest_join, nearest)):
        got = f(left, right, ["k"], "at", "value", "found", pieces=pieces)
        assert got.columns == [*left.columns, "found"]
        assert {r.id: (r.found, r.side) for r in got.collect()} == {r.id: (name(r.k, r.at), "side") for r in left.collect()}


def test_a_hot_key_is_in_no_single_task(hot):
    p = ordered.Pieces(hot, ["k"], F.col("at"), F.col("id"), pieces=10)
    sizes = [r.n for r in p.rows.filter("k = 'hot'").groupBy(p.piece).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 8 and max(sizes) < 250


def test_frontier_with_nulls_and_ties(spark):
    rng = np.random.default_rng(2)
    points = [(None if rng.random() < 0.1 else int(rng.integers(0, 25)), None if rng.random() < 0.1 else int(rng.integers(0, 25)), "reach") for _ in range(300)] + [(None, 99, "reach"), (0, None, "reach")]
    known = [p for p in points if None not in p]
    want = [p for p in known if not any((q[0] <= p[0] and q[1] > p[1]) or (q[0] < p[0] and q[1] >= p[1]) for q in known)]
    df = spark.createDataFrame(points, "c int, g int, reach string")
    for pieces in (2, 6, 50):
        assert sorted(map(tuple, operators.frontier(df, "c", "g", pieces).collect())) == sorted(want)
    assert operators.frontier(df.filter("c is null"), "c", "g", 6).count() == 0
    assert [tuple(r) for r in operators.frontier(spark.createDataFrame([(None, 9.0), (1.0, 5.0)], "c double, g double"), "c", "g", 4).collect()] == [(1.0, 5.0)]
