"""Frequent items against exact counts on skewed data; samples against plain sorting."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import frequent, sampling


@pytest.mark.parametrize("skew", [1.1, 1.6, 3.0])
@pytest.mark.parametrize("most", [None, 3, 40])
def test_frequent_items(spark, skew, most):
    rng = np.random.default_rng(7)
    items = [None if x == 2 else f"w{x}" for x in rng.zipf(skew, 5000)] + ["late"] * 400
    counts = Counter(items)
    df = spark.createDataFrame([(x,) for x in items], "item string")
    for share in (0.01, 0.05, 0.3):
        if most and (most + 1) * share <= 1:
            with pytest.raises(ValueError, match="counters"):
                frequent.frequent_items(df, "item", share, most)
            continue
        got = {r["item"]: r.n for r in frequent.frequent_items(df.repartition(5), "item", share, most).collect()}
        assert got == {k: n for k, n in counts.items() if n >= share * len(items)}
        may, n = frequent.frequent_bounds(df.repartition(5), "item", share, most)
        found = {r["item"]: r for r in may.collect()}
        assert n == len(items) and all(r.at_least <= counts[k] <= r.at_most for k, r in found.items())
        if most is None:
            assert len(found) <= 2 / share and all(r.at_most - r.at_least <= share * n / 2 for r in found.values())
    assert frequent.frequent_items(df.limit(0), "item", 0.1).count() == 0


def wanted(rows, size, seed=42):
    def key(r):
        h = int(hashlib.md5(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16)
        return -math.log((h + 0.5) / 2**52) / r[2]

    out = []
    for k in {r[1] for r in rows}:
        n = size.get(k, 0) if isinstance(size, dict) else size
        out += sorted((r for r in rows if r[1] == k and r[2] is not None and r[2] > 0), key=lambda r: (key(r), r[0]))[:n]
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [0, 1, 17, 10_000, {"hot": 300, "b": 2, "none": 4}])
def test_stratified(spark, size):
    rng = np.random.default_rng(3)
    rows = [(i, "hot" if i % 10 else [None, "a", "b"][i % 3], None if i % 31 == 0 else float(rng.integers(0, 5)), "x") for i in range(1500)]
    df = spark.createDataFrame(rows, "id int, k string, w double, rank string")
    for parts, pieces in ((1, 4), (7, 256)):
        assert sorted(map(tuple, sampling.stratified(df.repartition(parts), "k", "id", size, "w", pieces=pieces).collect()), key=repr) == wanted(rows, size)


def test_samples_of_parts_make_the_sample_of_the_whole(spark):
    df = spark.range(3000).select("id", (F.col("id") % 4).alias("k"))
    whole = sampling.stratified(df, "k", "id", 50).collect()
    parts = sampling.stratified(df.filter("id < 1000"), "k", "id", 50).union(sampling.stratified(df.filter("id >= 1000"), "k", "id", 50))
    assert sorted(map(tuple, sampling.stratified(parts, "k", "id", 50).collect())) == sorted(map(tuple, whole)) and len(whole) == 200


def test_weights_and_ties(spark):
    df = spark.range(4000).select("id", F.lit("k").alias("k"), F.when(F.col("id") < 2000, 9.0).otherwise(1.0).alias("w"))
    heavy = sampling.stratified(df, "k", "id", 400, "w").filter("id < 2000").count()
    assert 310 < heavy < 400
    same = spark.createDataFrame([(1, "k", i) for i in range(90)], "id int, k string, v int")
    assert sampling.stratified(same, "k", "id", 20).count() == 20 and sampling.stratified(same.limit(0), "k", "id", 20).count() == 0
