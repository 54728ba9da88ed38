"""Search by an inverted file against all pairs: exact mode, recall of the probed lists, odd vectors, hot lists."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace import operators
from millrace.operators import inverted


def frame(spark, x, odd=()):
    rows = [(i, [float(v) for v in row], int(i) % 3) for i, row in enumerate(x)] + [(len(x) + i, v, 9) for i, v in enumerate(odd)]
    return spark.createDataFrame(rows, "id long, v array<float>, cell_of int").repartition(4)


def truth(x, queries, k):
    x = x.astype(np.float32).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(u[queries] @ u.T, 6)
    return {(int(q), r, int(i), float(s[i])) for q, s in zip(queries, sims) for r, i in enumerate(np.lexsort((np.arange(len(x)), -s))[:k], 1)}


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(40, dim))[rng.integers(0, 40, n)] + 0.4 * rng.normal(size=(n, dim))


@pytest.mark.parametrize("kind", ["clusters", "noise", "copies"])
def test_exact_mode_equals_all_pairs(spark, kind):
    rng = np.random.default_rng(1)
    x = clustered(700, 12, 3) if kind == "clusters" else rng.normal(size=(500, 12))
    if kind == "copies":
        x[50:300] = x[7]
    odd = [None, [], [0.0] * 12, [1.0] * 5, [float("nan")] * 12, [float("inf")] + [1.0] * 11, [None] + [1.0] * 11]
    df = frame(spark, x, odd)
    queries = np.arange(0, len(x), 20)
    got = inverted.search(df.filter("id % 20 = 0"), df, "id", "v", 9, "cell_of", cells=30, probes=2, exact=True, block=64)
    assert got.columns == ["query_id", "rank", "id", "cell_of", "sim"]
    assert {(r.query_id, r["rank"], r.id, r.sim) for r in got.collect()} == truth(x, queries, 9)


def test_recall_of_probed_lists(spark):
    x = clustered(4000, 24, 5)
    df = frame(spark, x)
    got = {(r.query_id, r.id) for r in inverted.search(df.filter("id % 20 = 0"), df, "id", "v", 10, sample=1500).collect()}
    want = {(q, i) for q, _, i, _ in truth(x, np.arange(0, 4000, 20), 10)}
    assert len(got & want) / len(want) >= 0.9


def test_rows_cross_the_shuffle_once(spark):
    x = clustered(2000, 8, 6)
    df = frame(spark, x)
    at = inverted.fitted(df, "id", "v", 40)
    placed = inverted._placed(df, "id", "v", [], at)
    assert placed.count() == 2000 and at.shape == (40, 8) and np.allclose(np.linalg.norm(at, axis=1), 1)
    few = inverted.search(df.filter("id < 3"), df, "id", "v", 5, cells=40, probes=40)
    assert {(r.query_id, r["rank"], r.id, r.sim) for r in few.collect()} == truth(x, np.arange(3), 5)


def test_nothing_to_search(spark):
    df = frame(spark, clustered(50, 4, 1))
    assert inverted.search(df.limit(0), df, "id", "v", 3).count() == 0
    assert inverted.search(df, df.limit(0), "id", "v", 3).count() == 0
    assert inverted.search(df.limit(0), df, "id", "v", 3, exact=True).count() == 0


def test_blocks_leave_out_what_has_no_direction(spark):
    x = clustered(60, 4, 2)
    df = frame(spark, x, [None, [], [0.0] * 4, [1.0] * 7, [float("nan")] * 4, [float("inf"), 1.0, 1.0, 1.0], [None, 1.0, 1.0, 1.0]])
    got = operators.nearest(df, df, "id", "v", 5, block=16)
    assert {(r.query_id, r["rank"], r.id, r.sim) for r in got.collect()} == truth(x, np.arange(60), 5)


@pytest.mark.parametrize("further", [False, True])
def test_a_task_holds_few_cosines_at_once(spark, further):
    """A batch met all centroids at once, and its queries all their lists: ten thousand rows by thousands of lists, several times over."""
    x = clustered(1500, 8, 4)
    at, radius = x[:1000] / np.linalg.norm(x[:1000], axis=1, keepdims=True), np.full(1000, 3.2)
    df = frame(spark, x).withColumn("least", F.lit(-2.0))
    asked = inverted._asked(df, "id", "v", at, 3, *([radius, "least"] if further else []))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    assert asked.count() == 1500 * (997 if further else 3)
    at_once = [r.n for r in inverted._placed(df, "id", "v", [], at).coalesce(1).mapInArrow(sizes, "n long").collect()]
    assert sum(at_once) == 1500 and [j - i for i, j in inverted._pieces(10_000, 4096)][:2] == [256, 256]
    assert max(b.num_rows for b in inverted._cut([pa.record_batch({"a": range(1500)})], 4096)) * 4096 <= inverted.AT_ONCE
