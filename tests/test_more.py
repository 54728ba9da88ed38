"""Matching, fits, variants, table functions and score values on small fixtures."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import tables
from millrace.operators import fits, matching, scores
from millrace.sources import pointer_states, variants


def test_settled_pairs_are_those_of_a_walk(spark):
    rng = np.random.default_rng(2)
    pairs = [(f"a{rng.integers(0, 40)}", f"b{rng.integers(0, 40)}", int(rng.integers(0, 3))) for _ in range(300)] + [(None, "b1", 0), ("a1", None, 0)]
    left, right, want = set(), set(), set()
    for cost, a, b in sorted((c, a, b) for a, b, c in pairs if a and b):
        if a not in left and b not in right:
            want.add((a, b, cost))
            left.add(a)
            right.add(b)
    df = spark.createDataFrame(pairs, "a string, b string, cost int")
    assert {tuple(r) for r in matching.settled(df).collect()} == want and matching.settled(df.limit(0)).count() == 0


def test_matched_once(spark):
    a = spark.createDataFrame([("LLaMA-7B",), ("Llama 7b",), ("Pythia",), (None,), ("Qwen",)], "n string")
    b = spark.createDataFrame([("llama7b",), ("lama7b",), ("pythia!",), (None,)], "m string")
    assert {tuple(r) for r in matching.matched_once(a, b, "n", "m", 1).collect()} == {("LLaMA-7B", "llama7b", 0), ("Llama 7b", "lama7b", 1), ("Pythia", "pythia!", 0)}


def points(spark, noise, far=0.0):
    rng = np.random.default_rng(6)
    n, d = np.exp(rng.uniform(-3, 4, 3000)), np.exp(rng.uniform(0, 8, 3000))
    loss = 1.713 + 0.371 * n**-0.337 + 1.291 * d**-0.2831 + noise * rng.normal(size=3000)
    loss[::20] += far
    rows = [*zip(n.tolist(), d.tolist(), loss.tolist()), (0.0, 1.0, 5.0), (1.0, None, 5.0), (1.0, 1.0, None), (1.0, 1.0, float("nan"))]
    return spark.createDataFrame(rows, "n double, d double, loss double")


@pytest.mark.parametrize("noise, far, robust, near", [(0.0, 0.0, None, 1e-6), (0.01, 0.0, None, 0.02), (0.01, 3.0, 0.02, 0.02)])
def test_power_law_off_the_grid(spark, noise, far, robust, near):
    law, how = fits.power_law_fit(points(spark, noise, far).cache(), "n", "d", "loss", fits.Law(1.0, 1.0, 0.5, 1.0, 0.5), robust)
    assert how["converged"] and how["rows"] == 3000
    assert (law.e, law.a, law.alpha, law.b, law.beta) == pytest.approx((1.713, 0.371, 0.337, 1.291, 0.2831), abs=near)


def test_far_off_rows_spoil_plain_squares_and_few_rows_are_refused(spark):
    law, _ = fits.power_law_fit(points(spark, 0.01, 3.0).cache(), "n", "d", "loss", fits.Law(1.7, 0.4, 0.34, 1.3, 0.28))
    assert abs(law.e - 1.713) > 0.05
    with pytest.raises(ValueError, match="few"):
        fits.power_law_fit(points(spark, 0).limit(5), "n", "d", "loss", law)


def test_leaves(spark):
    cards = [
        {"a": {"b": [1, 2.5, {"c": None}], "d e": True}, "x'y": "z"}, [], {}, 7, "text", None, [[[]], [None]], {"path": {"kind": {"value": {"key": "deep"}}}},
    ]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cards)] + [(98, None), (99, "{broken")], "key int, card string")
    want = {
        (0, "$.a.b[0]", "number", "1"), (0, "$.a.b[1]", "number", "2.5"), (0, "$.a.b[2].c", "null", None), (0, "$.a['d e']", "boolean", "true"), (0, "$['x\\'y']", "string", "z"),
        (1, "$", "array", None), (2, "$", "object", None), (3, "$", "number", "7"), (4, "$", "string", "text"), (5, "$", "null", None),
        (6, "$[0][0]", "array", None), (6, "$[1][0]", "null", None), (7, "$.path.kind.value.key", "string", "deep"),
    }
    assert {tuple(r) for r in variants.leaves(df, "card", "key").collect()} == want


def test_named_matches(spark):
    tables.register(spark)
    spark.createDataFrame([(1, "a=1; bc=22"), (2, None), (3, "")], "id int, text string").createOrReplaceTempView("texts_")
    got = spark.sql(r"select id, m.* from texts_, lateral named_matches(text, '(?P<key>[a-z]+)=(?P<number>[0-9])(?P<more>[0-9])?') m")
    assert got.columns == ["id", "start", "key", "number", "more"]
    assert sorted(map(tuple, got.collect())) == [(1, 0, "a", "1", None), (1, 5, "bc", "2", "2")]
    for bad in ("'[a-z]'", "text"):
        with pytest.raises(Exception, match="group|constant"):
            spark.sql(f"select m.* from texts_, lateral named_matches(text, {bad}) m")


def test_pointer_states(spark, tmp_path):
    (tmp_path / "a").write_text("version https://git-lfs.github.com/spec/v1\noid sha256:0\nsize 1\n")
    (tmp_path / "b").write_text("version https://git-lfs.github.com/spec/v1 and more")
    (tmp_path / "c").write_text("x" * 5000)
    assert {r.path.rsplit("/", 1)[1]: r.state for r in pointer_states(spark, str(tmp_path)).collect()} == {"a": "pointer", "b": "data", "c": "data"}


def test_score_values(spark):
    """Rates whose scores are worked out by hand from the chance levels."""
    musr = {"musr_murder_mysteries": 0.54, "musr_object_placements": 0.26, "musr_team_allocation": 0.30}
    rates = {"ifeval": 0.0, "gpqa": 0.24664, "mmlu_pro": 0.11087, **musr} | {f"bbh_{t}": 1.0 / n + 0.1 * (1 - 1.0 / n) for t, n in scores.BBH_CHOICES.items()}
    rows = [("m", f"leaderboard_{task}", metric, 0.2 if metric.startswith("prompt") else 0.3 if metric.startswith("inst") else rates[task]) for _, task, metric, _ in scores.PARTS]
    got = scores.card_scores(spark.createDataFrame(rows, "card string, task string, metric string, value double"), "card").first()
    assert (got.mmlu_pro, got.gpqa, got.ifeval, got.bbh) == pytest.approx(((0.11087 - 0.1) / 0.9 * 100, 0.0, 25.0, 10.0))
    assert got.musr == pytest.approx((8.0 + 7.5 + 0.0) / 3) and F.col("x") is not None
