"""Sessions in state with timers: rows in any order, late rows, and state that goes."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from millrace.streaming import stateful

GAP = 600
SCHEMA = "k string, s long, value double, kind string"


def plain(rows):
    out = []
    for k in {r[0] for r in rows}:
        last = None
        for _, s, v, kind in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            if last is None or s - last >= GAP:
                out.append([k, s, s, 0, 0.0, set()])
            last = out[-1][2] = s
            out[-1][3] += 1
            out[-1][4] += v or 0.0
            out[-1][5] |= {kind} - {None}
    return sorted((k, s * 10**6, e * 10**6, n, round(t, 6), len(x)) for k, s, e, n, t, x in out)


def test_state_goes_once_the_watermark_has_passed(spark):
    rng = np.random.default_rng(5)
    base = int(datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC).timestamp())
    rows = [(f"k{rng.integers(0, 6) if i % 3 else 0}", base + int(rng.integers(0, 40_000)), None if i % 11 == 0 else float(rng.integers(0, 9)), [None, "a", "b"][i % 3]) for i in range(600)]
    early, later = [r for r in rows if r[1] < base + 20_000], [r for r in rows if r[1] >= base + 20_000]
    end = [("far", base + 10**6, 1.0, "a")]
    late = [("k1", base + 5, 1.0, "a"), ("k2", base + 999_999, 1.0, "a")]

    def frame(part):
        return spark.createDataFrame(part, SCHEMA).select("k", F.timestamp_seconds("s").alias("ts"), "value", "kind").repartition(3)

    with stateful.rocks_state(spark):
        closed, progress = stateful.in_runs([frame(early), frame(later), frame(end), frame(late)], lambda e: stateful.expiring_sessions(e, "k", GAP))
    got = sorted((*tuple(r)[:4], round(r.total, 6), r.kinds) for r in closed.drop("run").collect())
    assert got == plain(rows)
    seen = {r.run: r for r in progress.collect()}
    assert [seen[i].late_rows for i in range(4)] == [0, 0, 0, 1] and [seen[i].input_rows for i in range(4)] == [len(early), len(later), 1, 2]
    assert seen[2].state_rows < seen[0].state_rows / 3 and seen[2].state_rows <= 4
    assert {r.run for r in closed.select("run").distinct().collect()} == {0, 1, 2}


def test_keys_share_rows_of_state(spark):
    """A call and rows of state for each key took hours on many keys; null and large keys are keys like others."""
    base = int(datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC).timestamp())
    rows = [(None if i % 700 == 0 else 2**60 + i % 700, base + i * 37 % 5000, None if i % 5 == 0 else 0.5, [None, "a", "b"][i % 3]) for i in range(4000)]
    end = [(1, base + 10**6, 1.0, None)]
    frames = [spark.createDataFrame(part, "k long, s long, value double, kind string").select("k", F.timestamp_seconds("s").alias("ts"), "value", "kind") for part in (rows, end)]
    with stateful.rocks_state(spark):
        closed, progress = stateful.in_runs(frames, lambda e: stateful.expiring_sessions(e, "k", GAP, groups=5))
    assert sorted((str(r.k), r.start, r.last, r.n, round(r.total, 6), r.kinds) for r in closed.collect()) == plain([(str(k), *rest) for k, *rest in rows])
    assert dict(closed.dtypes)["k"] == "bigint" and [r.state_rows <= 5 for r in progress.collect()] == [True, True]
