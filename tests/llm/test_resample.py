"""Importance resampling against plain Python: odd rows, ties, empty tables, and the given table."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import queries as registered
from millrace.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
PROSE = "The quick brown fox jumps over 13 lazy dogs; and Éric naïvely wrote it down twice, on page two of the old book"
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, PROSE), (4, PROSE), (5, PROSE.upper()), (5, PROSE + " more"), (None, PROSE), (None, None), (6, LONG),
    (7, "one two"), (8, "a_b`c{d|e\x7ff\x00g漢字 h\x80i\xa0j"), (-9, PROSE[::-1]), *[(20 + i, f"{PROSE} {i % 7}") for i in range(60)],
]


def want(docs, target, percent=5, seed=42):
    def runs(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = WORD.findall(low)
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    of, s, t = [(d, *runs(x)) for d, x in docs], Counter(), Counter()
    for _, _, f in of:
        s.update(f)
    for x in target:
        t.update(runs(x)[1])
    a, b = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (a + 10000) / ((s[k] + 1) * (b + 10000)))) for k in range(10000)]
    rows = []
    for d, n, f in of:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[k] for k in f)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = i
    return Counter(tuple(r[:5]) for r in rows)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "s", 2.5) for d, t in rows], "doc_id long, text string, weight int, Row string, rank double")


@pytest.mark.parametrize("percent", [5, 37, 100, 0])
def test_odd_rows(spark, percent):
    df, target = frame(spark, ODD).repartition(3), spark.createDataFrame([("the lazy dogs of the old book",), (None,), ("",)], "text string")
    got = resample.resample(df, target, percent=percent, pivots=3)
    assert got.columns == ["doc_id", "text", "weight", "Row", "rank", "n_features", "weight_", "score", "rank_"]
    assert Counter(map(tuple, got.select("doc_id", "n_features", "weight_", "score", "rank_").collect())) == want(ODD, ["the lazy dogs of the old book"], percent)
    assert all(r.text == dict(ODD)[r.doc_id] for r in got.filter("doc_id > 10").collect())


def test_empty_tables(spark):
    df, none = frame(spark, ODD[:6]), spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(none, df).count() == 0
    got = resample.resample(df.select("doc_id", "text"), none, "doc_id", percent=100)
    assert Counter(map(tuple, got.collect())) == want(ODD[:6], [], 100)


def test_query_equals_plain_python_and_reruns_agree(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text").collect()]
    got = registered.queries()["op11_importance_resampling"](spark, sf_dir)
    assert Counter(map(tuple, got.collect())) == want(docs, target)


@pytest.mark.parametrize("pivots", [1, 4, 31])
def test_kth_key_of_a_hot_value(spark, pivots):
    rng = np.random.default_rng(pivots)
    rows = [(int(x), None if i % 9 == 0 else f"k{i % 5}", i) for i, x in enumerate(np.where(rng.random(700) < 0.6, 7, rng.integers(0, 40, 700)))]
    df = spark.createDataFrame(rows, "x long, y string, i long").repartition(5)
    ordered = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2]))
    for k in (1, 350, 700):
        assert resample.kth_key(df, ["x", "y", "i"], k, pivots) == ordered[k - 1]


def test_the_target_is_drawn_more_often(spark):
    rng = np.random.default_rng(1)
    words = {"like": [f"like{i}" for i in range(50)], "other": [f"other{i}" for i in range(50)]}
    rows = [(i, " ".join(rng.choice(words["like" if i % 10 == 0 else "other"], 30))) for i in range(400)]
    target = spark.createDataFrame([(" ".join(rng.choice(words["like"], 30)),) for _ in range(40)], "text string")
    drawn = resample.resample(spark.createDataFrame(rows, "doc_id long, text string"), target, "doc_id", percent=10).filter("rank is not null").collect()
    assert len(drawn) == 40 and all(r.doc_id % 10 == 0 for r in drawn)
