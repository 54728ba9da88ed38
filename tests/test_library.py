"""Functions, operators and readers on small fixtures with known values."""

import json
import lzma

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace import functions, operators, plans, scratch, sources, streaming
from millrace.operators import scores


def test_scores_above_chance(spark):
    df = spark.createDataFrame([(0.1, 0.1), (0.55, 0.1), (1.0, 0.25), (0.2, 0.25), (None, 0.25)], "s double, b double")
    got = [r[0] for r in df.select(F.greatest(F.lit(0.0), (F.col("s") - F.col("b")) / (1 - F.col("b"))) * 100).collect()]
    assert [round(x, 6) if x is not None else None for x in got[:4]] == [0.0, 50.0, 100.0, 0.0]
    assert df.select(functions.above_chance(F.lit(0.55), 0.1)).first()[0] == pytest.approx(50.0)


def test_composition(spark):
    df = spark.createDataFrame([("r", "a", 0.5), ("r", "b", 0.5), ("r", "c", 0.0), ("s", "a", 0.2), ("s", "b", 0.3), ("s", "c", 0.5)], "run string, d string, p double")
    q = df.withColumn("q", functions.replace_zeros(F.col("p"), 0.01, "run"))
    assert {r.run: round(r.t, 9) for r in q.groupBy("run").agg(F.sum("q").alias("t")).collect()} == {"r": 1.0, "s": 1.0}
    c = q.withColumn("c", functions.clr(F.col("q"), "run")).groupBy("run").agg(F.sum("c").alias("t")).collect()
    assert all(abs(r.t) < 1e-9 for r in c)


def test_experiment_names(spark):
    df = spark.createDataFrame([("N0.07_D0010_Q0.5",), ("other",), (None,)], "n string")
    assert [tuple(r[0]) for r in df.select(functions.experiment_parts(F.col("n"))).collect()] == [(0.07, 10.0, 0.5), (None, None, None), (None, None, None)]


def test_flops_and_sentinels(spark):
    df = spark.createDataFrame([(6e20, 10.0, 10.0, " N/A "), (1.0, 1.0, 0.0, "x"), (None, 1.0, 1.0, None)], "f double, n double, d double, s string")
    got = df.select(functions.flops_ratio(F.col("f"), F.col("n"), F.col("d")), functions.sentinel_to_null(F.col("s"), "N/A")).collect()
    assert [tuple(r) for r in got] == [(1.0, None), (None, "x"), (None, None)]


def test_joins_and_frontier(spark):
    left = spark.createDataFrame([(1, "a", 5.0), (2, "a", 15.0), (3, "b", 5.0)], "id int, k string, at double")
    right = spark.createDataFrame([("a", 0.0, 6.0), ("a", 5.0, 40.0), ("b", 6.0, 7.0)], "r_k string, s double, e double")
    assert sorted((r.id, r.s) for r in operators.range_join(left, right, "at", "s", "e", 10, ["k"]).collect()) == [(1, 0.0), (1, 5.0), (2, 5.0)]
    quotes = spark.createDataFrame([("a", 1.0, 10), ("a", 15.0, 20), ("a", 16.0, 30)], "k string, at double, v int")
    assert {r.id: r.q for r in operators.asof_join(left, quotes, ["k"], "at", "v", "q").collect()} == {1: 10, 2: 20, 3: None}
    points = spark.createDataFrame([(float(c), float(g)) for c in range(40) for g in [(c * 7) % 11 + c / 3]], "c double, g double")
    rows = [tuple(r) for r in points.collect()]
    want = {p for p in rows if not any((q[0] <= p[0] and q[1] > p[1]) or (q[0] < p[0] and q[1] >= p[1]) for q in rows)}
    assert {tuple(r) for r in operators.frontier(points, "c", "g", 6).collect()} == want


def test_fits(spark):
    df = spark.range(1, 200).select((F.col("id") % 13 + 1).alias("a"), (F.col("id") % 7 + 1).alias("b")).withColumn("y", 2.0 * F.col("a") - 3.0 * F.col("b") + 5)
    fit = operators.least_squares(df, "y", ["a", "b"])
    assert (fit["a"], fit["b"], fit["intercept"], fit["r2"]) == pytest.approx((2, -3, 5, 1))
    assert operators.least_squares(df.limit(0), "y", ["a", "b"]) == {}


def test_fuzzy(spark):
    a = spark.createDataFrame([("GPT-2 XL",), ("Pythia 12B",)], "n string")
    b = spark.createDataFrame([("gpt2-xl",), ("pythia-1.2b",), ("pythia-7b",)], "m string")
    assert {(r.n, r.m) for r in operators.fuzzy_matches(a, b, "n", "m", 0).collect()} == {("GPT-2 XL", "gpt2-xl"), ("Pythia 12B", "pythia-1.2b")}


@pytest.mark.parametrize("most, group", [(0, 1024), (1, 1024), (2, 1024), (2, 3)])
def test_fuzzy_finds_edits_anywhere(spark, most, group):
    rng = np.random.default_rng(5)
    names = ["", "a", "LLaMA", "Lama", "xLLaMA", "LLaM-A", "LLaMA", None, *["".join(rng.choice(list("abc"), rng.integers(0, 9))) for _ in range(60)], *[f"prefix{''.join(rng.choice(list('ab'), 4))}" for _ in range(30)]]
    a = spark.createDataFrame([(i, s) for i, s in enumerate(names)], "i int, n string")
    b = spark.createDataFrame([(j, s) for j, s in enumerate(names[::-1])], "j int, m string")

    def edits(s, t):
        row = list(range(len(t) + 1))
        for i, x in enumerate(s, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(t, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    plain = [None if s is None else "".join(c for c in s.lower() if c.isalnum()) for s in names]
    want = sorted((i, j) for i, s in enumerate(plain) for j, t in enumerate(plain[::-1]) if s is not None and t is not None and edits(s, t) <= most)
    assert sorted((r.i, r.j) for r in operators.fuzzy_matches(a, b, "n", "m", most, group).select("i", "j").collect()) == want


def test_csv_traps(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes(b'model,n,metric/x_val_loss\r\n"Solar 9B\n",10,1.5\r\n"L ""B"" ",10.0,\r\n')
    rows = sources.read_csv(spark, str(tmp_path / "m.csv"), "model string, n double, `metric/x_val_loss` double", "file").collect()
    assert [tuple(r) for r in rows] == [("Solar 9B", 10.0, 1.5, "m.csv"), ('L "B"', 10.0, None, "m.csv")]
    wide = spark.createDataFrame([(1, 0.5, 0.5)], "index int, train_a double, `train_b/c` double")
    assert sorted(tuple(r) for r in sources.domain_columns(wide, "index", "train_").collect()) == [(1, "a", 0.5), (1, "b_c", 0.5)]


def test_catalog_and_pointers(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.csv").write_text("x\n1\n")
    (tmp_path / "d" / "b.jsonl.xz").write_text(sources.POINTER + "\noid sha256:0\nsize 1\n")
    (tmp_path / "c.json").write_text(json.dumps([{"problem": "A", "file": "a.csv", "bytes": 4}, {"problem": "A", "file": "b.jsonl.xz", "bytes": 9, "note": "n"}, {"problem": "B", "file": "z.csv", "bytes": 1}]))
    state = sources.missing_files(sources.read_catalog(spark, str(tmp_path / "c.json")), str(tmp_path / "d"))
    assert {r.file: r.state for r in state.collect()} == {"a.csv": "present", "b.jsonl.xz": "other_size", "z.csv": "missing"}
    sources.refuse_pointers(spark, str(tmp_path / "d" / "a.csv"))
    with pytest.raises(sources.PointerError):
        sources.refuse_pointers(spark, str(tmp_path / "d"))


def test_cards(spark, tmp_path):
    body = json.dumps({"all": {"bbh": {"acc,none": 0.5}}, "bbh": {"acc,none": 0.5, "se,none": "N/A", "alias": "bbh"}})
    (tmp_path / "card.md").write_text(f"---\nx: 1\n---\n# T\n```python\n{body}\n```\n")
    rows = sources.read_cards(spark, str(tmp_path / "card.md")).collect()
    assert {tuple(r) for r in rows} == {("card.md", "bbh", "acc,none", 0.5), ("card.md", "bbh", "se,none", None)}


def test_late_rows_are_dropped(spark, tmp_path):
    for i, (t, v) in enumerate([("2024-01-01 00:10:00", 1.0), ("2024-01-01 05:00:00", 2.0), ("2024-01-01 05:01:00", 2.0), ("2024-01-01 00:20:00", 4.0)]):
        spark.createDataFrame([(t, v, "e")], "t string, value double, event_type string").select(F.col("t").cast("timestamp").alias("ts"), "value", "event_type").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema("ts timestamp, value double, event_type string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    rows = streaming.drained(streaming.windowed(stream, "1 hour"), "append").collect()
    assert [(r.n, r.total) for r in rows] == [(1, 1.0)]


def test_nearest_answers_every_query(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(90, 8)).astype(np.float32)
    x[7] = x[33] = x[40]
    rows = [(i, [float(v) for v in x[i]] if i not in (0, 9) else None if i == 9 else [0.0] * 8, i % 3 or None) for i in range(90)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    known = [i for i in range(90) if i not in (0, 9)]
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = {(q, rank, i, rows[i][2], s) for q in (20, 40, 60, 80) for rank, (s, i) in enumerate(sorted(((round(float(u[q] @ u[i]), 6), i) for i in known), key=lambda p: (-p[0], p[1]))[:20], 1)}
    assert {tuple(r) for r in plans.queries()["vector_cosine_search"](spark, str(tmp_path)).collect()} == want
    df = spark.read.parquet(str(tmp_path / "embeddings.parquet"))
    assert {tuple(r) for r in operators.nearest(df.filter("vec_id % 20 = 0"), df, "vec_id", "embedding", 20, "label", block=2).collect()} == want
    assert operators.nearest(df.limit(0), df, "vec_id", "embedding", 20).count() == 0


def test_streams_read_folders_of_part_files(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    assert len(list((tmp_path / "events.parquet").glob("part-*"))) == 5
    for name in ("stream_tumbling", "stream_sliding", "stream_session", "stream_dedup"):
        got, want = (sorted(map(tuple, plans.queries()[name](spark, d).collect())) for d in (str(tmp_path), sf_dir))
        assert got == want and got


def test_ranks_equal_whole_windows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, ["a", "b", None][i % 3] if i % 7 else "hot", None if i % 11 == 0 else float(rng.integers(0, 40))) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, k string, v double")
    w, tied = Window.partitionBy("k").orderBy(F.col("v").desc()), Window.partitionBy("k").orderBy(F.col("v").desc(), "id")
    want = df.select("id", F.rank().over(w), F.dense_rank().over(w), F.row_number().over(tied), F.count("*").over(w), F.ntile(7).over(tied)).collect()
    got = operators.ranked(df, "k", "v", "id", pieces=5)
    assert sorted(map(tuple, got.select("id", "rank", "dense", "number", "cume", operators.tile(F.col("number"), F.col("total"), 7)).collect())) == sorted(map(tuple, want))
    best = Window.partitionBy("k").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("id", F.max("id").over(best)).collect()
    assert sorted(map(tuple, operators.running_max(df, "k", "v", "id", "best", "id", pieces=5).select("id", "best").collect())) == sorted(map(tuple, want))
    assert operators.ranked(df.limit(0), "k", "v", "id").count() == 0 and operators.frontier(df.limit(0), "v", "id", 4).count() == 0
    z = {r.id: r.z for r in operators.z_scores(df, "k", "v", "z").collect()}
    hot = [v for _, k, v in rows if k == "hot" and v is not None]
    assert z[7] == pytest.approx((rows[7][2] - np.mean(hot)) / np.std(hot, ddof=1)) and z[0] is None


def test_nearest_join(spark):
    left = spark.createDataFrame([(1, "a", 5.0), (2, "a", 9.0), (3, "a", 12.0), (4, "b", 1.0), (5, None, 1.0)], "id int, k string, at double")
    right = spark.createDataFrame([("a", 5.0, "x"), ("a", 13.0, "y"), ("c", 1.0, "z")], "k string, at double, v string")
    assert {r.id: r.n for r in operators.nearest_join(left, right, ["k"], "at", "v", "n").collect()} == {1: "x", 2: "x", 3: "y", 4: None, 5: None}


def test_added_rows(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], "k int, n string, v double")
    new = spark.createDataFrame([(1.0, 1, "a"), (3.0, 2, "b"), (4.0, 3, "c")], "v double, k int, n string")
    assert {r.k: r.state for r in operators.added(old, new, "k").collect()} == {1: "kept", 2: "changed", 3: "new"}


def test_card_scores_need_every_part(spark):
    rows = [("m", "leaderboard_ifeval", "prompt_level_strict_acc,none", 0.2), ("m", "leaderboard_ifeval", "inst_level_strict_acc,none", 0.4), ("m", "leaderboard_gpqa", "acc_norm,none", 0.2), ("m", "leaderboard_musr_murder_mysteries", "acc_norm,none", 0.75), ("m", "leaderboard_mmlu_pro", "acc,none", None), ("m", "other", "acc,none", 0.5)]
    got = scores.card_scores(spark.createDataFrame(rows, "file_name string, task string, metric string, value double"), "file_name").first()
    assert (round(got.ifeval, 6), got.gpqa, got.musr, got.mmlu_pro, got.bbh) == (30.0, 0.0, None, None, None)
    assert len(scores.BBH_CHOICES) == 24


def test_run_times_and_names(spark):
    df = spark.createDataFrame([("2024-06-17T17-37-25.144953",), ("2024_06_17T17_37_25.144953",), ("2024-13-17T17-37-25",), ("latest",), (None,)], "s string")
    got = [str(r[0]) for r in df.select(functions.run_time(F.col("s"))).collect()]
    assert got == ["2024-06-17 17:37:25.144953"] * 2 + ["None"] * 3


def test_xz_lines_and_front_matter(spark, tmp_path):
    (tmp_path / "a.jsonl.xz").write_bytes(lzma.compress('{"x": 1}\n\n{"x": "é"}\n'.encode()))
    assert [tuple(r) for r in sources.read_xz_lines(spark, str(tmp_path / "a.jsonl.xz")).orderBy("line_no").collect()] == [("a.jsonl.xz", 0, '{"x": 1}'), ("a.jsonl.xz", 1, ""), ("a.jsonl.xz", 2, '{"x": "é"}')]
    (tmp_path / "b.md").write_text("---\nx: 1\nconfigs:\n- config_name: c\n  data_files:\n  - split: latest\n    path:\n    - '**/s.json'\n    - t.json\n---\n# T\n")
    (tmp_path / "c.md").write_text("# no head\n")
    rows = sources.read_front_matter(spark, str(tmp_path / "*.md")).collect()
    assert {tuple(r) for r in rows} == {("b.md", "c", "latest", "**/s.json"), ("b.md", "c", "latest", "t.json")}


def test_state_of_our_own_over_several_batches(spark, tmp_path):
    for i, rows in enumerate([[(1, 2.0), (2, None)], [(1, 5.0)], [(1, 1.0), (3, 4.0)]]):
        spark.createDataFrame(rows, "user_id long, value double").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema("user_id long, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    rows = streaming.drained(streaming.totals(stream, "user_id", "value"), "update", "user_id").collect()
    assert {tuple(r) for r in rows} == {(1, 3, 8.0, 5.0), (2, 1, 0.0, None), (3, 1, 4.0, 4.0)}


def test_shared_folder_is_needed_off_local_masters():
    class Off:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        scratch.folder(Off, "x")
