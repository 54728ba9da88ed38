"""Operators on vectors, conversations and counts against brute force, and the pipeline."""

import json
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import rollup, toolcalls, vectors
from millrace.llm.components import components


def components_brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(1000, 1060)] + [(7, i) for i in range(2000, 2300)] + [tuple(map(int, rng.integers(3000, 3400, 2))) for _ in range(180)] + [(5, 5)]
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    want = components_brute([e for e in edges if e[0] != e[1]])
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


def vectors_brute(rows, threshold=0.93):
    good = [(i, r) for i, r in enumerate(rows) if r[1] is not None and r[2] and all(x is not None and np.isfinite(x) for x in r[2]) and any(r[2])]
    edges = []
    for n, (i, a) in enumerate(good):
        for j, b in good[n + 1 :]:
            if a[1] == b[1] and len(a[2]) == len(b[2]):
                u, v = np.array(a[2]), np.array(b[2])
                if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= threshold:
                    edges.append((i, j))
    n = Counter(x for e in edges for x in e)
    roots = components_brute(edges)
    least = {}
    for i, r in enumerate(rows):
        k = roots.get(i, i)
        least[k] = min(least.get(k, (True, 0)), (r[0] is None, r[0] or 0))
    out = Counter()
    for i, r in enumerate(rows):
        none, c = least[roots.get(i, i)]
        c = None if none else c
        out[r[0], n[i], c, r[0] == c] += 1
    return out


def test_vectors_odd(spark):
    base = [float(x) for x in np.random.default_rng(1).normal(size=8)]
    other = [x + 0.05 for x in base]
    rows = [(1, 1, base), (2, 1, base), (3, 1, other), (4, 2, base), (5, None, base), (6, 1, None), (7, 1, [0.0] * 8), (8, 1, [float("nan")] + base[1:]), (9, 1, [None] + base[1:]), (10, 1, []), (3, 1, base[:4]), (None, 1, other), (2, 1, base), (11, 1, [float("inf")] + base[1:]), (12, 1, [2 * x for x in base]), (13, 3, [1e-300] * 8), (14, 3, [1e300] * 8), (15, 4, [0.0, -0.0, 1.0]), (16, 4, [-0.0, 0.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, row string, node int")
    got = vectors.near_vectors(df).collect()
    rows = [(a, b, [x * 1e290 for x in c] if a == 13 else c) for a, b, c in rows]
    rows = [(a, b, [x * 1e-290 for x in c] if a == 14 else c) for a, b, c in rows]
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == vectors_brute(rows)
    assert vectors.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("block, refine", [(vectors.BLOCK, vectors.REFINE), (16, vectors.REFINE), (8, 24)])
def test_vectors_given(spark, sf_dir, block, refine):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.label, r.embedding) for r in df.collect()]
    got = vectors.near_vectors(df, block=block, refine=refine).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == vectors_brute(rows)


@pytest.mark.parametrize("dims", [32, 64])
def test_vectors_recall_at_the_threshold(spark, dims):
    """Pairs just above 0.93 among random vectors: the hardest case for the index."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(1500, dims))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.normal(size=base.shape)
    noise -= (noise * base).sum(1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    near = 0.931 * base + np.sqrt(1 - 0.931**2) * noise
    rows = [(i, 1, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, near]))]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).agg(F.sum("n_links")).first()[0]
    assert got >= 0.99 * 3000


SCHEMAS = {
    "all": {
        "type": "object", "required": ["n", "s"], "additionalProperties": False,
        "properties": {"n": {"type": "integer", "minimum": -2, "maximum": 7}, "s": {"type": "string", "minLength": 2, "maxLength": 3, "pattern": "^[a-z]+$"}, "e": {"enum": [1, "x", None, [1.0]]}, "l": {"type": "array", "items": {"type": ["number", "null"]}}, "b": {"type": "boolean"}, "o": {"type": "object"}},
    },
}


def test_tool_calls(spark):
    calls = [("a", [], "all", '{"s":"ab","n":3}'), ("b", ["a"], "all", '{"n": 1.5, "s":"A", "x":1}'), ("c", ["b", "a", None, "zz"], "none", "{}"), ("d", ["e"], "all", "no json"), ("e", ["d"], "all", None), ("a", ["z"], "all", "[]"), (None, [], "all", "{}"), ("f", ["zz"], "all", '{"n":8,"s":"é"}'), ("g", ["c"], None, '{"b":{"z":1,"a":"é\\n"},"a":NaN}'), ("h", ["d", "a"], "all", '{"s":"\\ud800","n":1}'), ("i", None, "all", '{"n":1e400,"s":"ab"}'), ("j", ["j"], "all", "1")]
    results = [("a", "ok"), ("a", "again"), ("c", None), ("orphan", "x"), (None, "y")]
    df = spark.createDataFrame([(*c, 1, 2) for c in calls], "call_id string, parents array<string>, tool string, arguments string, depth int, node int")
    got = {r.call_id: r for r in toolcalls.link(df, spark.createDataFrame(results, "call_id string, content string"), SCHEMAS).collect()}
    assert set(got) == {*"abcdefghij", "orphan"}
    assert {k: got[k].depth for k in "abcdefghij"} == dict(a=0, b=1, c=2, d=None, e=None, f=0, g=3, h=None, i=0, j=None)
    assert {k: (got[k].chain, got[k].position) for k in "abcdefghij"} == dict(a=("a", 0), b=("a", 1), c=("a", 2), g=("a", 3), d=("a", 4), e=("a", 5), h=("a", 6), f=("f", 0), i=("i", 0), j=("j", 0))
    assert (got["a"].n_calls, got["a"].n_results, got["a"].status) == (2, 2, "linked") and got["orphan"].status == "orphan" and got["b"].status == "unanswered"
    assert got["a"].errors == "$: type" and got["b"].errors == "$.n: type; $.s: minLength; $.s: pattern; $.x: additionalProperties"
    assert got["c"].errors == "$: unknown tool" and all(got[k].errors == "$: no JSON" for k in "dghi") and got["e"].errors == "$: type"
    assert got["f"].errors == "$.n: maximum; $.s: minLength; $.s: pattern"
    assert got["f"].record == '{"arguments":{"n":8,"s":"é"},"id":"f","name":"all","result":null}'
    assert json.loads(got["h"].record) == {"arguments": None, "id": "h", "name": "all", "result": None}
    assert toolcalls.link(df.limit(0), spark.createDataFrame([], "call_id string, content string"), {}).count() == 0


def test_canonical_json():
    want = {"1": "1", "1.0": "1", "-0.0": "0", "1e21": "1e+21", "123456789012345678901": "123456789012345680000", "1E-7": "1e-7", "0.000001": "0.000001", "-1.50": "-1.5", "333333333.33333329": "333333333.3333333", "4.50": "4.5", "2e-3": "0.002", "1.5e300": "1.5e+300", "5e-324": "5e-324", "100": "100"}
    assert {k: toolcalls.canonical(toolcalls._parsed(k)) for k in want} == want
    assert toolcalls.canonical(toolcalls._parsed('{"\\ufb33":1,"\\ud83d\\ude00":2,"a":[true,null,"\\u001f/\\"é"]}')) == '{"a":[true,null,"\\u001f/\\"é"],"\U0001f600":2,"דּ":1}'


def errors_brute(v):
    """The rules of SCHEMAS["all"], written out."""
    def number(x):
        return type(x) in (int, float)

    if type(v) is not dict:
        return {"$: type"}
    out = {f"$.{k}: required" for k in "ns" if k not in v} | {f"$.{k}: additionalProperties" for k in v if k not in "nselbo"}
    for k, x in v.items():
        if k == "n":
            out |= {"$.n: type"} if not number(x) or x != int(x) else ({"$.n: minimum"} if x < -2 else set()) | ({"$.n: maximum"} if x > 7 else set())
        elif k == "s":
            out |= {"$.s: type"} if type(x) is not str else ({"$.s: minLength"} if len(x) < 2 else set()) | ({"$.s: maxLength"} if len(x) > 3 else set()) | (set() if x and all("a" <= c <= "z" for c in x) else {"$.s: pattern"})
        elif k == "e":
            out |= set() if x is None or (type(x) is str and x == "x") or (number(x) and x == 1) or (type(x) is list and len(x) == 1 and number(x[0]) and x[0] == 1) else {"$.e: enum"}
        elif k == "l":
            out |= {"$.l: type"} if type(x) is not list else {f"$.l[{i}]: type" for i, y in enumerate(x) if y is not None and not number(y)}
        elif k in "bo":
            out |= set() if type(x) is (bool if k == "b" else dict) else {f"$.{k}: type"}
    return out


def test_schema_rules_broken_one_and_all():
    rng, seen = np.random.default_rng(6), set()
    values = [None, True, False, 0, 1, 1.0, -3, 8, 2.5, "", "x", "ab", "abcd", "A1", [], [1], [1.0], [None, "x", True], {}, {"a": 1}]
    for _ in range(3000):
        v = {k: values[rng.integers(len(values))] for k in "nselbox" if rng.random() < 0.6}
        v = v if rng.random() < 0.97 else values[rng.integers(len(values))]
        got = toolcalls.schema_errors(toolcalls._parsed(json.dumps(v)), SCHEMAS["all"])
        assert set(got) == errors_brute(v) and len(set(got)) == len(got), v
        seen |= {e.split(": ")[1] for e in got}
    assert seen == {"type", "required", "additionalProperties", "minimum", "maximum", "minLength", "maxLength", "pattern", "enum"}


def test_depths_of_graphs(spark):
    """Chains, trees, ladders and cycles against the longest way by plain recursion."""
    rng = np.random.default_rng(7)
    edges = {(i, i - 1) for i in range(1, 150)}
    edges |= {(200 + i, 200 + int(p)) for i in range(1, 16) for p in set(rng.integers(max(0, i - 4), i, rng.integers(1, 3)))}
    edges |= {(300, 301), (301, 302), (302, 300), (303, 300), (303, 0), (304, 303), (305, 305)}
    nodes = sorted({x for e in edges for x in e} | {400})
    up = defaultdict(set)
    for a, b in edges:
        up[a].add(b)
    want = {n: None for n in range(300, 306)}
    for n in nodes:
        if n not in want:
            want[n] = max((want[p] + 1 for p in up[n]), default=0)
    got = toolcalls.depths(spark.createDataFrame(sorted(edges), "node long, parent long"), spark.createDataFrame([(n,) for n in nodes], "node long"))
    assert {r.node: r.depth for r in got.collect()} == want


VERSIONS = {"byte": "byte_bpe_50k.json", "word": "word_bpe_49k.json"}


def ledger_of(df):
    import public_tokenizers

    return rollup.document_ledger(df, {v: public_tokenizers.path(f) for v, f in VERSIONS.items()})


def ledger_brute(rows):
    """rows: doc_id, text, source, lang."""
    import re

    import public_tokenizers
    from tokenizers import Tokenizer

    least = {}
    for d, t, *_ in rows:
        if t is not None and d is not None:
            least[t] = min(d, least.get(t, d))
    out = defaultdict(lambda: [0, 0])
    for v, f in VERSIONS.items():
        tok = Tokenizer.from_file(public_tokenizers.path(f))
        for d, t, s, lang in rows:
            if t is None or d == least.get(t):
                out[s, lang, v][0] += 1
                out[s, lang, v][1] += len(tok.encode(re.sub("[0-9]+", "", t or ""), add_special_tokens=False).ids)
    return {k: tuple(x) for k, x in out.items()}


def test_ledger(spark, sf_dir):
    long = " ".join(f"w{i % 977} x{i}" for i in range(20_000))
    docs = [(1, "a b, 12", "s", "en"), (2, "a b, 12", "s", "en"), (3, None, None, "en"), (4, None, None, "en"), (None, "a b, 12", "s", None), (5, "12", "t", None), (1, "a b, 12", "s", "en"), (6, "", "t", "de"), (7, long, "t", "de"), (8, "None here", "s", "en"), (None, "no id", "s", "en"), (None, "no id", "u", "en")]
    df = spark.createDataFrame([(*d, 1, "x", "y") for d in docs], "doc_id long, text string, source string, lang string, copy int, digest string, least string")
    ledger = ledger_of(df)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in ledger.totals().collect()}
    assert got == ledger_brute(docs)
    assert sorted(map(str, ledger.compact("all").totals().collect())) == sorted(map(str, ledger.totals().collect()))
    ledger.commit("copies", spark.createDataFrame([("s", "en", "byte", 0, 5)], rollup.ROW))
    changed = {tuple(r)[:3]: r.tokens for r in ledger.totals().collect()}
    assert changed["s", "en", "byte"] > got["s", "en", "byte"][1] + 5 and len(ledger.commits()) == 4
    with pytest.raises(ValueError):
        ledger.commit("../x", df)
    assert ledger_of(df.limit(0)).totals().count() == 0 and rollup.TokenLedger(spark).totals().count() == 0
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    assert {tuple(r)[:3]: tuple(r)[3:] for r in ledger_of(given).totals().collect()} == ledger_brute([tuple(r) for r in given.collect()])


def test_a_commit_broken_off_changes_nothing(spark, monkeypatch):
    ledger, row = rollup.TokenLedger(spark), [("s", "en", "v", 1, 10)]
    ledger.commit("a", spark.createDataFrame(row, rollup.ROW))
    other = spark.createDataFrame([("s", "en", "v", 7, 70)], rollup.ROW)
    monkeypatch.setattr(ledger, "commits", lambda: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ledger.commit("a", other)
    monkeypatch.undo()
    ledger.write(other)
    assert [tuple(r) for r in ledger.totals().collect()] == row
    ledger.commit("a", other)
    assert [r.tokens for r in ledger.totals().collect()] == [70]


def test_pipeline(spark, sf_dir):
    """run() against the stages in plain Python."""
    import public_tokenizers
    from test_documents import groups_brute, quality_brute, secret_brute, words
    from tokenizers import Tokenizer

    import corpus_pipeline

    docs = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    m = {d["doc_id"]: quality_brute(d["text"]) for d in docs}
    docs = [d for d in docs if m[d["doc_id"]][0] >= 20 and 100 * m[d["doc_id"]][4] <= 30 * m[d["doc_id"]][0]]
    kept = {d for d, _, _, k in groups_brute([(d["doc_id"], d["text"]) for d in docs]) if k}
    docs = [d for d in docs if d["doc_id"] in kept]
    for d in docs:
        out, at = "", 0
        for s, _, e in secret_brute(d["text"]):
            if e > at:
                out += d["text"][at:s] + "[SECRET]" if s >= at else ""
                at = e
        d["text"] = out + d["text"][at:]
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n = {d["doc_id"]: len(tok.encode(d["text"], add_special_tokens=False).ids) + 1 for d in docs}
    size = {d["doc_id"]: len(words(d["text"])) for d in docs}
    total = defaultdict(int)
    for r in rows:
        assert n[r.doc_id] == r.doc_tokens
        total[r.doc_id] += r.length
    assert all(t % n[d] == 0 and t // n[d] <= 2 for d, t in total.items())
    taken = sum(size[d] * (t // n[d]) for d, t in total.items())
    assert abs(taken - 1.5 * sum(size.values())) <= 0.5 * max(size.values()) * len({d["source"] for d in docs})
