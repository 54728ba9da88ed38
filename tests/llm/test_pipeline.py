"""The pipeline's stages, each on odd rows of its own, and run() on odd and empty tables, against plain Python."""

from collections import Counter, defaultdict

import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_documents import ODD, crc, quality_brute, secret_brute, shingles
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import common, mixing, quality, tokens

NAMES = "doc_id long, text string, source string, lang string, n_chars long"
#: Columns that clash with those the stages make on the way.
CLASHING = ["kept", "quality", "base_failed", "host_failed", "verdict_host", "row", "first_row", "found", "scan_row", "scan_spans", "mix_size", "mix_copies", "Mix_Hash"]
CLEAN = [" ".join(f"{a}{i * 7 % 53}q{i}" for i in range(40)) for a in ("river", "stone", "cloud", "lamp")]
ROWS = [
    *[(*r, None if r[1] is None else len(r[1])) for r in ODD],
    *[(100 + i, t, f"clean{i % 2}", "en", len(t)) for i, t in enumerate(CLEAN)],
    (104, CLEAN[0].upper(), "clean0", "en", None), (105, CLEAN[1] + " tail", None, "en", -1), (100, CLEAN[0], "clean0", "en", len(CLEAN[0])),
    (None, CLEAN[2], "clean1", None, 1), (106, CLEAN[3] + " password=hunter2hunter2 x secret: abcdefgh1 and " + "0" * 40, "clean1", "en", 5),
]


@pytest.fixture(scope="module")
def odd_docs(spark):
    return spark.createDataFrame([(*r, *CLASHING) for r in ROWS], f"{NAMES}, {', '.join(f'{c} string' for c in CLASHING)}")


def by_text(docs):
    """How often each (doc_id, text, source) is there."""
    return Counter((r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect())


def kept_brute(rows):
    """rows: (doc_id, text, source). Those that pass the base rules and whose source is not condemned."""
    rules = []
    for _, text, _ in rows:
        n, chars, symbols, lines, repeats = quality_brute(text)
        rules.append([n < 20, 100 * repeats > 30 * n, 10 * symbols > n, 4 * lines > n, chars < 2 * n or chars > 15 * n])
    of = defaultdict(list)
    for (_, _, source), failed in zip(rows, rules):
        if source is not None:
            of[source].append(failed)
    bad = set()
    for k in range(5):
        n, fails = {s: len(own) for s, own in of.items()}, {s: sum(f[k] for f in own) for s, own in of.items()}
        alpha, beta = quality.beta_prior(sum(n.values()), len(n), sum(x * x for x in n.values()), sum(fails.values()), sum(fails[s] ** 2 / n[s] for s in n))
        bad |= {s for s in n if (fails[s] + alpha) / (n[s] + alpha + beta) > 0.5}
    return [r for r, failed in zip(rows, rules) if not failed[0] and not failed[1] and r[2] not in bad]


def components_brute(texts):
    """The number of each text's component; texts without a word are alone."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    return root


def redacted_brute(text):
    out, at = "", 0
    for start, _, end in secret_brute(text):
        if end > at:
            out += text[at:start] + "[SECRET]" if start >= at else ""
            at = end
    return text if text is None else out + text[at:]


def test_quality_stage(spark, odd_docs):
    got = corpus_pipeline.quality_rules(spark, odd_docs, "")
    assert got.columns == odd_docs.columns
    want = Counter(kept_brute([(r[0], r[1], r[2]) for r in ROWS]))
    assert by_text(got) == want and {d for d, _, _ in want} >= {100, 101, 102, 103, 105}


def test_quality_stage_condemns_hosts(spark):
    """A source of failures goes as a whole, one with few stays but for them, and rows without a source are judged alone."""
    good = [f"{w}{i}" for i, w in enumerate(["salt", "moor", "fern"] * 12)]
    rows = [(i, " ".join([*good, str(i)]), "good") for i in range(30)] + [(50 + i, "short", "bad") for i in range(30)]
    rows += [(90, " ".join(good), "bad"), (91, "short", "good"), (92, " ".join(good), None), (93, "short", None)]
    want = kept_brute(rows)
    assert {r[0] for r in want} == {*range(30), 92}
    assert by_text(corpus_pipeline.quality_rules(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "")) == Counter(want)


def test_neardup_stage(spark, odd_docs):
    got = corpus_pipeline.minhash_neardup(spark, odd_docs, "")
    assert got.columns == odd_docs.columns
    left, whole = by_text(got), by_text(odd_docs)
    texts = [t for _, t, _ in whole]
    root = dict(zip(whole, components_brute(texts)))
    have = {key for key in whole if shingles(key[1])}
    assert {k: n for k, n in left.items() if k not in have} == {k: n for k, n in whole.items() if k not in have}
    stays = [k for k in left if k in have]
    assert all(left[k] == 1 for k in stays) and sorted(root[k] for k in stays) == sorted({root[k] for k in have})
    for key in stays:  # the one of the least id, null last
        least = min((k[0] is None, k[0] or 0) for k in have if root[k] == root[key])
        assert least == (key[0] is None, key[0] or 0)


def test_neardup_stage_on_derived_tables(spark, odd_docs, tmp_path):
    """Unions and exploded rows of a table in files have no place of their own there: the copies go all the same."""
    odd_docs.repartition(2).write.parquet(f"file://{tmp_path}/docs")
    read = spark.read.parquet(f"file://{tmp_path}/docs")
    want = Counter(r.doc_id for r in corpus_pipeline.minhash_neardup(spark, read.filter("doc_id > 0"), "").collect())
    later = F.col("doc_id") + F.col("copy") * 1000
    twice = read.filter("doc_id > 0").withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("doc_id", later).drop("copy")
    union = read.filter("doc_id > 0").unionByName(read.filter("doc_id > 0").withColumn("doc_id", F.col("doc_id") + 1000))
    for docs in (twice, union):
        got = corpus_pipeline.minhash_neardup(spark, docs, "")
        assert got.columns == read.columns
        left = Counter(r.doc_id for r in got.collect())
        wordless = {1, 2, 3}
        assert {d: n for d, n in left.items() if d < 1000} == want
        assert {d - 1000 for d in left if d > 1000} == wordless


def test_secret_stage(spark, odd_docs):
    got = corpus_pipeline.secret_scan(spark, odd_docs, "")
    assert got.columns == odd_docs.columns
    want = Counter((d, redacted_brute(t), s) for d, t, s, *_ in ROWS)
    assert by_text(got) == want and any("[SECRET]" in (t or "") for _, t, _ in want)
    for r in got.filter("text like '%[SECRET]%'").collect():
        assert r.n_chars == len(r.text)


def test_mixing_stage(spark, odd_docs):
    got = corpus_pipeline.mixing_weights(spark, odd_docs, "")
    assert got.columns == odd_docs.columns
    want = Counter()
    size = {(d, s): 0 for d, _, s, *_ in ROWS}
    for r in mixing.mix(odd_docs).collect():
        want[r.doc_id, r.source] += r.copies
        assert 0 <= r.copies <= 2 and (r.doc_id, r.source) in size
    have = Counter()
    for (d, _, s), n in by_text(got).items():
        have[d, s] += n
    assert have == +want


def test_packing_stage(spark, odd_docs):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for d, t, *_ in ROWS:
        want[d] += len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    rows, have, filled = corpus_pipeline.harmonic_packing(spark, odd_docs, "").collect(), Counter(), defaultdict(list)
    for r in rows:
        have[r.doc_id] += r.length
        filled[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    ends = [r for r in rows if r.doc_tokens == 1]
    assert ends and all(r.start == 0 and r.length == 1 and r.ids_crc32 == crc([1]) for r in ends)


def test_packing_stage_keeps_no_cache_in_workers(spark, odd_docs):
    """The check was stopped on memory there: workers held a million encoded chunks each through the stages of the next run."""
    assert corpus_pipeline.harmonic_packing(spark, odd_docs, "").count()

    def held(batches):
        from millrace.llm import tokens

        for _ in batches:
            found = [len(e.chunks) for (_, limit), e in tokens._encoders.items() if limit == corpus_pipeline.CHUNKS]
            yield pd.DataFrame({"n": found})

    seen = [r.n for r in spark.range(0, 16, 1, 16).mapInPandas(held, "n long").collect()]
    assert seen and set(seen) == {0}


def test_texts_are_sliced_like_lists():
    texts = ["abc", None, "", "é" * 7, "漢", None, "x" * 30, "y"]
    got = list(tokens.sliced(pa.chunked_array([texts[:3], texts[3:]]), 8))
    assert [(i, j) for i, j, _ in got] == list(tokens.slices(texts, 8)) and [t for *_, part in got for t in part] == texts
    assert list(tokens.sliced(pa.array([], pa.string()))) == []


def test_run_on_odd_rows(spark, odd_docs, tmp_path):
    """A table of several part files with odd rows and clashing columns goes through all stages; the clean rows come out."""
    odd_docs.repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    judged = kept_brute([(r[0], r[1], r[2]) for r in ROWS])
    root, least = components_brute([t for _, t, _ in judged]), {}
    for (d, t, _), c in zip(judged, root):
        least[c] = min(least.get(c, (True, 0, "")), (d is None, d or 0, t))
    ids = {None if none else d for none, d, _ in least.values()}
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {None if none else d: len(tok.encode(redacted_brute(t), add_special_tokens=False).ids) + 1 for none, d, t in least.values()}
    total = Counter()
    for r in rows:
        assert r.doc_id in ids and r.doc_tokens == tokens[r.doc_id]
        total[r.doc_id] += r.length
    assert total and all(n % tokens[d] == 0 and n // tokens[d] <= 2 for d, n in total.items())


def test_run_on_an_empty_table(spark, odd_docs, tmp_path):
    none = odd_docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0
    none.write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_run_leaves_no_stage_behind(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    assert corpus_pipeline.run(spark, sf_dir).count()
    left = {p.name.rsplit("-", 1)[0] for p in (tmp_path / "millrace").iterdir()}
    assert left & {"quality_rules", "minhash_neardup", "secret_scan", "host-failures", "scanned", "spans"} == set() and "mixing_weights" in left
