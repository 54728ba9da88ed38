"""Personal data against the plain patterns in Python; checksums and context on known values; masks of long texts."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import pii
from millrace.llm import queries as registered

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [2 * int(d) - 9 * (int(d) > 4) for d in digits[-2::-2]]
    return (sum(twice) + sum(map(int, digits[-1::-2]))) % 10 == 0


def counts(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base(doc_id, text):
    found = sorted((m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if counts(k, m.group()))
    sizes = Counter(s.split(":")[0] for *_, s in found)
    return (doc_id, *[sizes[k] for k in PLAIN], hashlib.sha256(",".join(s for *_, s in found).encode()).hexdigest())


ODD = [
    (1, None), (2, ""), (3, "no data at all"), (4, "mail a.b+c@x-y.example.com, a@b.c_x@d.e a@b@c.d @x.y x@y x@.y x@y. %@-.-"), (4, "mail a.b+c@x-y.example.com, a@b.c_x@d.e a@b@c.d @x.y x@y x@.y x@y. %@-.-"),
    (5, "1.2.3.4.5.6.7.8 256.1.1.1 0255.000.01.1 1..2.3.4.5 9.9.9.9\U0001f600 1.2.3"), (6, "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 5 6 7  8 378282246310005\U0001f600 49927398716"),
    (7, "call +1 (017) 555-7713, +49 30 1234567. +1 +12 +123456789012345 +1234567890123456 + 1 23 +1()()()"), (None, "x@y.zz \U0001f600 +1 234 567 8901"),
    (8, "4111 1111 1111 1111 4111 1111 1111 1111"), (9, "a" * 3_000 + "@" + "b" * 10), (10, "1" * 3_000), (11, "a@b" + ".c" * 50_000), (12, "1 " * 3_000), (13, "+1" + "-" * 10_000), (14, "x@y.zz " * 5_000),
    (15, "café 0٣1 1٣.2.3.4 é@b.cc b@é.cc"), (None, None),
]


def test_base_spans_of_odd_rows(spark):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in ODD], "doc_id long, text string, found string, row int").repartition(3)
    got = pii.report(df).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(base(d, t) for d, t in ODD)


def test_very_long_runs(spark):
    """The plain patterns take quadratic time on these."""
    texts = ["a" * 300_000 + "@" + "b" * 10, "1" * 300_000, "1 " * 100_000, "+1" + "-" * 100_000, "a" * 300_000 + "@b.cc 1.2.3.4" + "5" * 300_000]
    rows = pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.spans for r in sorted(rows)] == ["", "", "", "", "email:0:300005"]


def test_query_equals_plain_python(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = registered.queries()["op12_personal_data"](spark, sf_dir).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(base(d, t) for d, t in docs)
    assert all(",".join(s for s in r.spans.split(",") if s.split(":")[0] in PLAIN) == r.spans for r in got if "iban" not in r.spans)
    assert pii.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize(
    "text, spans",
    [
        ("DE89370400440532013000", {"iban": 80}), ("IBAN GB82 WEST 1234 5698 7654 32.", {"iban": 100}), ("GB82 WEST 1234 5698 7654 33", {}), ("XDE89370400440532013000", {}),
        ("my SSN: 219-09-9999", {"ssn": 55}), ("part 219-09-9999", {}), ("ssn 000-09-9999", {}), ("tel 017 555-7713", {"local": 55}), ("item 017 555-7713", {}),
        ("tel " + "x" * 60 + " 017 555-7713", {}), ("tel +1 (017) 555-7713", {"phone": 85}), ("x +1 (017) 555-7713", {"phone": 55}), ("Visa 4111111111111111", {"card": 100}),
        ("4111111111111111", {"card": 80}), ("kreditkarte 4111111111111111", {"card": 80}), ("Teléfono móvil: (017) 555 7713", {"local": 55}),
    ],
)
def test_scores(spark, text, spans):
    row = pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert {s.split(":")[0]: int(n) for s, n in zip(row.spans.split(","), row.scores.split(",")) if s} == spans


def test_masks(spark):
    rng = np.random.default_rng(4)
    long = "".join(rng.choice(["some words here ", "\U0001f600", "a.b@c.de ", "\n", "+1 (017) 555-7713 "]) for _ in range(20_000))
    texts = [None, "", "nothing", "x@y.zz", "to x@y.zz and 1.2.3.4!", "x@1.2.3.4 end", long, long[:4096], "z" * 4096 + "x@y.zz" + "z" * 4090]
    df = spark.createDataFrame([(i, t, None if t is None else len(t), "q") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, pii_row string")
    got = {r.doc_id: r for r in pii.masked(df.union(df.filter("doc_id = 3"))).collect()}

    def plain(text):
        found = sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text) if counts(k, m.group()))
        out, at = "", 0
        for start, _, end, kind in found:
            out += text[at:start] + f"[{kind.upper()}]" if start >= at else ""
            at = max(at, end)
        return out + text[at:]

    assert {i: r.text for i, r in got.items()} == {i: t if t is None else plain(t) for i, t in enumerate(texts)}
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and r.pii_row == "q" for r in got.values())
    assert pii.masked(df.limit(0)).count() == 0


def test_no_python_on_the_path(spark):
    df = spark.createDataFrame([(1, "x@y.zz")], "doc_id long, text string")
    for made in (pii.report(df), pii.masked(df)):
        plan = made._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|MapInPandas", plan)


def test_many_spans_take_time_in_step(spark):
    text = "x@y.zz and more words " * 100_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.masked(df).first()
    assert row.text == "[EMAIL] and more words " * 100_000 and pii.report(df).select(F.col("n_email")).first()[0] == 100_000
