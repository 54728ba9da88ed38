"""Token alignment against a walk over both tokenizers' whole outputs."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from millrace.llm import alignment
from millrace.llm import queries as registered

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ODD = [
    (1, None), (2, ""), (3, " "), (4, "a"), (5, "  two  spaces\n\n lines\n"), (5, "  two  spaces\n\n lines\n"), (None, "no id"), (6, "<|endoftext|> and <s> </s> <unk> are text"),
    (7, "a▁b"), (8, "▁"), (9, "漢字かな交じり文 Straße \U0001f600\U0001f600 ǅ"), (10, "\x00\t\r\n\x85\xa0 　﻿x́"), (11, LONG), (12, "x" * 5000), (13, "\U0001f600" * 3000),
    (14, "<0x41>"), (15, "\n"), (16, "\n\n  \n"), (-17, "1234567890 3.14159 don't we'll"), (18, "aaaa\nbbbb\n  cccc"), (None, None),
]


def plain(docs):
    t, m = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    t.encode_special_tokens = True
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    letter = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    rows, counts = [], Counter()
    for d, text in docs:
        a = t.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = m.encode(text) if text else []
        of_a = [bytes(letter[c] for c in t.id_to_token(i)) for i in a]
        of_b = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if text and not b"".join(of_a) == b"".join(of_b) == b" " + text.encode():
            a = b = of_a = of_b = []
        groups, links, i, j, x, y, at = [[[], []]], [], 0, 0, 0, 0, 0
        ends_a, ends_b = np.cumsum([len(v) for v in of_a]), np.cumsum([len(v) for v in of_b])
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            x, y = ends_a[i], ends_b[j]
            if x <= y:
                groups[-1][0].append(a[i])
            if y <= x:
                groups[-1][1].append(b[j])
            i, j = i + (x <= y), j + (y <= x)
            if x == y:
                groups.append([[], []])
        groups = groups[:-1]
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        rows.append((d, len(a), len(b), len(groups), links, text))
        counts.update(links)
    best = {}
    for (_, q), n in counts.items():
        best[q] = max(n, best.get(q, 0))
    return Counter((d, na, nb, ng, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(w.encode()).hexdigest() if w else "", w) for d, na, nb, ng, links, w in rows)


@pytest.mark.parametrize("most", [0, 40, 500_000])
def test_odd_rows(spark, most):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in ODD], "doc_id long, text string, pairs string, row int").repartition(3)
    got = alignment.align(df, BYTES, PIECES, with_groups=True, most_pairs=most)
    assert Counter(map(tuple, got.collect())) == plain(ODD)


def test_query_equals_the_walk(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = registered.queries()["op13_token_alignment"](spark, sf_dir)
    assert Counter(map(tuple, got.collect())) == Counter({k[:8]: v for k, v in plain(docs).items()})


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), BYTES, PIECES).count() == 0


def test_encoders_equal_the_libraries():
    rng = np.random.default_rng(2)
    bits = ["a", "the", "é", " ", "  ", "    ", "\n", "\t", "漢", "\U0001f600", "'s", "12", ".", "<s>", "<|endoftext|>", "\0", "́", "﻿", "x" * 9]
    texts = ["".join(bits[i] for i in rng.integers(0, len(bits), rng.integers(0, 14))) for _ in range(4000)]
    a, b = alignment.ByteEncoder(BYTES), alignment.PieceEncoder(PIECES)
    t, m = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    t.encode_special_tokens = True
    assert not b.whole
    assert [np.frombuffer(x, a.dtype).tolist() for x in a.encode(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, b.dtype).tolist() for x in b.encode(texts)] == m.encode(texts)


def test_groups_of_long_runs_without_a_common_end():
    for seed in range(30):
        rng = np.random.default_rng(seed)
        sizes = rng.integers(0, 4, 6) * rng.integers(1, 200, 6)
        a, b, n_a, n_b, at = [], [], [], [], 0
        for size in sizes:
            ends = at + 1 + np.arange(size)
            x = ends[rng.random(size) < rng.random()]
            y = ends[~np.isin(ends, x)] if seed % 2 else ends[rng.random(size) < rng.random()]
            x, y = ([*x, at + size + 1], [*y, at + size + 1]) if size else ([], [])
            x, y = sorted({*x}), sorted({*y})
            a, b, n_a, n_b, at = a + x, b + y, [*n_a, len(x)], [*n_b, len(y)], at + size + 1
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        got = alignment.leaf_groups(a, b, np.array(n_a), np.array(n_b))
        common = np.intersect1d(a, b)
        assert a[got[1] - 1].tolist() == b[got[3] - 1].tolist() == common.tolist()
        assert got[0].tolist() == [0, *got[1][:-1]][: len(common)] and got[2].tolist() == [0, *got[3][:-1]][: len(common)]
