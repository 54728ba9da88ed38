"""Quality rules for documents and their hosts.

Each document is judged by rules on its own text. Failures of each rule are then summed by host,
the rates shrunk towards a beta prior that is fitted to all hosts by its moments, and a host
whose shrunk rate is too high fails as a whole; its verdict is joined back to its documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, staged
from .tokens import slices

SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _pairs(codes: np.ndarray, step: int) -> np.ndarray:
    """Codes for the pairs (codes[i], codes[i + step])."""
    return pd.factorize(codes[:-step] * (codes.max() + 1) + codes[step:])[0].astype(np.int64)


def repeated_words(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """By document, the words in windows of eight words that its text holds twice or more; words: of all documents in a row."""
    docs = np.repeat(np.arange(len(counts)), counts)
    if len(words) < WINDOW:
        return np.zeros(len(counts), np.int64)
    codes = pd.factorize(words)[0].astype(np.int64)
    for step in (1, 2, 4):
        codes = _pairs(codes, step)
    at = np.flatnonzero(docs[: len(codes)] == docs[WINDOW - 1 :])
    if not len(at):
        return np.zeros(len(counts), np.int64)
    keys = pd.factorize(docs[at] * (codes.max() + 1) + codes[at])[0]
    twice = at[np.bincount(keys)[keys] > 1]
    edge = np.bincount(twice, minlength=len(words) + 1) - np.bincount(twice + WINDOW, minlength=len(words) + 1)
    return np.bincount(docs[np.cumsum(edge)[:-1] > 0], minlength=len(counts))


def measure(texts: list) -> pd.DataFrame:
    """The measures of each text; nulls have no words."""
    out = []
    for i, j in slices(texts):
        part = [t or "" for t in texts[i:j]]
        split = [t.encode().split() for t in part]
        counts = np.array([len(w) for w in split])
        words = np.empty(counts.sum(), object)
        words[:] = [w for s in split for w in s]
        lines = [[x for x in t.split("\n") if x.strip(SPACES)] for t in part]
        out.append(
            pd.DataFrame(
                {
                    "n_words": counts,
                    "word_chars": [len(t) - sum(map(t.count, SPACES)) for t in part],
                    "n_symbols": [sum(map(t.count, SYMBOLS)) for t in part],
                    "n_dup_lines": [len(x) - len(set(x)) for x in lines],
                    "n_repeat_words": repeated_words(words, counts),
                }
            )
        )
    return pd.concat(out) if out else pd.DataFrame({m: [] for m in MEASURES})


def measures(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the whole text."""

    @F.pandas_udf(", ".join(f"{m} long" for m in MEASURES))
    def of(texts: pd.Series) -> pd.DataFrame:
        return measure(texts.tolist()).astype("int64")

    return of(text)


def rule_failures(m: str) -> dict[str, Column]:
    """Rules over the struct column m; the first two reject a document, all count against its host."""
    words = F.col(f"{m}.n_words")
    return {
        "short": words < 20,
        "repetitive": 100 * F.col(f"{m}.n_repeat_words") > 30 * words,
        "symbols": 10 * F.col(f"{m}.n_symbols") > words,
        "dup_lines": 4 * F.col(f"{m}.n_dup_lines") > words,
        "word_length": (F.col(f"{m}.word_chars") < 2 * words) | (F.col(f"{m}.word_chars") > 15 * words),
    }


def host_verdicts(judged: DataFrame, host: str, rules: list[str], max_rate: float) -> DataFrame:
    """A row for each host that is not null: host, n, failures and shrunk rate of each rule, host_failed.

    The prior of a rule has the mean m of all documents' failures and the strength that the hosts'
    rates show, by moments weighted with host size; where they differ no more than chance
    does, hosts are held to the common rate. One row of sums goes to the driver.
    """
    hosts = judged.filter(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in rules])
    hosts = staged(hosts, "hosts")
    sums = hosts.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"), *[F.sum(r).alias(r) for r in rules], *[F.sum(F.col(r).cast("double") * F.col(r) / F.col("n")).alias(f"{r}_sq") for r in rules]).first()
    failed = F.lit(False)
    for r in rules:
        alpha, beta = beta_prior(sums["n"] or 0, sums["k"], sums["n2"] or 0.0, sums[r] or 0, sums[f"{r}_sq"] or 0.0)
        rate = (F.col(r) + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta))
        hosts = hosts.withColumn(f"{r}_rate", rate)
        failed = failed | (F.col(f"{r}_rate") > max_rate)
    return hosts.withColumn("host_failed", failed)


def beta_prior(n: float, hosts: int, squares: float, failures: float, rate_squares: float, most: float = 1e6) -> tuple[float, float]:
    """alpha and beta from sums over hosts: documents, hosts, documents squared, failures, and failures squared by documents.

    Method of moments for a beta-binomial: the between-host sum of squares is split into what
    binomial chance gives and what is left, the variance of the hosts' own rates.
    """
    if not n:
        return 1.0, 1.0
    mean = (failures + 0.5) / (n + 1.0)
    between = max(0.0, rate_squares - failures * failures / n)
    chance, scale = mean * (1 - mean), n - squares / n
    excess = (between - (hosts - 1) * chance) / scale if scale > 0 else 0.0
    strength = min(most, max(1.0, chance / excess - 1.0)) if excess > 0 else most
    return mean * strength, (1 - mean) * strength


def judge(docs: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """docs (all columns) with struct columns quality (measures), rules (failures) and base_failed, host_failed, kept.

    Where docs has a column of such a name, the new one ends in an underscore. Null or empty
    texts have no words and fail as short, long ones are measured whole. A null host has no verdict: its documents are judged
    alone. Rows alike are judged each for itself. An empty table gives an empty result. Texts
    are measured in two passes, one for the hosts and one for the result, so none is stored.
    """
    q, r, bf, hf, kept = (fresh(docs, c) for c in ("quality", "rules", "base_failed", "host_failed", "kept"))
    failures = rule_failures(q)
    judged = docs.withColumn(q, measures(F.col("text"))).withColumn(r, F.struct(*[c.alias(n) for n, c in failures.items()]))
    flat = staged(judged.select(F.col(host).cast("string").alias("host"), f"{r}.*"), "host-failures")
    verdicts = host_verdicts(flat, "host", list(failures), max_rate).filter("host_failed").select(F.col("host").alias(hf))
    of = fresh(docs, "verdict_host")
    joined = judged.join(verdicts.withColumnRenamed(hf, of), judged[host].cast("string") == F.col(of), "left")
    joined = joined.withColumn(bf, F.col(f"{r}.short") | F.col(f"{r}.repetitive")).withColumn(hf, F.col(of).isNotNull()).drop(of)
    return joined.withColumn(kept, ~F.col(bf) & ~F.col(hf))


def judge_slim(docs: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """doc_id, the five measures, base_failed, host_failed and kept of each document, without carrying its text on.

    Null, empty and very long texts, null hosts, repeated rows, empty tables and columns of any name are as for judge.
    """
    m = docs.select(F.col("doc_id"), F.col(host).alias("source"), "text")
    slim = staged(m.select("doc_id", "source", measures(F.col("text")).alias("quality")), "measured")
    failures = rule_failures("quality")
    slim = slim.select("doc_id", "source", "quality.*", F.struct(*[c.alias(n) for n, c in failures.items()]).alias("rules"))
    verdicts = host_verdicts(slim.select(F.col("source").cast("string").alias("host"), "rules.*"), "host", list(failures), max_rate)
    joined = slim.join(verdicts.filter("host_failed").select(F.col("host").alias("of")), slim["source"].cast("string") == F.col("of"), "left")
    base = F.col("rules.short") | F.col("rules.repetitive")
    return joined.select("doc_id", *MEASURES, base.alias("base_failed"), F.col("of").isNotNull().alias("host_failed"), (~base & F.col("of").isNull()).alias("kept"))
