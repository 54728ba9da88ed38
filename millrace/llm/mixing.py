"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash. A source's budget beyond whole passes is met by the
documents whose hash lies below the source's threshold. The threshold comes from nested
histograms of tokens by source and hash bucket: the first splits the hash range into 4096
buckets, and each further one splits only the bucket in which the budget runs out. Rows are
filtered against the threshold; they are never sorted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, key60, n_words, staged

HASH_BITS, LEVEL_BITS = 60, 12
#: Tables of sources are broadcast up to so many rows; beyond it, Spark shuffles.
BROADCAST_SOURCES = 10_000
#: The driver plans the mix and holds a row for each source; more sources than this are refused.
MOST_SOURCES = 1_000_000


@dataclass(frozen=True)
class MixPlan:
    """What a mix does with one source: whole passes, and one more for hashes below threshold."""

    source: str | None
    size: int
    target: float
    passes: int
    threshold: int


def fill_targets(sizes: dict, weights: dict, budget: float, most: float) -> dict:
    """Shares of budget by weight; none above most times its size, the excess going to the others by weight."""
    targets = {s: 0.0 for s in sizes}
    free, left = {s for s in sizes if weights[s] > 0}, budget
    while free:
        weight = sum(weights[s] for s in free)
        full = {s for s in free if left * weights[s] / weight > most * sizes[s]}
        if not full:
            return targets | {s: left * weights[s] / weight for s in free}
        targets |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        free -= full
    return targets


def _thresholds(rows: DataFrame, rests: dict[int, float]) -> dict[int, int]:
    """rows: source number, hash, size. The hash below which each source's sizes come nearest to its rest."""
    spark, found, level = rows.sparkSession, {}, 0
    open_, part = {n: (0, rest) for n, rest in rests.items()}, rows
    while open_:
        level += 1
        shift = HASH_BITS - level * LEVEL_BITS
        ask = _source_table(spark, [(n, p, float(r)) for n, (p, r) in open_.items()], "ask long, prefix long, rest double")
        part = part.join(ask, (F.col("number") == F.col("ask")) & (F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix")))
        buckets = part.groupBy("number", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.first("rest").alias("rest"))
        before = F.sum("size").over(Window.partitionBy("number").orderBy("bucket")) - F.col("size")
        edge = buckets.withColumn("before", before).filter("before + size >= rest").groupBy("number").agg(F.min(F.struct("bucket", "before", "size", "n", "rest")).alias("e"))
        rows_ = edge.select("number", "e.*").collect()  # one row for each open source
        for n in open_.keys() - {r.number for r in rows_}:
            found[n] = 1 << HASH_BITS  # the rest is all there is
        part, open_ = part.drop("ask", "prefix", "rest"), {}
        for r in rows_:
            rest = r.rest - r.before
            if r.n == 1 or shift == 0:
                found[r.number] = (r.bucket + (2 * rest >= r.size)) << shift
            else:
                open_[r.number] = (r.bucket, rest)
    return found


def plan_mix(rows: DataFrame, weight_of, share: float, most: float) -> list[MixPlan]:
    """rows: source, hash, size. The driver holds one row for each source, MOST_SOURCES at most, none for documents.

    weight_of(sources) gives a weight for each of the sources, which come in code-point order, null last.
    """
    by_source = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(by_source) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sizes = {r.source: int(r.size or 0) for r in by_source}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = dict(zip(order, weight_of(order)))
    targets = fill_targets(sizes, weights, share * sum(sizes.values()), most)
    passes = {s: int(targets[s] // sizes[s]) if sizes[s] else 0 for s in order}
    rest = {i: targets[s] - passes[s] * sizes[s] for i, s in enumerate(order) if sizes[s] and targets[s] > passes[s] * sizes[s]}
    numbers = _source_table(rows.sparkSession, [(s, i) for i, s in enumerate(order) if i in rest], "of string, number long")
    numbered = rows.join(numbers, F.col("source").eqNullSafe(F.col("of"))).select("number", "hash", "size")
    edges = _thresholds(numbered, rest) if rest else {}
    return [MixPlan(s, sizes[s], targets[s], passes[s], edges.get(i, 0)) for i, s in enumerate(order)]


def _source_table(spark, rows: list[tuple], schema: str) -> DataFrame:
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= BROADCAST_SOURCES else table


def cyclic_weights(cycle: tuple = (3, 1, 2)):
    return lambda sources: [cycle[i % len(cycle)] for i in range(len(sources))]


def document_hash(doc_id: Column, text: Column) -> Column:
    """From id and text, so that it is the same in every run and rows without an id differ too."""
    return key60(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))


def mix(docs: DataFrame, weight_of=None, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """A row for each document: doc_id, source, size (words), source_size, target, copies, taken (size times copies).

    Whole documents are taken: floor(target / source size) times each, once more below the
    threshold; the document at the threshold is in or out, whichever is nearer. Reruns agree.
    Texts of any length are counted whole and taken whole. Null text has size 0. A null source is a source of its own, the last. Rows alike in id and
    text have the same hash and are in or out together. An empty table gives an empty result.
    Columns other than doc_id, text and source are not used. The sources (one row each) must fit
    the driver; the table of their plans is broadcast up to BROADCAST_SOURCES rows.
    """
    slim = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), document_hash(F.col("doc_id"), F.col("text")).alias("hash"), n_words(F.col("text")).alias("size"))
    slim = staged(slim, "mix")
    plans = plan_mix(slim.select("source", "hash", "size"), weight_of or cyclic_weights(), share, most)
    table = _source_table(slim.sparkSession, [(p.source, p.size, p.target, p.passes, p.threshold) for p in plans], "of string, source_size long, target double, passes long, threshold long")
    copies = F.col("passes") + (F.col("hash") < F.col("threshold")).cast("long")
    return slim.join(table, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mixed_documents(docs: DataFrame, weight_of=None, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """docs as the mix takes them: a document taken twice is there twice, one not taken is gone. The columns stay as they are.

    Null texts and sources, very long texts, ties, repeated rows, empty tables and clashing names are as for mix: a null text has size 0 and
    is taken by its hash like any other.
    """
    h, z, n, of = (fresh(docs, c) for c in ("mix_hash", "mix_size", "mix_copies", "mix_source"))
    slim = staged(docs.select(F.col("source").cast("string").alias("source"), document_hash(F.col("doc_id"), F.col("text")).alias("hash"), n_words(F.col("text")).alias("size")), "mix")
    plans = plan_mix(slim, weight_of or cyclic_weights(), share, most)
    table = _source_table(docs.sparkSession, [(p.source, p.passes, p.threshold) for p in plans], f"{of} string, {z} long, {h} long")
    copies = F.col(z) + (document_hash(docs["doc_id"], docs["text"]) < F.col(h)).cast("long")
    kept = docs.join(table, docs["source"].cast("string").eqNullSafe(F.col(of))).withColumn(n, copies).filter(F.col(n) > 0)
    return kept.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)
