"""A corpus pipeline of five stages; each takes the documents its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import mixing, neardup, packing, quality, secrets
from millrace.llm.common import drop, fresh, staged_alone

#: Encoded chunks in a worker's cache: few, as the JVM's heap is full by the time of the last stage.
CHUNKS = 250_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule, or whose host fails, go. Null and empty texts fail as short; long ones are measured whole, and rows alike judged alike."""
    judged = quality.judge(docs)
    return judged.filter(judged[fresh(docs, "kept")]).select(*docs.columns)


def minhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the least id. Texts without words are like no other and stay; long ones are compared whole."""
    return neardup.drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, in long texts too; all documents stay, null and empty texts as they are."""
    return secrets.redact(docs)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix leaves out go, and those that it takes twice are there twice. A null source counts as one; long texts are taken whole or not."""
    return mixing.mixed_documents(docs)


def harmonic_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens. Null and empty texts are an end token; long ones are cut into more pieces."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=2048, cache_entries=CHUNKS)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_neardup", minhash_neardup),
    ("secret_scan", secret_scan),
    ("mixing_weights", mixing_weights),
    ("harmonic_packing", harmonic_packing),
]

#: Hashing, MinHash and tokenizing are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Documents, however long, go through each stage whole; an empty table gives an empty result.

    A stage's table, and all that it staged on the way, is deleted once the next stage's is written; the table before the last stage stays, as the result is made of it.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = staged_alone(lambda: stage(spark, docs, sf_dir), name)
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
