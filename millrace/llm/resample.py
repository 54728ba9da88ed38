"""Importance resampling towards a target distribution, with a distributed quickselect of the winners.

A text's features are its runs of one to three words, hashed into buckets. The counts of all documents and of the
target's texts give each bucket a gain, the log of the ratio of its two smoothed shares; the array of gains scores every
document. Scores with Gumbel noise, the k greatest of which are a weighted sample without replacement, are
never sorted as a whole: random pivot keys cut the candidates, exact counts below, at and above each pivot tell in which part the
k-th key lies, and only that part is cut again. The winners alone are sorted and ranked.
"""

from __future__ import annotations

import json
import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .common import drop, fresh, numbered, staged

#: Features are counted in so many buckets.
BUCKETS = 10_000
#: Random pivots of a round: a round leaves about one part in so many.
PIVOTS = 31

#: Letters in lower case; ASCII other than letters and digits becomes a space. Longer characters of UTF-8 stay.
_PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def features(text: bytes) -> tuple[int, np.ndarray]:
    """The number of words of a UTF-8 text, and the CRC-32 of each run of one, two and three words joined by a space.

    A CRC goes on from where that of the run without its last word ended.
    """
    words = text.translate(_PLAIN).split()
    then = [b" " + w for w in words[1:]]
    one = list(map(crc32, words))
    two = list(map(crc32, then, one))
    three = list(map(crc32, then[1:], two))
    return len(words), np.array(one + two + three, np.int64)


def bucket_counts(texts: DataFrame, text: str = "text") -> np.ndarray:
    """Features by bucket over all texts (nulls have none): an array of BUCKETS sums, whatever the size of the table."""

    def count(batches):
        sums = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for t in batch.column(0):
                if t.is_valid:
                    sums += np.bincount(features(t.as_py())[1] % BUCKETS, minlength=BUCKETS)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["bucket", "n"])

    parts = texts.select(F.col(text).cast("binary").alias("text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():  # BUCKETS rows at most
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of the ratio of the buckets' smoothed shares in target and raw, rounded down."""
    of_raw, of_target = float(raw.sum() + len(raw)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * of_raw / ((s + 1.0) * of_target))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def measured(text: Column, gain: np.ndarray) -> Column:
    """A struct n_words, n_features, weight of a text; null has no words, and no features weigh 0."""

    @F.arrow_udf("n_words long, n_features long, weight long")
    def of(texts: pa.Array) -> pa.Array:
        rows = np.zeros((len(texts), 3), np.int64)
        for i, t in enumerate(texts):
            if t.is_valid:
                n, crcs = features(t.as_py())
                rows[i] = n, len(crcs), gain[crcs % BUCKETS].sum()
        return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], ["n_words", "n_features", "weight"])

    return of(text.cast("binary"))


def noise(key: Column, seed: int) -> Column:
    """1000 times a Gumbel value of a key, rounded down: the first 32 bits of the SHA-256 of seed:key as a uniform number."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def kth_key(rows: DataFrame, key: list[str], k: int, pivots: int = PIVOTS, seed: int = 42) -> tuple:
    """The k-th least (from 1) of the distinct keys of rows in ascending order (nulls first), by quickselect.

    Each round takes random pivots from the candidates, counts them exactly below, at and between the pivots, and stages
    the part that holds the k-th key. The driver holds the pivots and their counts.
    """
    kind = ArrayType(rows.select(F.struct(*key).alias("k")).schema["k"].dataType)
    left, kept = rows.select(*key), None
    for turn in range(10_000):
        random = left.orderBy(F.xxhash64(*key, F.lit(seed + turn)), *key).limit(pivots).collect()
        ordered = sorted((tuple(r) for r in random), key=lambda r: [(v is not None, v) for v in r])
        marks, at = F.from_json(F.lit(json.dumps([dict(zip(key, r)) for r in ordered], default=str)), kind), F.struct(*key)
        place = F.size(F.filter(marks, lambda p: p < at)) + F.size(F.filter(marks, lambda p: p <= at))  # even: between pivots; odd: at one
        counts = dict(left.groupBy(place.alias("place")).agg(F.count("*")).collect())
        for p in sorted(counts):
            if k <= counts[p]:
                break
            k -= counts[p]
        narrow = None if p % 2 else staged(left.filter(place == p), "select")
        if kept is not None:
            drop(kept)
        if narrow is None:
            return ordered[p // 2]
        left = kept = narrow
    raise RuntimeError("keys are not distinct")


def upto(key: list[str], last: tuple, schema) -> Column:
    """Whether a row's key is last or before it."""
    return F.struct(*key) <= F.struct(*[F.lit(v).cast(schema[c].dataType).alias(c) for v, c in zip(last, key)])


def resample(docs: DataFrame, target: DataFrame, *keep: str, percent: int = 5, min_words: int = 20, seed: int = 42, pivots: int = PIVOTS) -> DataFrame:
    """A row for each document: its columns (or only keep), n_features, weight, score and rank (from 1, null if it is not drawn).

    docs has doc_id and text, target text. Of the documents with min_words words and more, percent of a hundred (rounded down)
    are drawn: those of greatest score, equal scores by the smaller doc_id (null last), then by fewer features; rows alike in all of these
    take neighbouring ranks, and where only some of them are drawn, it makes no difference which. Null and empty texts have no features, weigh 0 and
    are never drawn; texts of any length are read whole. Empty tables: no documents give an empty result, an empty target gives each bucket the
    same pseudo-count. Where docs has a column of a new one's name, the new one ends in an underscore.
    """
    of, n, w, s, rank, row, m, drawn = (fresh(docs, c) for c in ("n_words", "n_features", "weight", "score", "rank", "scored_row", "measured", "drawn_row"))
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = docs.select("*", measured(F.col("text"), gain).alias(m)).select(*(keep or docs.columns), *([] if not keep or "doc_id" in keep else ["doc_id"]), F.col(f"{m}.n_words").alias(of), F.col(f"{m}.n_features").alias(n), F.col(f"{m}.weight").alias(w))
    scored = staged(scored.withColumn(s, F.col(w) + noise(F.col("doc_id"), seed)).withColumn(row, F.monotonically_increasing_id()), "scored")
    key = ["down", "unknown", "doc_id", n, row]
    able = scored.filter(F.col(of) >= min_words).select((-F.col(s)).alias("down"), F.col("doc_id").isNull().alias("unknown"), "doc_id", n, row)
    k = able.count() * percent // 100
    if k:
        winners = able.filter(upto(key, kth_key(able, key, k, pivots, seed), able.schema))
        ranks = numbered(winners, key, "place").select(F.col(row).alias(drawn), (F.col("place") + 1).alias(rank))
    else:
        ranks = able.limit(0).select(F.col(row).alias(drawn), F.lit(0).cast("long").alias(rank))
    out = scored.join(ranks, F.col(row) == F.col(drawn), "left")
    return out.select(*(keep or docs.columns), n, w, s, rank)
