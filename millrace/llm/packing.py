"""Harmonic packing of token sequences.

Piece sizes are the reciprocals of the capacity: a bin of class j holds exactly j pieces of
floor(capacity / j) tokens. Documents are cut into such pieces, largest first, so every worker
can number its pieces by class on its own; a piece's bin follows from its number and the count
of the class in earlier partitions. What is left over, fewer than j pieces of each class, is a
number of pieces with a fixed bound, which one task packs first-fit decreasing.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .tokens import CACHE, encoder, sliced

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, number long"


def piece_sizes(capacity: int) -> list[int]:
    """Ascending: every size up to the square root of the capacity or so, and the capacity's reciprocals above."""
    steps = int(1.4 * capacity**0.5)
    return sorted({capacity // j for j in range(1, steps + 1)} | set(range(1, capacity // steps + 1)))


def cut(n: int, sizes: list[int]) -> list[int]:
    """Lengths of the pieces of n tokens, each the largest size that fits what is left."""
    whole, rest = divmod(n, sizes[-1])
    out = [sizes[-1]] * whole
    while rest:
        out.append(sizes[bisect_right(sizes, rest) - 1])
        rest -= out[-1]
    return out


def cut_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 2048, keep_ids: bool = False, cache_entries: int = CACHE) -> DataFrame:
    """The pieces of all documents, numbered by length within each partition; ids are kept as packed bytes if asked for.

    A worker caches cache_entries encoded chunks; fewer than usual are also forgotten when a task ends.
    """

    def pieces(batches):
        enc, sizes, seen = encoder(tokenizer_path, cache_entries), piece_sizes(capacity), {}
        part, end = TaskContext.get().partitionId(), np.array([end_id], "<u4")
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for i, j, texts in sliced(batch.column(1)):
                rows: list[tuple] = []
                for doc_id, packed in zip(doc_ids[i:j], enc.encode([t or "" for t in texts])):
                    ids = np.concatenate([np.frombuffer(packed, enc.dtype).astype("<u4"), end])
                    start = 0
                    for n in cut(len(ids), sizes):
                        data = ids[start : start + n].tobytes()
                        number = seen[n] = seen.get(n, -1) + 1
                        rows.append((doc_id, start, n, zlib.crc32(data), len(ids), part, number, data if keep_ids else b""))
                        start += n
                columns = list(zip(*rows))
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.int32()), pa.array(columns[6], pa.int64())]
                if keep_ids:
                    arrays.append(pa.array(columns[7], pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, [*names, "part", "number", *["ids"] * keep_ids])
        if cache_entries < CACHE:
            enc.chunks.clear()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, PIECE + ", ids binary" * keep_ids)


def _first_fit(capacity: int):
    def pack(rows):
        rows = rows.drop(columns="all").sort_values(["length", "part", "number"], ascending=[False, True, True]).reset_index(drop=True)
        room: list[int] = []
        bins, at = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for i, n in enumerate(rows["length"]):
            b = next((b for b, r in enumerate(room) if r >= n), len(room))
            if b == len(room):
                room.append(capacity)
            bins[i], at[i] = b, capacity - room[b]
            room[b] -= n
        return rows.assign(bin=bins, offset=at)

    return pack


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048, keep_ids: bool = False, cache_entries: int = CACHE) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if keep_ids).

    Each document's ids and end_id are cut into pieces, the longest text into the most; a null or empty text is the end id alone.
    Every sequence but those of left-over pieces is a full bin of one class. Sequence ids run from 0.
    Rows alike are packed each for itself; a null doc_id stays null; other columns are not used.
    An empty table gives an empty result. With fewer cache_entries, workers take less memory and more time.

    The left-over pieces are fewer than j for each class j, under 11,000 for a capacity of 2048
    whatever the input, so one task can take them.
    """
    spark = docs.sparkSession
    pieces = staged(cut_documents(docs, tokenizer_path, end_id, capacity, keep_ids, cache_entries), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    order = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = staged(counts.select(F.col("length").alias("of"), F.col("part").alias("in"), F.col("n"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base")), "piece-bases")
    classes, first = [], 0
    for r in base.groupBy("of").agg(F.sum("n").alias("n")).orderBy("of").collect():  # a row for each size
        full = r.n // (capacity // r.of)
        classes.append((r.of, capacity // r.of, full * (capacity // r.of), first))
        first += full
    table = F.broadcast(spark.createDataFrame(classes, "class long, bin_of long, in_full long, first long"))  # under 100 rows
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids]
    placed = pieces.join(base.drop("n"), (F.col("length") == F.col("of")) & (F.col("part") == F.col("in"))).join(table, F.col("length") == F.col("class"))
    placed = placed.withColumn("at", F.col("base") + F.col("number"))
    full = placed.filter("at < in_full").select(*kept, F.expr("first + at div bin_of").alias("sequence_id"), F.expr("(at % bin_of) * length").alias("offset"))
    left = placed.filter("at >= in_full").select(*kept, "part", "number")
    schema = PIECE + ", ids binary" * keep_ids + ", bin long, offset long"
    left = left.select(*kept[:5], "part", "number", *kept[5:]).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_first_fit(capacity), schema)
    return full.union(left.select(*kept, (F.col("bin") + F.lit(first)).alias("sequence_id"), "offset"))
