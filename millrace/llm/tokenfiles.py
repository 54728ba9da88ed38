"""Token ids as flat binary files with 64-bit document offsets.

A set of files holds documents in ascending doc_id order. Each partition writes four flat
files without headers: NAME.bin, ids as little-endian unsigned integers of 16 or 32 bits;
NAME.idx, n + 1 signed 64-bit offsets in ids; NAME.doc, n signed 64-bit document ids; NAME.nul, n
bytes that are 1 where the document id is null. A partition's base, the ids in all earlier
partitions, comes from prefix sums over the manifest, so writers need not wait for each other.
"""

from __future__ import annotations

import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_folder, staged
from .tokens import encoder, slices

MANIFEST = "part int, name string, n_docs long, n_ids long, width int"
DOCUMENT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class FlatFile:
    """A flat array in a file: memory-mapped where the file is local, else read by ranges."""

    def __init__(self, uri: str, dtype: str):
        self.dtype, (store, path) = np.dtype(dtype), _store(uri)
        local = urlparse(uri).scheme in ("", "file")
        self.file = None if local else store.open_input_file(path)
        self.size = store.get_file_info(path).size
        self.map = np.memmap(path, self.dtype, "r") if local and self.size else np.zeros(0, self.dtype)

    def read(self, start: int, stop: int) -> np.ndarray:
        if self.file is None:
            return self.map[start:stop]
        return np.frombuffer(self.file.read_at((stop - start) * self.dtype.itemsize, start * self.dtype.itemsize), self.dtype)


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, files: int | None = None) -> DataFrame:
    """Writes the files and returns their manifest: part, name, n_docs, n_ids, width, base.

    Null text counts as empty, long texts are encoded whole; each document ends with end_id. A null doc_id comes first. Rows
    with the same doc_id come in the order of their texts' CRC-32; one id may spread over files.
    A file's name has the attempt that wrote it, and the manifest names the file of the attempt
    that counts, so a task that runs again does no harm. An empty table gives no files.
    """
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("crc"), F.monotonically_increasing_id().alias("tie"))
    order = ["doc_id", "crc", "tie"]
    ordered = keyed.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def task(batches):
        enc, context = encoder(tokenizer_path), TaskContext.get()
        end = np.array([end_id], enc.dtype).tobytes()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}"
        (store, path), keys, sizes, out = _store(folder), [], [], None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if batch.num_rows and out is None:
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(f"{path}/{name}.bin")
            for i, j in slices(texts):
                packed = enc.encode([t or "" for t in texts[i:j]])
                out.write(b"".join(x for p in packed for x in (p, end)))
                sizes.append(np.array([len(p) // enc.dtype.itemsize + 1 for p in packed], np.int64))
            keys.append(batch.column(0))
        if out is None:
            return
        out.close()
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate(sizes))])
        ids = pa.chunked_array(keys)
        with store.open_output_stream(f"{path}/{name}.idx") as f:
            f.write(offsets.astype("<i8").tobytes())
        with store.open_output_stream(f"{path}/{name}.doc") as f:
            f.write(ids.fill_null(0).to_numpy().astype("<i8").tobytes())
        with store.open_output_stream(f"{path}/{name}.nul") as f:
            f.write(ids.is_null().to_numpy().astype("u1").tobytes())
        row = [[context.partitionId()], [name], [len(ids)], [int(offsets[-1])], [enc.dtype.itemsize]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32()])], ["part", "name", "n_docs", "n_ids", "width"])

    manifest = staged(ordered.mapInArrow(task, MANIFEST), "manifest")  # frees the shuffled texts
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    return manifest.withColumn("base", F.coalesce(before, F.lit(0)))


def read(manifest: DataFrame, folder: str, docs_a_batch: int = 4096, ids_a_batch: int = 4_000_000) -> DataFrame:
    """A row for each document in the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Ids are read by ranges of so many documents and ids (or one longer document), one request each where a
    store is not local. Documents with null ids, repeated ids or no text come as they were written; a manifest
    without files gives an empty result.
    """

    def task(batches):
        for batch in batches:
            for row in batch.to_pylist():
                uri, n = f"{folder}/{row['name']}", row["n_docs"]
                ids, offsets, keys, nulls = (FlatFile(f"{uri}.{x}", t) for x, t in (("bin", f"<u{row['width']}"), ("idx", "<i8"), ("doc", "<i8"), ("nul", "u1")))
                i = 0
                while i < n:
                    at = np.asarray(offsets.read(i, min(n, i + docs_a_batch) + 1))
                    at = at[: max(2, np.searchsorted(at, at[0] + ids_a_batch, "right"))]
                    j = i + len(at) - 1
                    held = ids.read(int(at[0]), int(at[-1]))
                    crcs = [zlib.crc32(held[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1] - at[0], at[1:] - at[0])]
                    doc = pa.array(np.asarray(keys.read(i, j)), mask=np.asarray(nulls.read(i, j)).astype(bool))
                    yield pa.RecordBatch.from_arrays([doc, pa.array(at[:-1] + row["base"]), pa.array(np.diff(at)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    i = j

    files = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(files).mapInArrow(task, DOCUMENT)


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """What read gives for the files that write makes of docs, in a new folder unless one is named; nulls, ties and empty tables as there."""
    folder = folder or new_folder(docs.sparkSession, "token-files")
    return read(write(docs, folder, tokenizer_path, end_id), folder)
