"""Token counts as delta-maintained rollups.

A ledger keeps, for each committed batch, the signed sums of its changes by source, language and
tokenizer version. Totals are the sums over batches, so inserts, deletes and revised counts all
add. A commit writes a folder of its own and then an empty marker whose name tells which folder counts for the
batch: until the marker is there, totals are those of before, and committing a batch again replaces it.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked, drop, new_folder, shuffles_freed, staged
from .tokens import encoder, slices

KEYS = ["source", "lang", "tokenizer"]
ROW = "source string, lang string, tokenizer string, docs long, tokens long"


def inserted(rows: DataFrame) -> DataFrame:
    """rows: source, lang, tokenizer, tokens; each a document's count that comes in."""
    return rows.select(*KEYS, F.lit(1).cast("long").alias("docs"), "tokens")


def deleted(rows: DataFrame) -> DataFrame:
    """rows: source, lang, tokenizer, tokens; each a document's count that goes. Null keys are keys like others, a null count adds nothing, rows alike go each for itself."""
    return rows.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).alias("tokens"))


def revised(rows: DataFrame) -> DataFrame:
    """rows: source, lang, tokenizer, old_tokens, tokens; the documents stay, their counts change. A null old or new count changes nothing; null keys and rows alike are as for deleted."""
    return rows.select(*KEYS, F.lit(0).cast("long").alias("docs"), (F.col("tokens") - F.col("old_tokens")).alias("tokens"))


class TokenLedger:
    """Batches of signed deltas in a folder that driver and executors share.

    The folder holds data/ATTEMPT (Parquet) and commits/BATCH@NUMBER@ATTEMPT (empty). The greatest marker of a batch
    counts. The driver lists the markers, one for each commit; compact() makes one of them all.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_folder(spark, "ledger")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def commits(self) -> dict[str, tuple[int, str]]:
        """By batch, the number of its last commit and the folder that counts."""
        path, files = self._at("commits")
        found: dict[str, tuple[int, str]] = {}
        for status in files.listStatus(path) if files.exists(path) else []:
            batch, number, attempt = status.getPath().getName().split("@")
            found[batch] = max(found.get(batch, (0, "")), (int(number), attempt))
        return found

    def write(self, deltas: DataFrame) -> str:
        """Writes a batch's sums to a folder that does not count yet, and returns its name."""
        attempt = uuid.uuid4().hex
        sums = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.parquet(f"{self.path}/data/{attempt}")
        return attempt

    def commit(self, batch: str, deltas: DataFrame) -> None:
        """Adds a batch's sums; again for the same batch, it replaces them. Batch names hold letters, digits, dots and dashes."""
        if not batch or not all(c.isalnum() or c in ".-" for c in batch):
            raise ValueError(f"no name for a batch: {batch!r}")
        attempt = self.write(deltas)
        number = self.commits().get(batch, (0, ""))[0] + 1
        path, files = self._at(f"commits/{batch}@{number:09d}@{attempt}")
        files.create(path, False).close()

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens; keys whose documents and tokens all went are left out. Null keys count as keys."""
        paths = [f"{self.path}/data/{attempt}" for _, attempt in self.commits().values()]
        rows = self.spark.read.schema(ROW).parquet(*paths) if paths else self.spark.createDataFrame([], ROW)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 or tokens <> 0")

    def compact(self, into: str) -> TokenLedger:
        """A new ledger whose only batch is the totals of this one; of an empty ledger, a batch without rows. This one stays as it is, and who uses it goes over to the new path."""
        fresh = TokenLedger(self.spark)
        fresh.commit(into, self.totals())
        return fresh


def _counted(paths: list[str]):
    """Batches of text, plain text (null where it is the same) and other columns: those, and the tokens of both by tokenizer."""

    def task(batches):
        encoders = [encoder(p) for p in paths]
        for batch in batches:
            texts, plain = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            counts = np.zeros((2 * len(paths), len(texts)), np.int64)
            for k, enc in enumerate(encoders):
                for i, j in slices(texts):
                    counts[2 * k, i:j] = [len(x) // enc.dtype.itemsize for x in enc.encode([t or "" for t in texts[i:j]])]
                    changed = [n for n in range(i, j) if plain[n] is not None]
                    counts[2 * k + 1, i:j] = counts[2 * k, i:j]
                    counts[2 * k + 1, changed] = [len(x) // enc.dtype.itemsize for x in enc.encode([plain[n] for n in changed])]
            names = [f"{c}{k}" for k in range(len(paths)) for c in ("c", "r")]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *map(pa.array, counts)], [*batch.schema.names[2:], *names])

    return task


def document_ledger(docs: DataFrame, tokenizers: dict[str, str]) -> TokenLedger:
    """The history of a corpus as batches: inserts by tokenizer version, deletion of copies, revision.

    tokenizers gives the files of tokenizer versions by name. All documents come in, once for each version;
    then those whose text is that of a document with a smaller id go (null ids last, rows alike in id and
    text stay together); then runs of ASCII digits are taken out of the rest, whose counts change. The first
    batch is committed twice, as a job that ran again would. Null and empty texts have no tokens, null texts
    are no copies of each other; texts of any length are counted whole. An empty table gives an
    empty ledger. Other columns are not used.
    """
    with shuffles_freed(docs.sparkSession):
        return _document_ledger(docs, tokenizers)


def _document_ledger(docs: DataFrame, tokenizers: dict[str, str]) -> TokenLedger:
    ledger, versions = TokenLedger(docs.sparkSession), list(tokenizers)
    plain = F.when(F.col("text").rlike("[0-9]"), F.regexp_replace("text", "[0-9]+", ""))
    given = docs.select("text", plain.alias("plain"), "doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.md5("text").alias("digest"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields[2:])
    schema = f"{kept}, " + ", ".join(f"c{k} long, r{k} long" for k in range(len(versions)))
    slim = staged(given.mapInArrow(_counted(list(tokenizers.values())), schema), "counts")
    several = slim.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1")
    several = staged(several.select(F.col("digest").alias("d"), "least"), "several")
    marked = slim.filter("digest is not null").join(checked(several), F.col("digest") == F.col("d"), "left")
    marked = marked.withColumn("copy", F.col("d").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("least"))).drop("d", "least")
    marked = staged(marked.union(slim.filter("digest is null").withColumn("copy", F.lit(False))), "counts-marked")
    drop(slim, several)

    def rows(df: DataFrame, k: int) -> DataFrame:
        return df.select("source", "lang", F.lit(versions[k]).alias("tokenizer"), F.col(f"c{k}").alias("old_tokens"), F.col(f"r{k}").alias("new_tokens"))

    gone, stay = None, None
    for k, v in enumerate(versions):
        new = inserted(rows(marked, k).withColumnRenamed("old_tokens", "tokens"))
        for _ in range(1 + (k == 0)):
            ledger.commit(f"insert-{v}", new)
        less = deleted(rows(marked.filter("copy"), k).withColumnRenamed("old_tokens", "tokens"))
        more = revised(rows(marked.filter("not copy"), k).withColumnRenamed("new_tokens", "tokens"))
        gone, stay = less if gone is None else gone.union(less), more if stay is None else stay.union(more)
    ledger.commit("copies", gone)
    ledger.commit("revised", stay)
    drop(marked)
    return ledger
