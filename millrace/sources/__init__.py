"""Readers for the file kinds of training-data collections; each checks what Spark alone would misread."""

from __future__ import annotations

import json
import lzma
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "version https://git-lfs.github.com/spec/v1"
CATALOG = "problem string, file string, bytes long, source string, note string"


class PointerError(ValueError):
    """A data file is a pointer to large-file storage and holds no data."""


def pointer_states(spark: SparkSession, path: str, most: int = 1024) -> DataFrame:
    """path and state (pointer or data) of each file at path; only files of up to most bytes are read, as pointers are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = files.filter(F.col("length") <= most).select("path", F.when(F.col("content").cast("string").startswith(POINTER + "\n"), "pointer").otherwise("data").alias("state"))
    return small.union(files.filter(F.col("length") > most).select("path", F.lit("data")))


def refuse_pointers(spark: SparkSession, path: str, most: int = 1024) -> None:
    """Raises PointerError if a file at path begins as a storage pointer; only files of up to most bytes are read, as pointers are."""
    small = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(F.col("length") <= most)
    found = small.filter(F.col("content").cast("string").startswith(POINTER + "\n")).select("path").first()
    if found:
        raise PointerError(f"{found.path} is a pointer to large-file storage, not data")


def read_csv(spark: SparkSession, path: str, schema: str, file_name: str | None = None, multi_line: bool = True) -> DataFrame:
    """CSV with a header and doubled quotes; strings are trimmed of white space, file_name adds that column.

    With multi_line, quoted values may hold line feeds, and each file is read by one task; without, Spark splits files.
    """
    df = spark.read.schema(schema).option("header", True).option("multiLine", multi_line).option("escape", '"').option("enforceSchema", False).csv(path)
    return df.select(*[F.regexp_replace(F.col(f"`{f.name}`"), r"^\s+|\s+$", "").alias(f.name) if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`") for f in df.schema], *([F.col("_metadata.file_name").alias(file_name)] if file_name else []))


def write_csv(df: DataFrame, path: str, *by: str) -> None:
    """CSV that read_csv reads back: header, doubled quotes; one folder for each value of the by columns."""
    df.write.partitionBy(*by).option("header", True).option("escape", '"').csv(path)


def number_in_path(pattern: str) -> Column:
    """The number that the first group of pattern finds in the path of the row's file; null where there is none."""
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).try_cast("double")


def read_xz_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of xz files: file_name, line_no (from 0), value. A file is a task's work, as xz has no index; it must fit in a task."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("file_name"), "content")

    def lines(batches):
        for pdf in batches:
            for name, content in zip(pdf["file_name"], pdf["content"]):
                values = lzma.decompress(content).decode().split("\n")
                values = values[:-1] if values[-1] == "" else values
                for at in range(0, len(values), 10_000):
                    part = values[at : at + 10_000]
                    yield pd.DataFrame({"file_name": name, "line_no": range(at, at + len(part)), "value": part})

    return files.mapInPandas(lines, "file_name string, line_no long, value string")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of file entries; source and note may be missing."""
    return spark.read.schema(CATALOG).option("multiLine", True).json(path)


def missing_files(catalog: DataFrame, folder: str) -> DataFrame:
    """Entries of a catalog with state present, missing or other_size; contents are not read. file is the path below folder."""
    files = catalog.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    root = re.escape(re.sub(r"^[a-z][a-z0-9]*:/*|^/*", "", folder).rstrip("/"))
    below = F.regexp_extract("path", f"^(?:[a-z][a-z0-9]*:)?/*{root}/+(.*)$", 1)
    files = files.select(below.alias("below"), "length")
    joined = catalog.join(files, F.col("below") == F.col("file"), "left")
    state = F.when(F.col("length").isNull(), "missing").when(F.col("length") != F.col("bytes"), "other_size").otherwise("present")
    return joined.select("problem", "file", "bytes", "length", state.alias("state"))


def domain_columns(df: DataFrame, key: str, prefix: str, suffix: str = "") -> DataFrame:
    """A wide table (a column for each domain) as key, domain, value; prefix and suffix are taken off the names."""
    wide = [c for c in df.columns if c != key]
    renamed = df.select(key, *[F.col(f"`{c}`").cast("double").alias(c.removeprefix(prefix).removesuffix(suffix).replace("/", "_")) for c in wide])
    return renamed.unpivot([key], [c for c in renamed.columns if c != key], "domain", "value")


def read_cards(spark: SparkSession, path: str, name: str = "file_name") -> DataFrame:
    """Markdown cards with a fenced JSON object of results by task: file_name, task, metric, value (null for "N/A").

    The group "all", which repeats every entry, is left out. name is file_name or file_path.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col(f"_metadata.{name}").alias("file_name"), "value")

    def parse(batches):
        for pdf in batches:
            rows = []
            for name, text in zip(pdf["file_name"], pdf["value"]):
                for block in re.findall(r"```(?:python|json)?\s*(\{.*?\})\s*```", text, re.S):
                    for task, metrics in json.loads(block).items():
                        if task != "all" and isinstance(metrics, dict):
                            rows += [(name, task, m, v if isinstance(v, (int, float)) else None) for m, v in metrics.items() if isinstance(v, (int, float)) or v == "N/A"]
            yield pd.DataFrame(rows, columns=["file_name", "task", "metric", "value"]).astype({"value": "float64"})

    return whole.mapInPandas(parse, "file_name string, task string, metric string, value double").withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def read_front_matter(spark: SparkSession, path: str, name: str = "file_name") -> DataFrame:
    """The data files that a card's YAML head lists: file_name, config_name, split, path. Cards without a head give no rows."""
    whole = spark.read.text(path, wholetext=True).select(F.col(f"_metadata.{name}").alias("file_name"), F.regexp_extract("value", r"^---\r?\n([\s\S]*?)\n---\r?\n", 1).alias("head"))

    def parse(batches):
        import yaml

        for pdf in batches:
            rows = []
            for name, head in zip(pdf["file_name"], pdf["head"]):
                for config in (yaml.safe_load(head) or {}).get("configs") or []:
                    rows += [(name, config.get("config_name"), str(f.get("split")), p) for f in config.get("data_files") or [] for p in (f["path"] if isinstance(f["path"], list) else [f["path"]])]
            yield pd.DataFrame(rows, columns=["file_name", "config_name", "split", "path"])

    return whole.filter("head <> ''").mapInPandas(parse, "file_name string, config_name string, split string, path string")
