"""How a plan module registers its queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The tables of a folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def registrar(queries: dict, sql: dict):
    """A decorator: registers a function of Tables by its name, with the SQL that gives the same rows."""

    def register(oracle: str | None = None):
        def keep(f):
            queries[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if oracle:
                sql[f.__name__] = oracle
            return f

        return keep

    return register
