"""Table functions whose columns depend on their arguments, to be joined laterally."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


@udtf
class NamedMatches:
    """named_matches(text, pattern): a row for each match of a constant pattern in a text, with its start and a column for each named group.

    The pattern is Python's. Groups that take no part are null, and a null text gives no rows. Positions count characters from 0.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, pattern: AnalyzeArgument) -> AnalyzeResult:
        if not pattern.isConstantExpression or not isinstance(pattern.value, str):
            raise ValueError("the pattern must be a constant string")
        groups = sorted(re.compile(pattern.value).groupindex.items(), key=lambda g: g[1])
        if not groups:
            raise ValueError("the pattern names no group")
        schema = StructType().add("start", LongType())
        for name, _ in groups:
            schema = schema.add(name, StringType())
        return AnalyzeResult(schema)

    def __init__(self):
        self.pattern, self.names = None, []

    def eval(self, text, pattern):
        if text is None:
            return
        if self.pattern is None:
            self.pattern = re.compile(pattern)
            self.names = [n for n, _ in sorted(self.pattern.groupindex.items(), key=lambda g: g[1])]
        for m in self.pattern.finditer(text):
            yield (m.start(), *[m[n] for n in self.names])


def register(spark: SparkSession) -> None:
    """Makes named_matches known to SQL."""
    spark.udtf.register("named_matches", NamedMatches)
