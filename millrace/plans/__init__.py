"""Registered queries and their SQL."""

from . import corpus, files, relational, series


def queries() -> dict:
    return relational.QUERIES | series.QUERIES | corpus.QUERIES | files.QUERIES


def oracle_sql() -> dict[str, str]:
    return relational.SQL | series.SQL | corpus.SQL | files.SQL
