"""Samples of an exact size from each stratum, the same rows in every run and on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import fresh
from . import in_pieces


def uniform(key: Column, seed: int) -> Column:
    """A number above 0 and below 1 from the first 52 bits of the MD5 of seed:key; null counts as an empty string."""
    hexes = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(hexes, 16, 10).cast("double") + 0.5) / float(1 << 52)


def stratified(df: DataFrame, by: str, key: str, size: int | dict, weight: str | None = None, seed: int = 42, pieces: int = 256) -> DataFrame:
    """size rows of each stratum of by, or all of a smaller one: those of the least exponential keys, so that rows are drawn by weight without replacement.

    key tells rows apart and decides, with the seed, a row's number u; its exponential key is -ln(u) / weight. Rows with a null weight, or one not
    above zero, are never drawn. size may name sizes by stratum; strata that it lacks give none. A null stratum is one like the others. Samples of parts, sampled
    again together, give the sample of the whole. Rows of equal key, ties included, are drawn in the order of their other columns' hash.

    No stratum is sorted whole: its keys are cut into pieces of about equal count, the first pieces are taken whole, and only the piece in which
    the size is reached is ranked. Samples are as large as asked for, whatever the strata.
    """
    e, tie, n, before, of, piece_of, want, rank, named = fresh(df, "exponential", "tie", "n", "before", "of", "piece_of", "want", "rank", "stratum")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    keyed = df.filter(w > 0).withColumn(e, -F.ln(uniform(F.col(key), seed)) / w).withColumn(tie, F.xxhash64(*[c for c in df.columns]))
    cut, piece = in_pieces(keyed, by, e, pieces)
    counts = cut.groupBy(F.col(by).alias(of), F.col(piece).alias(piece_of)).agg(F.count("*").alias(n))
    upto = F.coalesce(F.sum(n).over(Window.partitionBy(of).orderBy(piece_of).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if isinstance(size, dict):
        sizes = df.sparkSession.createDataFrame([(k, int(v)) for k, v in size.items()], f"`{named}` {df.schema[by].dataType.simpleString()}, `{want}` long")
        counts = counts.join(F.broadcast(sizes), F.col(of).eqNullSafe(F.col(named)))
    else:
        counts = counts.withColumn(want, F.lit(size).cast("long"))
    counts = counts.withColumn(before, upto).filter(F.col(before) < F.col(want))
    met = cut.join(counts, F.col(by).eqNullSafe(F.col(of)) & (F.col(piece) == F.col(piece_of)))
    whole = F.col(before) + F.col(n) <= F.col(want)
    order = Window.partitionBy(of).orderBy(e, key, tie)
    last = met.filter(~whole).withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= F.col(want) - F.col(before))
    return met.filter(whole).select(*df.columns).union(last.select(*df.columns))
