"""One-to-one matches of names: candidates within some edits, settled by rounds of mutual best choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import staged
from . import fuzzy_matches


def settled(pairs: DataFrame) -> DataFrame:
    """pairs: a, b and cost, which order them (equal costs by a, then b). The pairs that a walk in that order takes when each a and each b may be taken once.

    In a round, the pairs that are the first of both their a and their b are taken, and all others of these go: no other pair could
    come before them. Every round takes the first pair that is left at least, most rounds a large part. Null a and b take no part; repeated pairs count once.
    """
    left, taken = staged(pairs.filter("a is not null and b is not null").groupBy("a", "b").agg(F.min("cost").alias("cost")), "pairs"), []
    while left.take(1):
        order = F.struct("cost", "a", "b")
        of_a, of_b = left.groupBy("a").agg(F.min(order).alias("first")), left.groupBy("b").agg(F.min(order).alias("first"))
        mutual = of_a.select("first").join(of_b.select("first"), "first")
        best = staged(mutual.select("first.a", "first.b", "first.cost"), "best")
        taken.append(best)
        left = staged(left.join(best.select("a"), "a", "left_anti").join(best.select("b"), "b", "left_anti").select("a", "b", "cost"), "pairs")
    out = pairs.select("a", "b", "cost").limit(0)
    for part in taken:
        out = out.unionByName(part)
    return out


def matched_once(left: DataFrame, right: DataFrame, name: str, other: str, most: int) -> DataFrame:
    """name, other, edits: each distinct name of left with at most one of right and the other way round, within most edits of their plain forms.

    Fewer edits go first, then the lesser name, then the lesser other. All candidates within most edits are ranked, none is lost before.
    """
    a, b = (df.select(c).filter(F.col(c).isNotNull()).distinct() for df, c in ((left, name), (right, other)))
    plain = [F.regexp_replace(F.lower(c), "[^a-z0-9]", "") for c in (name, other)]
    pairs = fuzzy_matches(a, b, name, other, most).select(F.col(name).alias("a"), F.col(other).alias("b"), F.levenshtein(*plain).cast("long").alias("cost"))
    return settled(pairs).select(F.col("a").alias(name), F.col("b").alias(other), F.col("cost").alias("edits"))
