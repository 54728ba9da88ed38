"""Connected components of a link table as Spark joins (large-star and small-star rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, shuffles_freed, staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node points to the least node around; repeated edges may come out."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, point to the least of them; every edge once."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    """The same for the same set of edges, and hardly ever for another."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, root) for every node of edges (u, v), staged; root is the least node it reaches. Nodes without edges are not returned.

    Each round is written to the shared folder in place of the one before, and rounds go on until the
    table of stars no longer changes: about log(n) squared rounds at worst, three to six in practice.
    A hub of any degree is a skewed join that Spark splits, never a group in one task.
    """
    with shuffles_freed(edges.sparkSession):
        now = staged(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v").distinct(), tag)
        mark = _mark(now)
        while mark[0]:
            last, now = now, staged(_small_star(_large_star(now)), tag)
            drop(last)
            new = _mark(now)
            if new == mark:
                break
            mark = new
        roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
        out = staged(now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots), f"{tag}-roots")
        drop(now)
    return out


def with_root(rows: DataFrame, roots: DataFrame | None, column: str = "node", name: str = "root") -> DataFrame:
    """rows with the root of a node column; a node that roots lacks is its own."""
    if roots is None:
        return rows.withColumn(name, F.col(column))
    to = roots.select(F.col("node").alias("node_of_root"), F.col("root").alias("root_found"))
    return rows.join(to, F.col(column) == F.col("node_of_root"), "left").withColumn(name, F.coalesce("root_found", column)).drop("node_of_root", "root_found")


def extended(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """The roots after more links (u, v), staged; only links between different roots are followed. The old table is dropped."""
    if roots is None:
        return components(links)
    between = with_root(with_root(links.select("u", "v"), roots, "u", "ru"), roots, "v", "rv").select(F.col("ru").alias("u"), F.col("rv").alias("v"))
    more = components(between)
    moved = with_root(roots.withColumnRenamed("root", "old"), more, "old").select("node", "root")
    new = more.join(roots.select("node"), "node", "left_anti")
    out = staged(moved.union(new), "roots")
    drop(roots, more)
    return out
