"""Spans in texts, in DataFrame functions only: matches with their places, neighbours by interval joins, texts with spans replaced."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MATCH = "array<struct<kind:int,i:int,gap:int,size:int,ok:boolean>>"
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
#: Texts whose spans are replaced are cut into pieces of so many characters first.
PIECE = 4096


def none(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def matches(text: Column, kind: int, pattern: str, ok: Callable[[Column], Column], group: int = 0) -> Column:
    """Matches of a pattern in order: characters before it since the last one, its own characters, and ok of its group.

    The parts between matches give the positions: splitting and extracting walk over the same matches.
    """
    gaps, whole, part = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(whole.alias("w"), part.alias("p"), F.slice(gaps, 1, F.size(whole)).alias("g"))
    return F.transform(zipped, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["g"]).alias("gap"), F.length(x["w"]).alias("size"), ok(x["p"]).alias("ok")))


def placed(found: DataFrame) -> DataFrame:
    """found: row, found. The matches that are ok: row, kind, start, end (characters, end exclusive)."""
    flat = found.select("row", F.inline("found"))
    order = Window.partitionBy("row", "kind").orderBy("i")
    start = F.sum("gap").over(order) + F.sum("size").over(order) - F.col("size")
    return flat.select("row", "kind", start.alias("start"), (start + F.col("size")).alias("end"), "ok").filter("ok").drop("ok")


def _bucketed(spans: DataFrame, margin: int, width: int) -> DataFrame:
    """A row for each position bucket that a span, widened by margin, touches."""
    first, last = F.expr(f"floor((start - {margin}) / {width})"), F.expr(f"floor((end + {margin}) / {width})")
    return spans.withColumn("bucket", F.explode(F.sequence(first, last)))


def near(spans: DataFrame, others: DataFrame, within: int, width: int, *also: str) -> DataFrame:
    """The spans that have one of others within so many characters in their text (0: that they overlap or touch), equal in the columns of also too.

    An interval join on row and position bucket: no bucket pairs more spans than its width has room for.
    """
    a = _bucketed(spans, within, width)
    b = _bucketed(others, 0, width).select(*[F.col(c).alias(f"{c}_") for c in ("row", "bucket", "start", "end", *also)])
    same = (F.col("row") == F.col("row_")) & (F.col("bucket") == F.col("bucket_"))
    for c in also:
        same = same & (F.col(c) == F.col(f"{c}_"))
    return a.join(b, same & (F.col("start_") <= F.col("end") + within) & (F.col("end_") >= F.col("start") - within), "left_semi").drop("bucket").distinct()


def listed(spans: Column, kinds: list[str], keep: int) -> Column:
    """kind:start:end of the spans whose kind is below keep, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    wanted = F.filter(spans, lambda s: s["kind"] < keep)
    return F.array_join(F.transform(wanted, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def cuts(spans: DataFrame) -> DataFrame:
    """spans: row, kind, start, end. By row: of, cuts (at, upto and kind: from where text stays up to a span, and which) and rest, from where it stays at the end.

    Of spans that overlap, the first by start and kind counts, and the text goes on where the last of them ends.
    """
    order = Window.partitionBy("row").orderBy("start", "kind", "end")
    at = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    first = F.struct(F.col("start").alias("upto"), F.col("at"), F.col("kind"))
    rows = spans.withColumn("at", at)
    kept = F.when(F.col("start") >= F.col("at"), first)
    return rows.groupBy(F.col("row").alias("of")).agg(F.sort_array(F.collect_list(kept)).alias("cuts"), F.max("end").alias("rest"))


def pieces(text: Column) -> Column:
    """A text as pieces of PIECE characters, the last one shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _between(parts: Column, start: Column, stop: Column) -> Column:
    """The characters of a text in pieces from start to stop: no more than two pieces are walked through, those between are taken whole."""
    a, b = (start / PIECE).cast("int"), ((stop - 1) / PIECE).cast("int")
    first, last = (start % PIECE + 1).cast("int"), ((stop - 1) % PIECE + 1).cast("int")
    head, tail = F.element_at(parts, a + 1), F.element_at(parts, b + 1)
    within = F.substring(head, first, (stop - start).cast("int"))
    over = F.concat(F.substring(head, first, F.lit(PIECE)), F.array_join(F.slice(parts, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.substring(tail, F.lit(1), last))
    return F.when(stop <= start, "").when(a == b, within).otherwise(over)


def replaced(parts: str, cuts: str, rest: str, length: Column, mark: Callable[[Column], Column]) -> Column:
    """The text of the columns of pieces and cuts, with a mark for each cut; time grows with the text and the number of cuts, each by itself."""
    whole = F.col(parts)
    kept = F.transform(F.col(cuts), lambda c: F.concat(_between(whole, c["at"], c["upto"]), mark(c["kind"])))
    return F.concat(F.array_join(kept, ""), _between(whole, F.col(rest), length))
