"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong patterns are reported wherever they stand. Weak candidates, a bare 40-character key or an
endpoint, are reported only where the parts that complete them stand within a scope of so many
characters: a key needs an access identifier, an endpoint an identifier and a secret. Parts
meet by an interval join on row and position bucket, so that no bucket pairs more parts than
its width has room for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import fresh, staged

# Kinds in the order in which spans are listed, their patterns, the group that
# must be so long, and the least length. A key may follow "=" (NAME=value), but no run of its own
# letters, nor one that goes on with "_" or "-"; what "=" follows may be padded and longer.
KINDS = ["assign", "access", "hex", "key", "endpoint"]
PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
    "key": (r"(?<![A-Za-z0-9+/])(?<![A-Za-z0-9+/][_-])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])", 0, 40),
    "endpoint": (r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/?&=%+-]*)?", 0, 8),
}
BASE = KINDS[:3]
SCOPE = 256


def _found(text: Column, kind: str) -> Column:
    pattern, group, least = PATTERNS[kind]
    return S.matches(text, KINDS.index(kind), pattern, lambda part: F.length(part) >= least, group)


def candidates(text: Column) -> Column:
    """All matches of all kinds in a text, as one array; weak kinds only beside an identifier or a secret."""
    def of(kind: str, when: Column) -> Column:
        return F.when(when, _found(text, kind)).otherwise(S.none(S.MATCH))

    has = {k: text.rlike(PATTERNS[k][0]) for k in KINDS}
    return F.concat(of("assign", has["assign"]), of("access", has["access"]), of("hex", has["hex"]), of("key", has["access"] & has["key"]), of("endpoint", has["access"] & has["endpoint"]))


def near(spans: DataFrame, others: DataFrame, within: int) -> DataFrame:
    """The spans that have one of others within so many characters in their text (0: that they overlap or touch)."""
    return S.near(spans, others, within, SCOPE)


def link(spans: DataFrame) -> DataFrame:
    """Base spans as they are, and the weak ones whose complementary parts stand within the scope."""
    kind = {k: spans.filter(F.col("kind") == i) for i, k in enumerate(KINDS)}
    base = spans.filter(F.col("kind") < len(BASE))
    keys = near(kind["key"], kind["access"], SCOPE)
    keys = keys.join(near(kind["key"], base, 0), ["row", "kind", "start", "end"], "left_anti")
    points = near(near(kind["endpoint"], kind["access"], SCOPE), kind["assign"].union(keys), SCOPE)
    return base.union(keys.select(base.columns)).union(points.select(base.columns))


def _same(number: int):
    return lambda x: x == number


def _scanned(docs: DataFrame, row: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents without a match of a strong pattern; the others, stored with a number each; and these numbers' spans."""
    raw, text = fresh(docs, "scan_raw"), F.coalesce(F.col("text"), F.lit(""))
    hit = text.rlike(PATTERNS["assign"][0]) | text.rlike(PATTERNS["access"][0]) | text.rlike(PATTERNS["hex"][0])
    stored = staged(docs.filter(hit).withColumn(raw, candidates(text)).withColumn(row, F.monotonically_increasing_id()), "scanned")
    return docs.filter(~hit), stored, link(staged(S.placed(stored.select(F.col(row).alias("row"), F.col(raw).alias("found"))), "spans"))


def scan(docs: DataFrame) -> DataFrame:
    """docs (all columns) with found: an array of spans (start, kind, end) by start and kind, both as numbers.

    Positions count characters of the whole text, however long, ends excluded; kind numbers index KINDS. A
    null or empty text has no spans. Rows alike are scanned each for itself; an empty table gives
    an empty result. A column of docs that is called found stays, and the new one ends in an underscore.
    Only documents with a match of a strong pattern are stored on the way.
    """
    row, of, all_, out = (fresh(docs, c) for c in ("scan_row", "scan_of", "scan_spans", "found"))
    clean, stored, spans = _scanned(docs, row)
    listed = spans.groupBy(F.col("row").alias(of)).agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias(all_))
    joined = stored.join(listed, stored[row] == F.col(of), "left").withColumn(out, F.coalesce(all_, S.none(S.SPAN)))
    return clean.withColumn(out, S.none(S.SPAN)).union(joined.select(*docs.columns, out))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: the digest of a scan, without carrying texts on.

    Texts of any length are scanned whole. Null and empty ones have no spans: counts of 0, the digest of nothing and an empty list. Repeated rows come
    each for itself, an empty table gives an empty result, and columns other than doc_id and text are not used.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = staged(docs.select("doc_id", candidates(text).alias("found"), F.monotonically_increasing_id().alias("row")), "scanned")
    spans = link(staged(S.placed(slim.filter(F.size("found") > 0).select("row", "found")), "spans"))
    listed = spans.groupBy(F.col("row").alias("of")).agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("all"))
    joined = slim.select("doc_id", "row").join(listed, F.col("row") == F.col("of"), "left")
    joined = joined.withColumn("all", F.coalesce("all", S.none(S.SPAN)))
    counts = [F.size(F.filter(F.col("all")["kind"], _same(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return joined.select("doc_id", *counts, F.sha2(S.listed(F.col("all"), KINDS, len(BASE)), 256).alias("base_sha256"), S.listed(F.col("all"), KINDS, len(KINDS)).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every reported span of the text replaced by mark (overlapping spans by one), and n_chars anew.

    Null and empty texts stay as they are; rows, repeated ones too, all stay; an empty table gives an empty result; columns
    of any name are carried along. The time that a text takes grows with its length and with its spans, each by itself.
    """
    row, of, at, rest, parts = (fresh(docs, c) for c in ("scan_row", "scan_of", "scan_cuts", "scan_rest", "scan_parts"))
    clean, stored, spans = _scanned(docs, row)
    cut = S.cuts(spans).withColumnsRenamed({"of": of, "cuts": at, "rest": rest})
    joined = stored.join(cut, F.col(row) == F.col(of), "left").withColumn(parts, S.pieces(F.col("text")))
    text = S.replaced(parts, at, rest, F.length("text"), lambda kind: F.lit(mark))
    out = clean.union(joined.withColumn("text", F.when(F.col(at).isNotNull(), text).otherwise(F.col("text"))).select(*docs.columns))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
