"""Nested JSON of unknown shape as variants, shredded to a row for each leaf."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import fresh, staged


def leaves(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep, path, kind and value of every leaf of a column of JSON texts: scalars, nulls, and objects and arrays without members.

    path is $, then .key or ['key'] (for keys other than letters, digits and _) and [i]; kind is that of Spark's variants (bigint,
    decimal and double are number); value is the leaf as text, null for null and for what is empty. Texts that are null or no JSON give no rows.
    Each level of nesting is one pass over what is left of the levels above; the driver sees only whether any is left.
    """
    (v,) = fresh(df, "variant")
    open_ = df.select(*keep, F.lit("$").alias("path"), F.try_parse_json(text).alias(v)).filter(F.col(v).isNotNull())
    done = []
    while True:
        kind = F.schema_of_variant(v)
        level = staged(open_.withColumn("kind", kind), "variants")
        nested = F.col("kind").rlike("^(OBJECT|ARRAY)<.") & ~F.col("kind").isin("OBJECT<>", "ARRAY<VOID>")
        empty = F.col("kind").isin("OBJECT<>", "ARRAY<VOID>") & F.variant_get(v, "$[0]", "variant").isNull()
        holds = nested | (F.col("kind") == "ARRAY<VOID>") & ~empty
        plain = F.when(F.col("kind").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number").when(F.col("kind") == "VOID", "null").otherwise(F.lower(F.regexp_extract("kind", "^[A-Z]+", 0)))
        value = F.when(~F.col("kind").rlike("^(OBJECT|ARRAY)<"), F.variant_get(v, "$", "string"))
        done.append(level.filter(~holds).select(*keep, "path", plain.alias("kind"), value.alias("value")))
        inner = level.filter(holds)
        if not inner.take(1):
            break
        pos, key, value = fresh(inner, "pos", "key", "value")
        members = inner.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(v).outer()).toDF(pos, key, value))
        quoted = F.concat(F.lit("['"), F.replace(key, F.lit("'"), F.lit("\\'")), F.lit("']"))
        step = F.when(F.col(key).isNull(), F.concat(F.lit("["), pos, F.lit("]"))).when(F.col(key).rlike("^[A-Za-z0-9_]+$"), F.concat(F.lit("."), key)).otherwise(quoted)
        open_ = members.select(*keep, F.concat("path", step).alias("path"), F.col(value).alias(v))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
