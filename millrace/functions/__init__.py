"""Column expressions for scores, compositions and ratios."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def above_chance(score: Column, chance: Column | float) -> Column:
    """A score from chance level to 1 as 0 to 100; below chance it is 0, and null where score or chance is."""
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), (score - chance) / (F.lit(1.0) - chance)) * 100)


def share(x: Column, *by: str) -> Column:
    """x as a part of its total; null where the total is zero."""
    return F.try_divide(x, F.sum(x).over(Window.partitionBy(*by)))


def clr(part: Column, *by: str) -> Column:
    """Centred log-ratio of the parts of a composition; parts must be above zero (see replace_zeros)."""
    return F.ln(part) - F.avg(F.ln(part)).over(Window.partitionBy(*by))


def replace_zeros(part: Column, delta: float, *by: str) -> Column:
    """Multiplicative replacement: zeros become delta, other parts shrink so that the sum stays 1."""
    zeros = F.sum(F.when(part == 0, 1).otherwise(0)).over(Window.partitionBy(*by))
    return F.when(part == 0, F.lit(delta)).otherwise(part * (1 - zeros * delta))


def entropy(part: Column) -> Column:
    """Aggregate: Shannon entropy in nats; empty parts count nothing."""
    return -F.sum(F.when(part > 0, part * F.ln(part)).otherwise(0.0))


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def flops_ratio(flops: Column, params_b: Column, tokens_b: Column) -> Column:
    """Stated compute by six times parameters times tokens (both in units of 1e9); null where one is unknown or zero."""
    return F.try_divide(flops, F.lit(6e18) * F.nullif(params_b * tokens_b, F.lit(0.0)))


def sentinel_to_null(x: Column, *sentinels: str) -> Column:
    return F.when(~F.trim(x).isin(*sentinels), x)


def experiment_parts(name: Column) -> Column:
    """A struct n, d, q from a name such as N0.07_D0010_Q0.5; null parts where the name has another form."""
    pattern = r"^N([0-9.]+)_D([0-9.]+)_Q([0-9.]+)$"
    return F.struct(*[F.regexp_extract(name, pattern, i + 1).try_cast("double").alias(c) for i, c in enumerate("ndq")])


def experiment_name(n: Column, d: Column, q: Column) -> Column:
    """The name that experiment_parts reads, such as N0.07_D0010_Q0.5."""
    return F.format_string("N%.2f_D%04d_Q%.1f", n, d, q)


def power_law_loss(n: Column, d: Column, e: float = 1.69, a: float = 0.354, alpha: float = 0.34, b: float = 1.237, beta: float = 0.28) -> Column:
    """Loss of n parameters and d tokens (both in units of 1e9); null where one is not above zero."""
    return F.when((n > 0) & (d > 0), e + a * F.pow(n, F.lit(-alpha)) + b * F.pow(d, F.lit(-beta)))


def run_time(stamp: Column) -> Column:
    """A timestamp_ntz from a run stamp such as 2024-06-17T17-37-25.144953 or 2024_06_17T17_37_25.144953; null for other forms."""
    form = r"^(\d{4})[-_](\d\d)[-_](\d\d)T(\d\d)[-_](\d\d)[-_](\d\d(?:\.\d{1,6})?)$"
    return F.when(stamp.rlike(form), F.regexp_replace(stamp, form, "$1-$2-$3 $4:$5:$6")).try_cast("timestamp_ntz")
