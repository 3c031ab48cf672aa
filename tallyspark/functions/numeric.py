"""Numeric expressions.  Nulls are nulls (never NaN), division by zero is null, literals are doubles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def safe_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def number(x: Column) -> Column:
    """A double, null for text that is none and for NaN."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d), d)


def share(condition: Column) -> Column:
    """The part of all rows with the condition."""
    return F.avg(condition.cast("double"))


def ci95(x: Column) -> Column:
    """Half the width of the 95 % interval of a mean; null for fewer than two values."""
    return F.lit(1.96) * F.stddev_samp(x) / F.sqrt(F.nullif(F.count(x), F.lit(0)).cast("double"))


def of_successes(agg, x: str) -> Column:
    """`agg` over the rows with `success`: one pass instead of a filtered aggregate and a join."""
    return agg(F.when(F.col("success"), F.col(x)))


def with_bounds(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`df` with `lo_x` and `hi_x` of each expression over the whole table, by way of one row of aggregates."""
    aggs = [f(c).alias(f"{k}_{n}") for n, c in columns.items() for k, f in (("lo", F.min), ("hi", F.max))]
    return df.crossJoin(F.broadcast(df.agg(*aggs)))


def scaled(x: Column, lo: Column, hi: Column, invert: bool = False) -> Column:
    """Min-max to [0, 1]: nulls are 0, a constant is 1, without any value 0; `invert` is applied last, also to these."""
    out = F.when(lo.isNull(), 0.0).when(lo == hi, 1.0).otherwise(F.coalesce((x - lo) / (hi - lo), F.lit(0.0)))
    return 1.0 - out if invert else out


def scaled_from_zero(x: Column, lo: Column, hi: Column, invert: bool = False) -> Column:
    """Min-max of values whose nulls count as 0, bounds likewise; a constant is 0."""
    out = F.when(lo == hi, 0.0).otherwise((F.coalesce(x, F.lit(0.0)) - lo) / (hi - lo))
    return 1.0 - out if invert else out


def average_rank(by: Sequence[str], x: str) -> Column:
    """Ranks within `by`, ties share their mean rank."""
    ties = F.count("*").over(Window.partitionBy(*by, x))
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (ties - 1) / F.lit(2.0)


def correlation(x: str, y: str) -> Column:
    """Pearson's; null for fewer than three rows or without variance."""
    r = F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
    return F.when(F.count("*") >= 3, r)


def spearman(df: DataFrame, by: Sequence[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Rank correlations of `pairs` (output: columns) within `by`; ranks are taken inside each group."""
    columns = sorted({c for p in pairs.values() for c in p})
    ranked = df.select(*by, *[average_rank(by, c).alias(c) for c in columns])
    return ranked.groupBy(*by).agg(*[correlation(*p).alias(n) for n, p in pairs.items()], F.count("*").alias("n"))


def quadratic_kappa(a: str, b: str) -> Column:
    """Weighted kappa of paired scores from moments: the expected disagreement of all pairs of marginals is
    E[a2] + E[b2] - 2 E[a] E[b].  Null for fewer than two pairs or without expected disagreement."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    expected = F.avg(x * x) + F.avg(y * y) - 2.0 * F.avg(x) * F.avg(y)
    return F.when(F.count("*") >= 2, 1.0 - F.try_divide(F.avg((x - y) * (x - y)), F.nullif(expected, F.lit(0.0))))


def rounded(df: DataFrame, digits: int = 3, half_even: bool = True) -> DataFrame:
    """All double columns rounded; half to even, as in the published tables."""
    f = F.bround if half_even else F.round
    return df.select(*[(f(c, digits) + 0.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
