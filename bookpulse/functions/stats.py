"""Aggregates and windows that stay defined where Spark's own raise or differ: ranks, correlation, t statistics."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def average_rank(value: str, by: list[str]) -> Column:
    """Rank with ties at their mean; both windows share one exchange."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def dense(value: str, by: list[str]) -> Column:
    """Dense rank; its maximum is the number of distinct values, with no second exchange."""
    return F.dense_rank().over(Window.partitionBy(*by).orderBy(value))


def correlation(x: str, y: str) -> Column:
    """Pearson, NULL where a side is constant (corr raises there under ANSI mode); at 12 digits, so that a sum of order noise is zero."""
    return quotient(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def quotient(n: Column, d: Column) -> Column:
    """n / d at 12 digits, NULL where d is 0."""
    return F.round(F.try_divide(n, d), 12)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def share_positive(c: Column) -> Column:
    """Mean of c > 0 over what isn't NULL."""
    return F.avg(F.when(c > 0, 1.0).when(c <= 0, 0.0))


def icir(mean: Column, std: Column) -> Column:
    return F.when(std > 0, mean / std)


def t_stat(mean: Column, std: Column, n: Column) -> Column:
    return F.when((std > 0) & (n > 1), mean / (std / F.sqrt(n)))


def rounded(df, digits: int = 6):
    """Every double column rounded: for comparisons between engines."""
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
