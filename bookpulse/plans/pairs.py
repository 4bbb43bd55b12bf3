"""Long form of column pairs: one row per (keys, left, right) with both values, instead of a join per pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_pairs(df: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]], left: str, right: str, carry: Sequence[str] = ()) -> DataFrame:
    """keys, carry, ``left`` and ``right`` (names), x and y (values); rows where either value is NULL are left out."""
    cells = [F.struct(F.lit(a).alias(left), F.lit(b).alias(right), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs]
    return df.select(*keys, *carry, F.inline(F.array(*cells))).where("x is not null and y is not null")


def grid(df: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]], left: str, right: str) -> DataFrame:
    """Every pair at every distinct key."""
    cells = [F.struct(F.lit(a).alias(left), F.lit(b).alias(right)) for a, b in pairs]
    return df.select(*keys).distinct().select(*keys, F.inline(F.array(*cells)))


def pair_frame(df: DataFrame, pairs: Sequence[tuple[str, str]], left: str, right: str) -> DataFrame:
    """The pairs themselves: bounded by the number of columns."""
    return df.sparkSession.createDataFrame(list(pairs), f"{left} string, {right} string")


def wide(df: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]], fields: Sequence[str], left: str, right: str) -> DataFrame:
    """One row per key, a column {field}__{left}__{right} for each pair and field; the pairs are declared, not found."""
    here = lambda a, b: (F.col(left) == a) & (F.col(right) == b)
    cells: list[Column] = [F.max(F.when(here(a, b), F.col(f))).alias(f"{f}__{a}__{b}") for a, b in pairs for f in fields]
    return df.groupBy(*keys).agg(*cells)


def unpivot(df: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]], fields: Sequence[str], left: str, right: str) -> DataFrame:
    """The inverse of ``wide``."""
    cells = [F.struct(F.lit(a).alias(left), F.lit(b).alias(right), *(F.col(f"{f}__{a}__{b}").alias(f) for f in fields)) for a, b in pairs]
    return df.select(*keys, F.inline(F.array(*cells)))
