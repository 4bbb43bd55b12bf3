"""Coverage of columns and symbols, reasons for invalid groups, and robustness across sessions and months."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookpulse.functions import stats as S
from bookpulse.operators import schema
from bookpulse.operators.evaluate import REASONS, cube, level

PAIR = ["factor", "label"]


def cells(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """keys, column, column_type and v: a row for each row and column."""
    kind = lambda c: F.lit("label" if c.startswith(schema.LABEL_PREFIX) else "factor")
    return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), kind(c).alias("column_type"), F.col(c).cast("double").alias("v")) for c in columns])))


def coverage(df: DataFrame, factors=None, labels=None, keys: Sequence[str] = (), extremes: bool = True) -> DataFrame:
    """Rows, NULLs, distinct values (NULL is one), mean, std and extremes of each column: one pass over all columns."""
    f, y = schema.selections(df, factors, labels, keys)
    by = [*keys, "column", "column_type"]
    out = cells(df, [*f, *y], keys).groupBy(*by).agg(
        F.count("*").alias("total_rows"), F.count("v").alias("non_null_rows"), F.count_if(F.col("v").isNull()).alias("null_rows"),
        (F.countDistinct("v") + F.max(F.col("v").isNull().cast("int"))).cast("long").alias("n_unique"), F.avg("v").alias("value_mean"), F.stddev_samp("v").alias("value_std"),
        *([F.min("v").alias("value_min"), F.max("v").alias("value_max")] if extremes else []),
    )
    return out.withColumn("coverage_ratio", F.col("non_null_rows") / F.col("total_rows"))


def symbol_coverage(df: DataFrame, factors=None, labels=None) -> DataFrame:
    return coverage(df, factors, labels, [*(["source_month"] if "source_month" in df.columns else []), "symbol"], extremes=False)


def reasons(found: DataFrame) -> DataFrame:
    """A level of a cube (``evaluate.cube``) as a report of reasons: by pair, or by pair and time."""
    more = ["min_n_obs", "max_n_obs"] if "event_time" in found.columns else ["rank_ic_std"]
    keys = [c for c in ("factor", "label", "event_time") if c in found.columns]
    counts = [c for c in found.columns if c.startswith("groups_")]
    return found.select(*keys, *counts, "avg_n_obs", "rank_ic_mean", *more).withColumn("valid_ratio", F.col("groups_valid") / F.col("groups_total"))


def pair_reasons(long: DataFrame) -> DataFrame:
    return reasons(level(cube(long, "pair"), "pair"))


def event_time_reasons(long: DataFrame) -> DataFrame:
    return reasons(level(cube(long, "event_time"), "event_time"))


def sessions(found: DataFrame) -> DataFrame:
    """A level of a cube with sessions as a report of robustness."""
    out = found.drop(*(f"groups_{r}" for r in REASONS), "min_n_obs", "max_n_obs").withColumnRenamed("avg_n_obs", "avg_cross_section")
    mean, std = F.col("rank_ic_mean"), F.col("rank_ic_std")
    return out.withColumns({"valid_ratio": F.col("groups_valid") / F.col("groups_total"), "icir": S.icir(mean, std), "t_stat": S.t_stat(mean, std, F.col("time_points"))})


def session_summary(long: DataFrame, monthly: bool = False) -> DataFrame:
    """By session (and month), rows outside both sessions left out."""
    at = "month_session" if monthly else "session"
    return sessions(level(cube(long, at), at))


def stability(segments: DataFrame) -> DataFrame:
    """Spread of the month and session segments of each pair."""
    ic = F.col("rank_ic_mean")
    out = segments.groupBy(*PAIR).agg(
        F.countDistinct("month").alias("months_observed"), F.countDistinct("session").alias("sessions_observed"), F.avg(ic).alias("avg_segment_rank_ic"),
        F.min(ic).alias("min_segment_rank_ic"), F.max(ic).alias("max_segment_rank_ic"), S.share_positive(ic).alias("positive_segment_ratio"),
        F.avg("valid_ratio").alias("avg_segment_valid_ratio"), F.min("valid_ratio").alias("min_segment_valid_ratio"), F.min("time_points").alias("min_segment_time_points"),
    )
    return out.withColumn("segment_ic_range", F.col("max_segment_rank_ic") - F.col("min_segment_rank_ic"))
