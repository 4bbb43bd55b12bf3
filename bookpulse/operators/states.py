"""Summaries from states that can be merged: a store of one small table a day, so that an added day is computed alone.

A state holds counts, and of a value its number, mean, sum of squared deviations, least, greatest and how many are
positive. States of any days merge into the figures of all of them by one aggregation of a few rows a day. Distinct
values have no such state of fixed size: the store keeps each day's distinct values of a column, and the merge counts them.

A day's states replace those that the store has of it; a day is there once its last table is written, so a run that broke
off is made good by running it again. Rows need a trading day: those without one belong to no day and raise an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookpulse.functions import exprs as X
from bookpulse.functions import stats as S
from bookpulse.operators import diagnose as D
from bookpulse.operators import evaluate as E
from bookpulse.operators import groups as G
from bookpulse.operators import schema
from bookpulse.sources.tables import file_system, materialize

DAY, PAIR = "trading_day", ["factor", "label"]
#: Tables of a store; the last one tells which days are there.
TABLES = ("ic", "returns", "values", "columns")


def moments(value: str) -> list[Column]:
    """State of a value: n, mean, m2 (squared deviations), low, high, positive."""
    v = F.col(value)
    return [F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"), F.min(v).alias("low"), F.max(v).alias("high"), F.count_if(v > 0).alias("positive")]


def merged_moments(mean: str, std: str, n: str | None = None, positive: str | None = None, low: str | None = None, high: str | None = None) -> list[Column]:
    """Figures of merged states under the given names; a value that never changes has exactly itself as mean, and no spread."""
    size, total = F.sum("n"), F.sum(F.col("n") * F.col("mean"))
    same = F.min("low") == F.max("high")
    spread = F.sum("m2") + F.sum(F.col("n") * F.col("mean") * F.col("mean")) - total * F.try_divide(total, size)
    out = [
        F.when(same, F.min("low")).otherwise(F.try_divide(total, size)).alias(mean),
        F.when(size > 1, F.when(same, 0.0).otherwise(F.sqrt(F.greatest(spread, F.lit(0.0)) / (size - 1)))).alias(std),
    ]
    for name, c in ((n, size), (positive, F.try_divide(F.sum("positive"), size)), (low, F.min("low")), (high, F.max("high"))):
        out += [c.alias(name)] if name else []
    return out


def ic_states(long: DataFrame) -> DataFrame:
    """Of an IC series: a row for each day, session and pair."""
    return long.withColumn("session", X.session()).groupBy(DAY, "session", *PAIR).agg(
        F.count("*").alias("groups_total"), F.count_if("is_valid").alias("groups_valid"), *E.counted(), F.sum(F.when(F.col("is_valid"), F.col("n_obs"))).alias("obs"),
        E.valid_n(F.min).alias("least_obs"), E.valid_n(F.max).alias("most_obs"), *moments("rank_ic"),
    )


def return_states(found: DataFrame) -> DataFrame:
    """Of group returns: a row for each day, pair and group."""
    return found.groupBy(DAY, *PAIR, "group_id").agg(
        F.count("*").alias("times"), F.sum("group_n_obs").alias("rows"), F.sum("cross_section_n_obs").alias("cross_rows"), F.max("num_groups").alias("num_groups"),
        F.max("min_group_cross_section").alias("min_group_cross_section"), *moments("group_mean_ret"),
    )


def days(spark: SparkSession, store: str) -> set[int]:
    """The days that a store has whole."""
    fs, path = file_system(spark, f"{store}/{TABLES[-1]}")
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    return {int(n.partition("=")[2]) for n in names if n.startswith(f"{DAY}=")}


def update(spark: SparkSession, store: str, panel: DataFrame, factors: Sequence[str] | None = None, labels: Sequence[str] | None = None, least: int = E.LEAST, groups: int = 5, again: Iterable[int] = ()) -> list[int]:
    """Add the panel's days that the store doesn't have, and those to be made ``again``; gives them. Other days aren't read."""
    f, y = schema.selections(panel, factors, labels, [DAY, "event_time", "symbol"])
    have = days(spark, store)
    found = [r[0] for r in panel.select(DAY).distinct().collect()]  # a row a day
    if None in found:
        raise ValueError(f"rows without a {DAY}")
    new = sorted((set(found) - have) | (set(found) & set(again)))
    if not new:
        return new
    rows = panel.where(F.col(DAY).isin(new))
    cells = materialize(D.cells(rows, [*f, *y], [DAY]))
    by = [DAY, "column", "column_type"]
    tables = {
        "ic": ic_states(E.rank_ic(rows, f, y, least=least)),
        "returns": return_states(G.returns(G.grouped(rows, f, y, least=least, groups=groups), least=least, groups=groups)),
        "values": cells.where("v is not null").select(DAY, "column", "v").distinct(),
        "columns": cells.groupBy(*by).agg(F.count("*").alias("total_rows"), F.count_if(F.col("v").isNull()).alias("null_rows"), *moments("v")),
    }
    for name in TABLES:
        tables[name].write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(DAY).parquet(f"{store}/{name}")
    return new


def _table(spark: SparkSession, store: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{store}/{name}")


def ic_summary(spark: SparkSession, store: str, by: Sequence[str] = (), pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """As ``evaluate.summary``, of all days of a store; ``by`` may name month and session."""
    states = _table(spark, store, "ic").withColumn("month", X.month_of())
    merged = states.groupBy(*by, *PAIR).agg(
        F.sum("groups_total").alias("groups_total"), F.sum("groups_valid").alias("groups_valid"), (F.sum("groups_total") - F.sum("groups_valid")).alias("groups_invalid"),
        *(F.sum(f"groups_{r}").alias(f"groups_{r}") for r in E.REASONS), *merged_moments("rank_ic_mean", "rank_ic_std", n="time_points", positive="positive_ratio"),
        F.try_divide(F.sum("obs"), F.sum("groups_valid")).alias("avg_n_obs"), F.min("least_obs").alias("min_n_obs"), F.max("most_obs").alias("max_n_obs"),
    )
    return E.summarised(merged, None if by else pairs)


def group_summary(spark: SparkSession, store: str) -> DataFrame:
    """As ``groups.summary``, of all days of a store."""
    out = _table(spark, store, "returns").groupBy(*PAIR, "group_id").agg(
        *merged_moments("mean_ret", "std_ret", n="time_points", positive="positive_ratio"), (F.sum("rows") / F.sum("times")).alias("avg_group_size"),
        (F.sum("cross_rows") / F.sum("times")).alias("avg_cross_section"), F.max("num_groups").alias("num_groups"), F.max("min_group_cross_section").alias("min_group_cross_section"),
    )
    return out.withColumn("t_stat", S.t_stat(F.col("mean_ret"), F.col("std_ret"), F.col("time_points")))


def coverage(spark: SparkSession, store: str) -> DataFrame:
    """As ``diagnose.coverage`` without keys, of all days of a store."""
    distinct = _table(spark, store, "values").groupBy("column").agg(F.countDistinct("v").alias("_d"))
    out = _table(spark, store, "columns").groupBy("column", "column_type").agg(
        F.sum("total_rows").alias("total_rows"), F.sum("n").alias("non_null_rows"), F.sum("null_rows").alias("null_rows"), *merged_moments("value_mean", "value_std", low="value_min", high="value_max"),
    )
    unique = (F.coalesce("_d", F.lit(0)) + (F.col("null_rows") > 0).cast("int")).cast("long")
    return out.join(distinct, "column", "left").withColumns({"n_unique": unique, "coverage_ratio": F.col("non_null_rows") / F.col("total_rows")}).drop("_d")
