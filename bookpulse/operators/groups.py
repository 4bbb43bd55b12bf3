"""Quantile groups of a cross-section, their returns, and monotonicity."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookpulse.functions import exprs as X
from bookpulse.functions import stats as S
from bookpulse.operators import schema
from bookpulse.operators.evaluate import KEYS, LEAST, auction
from bookpulse.plans import pairs as P

PAIR = ["factor", "label"]


def grouped(df: DataFrame, factors=None, labels=None, keys: Sequence[str] = KEYS, least: int = LEAST, groups: int = 5, filter_auction: bool = True, tiebreak: Sequence[str] = ("symbol",)) -> DataFrame:
    """Each pair's rows with n, n_unique, ordinal rank (ties by ``tiebreak``) and group_id; small and constant groups are left out."""
    f, y = schema.selections(df, factors, labels, [*keys, *tiebreak])
    by, smallest = [*keys, *PAIR], schema.grouping_cross_section(least, groups)
    rows = P.long_pairs(auction(df, filter_auction), keys, list(product(f, y)), *PAIR, carry=tiebreak)
    whole = Window.partitionBy(*by)
    ranked = rows.withColumns({"n": F.count("*").over(whole), "_d": S.dense("x", by), "ordinal": F.row_number().over(whole.orderBy("x", *tiebreak))})
    ranked = ranked.withColumn("n_unique", F.max("_d").over(whole)).where((F.col("n") >= smallest) & (F.col("n_unique") > 1)).drop("_d")
    return ranked.withColumn("group_id", X.quantile_group(F.col("ordinal"), F.col("n"), groups))


def returns(rows: DataFrame, keys: Sequence[str] = KEYS, least: int = LEAST, groups: int = 5) -> DataFrame:
    """Mean label of each group at each key."""
    out = rows.groupBy(*keys, *PAIR, "group_id").agg(
        F.avg("y").alias("group_mean_ret"), F.count("*").alias("group_n_obs"), F.max("n").alias("cross_section_n_obs"), F.max("n_unique").cast("long").alias("factor_n_unique")
    )
    return out.withColumns({"num_groups": F.lit(groups), "min_group_cross_section": F.lit(schema.grouping_cross_section(least, groups))})


def summary(found: DataFrame) -> DataFrame:
    out = found.groupBy(*PAIR, "group_id").agg(
        F.avg("group_mean_ret").alias("mean_ret"), F.stddev_samp("group_mean_ret").alias("std_ret"), F.count("group_mean_ret").alias("time_points"),
        S.share_positive(F.col("group_mean_ret")).alias("positive_ratio"), F.avg("group_n_obs").alias("avg_group_size"), F.avg("cross_section_n_obs").alias("avg_cross_section"),
        F.max("num_groups").alias("num_groups"), F.max("min_group_cross_section").alias("min_group_cross_section"),
    )
    return out.withColumn("t_stat", S.t_stat(F.col("mean_ret"), F.col("std_ret"), F.col("time_points")))


def spread(found: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Top minus bottom group where both are there; one aggregation instead of a self-join."""
    at = lambda k: F.max(F.when(F.col("group_id") == k, F.col("group_mean_ret")))
    out = found.groupBy(*keys, *PAIR).agg(at(1).alias("bottom_ret"), at(F.col("num_groups")).alias("top_ret"))
    return out.where("bottom_ret is not null and top_ret is not null").withColumn("top_minus_bottom", F.col("top_ret") - F.col("bottom_ret"))


def monotonicity(found: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Order of the groups' mean returns, and statistics of the spread; a single group is monotonic."""
    means = summary(found)
    w = Window.partitionBy(*PAIR)
    steps = means.withColumns({"_step": F.col("mean_ret") - F.lag("mean_ret").over(w.orderBy("group_id")), "_rx": S.average_rank("group_id", PAIR), "_ry": S.average_rank("mean_ret", PAIR)})
    order = steps.groupBy(*PAIR).agg(
        F.count("*").alias("groups_observed"), F.max("num_groups").alias("num_groups"),
        F.coalesce(F.bool_and(F.col("_step") >= 0), F.lit(True)).alias("is_monotonic_non_decreasing"), S.correlation("_rx", "_ry").alias("spearman_group_ret_corr"),
    )
    d = F.col("top_minus_bottom")
    wide = spread(found, keys).groupBy(*PAIR).agg(F.avg(d).alias("top_minus_bottom_mean"), F.stddev_samp(d).alias("top_minus_bottom_std"), F.count(d).alias("spread_time_points"), S.share_positive(d).alias("positive_spread_ratio"))
    mean = F.col("top_minus_bottom_mean")
    return order.join(wide, PAIR, "left").withColumns(
        {
            "top_bottom_spread_sign": F.when(mean > 0, "positive").when(mean < 0, "negative").when(mean == 0, "flat"),
            "top_minus_bottom_t_stat": S.t_stat(mean, F.col("top_minus_bottom_std"), F.col("spread_time_points")),
            "has_complete_group_grid": F.col("groups_observed") == F.col("num_groups"),
        }
    )
