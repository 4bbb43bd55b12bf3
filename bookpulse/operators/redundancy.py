"""Redundancy of factors: correlations of values and of ICs, strength, and keep/drop recommendations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookpulse.functions import exprs as X
from bookpulse.functions import stats as S
from bookpulse.operators import gram, schema
from bookpulse.operators.evaluate import KEYS, LEAST, auction, counted, judged, valid_n
from bookpulse.plans import pairs as P

PAIR = ["factor_left", "factor_right"]
# Thresholds for absolute correlations.
HIGH, SAME_FAMILY_FACTOR, SAME_FAMILY_IC = 0.80, 0.65, 0.60
REASONS = ("below_min_cross_section", "both_constant", "left_factor_constant", "right_factor_constant", "missing_pair_values", "nan_factor_corr")


def factor_corr(df: DataFrame, factors: Sequence[str], keys: Sequence[str] = KEYS, least: int = LEAST, filter_auction: bool = True) -> DataFrame:
    """Rank correlation of each two factors at each key, long: pairs in the order of the list."""
    schema.factor_pairs(list(factors))  # two at least
    schema.need(df, [*keys, *factors])
    found = gram.rank_statistics(auction(df, filter_auction), list(factors), keys, *PAIR)
    out = judged(found, schema.cross_section(least), "left_factor", "right_factor", "factor_corr")
    return out.select(*keys, *PAIR, "factor_corr", "n_obs", F.col("x_n_unique").alias("left_factor_n_unique"), F.col("y_n_unique").alias("right_factor_n_unique"), "is_valid", "invalid_reason")


def factor_corr_summary(long: DataFrame) -> DataFrame:
    c = F.col("factor_corr")
    out = long.groupBy(*PAIR).agg(
        F.count("*").alias("groups_total"), F.count_if("is_valid").alias("groups_valid"), *counted(REASONS), F.avg(c).alias("factor_corr_mean"), F.stddev_samp(c).alias("factor_corr_std"),
        F.count(c).alias("time_points"), F.avg(F.abs(c)).alias("factor_corr_abs_mean"), valid_n().alias("avg_cross_section"),
    )
    return out.withColumns({"valid_ratio": F.col("groups_valid") / F.col("groups_total"), "groups_invalid": F.col("groups_total") - F.col("groups_valid")})


def ic_corr(ic: DataFrame, factors: Sequence[str], labels: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Pearson of two factors' IC series over their common times, per label; a row even without any."""
    pairs = schema.factor_pairs(list(factors))
    wide = ic.groupBy(*keys, "label").agg(*[F.max(F.when(F.col("factor") == f, F.col("rank_ic"))).alias(f) for f in factors])
    found = P.long_pairs(wide, [*keys, "label"], pairs, *PAIR).groupBy(*PAIR, "label").agg(F.count("*").alias("overlap_time_points"), S.correlation("x", "y").alias("_c"))
    all_rows = ic.sparkSession.createDataFrame([(a, b, y) for a, b in pairs for y in labels], "factor_left string, factor_right string, label string")
    out = all_rows.join(found, [*PAIR, "label"], "left").withColumn("overlap_time_points", F.coalesce("overlap_time_points", F.lit(0).cast("long")))
    c = F.when((F.col("overlap_time_points") > 1) & S.finite(F.col("_c")), F.col("_c"))
    return out.select(*PAIR, "label", "overlap_time_points", c.alias("ic_corr"), F.abs(c).alias("ic_corr_abs"))


def strength(summary: DataFrame) -> DataFrame:
    """Per factor, over labels: mean and largest absolute mean IC, mean valid ratio."""
    ic = F.abs("rank_ic_mean")
    return summary.groupBy("factor").agg(F.avg(ic).alias("avg_abs_rank_ic_mean"), F.max(ic).alias("max_abs_rank_ic_mean"), F.avg("valid_ratio").alias("avg_valid_ratio"))


def ic_rollup(ic_summary: DataFrame) -> DataFrame:
    return ic_summary.groupBy(*PAIR).agg(
        F.avg("ic_corr").alias("ic_corr_mean"), F.avg("ic_corr_abs").alias("ic_corr_abs_mean"), F.max("ic_corr_abs").alias("ic_corr_abs_max"),
        F.min("overlap_time_points").alias("min_overlap_time_points"), F.max("overlap_time_points").alias("max_overlap_time_points"),
    )


def recommend(corr_summary: DataFrame, ic_summary: DataFrame, ic_means: DataFrame) -> DataFrame:
    """Which factor of each pair to keep. A NULL likely_redundant (no IC overlap) falls through to a choice, as a CASE does."""
    power = strength(ic_means)
    sided = lambda s: power.select(F.col("factor").alias(f"factor_{s}"), *(F.col(c).alias(f"{s}_{c}") for c in power.columns[1:]))
    rows = corr_summary.join(ic_rollup(ic_summary), PAIR, "left").join(sided("left"), "factor_left", "left").join(sided("right"), "factor_right", "left")
    fc, ic = F.col("factor_corr_abs_mean"), F.col("ic_corr_abs_mean")
    rows = rows.withColumns({f"factor_family_{s}": X.family(F.col(f"factor_{s}")) for s in ("left", "right")} | {"high_factor_corr": fc >= HIGH, "high_ic_corr": ic >= HIGH})
    rows = rows.withColumn("same_family", F.col("factor_family_left") == F.col("factor_family_right"))
    both_high = F.col("high_factor_corr") & F.col("high_ic_corr")
    rows = rows.withColumn("likely_redundant", both_high | (F.col("same_family") & (fc >= SAME_FAMILY_FACTOR) & (ic >= SAME_FAMILY_IC)))
    # The stronger factor stays: by mean, then largest absolute IC, then valid ratio; the left one on a tie.
    prefer = F.when(F.col("left_avg_valid_ratio") >= F.col("right_avg_valid_ratio"), F.col("factor_left")).otherwise(F.col("factor_right"))
    for c in ("max_abs_rank_ic_mean", "avg_abs_rank_ic_mean"):
        a, b = F.col(f"left_{c}"), F.col(f"right_{c}")
        prefer = F.when(a > b, F.col("factor_left")).when(a < b, F.col("factor_right")).otherwise(prefer)
    distinct = ~F.col("likely_redundant")
    rows = rows.withColumn("recommended_keep", F.when(distinct, "keep_both").otherwise(prefer))
    dropped = F.when(F.col("recommended_keep") == F.col("factor_left"), F.col("factor_right")).otherwise(F.col("factor_left"))
    kept_why = F.when(F.col("same_family"), "same_family_but_distinct_in_current_sample").otherwise("retain_both")
    dropped_why = F.when(both_high, "high_factor_and_ic_correlation").otherwise("same_family_with_material_correlation")
    return rows.withColumns({"recommended_drop": F.when(F.col("recommended_keep") != "keep_both", dropped), "reason": F.when(distinct, kept_why).otherwise(dropped_why)})
