"""Data of the four figures and of their bundle, and plots of them where matplotlib is there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The factors of the headline figures, and those shown beside them.
CORE = ("oir_1", "book_slope_5", "trade_imbalance_3s", "voi_1", "relative_spread_1")
SUPPLEMENTARY = ("oir_5", "ofi_1", "micro_price_1")
ALL = (*CORE, *SUPPLEMENTARY)


def _listed(df: DataFrame, factors: Sequence[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(f,) for f in factors], "factor string")


def _one(count: Column, value: Column, what: str, *of: str) -> Column:
    """The value where exactly one row was found; else the query fails."""
    wrong = F.raise_error(F.concat(F.coalesce(count, F.lit(0)).cast("string"), F.lit(f" rows of {what} for "), *(F.concat(F.col(c), F.lit(" ")) for c in of)))
    return F.when(count == 1, value).otherwise(wrong.cast("double"))


def rank_ic(summary: DataFrame, factors: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Mean IC of each factor, a column per label; a pair without exactly one row fails."""
    here = lambda y: F.col("label") == y
    found = summary.groupBy("factor").agg(*[F.max(F.when(here(y), F.col("rank_ic_mean"))).alias(y) for y in labels], *[F.count_if(here(y)).alias(f"n_{i}") for i, y in enumerate(labels)])
    rows = _listed(summary, factors).join(found, "factor", "left")
    return rows.select("factor", *[_one(F.col(f"n_{i}"), F.col(y), f"label {y}", "factor").alias(y) for i, y in enumerate(labels)])


def monotonicity(group_summary: DataFrame, factors: Sequence[str], label: str) -> DataFrame:
    """Mean return of each group in basis points."""
    rows = group_summary.where(F.col("factor").isin(*factors) & (F.col("label") == label))
    return rows.select("factor", "group_id", (F.col("mean_ret") * 1e4).alias("mean_ret_bps"))


def core_monotonicity(group_summary: DataFrame, monotonicity_summary: DataFrame, labels: Sequence[str], factors: Sequence[str] = CORE) -> DataFrame:
    """Mean return of each group of the core factors in basis points, per label, with the share of positive spreads at the first label."""
    found = monotonicity_summary.where(F.col("label") == labels[0]).groupBy("factor").agg(F.count("*").alias("n"), F.max("positive_spread_ratio").alias("v"))
    spread = _listed(group_summary, factors).join(found, "factor", "left").select("factor", _one(F.col("n"), F.col("v"), f"label {labels[0]}", "factor").alias("positive_spread_ratio"))
    rows = group_summary.where(F.col("label").isin(*labels)).select("factor", "label", "group_id", (F.col("mean_ret") * 1e4).alias("mean_ret_bps"))
    return spread.join(rows, "factor")


def redundancy_matrix(recommendation: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Symmetric matrix of the larger of both mean absolute correlations, ones on the diagonal: factor and a column per factor.

    Pairs are found in either order; one that is missing, or there twice, fails.
    """
    cell = F.greatest(F.coalesce("factor_corr_abs_mean", F.lit(0.0)), F.coalesce("ic_corr_abs_mean", F.lit(0.0)))
    half = recommendation.select(F.col("factor_left").alias("a"), F.col("factor_right").alias("b"), cell.alias("v"))
    ones = recommendation.sparkSession.createDataFrame([(f, f, 1.0) for f in factors], "a string, b string, v double")
    whole = half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "v")).unionByName(ones)
    here = lambda f: F.col("b") == f
    found = whole.groupBy(F.col("a").alias("factor")).agg(*[F.max(F.when(here(f), F.col("v"))).alias(f) for f in factors], *[F.count_if(here(f)).alias(f"n_{i}") for i, f in enumerate(factors)])
    rows = _listed(recommendation, factors).join(found, "factor", "left")
    return rows.select("factor", *[_one(F.col(f"n_{i}"), F.col(f), f"factor {f}", "factor").alias(f) for i, f in enumerate(factors)])


def coverage_validity(coverage: DataFrame, summary: DataFrame, label: str, factors: Sequence[str]) -> DataFrame:
    """Coverage of each factor beside the valid ratio of its groups; a factor without exactly one row of either fails."""
    valid = summary.where(F.col("label") == label).groupBy("factor").agg(F.count("*").alias("n"), F.max("valid_ratio").alias("v"))
    cover = coverage.groupBy(F.col("column").alias("factor")).agg(F.count("*").alias("m"), F.max("coverage_ratio").alias("c"))
    rows = _listed(summary, factors).join(cover, "factor", "left").join(valid, "factor", "left")
    return rows.select("factor", _one(F.col("m"), F.col("c"), "coverage", "factor").alias("coverage_ratio"), _one(F.col("n"), F.col("v"), f"label {label}", "factor").alias("valid_ratio"))


def bundle(summary: DataFrame, group_summary: DataFrame, monotonicity_summary: DataFrame, recommendation: DataFrame, coverage: DataFrame, labels: Sequence[str], core: Sequence[str] = CORE, supplementary: Sequence[str] = SUPPLEMENTARY) -> dict[str, DataFrame]:
    """The frames of all figures by name; the first label is the short horizon."""
    every = (*core, *supplementary)
    return {
        "core_factor_rank_ic": rank_ic(summary, core, labels),
        "core_factor_monotonicity": core_monotonicity(group_summary, monotonicity_summary, labels, core),
        "factor_redundancy_heatmap": redundancy_matrix(recommendation, every),
        "factor_coverage_validity": coverage_validity(coverage, summary, labels[0], every),
    }


def single_value(df: DataFrame, factor: str, label: str, value: str) -> float:
    """The value of exactly one row."""
    rows = df.where((F.col("factor") == factor) & (F.col("label") == label)).select(value).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{len(rows)} rows for {factor}, {label}")
    return rows[0][0]


def plot(frames: dict[str, DataFrame], folder: str) -> list[str]:
    """PNG and SVG of a bundle: bars of factors, lines of groups a factor, a heat map. Needs matplotlib; frames are report-sized."""
    try:
        import matplotlib.pyplot as plt
    except ImportError as e:
        raise RuntimeError("plots need matplotlib; the frames are there without it") from e
    out = []
    for name, df in frames.items():
        data = df.toPandas()
        if "group_id" in data:
            parts = list(data.groupby("factor"))
            figure, axes = plt.subplots(1, len(parts), figsize=(3.2 * len(parts), 3.6), sharey=True, squeeze=False)
            for axis, (factor, rows) in zip(axes[0], parts):
                for label, line in rows.sort_values("group_id").groupby("label"):
                    axis.plot(line["group_id"], line["mean_ret_bps"], marker="o", label=label)
                axis.set_title(f"{factor}, spread+ {rows['positive_spread_ratio'].iloc[0]:.2f}", fontsize=8)
            axes[0][0].set_ylabel("mean forward return (bps)")
            axes[0][0].legend(fontsize=7)
        elif set(data["factor"]) == set(data.columns[1:]):
            figure, axis = plt.subplots(figsize=(8, 7))
            values = data.set_index("factor").loc[list(data.columns[1:])]
            figure.colorbar(axis.imshow(values.to_numpy(float), vmin=0, vmax=1))
            axis.set_xticks(range(len(values)), values.columns, rotation=35, ha="right")
            axis.set_yticks(range(len(values)), values.index)
            for i, row in enumerate(values.to_numpy(float)):
                for j, v in enumerate(row):
                    axis.text(j, i, f"{v:.2f}", ha="center", va="center", fontsize=7)
        else:
            figure = data.set_index("factor").plot.bar(figsize=(10, 5)).get_figure()
        figure.suptitle(name.replace("_", " "))
        figure.tight_layout()
        for kind in ("png", "svg"):
            out.append(f"{folder}/{name}.{kind}")
            figure.savefig(out[-1], dpi=220)
        plt.close(figure)
    return out
