"""Cross-sectional rank correlations (IC): time series, reasons, summaries by period, minimum-size sweeps."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookpulse.functions import exprs as X
from bookpulse.functions import stats as S
from bookpulse.operators import schema
from bookpulse.plans import pairs as P

KEYS = ("trading_day", "event_time")
LEAST, SWEEP = 10, (8, 10, 15, 20)
REASONS = ("below_min_cross_section", "factor_constant", "label_constant", "both_constant", "missing_pair_values", "nan_rank_ic")


def rank_statistics(df: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str] = KEYS, left: str = "factor", right: str = "label") -> DataFrame:
    """keys, pair, n_obs, x_n_unique, y_n_unique, corr (Pearson of average ranks): one exchange for all pairs."""
    by = [*keys, left, right]
    rows = P.long_pairs(df, keys, pairs, left, right)
    ranked = rows.select(*by, S.average_rank("x", by).alias("rx"), S.average_rank("y", by).alias("ry"), S.dense("x", by).alias("dx"), S.dense("y", by).alias("dy"))
    return ranked.groupBy(*by).agg(
        F.count("*").alias("n_obs"), F.max("dx").cast("long").alias("x_n_unique"), F.max("dy").cast("long").alias("y_n_unique"), S.correlation("rx", "ry").alias("corr")
    )


def reason(least: Column | int, x: str, y: str, nan: str) -> Column:
    """Why a group is invalid, the first that holds; NULL for valid ones."""
    n, ux, uy = F.col("n_obs"), F.col("x_n_unique"), F.col("y_n_unique")
    return (
        F.when(n.isNull(), "missing_pair_values")
        .when(n < least, "below_min_cross_section")
        .when((ux <= 1) & (uy <= 1), "both_constant")
        .when(ux <= 1, f"{x}_constant")
        .when(uy <= 1, f"{y}_constant")
        .when(~F.coalesce(S.finite(F.col("corr")), F.lit(False)), nan)
    )


def judged(statistics: DataFrame, least: Column | int, x: str, y: str, value: str) -> DataFrame:
    """Add invalid_reason and is_valid; ``value`` is corr where valid."""
    found = statistics.withColumn("invalid_reason", reason(least, x, y, f"nan_{value}"))
    return found.withColumn("is_valid", F.col("invalid_reason").isNull()).withColumn(value, F.when(F.col("is_valid"), F.col("corr")))


def auction(df: DataFrame, wanted: bool = True) -> DataFrame:
    return df.where(X.in_windows()) if wanted else df


def complete_statistics(df: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str], left: str = "factor", right: str = "label") -> DataFrame:
    """Statistics of every pair at every key of the panel; those of absent groups are NULL."""
    by = [*keys, left, right]
    return P.grid(df, keys, pairs, left, right).join(rank_statistics(df, pairs, keys, left, right), by, "left")


def rank_ic(df: DataFrame, factors=None, labels=None, keys: Sequence[str] = KEYS, least: int = LEAST, filter_auction: bool = True) -> DataFrame:
    """The IC time series in long form: keys, factor, label, rank_ic, n_obs, factor_n_unique, label_n_unique, is_valid, invalid_reason."""
    f, y = schema.selections(df, factors, labels, keys)
    found = complete_statistics(auction(df, filter_auction), list(product(f, y)), keys)
    out = judged(found, schema.cross_section(least), "factor", "label", "rank_ic")
    return out.select(*keys, "factor", "label", "rank_ic", "n_obs", F.col("x_n_unique").alias("factor_n_unique"), F.col("y_n_unique").alias("label_n_unique"), "is_valid", "invalid_reason")


def rank_ic_wide(long: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str] = KEYS) -> DataFrame:
    return P.wide(long, keys, pairs, schema.PAIR_FIELDS, "factor", "label")


def rank_ic_long(wide: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    f, y = schema.pairs_of_timeseries(wide)
    return P.unpivot(wide, keys, list(product(f, y)), schema.PAIR_FIELDS, "factor", "label")


def counted(reasons: Sequence[str] = REASONS) -> list[Column]:
    return [F.count_if(F.col("invalid_reason") == r).alias(f"groups_{r}") for r in reasons]


def valid_n(what=F.avg) -> Column:
    return what(F.when(F.col("is_valid"), F.col("n_obs")))


def sums(ic: str = "rank_ic") -> list[Column]:
    """All that any summary of an IC series holds, as aggregates that are combined before the shuffle."""
    return [
        F.count("*").alias("groups_total"), F.count_if("is_valid").alias("groups_valid"), F.count_if(~F.col("is_valid")).alias("groups_invalid"), *counted(),
        F.avg(ic).alias("rank_ic_mean"), F.stddev_samp(ic).alias("rank_ic_std"), F.count(ic).alias("time_points"), S.share_positive(F.col(ic)).alias("positive_ratio"),
        valid_n().alias("avg_n_obs"), valid_n(F.min).alias("min_n_obs"), valid_n(F.max).alias("max_n_obs"),
    ]


#: Groupings of the summaries, besides factor and label.
LEVELS: dict[str, tuple[str, ...]] = {"pair": (), "month": ("month",), "event_time": ("event_time",), "session": ("session",), "month_session": ("month", "session")}
PAIR = ["factor", "label"]


def cube(long: DataFrame, *levels: str) -> DataFrame:
    """``sums`` of the IC series at each of the levels (all of LEVELS, if none is named): one scan, one exchange.

    Columns: level, factor, label, month, session and event_time (NULL where they aren't of the level), and the sums. Rows
    outside both sessions have none at the levels of sessions.
    """
    chosen = levels or tuple(LEVELS)
    keys = [*PAIR, "month", "session", "event_time"]
    rows = long.withColumns({"month": X.month_of(), "session": X.session()})
    found = rows.groupingSets([[F.col(c) for c in (*PAIR, *LEVELS[n])] for n in chosen], *keys).agg(F.grouping_id().alias("_id"), *sums())
    number = {n: sum(1 << (len(keys) - 1 - i) for i, c in enumerate(keys) if c not in (*PAIR, *LEVELS[n])) for n in chosen}
    name = F.create_map(*(F.lit(x) for n, k in number.items() for x in (k, n)))
    return found.where(~F.col("session").eqNullSafe("off_session")).select(name[F.col("_id").cast("int")].alias("level"), *(c for c in found.columns if c != "_id"))


def level(found: DataFrame, name: str) -> DataFrame:
    """One level of a cube, with its own keys only."""
    others = [c for c in ("month", "session", "event_time") if c not in LEVELS[name]]
    return found.where(F.col("level") == name).drop("level", *others)


def summarised(out: DataFrame, pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Sums with ratios, icir and t_stat; with ``pairs`` each of them has a row even if the series is empty."""
    out = out.withColumnRenamed("avg_n_obs", "avg_cross_section").drop("min_n_obs", "max_n_obs")
    if pairs is not None:
        zero = [c for c, t in out.dtypes if t == "bigint"]
        out = P.pair_frame(out, pairs, *PAIR).join(out, PAIR, "left").fillna(0, zero)
    mean, std = F.col("rank_ic_mean"), F.col("rank_ic_std")
    return out.withColumns({"valid_ratio": F.try_divide(F.col("groups_valid"), F.col("groups_total")), "icir": S.icir(mean, std), "t_stat": S.t_stat(mean, std, F.col("time_points"))})


def summary(long: DataFrame, by: Sequence[str] = (), pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Per factor, label and ``by``: counts by reason, mean, std, share positive, valid ratio, icir, t_stat.

    With ``pairs`` each of them has a row even if the time series is empty.
    """
    return summarised(long.groupBy(*by, *PAIR).agg(*sums()), None if by else pairs)


def monthly(long: DataFrame) -> DataFrame:
    return summarised(level(cube(long, "month"), "month"))


def sweep(df: DataFrame, factors=None, labels=None, sizes: Sequence[int] = SWEEP, keys: Sequence[str] = KEYS, filter_auction: bool = True) -> DataFrame:
    """The summary for each minimum size; ranks are computed once and judged again for each."""
    f, y = schema.selections(df, factors, labels, keys)
    found = complete_statistics(auction(df, filter_auction), list(product(f, y)), keys)
    each = found.withColumn("min_cross_section", F.explode(F.array(*map(F.lit, schema.cross_sections(sizes)))))
    return summary(judged(each, F.col("min_cross_section"), "factor", "label", "rank_ic"), ["min_cross_section"])
