"""Stages of the research pipeline, each from Parquet to Parquet; done ones are left alone unless forced."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame, SparkSession

from bookpulse.operators import diagnose as D
from bookpulse.operators import evaluate as E
from bookpulse.operators import factors as B
from bookpulse.operators import figures as V
from bookpulse.operators import groups as G
from bookpulse.operators import labels as L
from bookpulse.operators import redundancy as R
from bookpulse.operators import schema
from bookpulse.sources.tables import materialize, read_many, stage, write_parquet


def _paths(root: str, *names: str) -> dict[str, str]:
    return {n: f"{root}/{n}" for n in names}


def factors(spark: SparkSession, snapshots: str, out: str, trades: str | None = None, window_ms: int = 3000, force: bool = False, **levels) -> dict[str, str]:
    def build(at: dict[str, str]) -> dict[str, DataFrame]:
        frame = read_many(spark, snapshots)
        found = B.book_factors(frame, **levels)
        if trades:
            t = read_many(spark, trades)
            if lost := B.unpaired(frame, t).limit(5).collect():
                raise FileNotFoundError(f"no trades for {[tuple(r) for r in lost]}")
            found = B.with_trade_imbalance(found, B.trade_imbalance(t, window_ms))
        return {"factors": found}

    return stage(spark, {"factors": out}, build, force, [snapshots, *([trades] if trades else [])], ["factors", window_ms, levels])


def labels(spark: SparkSession, source: str, out: str, horizons_ms: Sequence[int] = (3000, 30000), price: str = "mid_price_1", force: bool = False) -> dict[str, str]:
    return stage(spark, {"labels": out}, lambda at: {"labels": L.forward_returns(read_many(spark, source), horizons_ms, price)}, force, [source], ["labels", list(horizons_ms), price])


def panel(spark: SparkSession, source: str, out: str, factor_columns=None, label_columns=None, force: bool = False) -> dict[str, str]:
    return stage(spark, {"panel": out}, lambda at: {"panel": L.panel(read_many(spark, source), factor_columns, label_columns)}, force, [source], ["panel", factor_columns, label_columns])


def evaluation(spark: SparkSession, source: str, root: str, factor_columns=None, label_columns=None, least: int = E.LEAST, sweep: Sequence[int] | None = None, filter_auction: bool = True, force: bool = False) -> dict[str, str]:
    """The time series is written first; its summaries read it back."""
    outputs = _paths(root, "rank_ic_timeseries", "rank_ic_summary", "rank_ic_monthly_summary", *(["rank_ic_min_cross_section_scan"] if sweep else []))

    def build(at: dict[str, str]) -> dict[str, DataFrame]:
        p = read_many(spark, source)
        f, y = schema.selections(p, factor_columns, label_columns, E.KEYS)
        pairs = list(product(f, y))
        write_parquet(E.rank_ic_wide(E.rank_ic(p, f, y, least=least, filter_auction=filter_auction), pairs), at["rank_ic_timeseries"], sort_by=E.KEYS)
        long = E.rank_ic_long(spark.read.parquet(at["rank_ic_timeseries"]))
        found = materialize(E.cube(long, "pair", "month"))
        made = {"rank_ic_summary": E.summarised(E.level(found, "pair"), pairs), "rank_ic_monthly_summary": E.summarised(E.level(found, "month"))}
        return made | ({"rank_ic_min_cross_section_scan": E.sweep(p, f, y, sweep, filter_auction=filter_auction)} if sweep else {})

    return stage(spark, outputs, build, force, [source], ["evaluation", factor_columns, label_columns, least, sweep, filter_auction])


def diagnostics(spark: SparkSession, panel_path: str, timeseries: str, root: str, force: bool = False) -> dict[str, str]:
    def build(at: dict[str, str]) -> dict[str, DataFrame]:
        p, long = read_many(spark, panel_path), E.rank_ic_long(spark.read.parquet(timeseries))
        found = materialize(E.cube(long, "pair", "event_time"))
        return {"column_coverage": D.coverage(p), "symbol_coverage": D.symbol_coverage(p), "pair_reason_summary": D.reasons(E.level(found, "pair")), "event_time_reason_summary": D.reasons(E.level(found, "event_time"))}

    return stage(spark, _paths(root, "column_coverage", "symbol_coverage", "pair_reason_summary", "event_time_reason_summary"), build, force, [panel_path, timeseries], ["diagnostics"])


def robustness(spark: SparkSession, timeseries: str, root: str, force: bool = False) -> dict[str, str]:
    def build(at: dict[str, str]) -> dict[str, DataFrame]:
        long = E.rank_ic_long(spark.read.parquet(timeseries))
        found = materialize(E.cube(long, "session", "month_session"))
        segments = D.sessions(E.level(found, "month_session"))
        return {"session_summary": D.sessions(E.level(found, "session")), "month_session_summary": segments, "stability_summary": D.stability(segments)}

    return stage(spark, _paths(root, "session_summary", "month_session_summary", "stability_summary"), build, force, [timeseries], ["robustness"])


def grouping(spark: SparkSession, panel_path: str, root: str, factor_columns=None, label_columns=None, least: int = E.LEAST, groups: int = 5, force: bool = False) -> dict[str, str]:
    outputs = _paths(root, "group_return_timeseries", "group_return_summary", "group_monotonicity_summary")

    def build(at: dict[str, str]) -> dict[str, DataFrame]:
        rows = G.grouped(read_many(spark, panel_path), factor_columns, label_columns, least=least, groups=groups)
        write_parquet(G.returns(rows, least=least, groups=groups), at["group_return_timeseries"])
        found = spark.read.parquet(at["group_return_timeseries"])
        return {"group_return_summary": G.summary(found), "group_monotonicity_summary": G.monotonicity(found)}

    return stage(spark, outputs, build, force, [panel_path], ["grouping", factor_columns, label_columns, least, groups])


def redundancy(spark: SparkSession, panel_path: str, timeseries: str, summary: str, root: str, factor_columns=None, label_columns=None, least: int = E.LEAST, force: bool = False) -> dict[str, str]:
    outputs = _paths(root, "factor_corr_timeseries", "factor_corr_summary", "ic_corr_summary", "redundancy_recommendation")

    def build(at: dict[str, str]) -> dict[str, DataFrame]:
        p = read_many(spark, panel_path)
        f, y = schema.selections(p, factor_columns, label_columns, E.KEYS)
        write_parquet(R.factor_corr(p, f, least=least), at["factor_corr_timeseries"])
        write_parquet(R.factor_corr_summary(spark.read.parquet(at["factor_corr_timeseries"])), at["factor_corr_summary"])
        write_parquet(R.ic_corr(E.rank_ic_long(spark.read.parquet(timeseries)), f, y), at["ic_corr_summary"])
        read = lambda n: spark.read.parquet(at[n])
        return {"redundancy_recommendation": R.recommend(read("factor_corr_summary"), read("ic_corr_summary"), spark.read.parquet(summary))}

    return stage(spark, outputs, build, force, [panel_path, timeseries, summary], ["redundancy", factor_columns, label_columns, least])


def figures(spark: SparkSession, reports: str, root: str, plots: bool = False, core: Sequence[str] = V.CORE, supplementary: Sequence[str] = V.SUPPLEMENTARY) -> dict[str, str]:
    """Figure data of reports below one root (eval, diagnostics, grouping, redundancy), and plots if asked for. The shortest horizon is the first label."""
    read = lambda n: spark.read.parquet(f"{reports}/{n}")
    summary = read("eval/rank_ic_summary")
    found = [r[0] for r in summary.select("label").distinct().collect()]  # one row a horizon
    y = sorted(found, key=lambda n: (int("".join(filter(str.isdigit, n)) or 0), n))
    frames = V.bundle(summary, read("grouping/group_return_summary"), read("grouping/group_monotonicity_summary"), read("redundancy/redundancy_recommendation"), read("diagnostics/column_coverage"), y, core, supplementary)
    out = {n: write_parquet(df, f"{root}/{n}") for n, df in frames.items()}
    if plots:
        V.plot(frames, root)
    return out
