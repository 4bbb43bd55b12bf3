"""Queries over the sources, the schema checks and the stages: raw CSV in, typed tables and written reports out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookpulse.functions import stats as S
from bookpulse.operators import evaluate as E
from bookpulse.operators import factors as B
from bookpulse.operators import schema
from bookpulse.plans import catalogue, stages
from bookpulse.plans.catalogue import FACTORS, HORIZONS, KEY, LABELS, WINDOW_MS
from bookpulse.sources import events, files, ingest
from bookpulse.sources.tables import exists, read_many, shared_dir, stage, version

MONTH = "202401"


# ---- raw files ------------------------------------------------------------------------------------------------


def _token(key: str):
    """One of the null tokens, by turns."""
    k = F.col(key) % 4
    return F.when(k == 0, "None").when(k == 1, "null").when(k == 2, "NULL").otherwise("")


def _raw_trades(s: SparkSession, d: str) -> DataFrame:
    i, n = F.col("deal_id"), F.col("symbol").cast("long")
    return events.trades(s, d).select(
        F.when(i % 5 == 0, 1_000_000 + n).otherwise(n).alias("SecuCode"), F.col("trading_day").alias("TradingDay"), F.col("event_time").alias("DealTime"), (2 * i).alias("BuyID"),
        F.when(i % 3 == 0, _token("deal_id")).otherwise((2 * i + 1).cast("string")).alias("SellID"), i.alias("DealID"), F.col("price").alias("Price"), F.col("volume").alias("Volume"),
        F.col("side").alias("Side"), (i % 7).alias("Channel"), (i + 10).alias("BizIndex"),
    )


def _raw_orders(s: SparkSession, d: str) -> DataFrame:
    i = F.col("o_orderkey")
    return s.read.parquet(f"{d}/orders.parquet").select(
        (i * 37).alias("SecuCode"), F.date_format("o_orderdate", "yyyyMMdd").alias("TradingDay"), (93_000_000 + i % 1000).alias("OrderTime"), i.alias("OrderID"), F.col("o_totalprice").alias("Price"),
        F.col("o_custkey").alias("Volume"), (i % 3).alias("OrderType"), (i % 7).alias("Channel"), (i + 10).alias("BizIndex"), (2 * i).alias("DBOrderID"), _token("o_orderkey").alias("LastPrice"),
    )


def _raw_snapshots(s: SparkSession, d: str) -> DataFrame:
    rows = events.snapshots(s, d).withColumn("k", F.floor(F.col("event_time") / 10_000_000) + F.col("trading_day"))
    named = {"SecuCode": F.col("symbol").cast("long"), "TradingDay": F.col("trading_day"), "TickTime": F.col("event_time"), "TickTimeDiff": F.lit(3000), "Price": F.col("bid_price_1")}
    for i, name in enumerate("DealNum Volume Turnover TotalDealNum TotalVolume TotalTurnover TotalBidVolume TotalAskVolume WeightBidPrice WeightAskPrice".split()):
        named[name] = F.when(F.col("k") % 5 == 0, _token("k")).otherwise((F.col("k") + i).cast("string"))
    for n in range(1, ingest.BOOK_DEPTH + 1):
        for raw, ours in (("AskPrice", "ask_price"), ("AskVolume", "ask_volume"), ("BidPrice", "bid_price"), ("BidVolume", "bid_volume")):
            named[f"{raw}{n}"] = F.col(f"{ours}_{n}") if n <= 5 else _token("k")
        named[f"BidOrder{n}"], named[f"AskOrder{n}"] = F.lit(n), F.lit(-n)
    return rows.select(*[c.alias(n) for n, c in named.items()])


_RAW: dict[str, Callable] = {"snapshot": _raw_snapshots, "order": _raw_orders, "trade": _raw_trades}


def _ingested(dataset: str) -> Callable[[SparkSession, str], DataFrame]:
    """Files of two header orders in one folder are planned, discovered, typed and stored."""

    def query(s: SparkSession, d: str) -> DataFrame:
        root = shared_dir(s)
        raw = _RAW[dataset](s, d)
        order = {0: raw.columns[::-1], 1: raw.columns}  # half of the files have their columns turned round
        for k, columns in order.items():
            raw.where(F.pmod(F.col("SecuCode"), F.lit(2)) == k).select(*[F.col(c).cast("string") for c in columns]).write.mode("append").option("header", "true").csv(f"{root}/raw/{dataset}")
        (target,) = ingest.run(s, ingest.plan({MONTH: {dataset: f"{root}/raw/{dataset}"}}, f"{root}/typed"))
        return s.read.parquet(target)

    return query


def csv_discovery(s, d):
    """Trades of one side after the other are written to a folder that holds other files and folders as well: after each, the CSV files found there and their rows."""
    root, trades = shared_dir(s), events.trades(s, d).select("deal_id", "side")
    rows = []
    for side in (0, 1, -11):
        one = trades.where(F.col("side") == side).coalesce(1)
        one.write.mode("append").option("header", "true").csv(f"{root}/in")
        one.write.mode("append").json(f"{root}/in")
        one.write.mode("append").csv(f"{root}/in/below.csv")
        found = ingest.csv_files(s, f"{root}/in")
        rows.append((side, len(found), s.read.option("header", "true").csv(found).count()))
    return s.createDataFrame(rows, "side int, files int, rows long")


def ingest_jobs(s, d):
    """Jobs planned for the months of ``orders``: all, and those of the last two months, turned round, and of orders alone."""
    found = s.read.parquet(f"{d}/orders.parquet").select(F.date_format("o_orderdate", "yyyyMM").alias("m")).distinct().orderBy("m").collect()  # a row a month
    sources = {r.m: {n: f"raw/{n}/{r.m}" for n in ("trade", "order")} for r in found if r.m}
    last = list(sources)[-2:][::-1]
    rows = [("chosen", i, j.dataset, j.month, j.source, j.target) for i, j in enumerate(ingest.plan(sources, "out", last, ["order"]))]
    rows += [("all", i, j.dataset, j.month, j.source, j.target) for i, j in enumerate(ingest.plan(sources, "out"))]
    return s.createDataFrame(rows, "plan string, place int, dataset string, month string, source string, target string")


def idempotent_stage(s, d):
    """What a stage over ``events`` has built, and the number in its output, after each run: the first, a second, one with
    another parameter, one with more input, one whose build fails, and one forced."""
    root, built = shared_dir(s), []
    source = s.read.parquet(f"{d}/events.parquet").select("event_id", "event_type")
    source.where("event_id % 2 = 0").write.parquet(f"{root}/in")

    def run(k: int, force: bool = False, fail: bool = False) -> None:
        def build(at: dict[str, str]) -> dict[str, DataFrame]:
            built.append(1)
            rows = s.read.parquet(f"{root}/in").where(F.col("event_id") % k == 0)
            wrong = rows.select(F.raise_error(F.lit("no second output")).cast("string").alias("event_type"))
            return {"count": rows.agg(F.count("*").alias("n")), "types": wrong if fail else rows.select("event_type").distinct()}

        stage(s, {n: f"{root}/out/{n}" for n in ("count", "types")}, build, force, [f"{root}/in"], [k])

    rows = []

    def note(step: str, *args, **more) -> None:
        try:
            run(*args, **more)
        except Exception as e:
            if "no second output" not in str(e):
                raise
        count = s.read.parquet(f"{root}/out/count").first().n
        rows.append((len(rows), step, len(built), count, s.read.parquet(f"{root}/out/types").count()))

    note("first", 2)
    note("again", 2)
    note("other parameter", 3)
    source.where("event_id % 2 = 1").write.mode("append").parquet(f"{root}/in")
    note("more input", 3)
    note("failing", 5, fail=True)
    note("again", 3)
    note("forced", 3, force=True)
    return s.createDataFrame(rows, "place int, step string, built int, rows long, types long")


def _file_checks(s: SparkSession, rows: DataFrame, required: list[str], numeric: list[str], missing: str, text: str) -> DataFrame:
    """Rows in files of one day each, of which the first day's lack a column and the last day's have text in one: the days
    that the footers tell to be unfit, their rows and files, and what is wrong."""
    root, rows = shared_dir(s), rows.withColumn("day", F.col("trading_day")).repartition("day")
    first, last = rows.agg(F.min("day"), F.max("day")).first()
    good, worse = F.col("day").between(first + 1, last - 1), rows.where(F.col("day") == last).withColumn(text, F.col(text).cast("string"))
    for part in (rows.where(good), rows.where(F.col("day") == first).drop(missing), worse):
        part.write.mode("append").partitionBy("day").parquet(root)
    found = files.odd_files(files.footers(s, root), required, numeric)
    return found.groupBy(F.regexp_extract("file", r"day=(\d+)", 1).cast("int").alias("trading_day"), "problem").agg(F.sum("rows").alias("rows"), F.count("*").alias("files"))


def snapshot_file_checks(s, d):
    return _file_checks(s, events.snapshots(s, d), [*schema.SORT_KEYS, *schema.book_columns(5)], schema.book_columns(5), "ask_volume_1", "bid_price_2")


def trade_file_checks(s, d):
    return _file_checks(s, events.trades(s, d), schema.TRADE_COLUMNS, schema.TRADE_COLUMNS[1:], "volume", "price")


def panel_file_checks(s, d):
    return _file_checks(s, catalogue._panel(s, d), [*E.KEYS, "symbol", *FACTORS, *LABELS], [*FACTORS, *LABELS], LABELS[0], FACTORS[0])


def series_file_checks(s, d):
    series = E.rank_ic_wide(catalogue._ic(s, d), catalogue.PAIRS)
    cells = [f"{p}__{f}__{y}" for f, y in catalogue.PAIRS for p in schema.PAIR_FIELDS]
    return _file_checks(s, series, [*E.KEYS, *cells], [c for c in cells if c.startswith(("rank_ic__", "n_obs__"))], cells[0], f"n_obs__{FACTORS[1]}__{LABELS[1]}")


def drifted_columns(s, d):
    """Trades in files of one side each; one side's prices are text: the column, the usual type, and the rows in such files."""
    root, rows = shared_dir(s), events.trades(s, d).withColumn("part", F.col("side"))
    for k in (0, 1, -11):
        one = rows.where(F.col("side") == k)
        (one.withColumn("price", F.col("price").cast("string")) if k == 1 else one).coalesce(1).write.mode("append").partitionBy("part").parquet(root)
    found = files.footers(s, root)
    return files.drifted(found).join(found.select("file", "column", "rows"), ["file", "column"]).select(F.regexp_extract("file", r"part=(-?\d+)", 1).cast("int").alias("side"), "column", "type", "usual", "rows")


def read_many_files(s, d):
    """Rows by month of a dataset below several folders."""
    root = shared_dir(s)
    events.snapshots(s, d).withColumn("am", F.col("event_time") < 120_000_000).write.partitionBy("am").parquet(f"{root}/deep/er")
    return read_many(s, root).groupBy("source_month").agg(F.count("*").alias("rows"))


def unpaired_trades(s, d):
    return B.unpaired(events.snapshots(s, d), events.trades(s, d).where("symbol > '000002'"))


# ---- schema checks --------------------------------------------------------------------------------------------


def schema_checks(s, d):
    """What each check says of good and of bad input."""
    book, trades = events.snapshots(s, d), events.trades(s, d)
    panel = s.createDataFrame([], "trading_day int, event_time long, symbol string, oir_1 double, voi_1 double, fwd_ret_3000ms double")
    series = s.createDataFrame([], ", ".join(f"{p}__oir_1__fwd_ret_3000ms double" for p in schema.PAIR_FIELDS))
    cases = [
        ("V1", "two depths", lambda: ",".join(schema.required_snapshot_columns([1], [1, 2]))),
        ("V2", "whole", lambda: schema.check_snapshot(book, 5)),
        ("V2", "column missing", lambda: schema.check_snapshot(book.drop("ask_volume_1"), 5)),
        ("V2", "not numeric", lambda: schema.check_snapshot(book.withColumn("ask_volume_1", F.lit("x")), 5)),
        ("V3", "whole", lambda: schema.check_trades(trades)),
        ("V3", "columns missing", lambda: schema.check_trades(trades.drop("side", "price"))),
        ("V3", "not numeric", lambda: schema.check_trades(trades.withColumn("side", F.lit("x")))),
        ("V4", "quotes", lambda: schema.check_labels(book, "mid_price_1")),
        ("V4", "quote missing", lambda: schema.check_labels(book.drop("bid_price_1"), "mid_price_1")),
        ("V4", "price missing", lambda: schema.check_labels(book, "last_price")),
        ("V5", "repeated", lambda: schema.horizons([30000, 3000, 3000])),
        ("V5", "none", lambda: schema.horizons([])),
        ("V5", "zero", lambda: schema.horizons([0, 3000])),
        ("V6", "inferred", lambda: schema.selections(panel)),
        ("V6", "no label", lambda: schema.selections(panel.drop("fwd_ret_3000ms"))),
        ("V7", "index missing", lambda: schema.selections(panel.drop("symbol"), index=["symbol"])),
        ("V7", "chosen", lambda: schema.selections(panel, ["voi_1"], ["fwd_ret_3000ms"], ["symbol"])),
        ("V8", "one", lambda: schema.cross_section(1)),
        ("V8", "repeated", lambda: schema.cross_sections([10, 8, 8])),
        ("V9", "whole", lambda: schema.pairs_of_timeseries(series)),
        ("V9", "field missing", lambda: schema.pairs_of_timeseries(series.drop("is_valid__oir_1__fwd_ret_3000ms"))),
        ("V10", "product", lambda: schema.pairs_of_timeseries(series.withColumn("rank_ic__voi_1__fwd_ret_30000ms", F.lit(0.0)))),
        ("V11", "raised", lambda: schema.grouping_cross_section(3, 5)),
        ("V11", "one group", lambda: schema.grouping_cross_section(3, 1)),
        ("V12", "three", lambda: schema.factor_pairs(["a", "b", "c"])),
        ("V12", "one", lambda: schema.factor_pairs(["a"])),
        ("V13", "no pair", lambda: schema.pairs_of_timeseries(panel)),
    ]
    rows = []
    for item, case, check in cases:
        try:
            said = str(check())
        except ValueError as e:
            said = f"{type(e).__name__}: {e}"
        rows.append((item, case, said))
    return s.createDataFrame(rows, "item string, case string, said string")


# ---- stages ---------------------------------------------------------------------------------------------------

_roots: dict[tuple, str] = {}


def _reports(s: SparkSession, d: str) -> str:
    """All stages over the adapter's tables, from Parquet to Parquet, once a session and state of the events; gives their folder."""
    key = (s.sparkContext.applicationId, d, version(s, f"{d}/events.parquet"))
    if key not in _roots or not exists(s, f"{_roots[key]}/figures/factor_coverage_validity"):
        at = shared_dir(s)
        events.snapshots(s, d).write.parquet(f"{at}/snapshot/month={MONTH}")
        events.trades(s, d).write.parquet(f"{at}/trade/month={MONTH}")
        stages.factors(s, f"{at}/snapshot", f"{at}/factors", f"{at}/trade", WINDOW_MS)
        stages.labels(s, f"{at}/factors", f"{at}/labels", HORIZONS)
        stages.panel(s, f"{at}/labels", f"{at}/panel", FACTORS, LABELS)
        stages.evaluation(s, f"{at}/panel", f"{at}/eval", sweep=(8, 10, 15, 20))
        series = f"{at}/eval/rank_ic_timeseries"
        stages.diagnostics(s, f"{at}/panel", series, f"{at}/diagnostics")
        stages.robustness(s, series, f"{at}/robustness")
        stages.grouping(s, f"{at}/panel", f"{at}/grouping")
        stages.redundancy(s, f"{at}/panel", series, f"{at}/eval/rank_ic_summary", f"{at}/redundancy")
        stages.figures(s, at, f"{at}/figures")
        _roots[key] = at
    return _roots[key]


def _report(path: str, *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(s: SparkSession, d: str) -> DataFrame:
        df = s.read.parquet(f"{_reports(s, d)}/{path}")
        return S.rounded(df.select(*columns) if columns else df)

    return query


#: Table of a stage by the name of its query; the query of the operator that it has to agree with.
STAGES = {
    "stage_labels": ("labels", "forward_label"),
    "stage_panel": ("panel", "panel"),
    "stage_rank_ic_timeseries": ("eval/rank_ic_timeseries", "rank_ic_timeseries"),
    "stage_rank_ic_summary": ("eval/rank_ic_summary", "rank_ic_summary"),
    "stage_rank_ic_monthly": ("eval/rank_ic_monthly_summary", "rank_ic_monthly"),
    "stage_rank_ic_scan": ("eval/rank_ic_min_cross_section_scan", "rank_ic_sweep"),
    "stage_column_coverage": ("diagnostics/column_coverage", "column_coverage"),
    "stage_symbol_coverage": ("diagnostics/symbol_coverage", "symbol_coverage"),
    "stage_pair_reason": ("diagnostics/pair_reason_summary", "pair_reason"),
    "stage_event_time_reason": ("diagnostics/event_time_reason_summary", "event_time_reason"),
    "stage_session_summary": ("robustness/session_summary", "session_summary"),
    "stage_month_session_summary": ("robustness/month_session_summary", "month_session_summary"),
    "stage_stability": ("robustness/stability_summary", "stability"),
    "stage_group_returns": ("grouping/group_return_timeseries", "group_returns"),
    "stage_group_summary": ("grouping/group_return_summary", "group_summary"),
    "stage_group_monotonicity": ("grouping/group_monotonicity_summary", "group_monotonicity"),
    "stage_factor_corr_summary": ("redundancy/factor_corr_summary", "factor_corr_summary"),
    "stage_ic_corr_summary": ("redundancy/ic_corr_summary", "ic_corr_summary"),
    "stage_redundancy": ("redundancy/redundancy_recommendation", "redundancy_recommendation"),
    "stage_fig_rank_ic": ("figures/core_factor_rank_ic", "fig_core_rank_ic"),
    "stage_fig_monotonicity": ("figures/core_factor_monotonicity", "fig_core_monotonicity"),
    "stage_fig_redundancy": ("figures/factor_redundancy_heatmap", "fig_redundancy_matrix"),
    "stage_fig_coverage": ("figures/factor_coverage_validity", "fig_coverage_validity"),
}
_LABELLED = [f"{p}_{h}ms" for h in HORIZONS for p in ("label_time_ms", "label_price", "fwd_ret")]

QUERIES = {
    **{f"ingest_{name}": _ingested(name) for name in _RAW},
    **{f.__name__: f for f in (csv_discovery, ingest_jobs, idempotent_stage, snapshot_file_checks, trade_file_checks, panel_file_checks, series_file_checks, drifted_columns, read_many_files, unpaired_trades, schema_checks)},
    "stage_factors": _report("factors", *KEY, *FACTORS),
    **{name: _report(path, *(KEY + _LABELLED if name == "stage_labels" else [])) for name, (path, _) in STAGES.items()},
}

ALL = catalogue.QUERIES | QUERIES
