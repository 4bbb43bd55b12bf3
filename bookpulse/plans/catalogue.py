"""The queries of the factor library over the ``events`` adapter (and ``lineitem`` as a second shape)."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookpulse.functions import exprs as X
from bookpulse.functions import stats as S
from bookpulse.operators import diagnose as D
from bookpulse.operators import evaluate as E
from bookpulse.operators import factors as B
from bookpulse.operators import figures as V
from bookpulse.operators import groups as G
from bookpulse.operators import labels as L
from bookpulse.operators import ranks as K
from bookpulse.operators import redundancy as R
from bookpulse.operators import states as T
from bookpulse.sources import events
from bookpulse.sources.tables import exists, materialize, shared_dir, version

WINDOW_MS, HORIZONS = 3_600_000, (3_600_000, 10_800_000)
FACTORS = ["book_slope_5", "micro_price_1", "ofi_1", "oir_1", "oir_5", "relative_spread_1", "trade_imbalance_3s", "voi_1"]
LABELS = [f"fwd_ret_{h}ms" for h in sorted(HORIZONS)]  # the shortest horizon first
PAIRS = list(product(FACTORS, LABELS))
KEY = ["symbol", "trading_day", "event_time"]


_written: dict[tuple, tuple] = {}


def shared(s: SparkSession, d: str, name: str, build) -> DataFrame:
    """A table that several queries read, written by the first of a session that needs it; anew when the events change."""
    key = (s.sparkContext.applicationId, d, version(s, f"{d}/events.parquet"), name)
    if key not in _written or not exists(s, _written[key][0]):
        df, path = build(), shared_dir(s)
        df.write.parquet(path)
        _written[key] = path, df.schema
    path, schema = _written[key]
    return s.read.schema(schema).parquet(path)


def _factored(s: SparkSession, d: str) -> DataFrame:
    return B.with_trade_imbalance(B.book_factors(events.snapshots(s, d)), B.trade_imbalance(events.trades(s, d), WINDOW_MS))


def _panel(s: SparkSession, d: str) -> DataFrame:
    return shared(s, d, "panel", lambda: L.panel(L.forward_returns(_factored(s, d), HORIZONS), FACTORS, LABELS))


def _ic(s: SparkSession, d: str) -> DataFrame:
    """The time series is written once; all its summaries read it."""
    return shared(s, d, "ic", lambda: E.rank_ic(_panel(s, d), FACTORS, LABELS))


def _at(s: SparkSession, d: str, name: str) -> DataFrame:
    """One level of the summaries of the IC series, of which all levels are made in one scan."""
    return E.level(shared(s, d, "cube", lambda: E.cube(_ic(s, d))), name)


def _summary(s: SparkSession, d: str) -> DataFrame:
    return E.summarised(_at(s, d, "pair"), PAIRS)


def _corr(s: SparkSession, d: str) -> DataFrame:
    return shared(s, d, "corr", lambda: R.factor_corr(_panel(s, d), FACTORS))


def _column(name: str, c) -> "callable":
    return lambda s, d: S.rounded(events.snapshots(s, d).select(*KEY, c().alias(name)))


def book_lag(s, d):
    return S.rounded(B.lags(events.snapshots(s, d)).select(*KEY, *[f"prev_{f}_1" for f in ("bid_price", "ask_price", "bid_volume", "ask_volume")]))


def _factor(name):
    return lambda s, d: S.rounded(B.book_factors(events.snapshots(s, d)).select(*KEY, name))


def snapshot_factors(s, d):
    return S.rounded(B.book_factors(events.snapshots(s, d)).select(*KEY, *[f for f in FACTORS if f != "trade_imbalance_3s"]))


def auction_filter(s, d):
    return events.snapshots(s, d).where(X.in_windows()).select(*KEY)


def session_label(s, d):
    return events.snapshots(s, d).select(*KEY, X.session().alias("session"))


def trade_filter(s, d):
    return events.trades(s, d).where(X.clean_trade()).select(*KEY, "deal_id", "volume", "side")


def trade_bucket(s, d):
    return events.trades(s, d).select("deal_id", X.bucket_end(X.clock_ms(), WINDOW_MS).alias("bucket_ms"))


def trade_imbalance(s, d):
    return S.rounded(B.trade_imbalance(events.trades(s, d), WINDOW_MS))


def trade_factor_join(s, d):
    return S.rounded(B.with_trade_imbalance(events.snapshots(s, d), B.trade_imbalance(events.trades(s, d), WINDOW_MS)).select(*KEY, "trade_imbalance_3s"))


def label_base_price(s, d):
    frame = events.snapshots(s, d)
    return S.rounded(frame.select(*KEY, L.base_price(frame).alias("base_price")))


def forward_label(s, d):
    out = L.forward_returns(events.snapshots(s, d), HORIZONS)
    return S.rounded(out.select(*KEY, *[f"{p}_{h}ms" for h in HORIZONS for p in ("label_time_ms", "label_price", "fwd_ret")]))


def asof_next_quote(s, d):
    """For each trade the next snapshot of its symbol and day, and its middle price where the quote is valid."""
    quotes = events.snapshots(s, d).select("symbol", "trading_day", X.clock_ms().alias("quote_ms"), F.when(X.valid_quote(1), X.mid_price(1)).alias("mid"))
    deals = events.trades(s, d).select("deal_id", "symbol", "trading_day", X.clock_ms().alias("deal_ms"))
    return S.rounded(L.asof_forward(deals, quotes, ["symbol", "trading_day"], "deal_ms", "quote_ms", ["quote_ms", "mid"]))


def panel(s, d):
    return S.rounded(_panel(s, d))


def average_rank(s, d):
    rows = events.snapshots(s, d).select("trading_day", "event_time", "symbol", X.oir(1).alias("x")).where("x is not null")
    return rows.select("trading_day", "event_time", "symbol", S.average_rank("x", ["trading_day", "event_time"]).alias("average_rank"))


def rank_ic_pair(s, d):
    p = materialize(L.panel(L.forward_returns(B.book_factors(events.snapshots(s, d)), HORIZONS[:1])))
    return S.rounded(E.rank_statistics(E.auction(p), [("oir_1", f"fwd_ret_{HORIZONS[0]}ms")]))


def rank_ic_timeseries_long(s, d):
    return S.rounded(E.rank_ic(_panel(s, d), FACTORS, LABELS))


def rank_ic_timeseries(s, d):
    return S.rounded(E.rank_ic_wide(_ic(s, d), PAIRS))


def rank_ic_summary(s, d):
    return S.rounded(_summary(s, d))


def rank_ic_monthly(s, d):
    return S.rounded(E.summarised(_at(s, d, "month")))


def rank_ic_sweep(s, d):
    return S.rounded(E.sweep(_panel(s, d), FACTORS, LABELS))


def _grouped(s, d):
    return G.grouped(_panel(s, d), FACTORS, LABELS)


def ordinal_rank(s, d):
    return _grouped(s, d).select("trading_day", "event_time", "symbol", "factor", "label", "ordinal", F.col("n").alias("cross_section_n_obs"))


def group_id(s, d):
    return _grouped(s, d).select("trading_day", "event_time", "symbol", "factor", "label", "group_id")


def _returns(s, d):
    return shared(s, d, "returns", lambda: G.returns(_grouped(s, d)))


def group_returns(s, d):
    return S.rounded(_returns(s, d))


def group_summary(s, d):
    return S.rounded(G.summary(_returns(s, d)))


def group_spread(s, d):
    return S.rounded(G.spread(_returns(s, d)))


def group_monotonicity(s, d):
    return S.rounded(G.monotonicity(_returns(s, d)))


def column_coverage(s, d):
    return S.rounded(D.coverage(_panel(s, d), FACTORS, LABELS))


def symbol_coverage(s, d):
    return S.rounded(D.symbol_coverage(_panel(s, d), FACTORS, LABELS))


def pair_reason(s, d):
    return S.rounded(D.reasons(_at(s, d, "pair")))


def event_time_reason(s, d):
    return S.rounded(D.reasons(_at(s, d, "event_time")))


def session_summary(s, d):
    return S.rounded(D.sessions(_at(s, d, "session")))


def month_session_summary(s, d):
    return S.rounded(D.sessions(_at(s, d, "month_session")))


def stability(s, d):
    return S.rounded(D.stability(D.sessions(_at(s, d, "month_session"))))


def factor_corr_timeseries(s, d):
    return S.rounded(_corr(s, d))


def factor_corr_summary(s, d):
    return S.rounded(R.factor_corr_summary(_corr(s, d)))


def ic_corr_summary(s, d):
    return S.rounded(R.ic_corr(_ic(s, d), FACTORS, LABELS))


def factor_strength(s, d):
    return S.rounded(R.strength(_summary(s, d)))


def ic_pair_rollup(s, d):
    return S.rounded(R.ic_rollup(R.ic_corr(_ic(s, d), FACTORS, LABELS)))


def _redundancy(s, d):
    parts = R.factor_corr_summary(_corr(s, d)), R.ic_corr(_ic(s, d), FACTORS, LABELS), _summary(s, d)
    # Rounded before they are compared, so that the last digit of a mean decides nothing.
    return shared(s, d, "redundancy", lambda: R.recommend(*(S.rounded(materialize(x), 9) for x in parts)))


def redundancy_recommendation(s, d):
    return S.rounded(_redundancy(s, d))


def fig_redundancy_matrix(s, d):
    return S.rounded(V.redundancy_matrix(_redundancy(s, d), FACTORS))


def fig_coverage_validity(s, d):
    return S.rounded(V.coverage_validity(D.coverage(_panel(s, d), FACTORS, LABELS), _summary(s, d), LABELS[0], FACTORS))


def fig_core_monotonicity(s, d):
    return S.rounded(V.core_monotonicity(G.summary(_returns(s, d)), G.monotonicity(_returns(s, d)), LABELS))


def fig_core_rank_ic(s, d):
    return S.rounded(V.rank_ic(_summary(s, d), V.CORE, LABELS))


def fig_single_value(s, d):
    """One cell of the summary, looked up for each pair of core factor and label."""
    found = _summary(s, d)
    rows = [(f, y, V.single_value(found, f, y, "valid_ratio")) for f in V.CORE[:2] for y in LABELS]
    return S.rounded(s.createDataFrame(rows, "factor string, label string, valid_ratio double"))


def fig_rank_ic(s, d):
    return S.rounded(V.rank_ic(_summary(s, d), FACTORS, LABELS))


def fig_monotonicity(s, d):
    return S.rounded(V.monotonicity(G.summary(_returns(s, d)), FACTORS, LABELS[0]))


def zfill_symbol(s, d):
    return s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", X.zero_padded(F.col("o_orderkey") * 7).alias("symbol"))


def month_slice(s, d):
    return events.snapshots(s, d).groupBy(X.month_of().alias("month")).agg(F.count("*").alias("rows"))


def factor_family(s, d):
    """The family of each factor of the panel, and how many values it has there."""
    found = D.coverage(_panel(s, d), FACTORS, LABELS).where("column_type = 'factor'")
    return found.select(F.col("column").alias("factor"), X.family(F.col("column")).alias("family"), "non_null_rows")


_stores: dict[tuple, str] = {}


def _store(s: SparkSession, d: str) -> str:
    """A store of daily states, filled in three runs: half of the days, all days, and the first day once more."""
    key = (s.sparkContext.applicationId, d, version(s, f"{d}/events.parquet"))
    if key not in _stores or not T.days(s, _stores[key]):
        at, p = shared_dir(s), _panel(s, d)
        found = sorted(r[0] for r in p.select("trading_day").distinct().collect())  # a row a day
        T.update(s, at, p.where(F.col("trading_day").isin(found[: len(found) // 2])), FACTORS, LABELS)
        T.update(s, at, p, FACTORS, LABELS)
        T.update(s, at, p, FACTORS, LABELS, again=found[:1])
        _stores[key] = at
    return _stores[key]


def store_rank_ic_summary(s, d):
    return S.rounded(T.ic_summary(s, _store(s, d), pairs=PAIRS))


def store_rank_ic_monthly(s, d):
    return S.rounded(T.ic_summary(s, _store(s, d), ["month"]))


def store_group_summary(s, d):
    return S.rounded(T.group_summary(s, _store(s, d)))


def store_column_coverage(s, d):
    return S.rounded(T.coverage(s, _store(s, d)))


def lineitem_rank_ic(s, d):
    rows = _by_month(s, d, "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    # (a month's lines grow with the table: no group fits a task for certain)
    return S.rounded(K.rank_statistics(rows, [(f, "l_extendedprice") for f in ("l_quantity", "l_discount", "l_tax")], ["ship_month"]))


def _by_month(s, d, *columns):
    return s.read.parquet(f"{d}/lineitem.parquet").select(F.date_format("l_shipdate", "yyyyMM").cast("int").alias("ship_month"), *columns)


def lineitem_ordinal_groups(s, d):
    """Places and quantile groups of a month's lines by price; ties go by order and line."""
    rows = _by_month(s, d, "l_orderkey", "l_linenumber", "l_extendedprice")
    return K.ordinal(rows, ["ship_month"], "l_extendedprice", ["l_orderkey", "l_linenumber"], E.LEAST, 5).drop("l_extendedprice")


def lineitem_group_returns(s, d):
    """Discount and quantity of a month's lines by quantile group of their price."""
    rows = _by_month(s, d, "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount")
    placed = K.ordinal(rows, ["ship_month"], "l_extendedprice", ["l_orderkey", "l_linenumber"], E.LEAST, 5)
    return S.rounded(placed.groupBy("ship_month", "group_id").agg(F.avg("l_discount").alias("mean_discount"), F.avg("l_quantity").alias("mean_quantity"), F.count("*").alias("group_n_obs"), F.max("n").alias("cross_section_n_obs")))


QUERIES = {
    "micro_price": _column("micro_price_1", X.micro_price),
    "relative_spread": _column("relative_spread_1", X.relative_spread),
    "oir_1": _column("oir_1", lambda: X.oir(1)),
    "oir_5": _column("oir_5", lambda: X.oir(5)),
    "book_slope_5": _column("book_slope_5", lambda: X.book_slope(5)),
    "event_time_ms": lambda s, d: events.trades(s, d).select("deal_id", X.clock_ms().alias("event_time_ms")),
    "voi_1": _factor("voi_1"),
    "ofi_1": _factor("ofi_1"),
} | {
    f.__name__: f
    for f in (
        book_lag, snapshot_factors, auction_filter, session_label, trade_filter, trade_bucket, trade_imbalance, trade_factor_join, label_base_price, forward_label, asof_next_quote, panel, average_rank, rank_ic_pair,
        rank_ic_timeseries_long, rank_ic_timeseries, rank_ic_summary, rank_ic_monthly, rank_ic_sweep, ordinal_rank, group_id, group_returns, group_summary, group_spread, group_monotonicity,
        column_coverage, symbol_coverage, pair_reason, event_time_reason, session_summary, month_session_summary, stability, factor_corr_timeseries, factor_corr_summary, ic_corr_summary,
        factor_strength, ic_pair_rollup, redundancy_recommendation, fig_redundancy_matrix, fig_coverage_validity, fig_core_monotonicity, fig_core_rank_ic, fig_single_value, fig_rank_ic, fig_monotonicity, zfill_symbol, month_slice, factor_family, lineitem_rank_ic, lineitem_ordinal_groups, lineitem_group_returns,
        store_rank_ic_summary, store_rank_ic_monthly, store_group_summary, store_column_coverage,
    )
}


def flagship(spark: SparkSession, sf_dir: str, least: int = 3) -> DataFrame:
    """Snapshots, order imbalance, one-hour forward label, rank IC, summary."""
    p = materialize(L.panel(L.forward_returns(B.book_factors(events.snapshots(spark, sf_dir)), HORIZONS[:1])))
    y = [f"fwd_ret_{HORIZONS[0]}ms"]
    return S.rounded(E.summary(E.rank_ic(p, ["oir_1"], y, least=least), pairs=[("oir_1", y[0])]))
