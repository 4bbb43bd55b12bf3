"""The reference's scenarios and edge cases, on literal rows."""

import math
import random

import pytest

from bookpulse.functions import exprs as X
from bookpulse.operators import diagnose as D
from bookpulse.operators import evaluate as E
from bookpulse.operators import factors as B
from bookpulse.operators import gram
from bookpulse.operators import groups as G
from bookpulse.operators import labels as L
from bookpulse.operators import ranks as K
from bookpulse.operators import redundancy as R
from bookpulse.operators import schema
from bookpulse.operators import states
from pyspark.sql import functions as F

BOOK = [f"{s}_{f}_{k}" for k in range(1, 6) for s in ("bid", "ask") for f in ("price", "volume")]


def snapshots(spark, rows):
    """rows: (symbol, day, time, bid, bid volume, ask, ask volume); deeper levels step 0.01 away."""
    kind = "symbol string, source_month string, trading_day bigint, event_time bigint, " + ", ".join(f"{c} double" for c in BOOK)
    out = []
    for s, day, t, bid, bv, ask, av in rows:
        levels = []
        for k in range(5):
            levels += [None if bid is None else round(bid - 0.01 * k, 2), bv, None if ask is None else round(ask + 0.01 * k, 2), av]
        out.append((s, str(day)[:6], day, t, *levels))
    return spark.createDataFrame(out, kind)


A = [("000001", 20251103, 93000000, 10.00, 100.0, 10.02, 120.0), ("000001", 20251103, 93003000, 10.00, 110.0, 10.02, 90.0), ("000001", 20251103, 93006000, 10.02, 130.0, 10.04, 80.0)]
TRADES = "symbol string, source_month string, trading_day bigint, event_time bigint, price double, volume double, side bigint"
T = [(93001000, 10.01, 300.0, 1), (93002000, 10.01, 100.0, 0), (93004000, 10.03, 100.0, 1), (93005000, 10.03, 300.0, 0), (93005050, 0.0, 500.0, -11), (92500000, 10.0, 200.0, 1)]


def trades(spark, rows=T):
    return spark.createDataFrame([("000001", "202511", 20251103, *r) for r in rows], TRADES)


def by_time(df):
    return [r.asDict() for r in df.orderBy("symbol", "trading_day", "event_time").collect()]


def test_factors_and_labels(spark):
    out = B.with_trade_imbalance(B.book_factors(snapshots(spark, A)), B.trade_imbalance(trades(spark)))
    r1, r2, r3 = by_time(L.forward_returns(out, [3000]))
    assert r1["voi_1"] is None and r1["ofi_1"] is None and r1["trade_imbalance_3s"] is None
    assert math.isclose(r1["micro_price_1"], (10.00 * 120 + 10.02 * 100) / 220) and math.isclose(r1["relative_spread_1"], 0.02 / 10.01)
    assert r2["voi_1"] == 40 and r2["ofi_1"] == 40 and r3["voi_1"] is None and r3["ofi_1"] == 220
    assert r2["trade_imbalance_3s"] == -0.5 and r3["trade_imbalance_3s"] == 0.5
    assert r1["fwd_ret_3000ms"] == 0 and r2["fwd_ret_3000ms"] > 0 and r3["fwd_ret_3000ms"] is None
    assert r1["label_time_ms_3000ms"] == 34203000


def test_invalid_books(spark):
    rows = [("000001", 20251103, 93000000, 10.0, 100.0, 9.99, 50.0), ("000001", 20251103, 93003000, 10.0, 100.0, 10.0, 50.0), ("000001", 20251103, 93006000, None, 100.0, 10.0, None), ("000001", 20251103, 93009000, 0.0, 0.0, 10.0, 0.0)]
    crossed, locked, missing, zero = by_time(B.book_factors(snapshots(spark, rows)))
    assert crossed["micro_price_1"] is None and crossed["book_slope_5"] is None and crossed["oir_1"] == 50 / 150
    assert locked["relative_spread_1"] == 0 and locked["book_slope_5"] is not None
    assert missing["micro_price_1"] is None and missing["oir_1"] == 1.0 and missing["ofi_1"] is None
    assert zero["oir_5"] is None


def test_days_and_symbols_are_walls(spark):
    rows = [("000001", 20251103, 145700000, 10.0, 1.0, 10.02, 1.0), ("000001", 20251104, 93000000, 10.0, 9.0, 10.02, 1.0), ("000002", 20251103, 145700000, 10.0, 5.0, 10.02, 1.0)]
    out = by_time(L.forward_returns(B.book_factors(snapshots(spark, rows)), [3000]))
    assert all(r["voi_1"] is None and r["fwd_ret_3000ms"] is None for r in out)


def test_asof_crosses_lunch_and_stops_at_invalid(spark):
    rows = [("000001", 20251103, 112958000, 10.0, 1.0, 10.02, 1.0), ("000001", 20251103, 130000000, 11.0, 1.0, 11.02, 1.0), ("000001", 20251103, 130003000, 11.0, 1.0, 10.0, 1.0), ("000001", 20251103, 130006000, 12.0, 1.0, 12.02, 1.0)]
    a, b, c, d = by_time(L.forward_returns(snapshots(spark, rows), [3000]))
    assert math.isclose(a["fwd_ret_3000ms"], 11.01 / 10.01 - 1) and b["fwd_ret_3000ms"] is None and b["label_time_ms_3000ms"] == 46803000
    assert c["fwd_ret_3000ms"] is None and d["label_time_ms_3000ms"] is None


def test_asof_takes_the_first_of_equal_times(spark):
    builds = spark.createDataFrame([("a", 5, 2, 20.0), ("a", 5, 1, 10.0), ("a", 7, 0, 30.0)], "k string, t int, tie int, v double")
    probes = spark.createDataFrame([("a", 5), ("a", 6), ("a", 8), ("b", 1)], "k string, at int")
    got = L.asof_forward(probes, builds, ["k"], "at", "t", ["v"], ["tie"]).collect()
    assert {(r.k, r.at): r.v for r in got} == {("a", 5): 10.0, ("a", 6): 30.0, ("a", 8): None, ("b", 1): None}


def test_labels_take_one_exchange(spark):
    """And one scan, for any number of horizons."""
    frame = snapshots(spark, A)
    for steps in ([3000], [3000, 6000, 9000, 30000]):
        plan = L.forward_returns(frame, steps)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Scan") == 1 and plan.count("Sort [") == 1


def test_labels_of_equal_and_missing_times(spark):
    rows = [("000001", 20251103, t, p, 1.0, p + 0.02, 1.0) for t, p in ((93000000, 10.0), (93003000, 12.0), (93003000, 11.0), (93006000, 13.0))]
    frame = snapshots(spark, rows).withColumn("tie", -F.col("bid_price_1")).unionByName(snapshots(spark, rows[:1]).withColumns({"tie": F.lit(0.0), "event_time": F.lit(None).cast("bigint")}))
    got = {(r.event_time, r.bid_price_1): r.label_price_3000ms for r in L.forward_returns(frame, [3000], tiebreak=["tie"]).collect()}
    assert got == {(93000000, 10.0): 12.01, (93003000, 12.0): 13.01, (93003000, 11.0): 13.01, (93006000, 13.0): None, (None, 10.0): None}


def test_bucket_edges_and_negative_volume(spark):
    rows = [(93003000, 1.0, 10.0, 0), (93003001, 1.0, 10.0, 1), (93003002, 1.0, -5.0, 1), (93003003, 1.0, None, 0)]
    got = {r.bucket_ms: r.trade_imbalance_3s for r in B.trade_imbalance(trades(spark, rows)).collect()}
    assert got == {34203000: 1.0, 34206000: -1.0}
    one = spark.range(1).select(X.bucket_end(F.lit(3000), 3000).alias("a"), X.bucket_end(F.lit(3001), 3000).alias("b"), X.clock_ms(F.lit(93000001)).alias("c")).first()
    assert tuple(one) == (3000, 6000, 34200001)


def test_schema_checks(spark):
    frame = snapshots(spark, A)
    with pytest.raises(schema.SchemaError):
        B.book_factors(frame.drop("ask_volume_1"))
    with pytest.raises(schema.SchemaError):
        B.book_factors(frame.withColumn("ask_volume_1", F.lit("x")))
    for bad in ([], [0], [-1]):
        with pytest.raises(ValueError):
            schema.horizons(bad)
    with pytest.raises(ValueError):
        schema.cross_section(1)
    with pytest.raises(ValueError):
        schema.grouping_cross_section(3, 1)
    with pytest.raises(ValueError):
        X.in_windows([])


PANEL = "trading_day bigint, event_time bigint, symbol string, source_month string, oir_1 double, fwd_ret_3000ms double"


def test_rank_ic(spark):
    rows = []
    for t, xs in ((91400000, (1, 2, 3)), (93000000, (1, 2, 3)), (93003000, (5, 5, 5))):
        rows += [(20251103, t, f"00000{i}", "202511", float(x), 0.01 * i) for i, x in enumerate(xs)]
    rows += [(20251103, 93006000, "000001", "202511", None, 0.1)]
    p = spark.createDataFrame(rows, PANEL)
    long = E.rank_ic(p, least=3)
    got = {r.event_time: r for r in long.collect()}
    assert [got[t].invalid_reason for t in (93000000, 93003000, 93006000)] == [None, "factor_constant", "missing_pair_values"] and len(got) == 3
    s = E.summary(long).first()
    assert (s.groups_total, s.groups_valid, s.rank_ic_mean, s.rank_ic_std, s.t_stat) == (3, 1, 1.0, None, None)
    assert E.rank_ic_long(E.rank_ic_wide(long, [("oir_1", "fwd_ret_3000ms")])).count() == 3
    assert [r.groups_valid for r in E.sweep(p, sizes=(2, 3, 4)).orderBy("min_cross_section").collect()] == [1, 1, 0]
    empty = E.summary(E.rank_ic(p.limit(0), least=3), pairs=[("oir_1", "fwd_ret_3000ms")]).first()
    assert empty.groups_total == 0 and empty.valid_ratio is None
    c = {r.column: r for r in D.coverage(p).collect()}
    assert c["oir_1"].n_unique == 5 and c["oir_1"].coverage_ratio == 0.9 and c["fwd_ret_3000ms"].column_type == "label"


def test_rank_statistics_shuffle_once(spark):
    p = spark.createDataFrame([(1, 1, "a", "m", 1.0, 1.0)], PANEL)
    plan = E.rank_statistics(p, [("oir_1", "fwd_ret_3000ms"), ("fwd_ret_3000ms", "oir_1")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_rank_statistics_of_large_groups(spark):
    """Ranks by parts of a sort over all tasks equal those of one window, ties, constants and single rows included."""
    rows = [(1, (i * 7919) % 501 / 4, float((i * 31) % 97)) for i in range(3000)] + [(2, 1.0, float(i)) for i in range(5)] + [(3, 2.0, 3.0), (4, None, 1.0), (5, 1.0, 2.0), (5, 2.0, 1.0), (5, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, a double, b double")
    pairs = [("a", "b"), ("b", "a"), ("a", "a")]
    assert sorted(map(tuple, K.rank_statistics(df, pairs, ["g"]).collect())) == sorted(map(tuple, E.rank_statistics(df, pairs, ["g"]).collect()))
    assert K.rank_statistics(df.limit(0), pairs, ["g"]).count() == 0


def test_parts_follow_the_rows(spark, monkeypatch):
    """A task numbers a few parts at most, however well its rows compress; results are those of one window."""
    monkeypatch.setattr(K, "PART_ROWS", 2000, raising=False)
    rows = spark.range(60_000).select(F.lit(1).alias("g"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") * 7919 % 30_011).cast("double").alias("y"), "id")
    tasks = K._labelled(rows, ["x"], "y", ["g"])[0].groupBy(F.spark_partition_id()).count().collect()
    assert sum(t["count"] for t in tasks) == 60_000 and max(t["count"] for t in tasks) < 20_000
    pairs = [("x", "y"), ("y", "x")]
    assert sorted(map(tuple, K.rank_statistics(rows, pairs, ["g"]).collect())) == sorted(map(tuple, E.rank_statistics(rows, pairs, ["g"]).collect()))
    last = K.ordinal(rows, ["g"], "y", ["id"]).orderBy("ordinal").select("y", "id", "ordinal", "n").collect()
    assert [x.ordinal for x in last] == list(range(1, 60_001)) and [(x.y, x.id) for x in last] == sorted((x.y, x.id) for x in last)


def test_group_sizes(spark):
    sizes = spark.range(1, 13).groupBy(X.quantile_group(F.col("id"), F.lit(12), 5).alias("g")).count().orderBy("g").collect()
    assert [r["count"] for r in sizes] == [3, 2, 3, 2, 2]


def test_grouping(spark):
    rows = [(20251103, t, f"00000{i}", "202511", float(i), 0.01 * i + d) for t, d in ((93000000, 0.0), (93003000, 0.005)) for i in range(1, 7)]
    p = spark.createDataFrame(rows, PANEL)
    found = G.returns(G.grouped(p, least=3, groups=3), least=3, groups=3)
    assert found.count() == 6 and {r.group_n_obs for r in found.collect()} == {2}
    first = {r.group_id: r.group_mean_ret for r in found.where("event_time = 93000000").collect()}
    assert math.isclose(first[1], 0.015) and math.isclose(first[3], 0.055)
    m = G.monotonicity(found).first()
    assert m.is_monotonic_non_decreasing and m.has_complete_group_grid and m.top_bottom_spread_sign == "positive" and m.positive_spread_ratio == 1
    assert G.monotonicity(found.where("group_id = 1")).first().is_monotonic_non_decreasing


def test_sessions_and_stability(spark):
    rows = [(20251103, 93000000, "oir_1", "fwd_ret_3000ms", 0.4, 10, True, None), (20251103, 130000000, "oir_1", "fwd_ret_3000ms", 0.2, 10, True, None), (20251203, 93000000, "oir_1", "fwd_ret_3000ms", None, 3, False, "below_min_cross_section"), (20251203, 130000000, "oir_1", "fwd_ret_3000ms", 0.1, 10, True, None), (20251203, 120000000, "oir_1", "fwd_ret_3000ms", 0.9, 10, True, None)]
    ts = spark.createDataFrame(rows, "trading_day bigint, event_time bigint, factor string, label string, rank_ic double, n_obs bigint, is_valid boolean, invalid_reason string")
    assert {r.session: r.valid_ratio for r in D.session_summary(ts).collect()} == {"am": 0.5, "pm": 1.0}
    s = D.stability(D.session_summary(ts, monthly=True)).first()
    assert (s.months_observed, s.sessions_observed) == (2, 2) and math.isclose(s.segment_ic_range, 0.3)


def test_recommendation(spark):
    pairs = [("oir_1", "oir_5", 0.9), ("oir_1", "ofi_1", 0.1), ("voi_1", "ofi_1", 0.95)]
    corr = spark.createDataFrame([(a, b, c, c) for a, b, c in pairs], "factor_left string, factor_right string, factor_corr_mean double, factor_corr_abs_mean double")
    ic = spark.createDataFrame([("oir_1", "oir_5", "y", 0.9, 0.9, 4), ("oir_1", "ofi_1", "y", 0.1, 0.1, 4), ("voi_1", "ofi_1", "y", None, None, 0)], "factor_left string, factor_right string, label string, ic_corr double, ic_corr_abs double, overlap_time_points bigint")
    means = spark.createDataFrame([("oir_1", "y", 0.2, 1.0), ("oir_5", "y", 0.1, 1.0), ("ofi_1", "y", 0.3, 1.0), ("voi_1", "y", -0.3, 1.0)], "factor string, label string, rank_ic_mean double, valid_ratio double")
    got = {(r.factor_left, r.factor_right): r for r in R.recommend(corr, ic, means).collect()}
    a, b, c = (got[p[:2]] for p in pairs)
    assert (a.likely_redundant, a.recommended_keep, a.recommended_drop, a.reason) == (True, "oir_1", "oir_5", "high_factor_and_ic_correlation")
    assert (b.recommended_keep, b.recommended_drop, b.reason) == ("keep_both", None, "retain_both")
    assert (c.likely_redundant, c.recommended_keep, c.reason) == (None, "voi_1", "same_family_with_material_correlation")


# ---- what scales ------------------------------------------------------------------------------------------------


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def gappy_panel(spark, symbols=30, stamps=6, seed=3):
    """Factors with ties and NULLs: two always there, two NULL in the same rows, one in others, one constant, one never there."""
    r = random.Random(seed)
    rows = []
    for t in range(stamps):
        for k in range(symbols):
            a, b = r.random() < 0.8, r.random() < 0.7
            rows.append((20250101, 93000000 + t * 1000, f"{k:06d}", r.randrange(9) / 4, r.random(), r.randrange(5) / 2 if a else None, r.random() if a else None, r.random() if b else None, 1.5, None if t != 2 else None))
    kind = "trading_day int, event_time long, symbol string, " + ", ".join(f"f{i} double" for i in range(7))
    return spark.createDataFrame(rows, kind).repartition(3), [f"f{i}" for i in range(7)]


def test_gram_equals_pairs(spark):
    """Ranks once a class of NULLs give what ranks for each pair give."""
    df, factors = gappy_panel(spark)
    want = E.complete_statistics(df, schema.factor_pairs(factors), E.KEYS, "factor_left", "factor_right")
    got = gram.rank_statistics(df, factors, E.KEYS, "factor_left", "factor_right")
    columns = ["trading_day", "event_time", "factor_left", "factor_right", "n_obs", "x_n_unique", "y_n_unique", F.round("corr", 9)]
    rows = sorted(map(str, got.select(*columns).collect()))
    assert rows == sorted(map(str, want.select(*columns).collect())) and len(rows) == 6 * 21
    assert sum(r.corr is not None for r in got.collect()) == 6 * 10
    assert got.where("factor_right = 'f6'").where("n_obs is not null").count() == 0
    assert gram.rank_statistics(df.limit(0), factors, E.KEYS, "a", "b").count() == 0


def test_gram_takes_one_exchange_of_rows(spark):
    """However many factors: the rows are dealt once as they are, and nothing a pair wide is."""
    for n in (3, 7):
        df, factors = gappy_panel(spark)
        plan = plan_of(gram.rank_statistics(df, factors[:n], E.KEYS, "factor_left", "factor_right"))
        assert plan.count("Exchange hashpartitioning(trading_day") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_gram_of_many_columns(spark):
    """More columns than a word has bits."""
    r = random.Random(1)
    names = [f"c{i}" for i in range(70)]
    df = spark.createDataFrame([(1, *(r.random() if (i + k) % 3 or i < 60 else None for i in range(70))) for k in range(12)], "k int, " + ", ".join(f"{c} double" for c in names))
    got = gram.rank_statistics(df, names, ["k"], "a", "b").where("a = 'c2' and b in ('c3', 'c65', 'c69')")
    want = E.rank_statistics(df, [("c2", b) for b in ("c3", "c65", "c69")], ["k"], "a", "b")
    columns = ["a", "b", "n_obs", "x_n_unique", "y_n_unique", F.round("corr", 9)]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))


def series(spark, days=5):
    r = random.Random(7)
    rows = []
    for d in range(days):
        for t in (93000000, 100000000, 120000000, 140000000):
            for f in ("oir_1", "voi_1"):
                why = r.choice([None, None, None, "factor_constant", "below_min_cross_section"])
                rows.append((20250130 + d if d < 2 else 20250200 + d, t, f, "fwd_ret_3000ms", None if why else r.uniform(-1, 1), r.randrange(2, 40) if r.random() < 0.9 or why is None else None, why is None, why))
    return spark.createDataFrame(rows, "trading_day int, event_time long, factor string, label string, rank_ic double, n_obs long, is_valid boolean, invalid_reason string")


def test_cube_is_one_scan(spark):
    long = series(spark)
    plan = plan_of(E.cube(long))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Expand") == 1
    cube = E.cube(long)
    assert {r[0] for r in cube.select("level").distinct().collect()} == set(E.LEVELS)
    for name, by in E.LEVELS.items():
        rows = long.withColumns({"month": X.month_of(), "session": X.session()})
        rows = rows.where("session <> 'off_session'") if "session" in by else rows
        alone = rows.groupBy("factor", "label", *by).agg(*E.sums())
        got = E.level(cube, name).select(*alone.columns)
        rounded = lambda df: sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in df.collect())
        assert rounded(got) == rounded(alone) and got.count() > 1
    assert E.cube(long.limit(0)).count() == 0


def test_store_of_days(spark, tmp_path):
    """Days added one after the other, one made again: the figures are those of all days at once, other days' files stay."""
    r, store = random.Random(2), str(tmp_path / "store")
    rows = [(d, 93000000 + t, f"{k:06d}", None if r.random() < 0.1 else r.randrange(20) / 3, 2.5, r.gauss(0, 1)) for d in (20250130, 20250131, 20250203, 20250204) for t in (0, 3000) for k in range(14)]
    p = spark.createDataFrame(rows, "trading_day int, event_time long, symbol string, oir_1 double, voi_1 double, fwd_ret_3000ms double")
    files = lambda day: sorted((f.name, f.stat().st_mtime_ns) for f in (tmp_path / "store").glob(f"*/trading_day={day}/*"))
    assert states.days(spark, store) == set()
    assert states.update(spark, store, p.where("trading_day < 20250131")) == [20250130]
    before = files(20250130)
    assert states.update(spark, store, p.where("trading_day < 20250204")) == [20250131, 20250203] and states.update(spark, store, p, again=[20250203, 20300101]) == [20250203, 20250204]
    assert files(20250130) == before and states.update(spark, store, p) == [] and states.days(spark, store) == {20250130, 20250131, 20250203, 20250204}
    rounded = lambda df, columns: sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in x)) for x in df.select(*columns).collect())
    ic = E.rank_ic(p)
    returns = G.returns(G.grouped(p))
    for got, want in (
        (states.ic_summary(spark, store), E.summary(ic)), (states.ic_summary(spark, store, ["month"]), E.monthly(ic)), (states.group_summary(spark, store), G.summary(returns)), (states.coverage(spark, store), D.coverage(p)),
    ):
        assert set(got.columns) == set(want.columns) and rounded(got, want.columns) == rounded(want, want.columns) and want.count()
    with pytest.raises(ValueError, match="without"):
        states.update(spark, store, p.withColumn("trading_day", F.lit(None).cast("int")))


def test_merged_moments_of_a_constant(spark):
    """A value that never changes has no spread, however it is split."""
    rows = spark.createDataFrame([(d, 0.1 + 0.2) for d in range(7) for _ in range(d + 1)] + [(8, None)], "d int, v double")
    got = rows.groupBy("d").agg(*states.moments("v")).agg(*states.merged_moments("m", "s", n="n")).first()
    assert (got.m, got.s, got.n) == (0.1 + 0.2, 0.0, 28)


@pytest.fixture
def many_parts(spark):
    """Small tables stay in as many parts as large ones would."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_asof_over_parts(spark, many_parts):
    """A day that holds nearly all rows lies in all parts; matches across the parts' ends, ties, gaps and NULLs are right."""
    r = random.Random(4)
    day = lambda: "hot" if r.random() < 0.9 else r.choice(["a", "b", None])
    builds = [(day(), r.randrange(4000) if r.random() < 0.98 else None, r.randrange(3), None if r.random() < 0.2 else r.random(), k) for k in range(300)]
    probes = [(k, day(), r.randrange(4200) if r.random() < 0.98 else None) for k in range(3000)]
    left = spark.createDataFrame(probes, "id int, day string, at int")
    right = spark.createDataFrame(builds, "day string, t int, tie int, v double, b int")
    got = {x.id: (x.v, x.b) for x in L.asof_forward(left, right, ["day"], "at", "t", ["v", "b"], ["tie"]).collect()}
    order = lambda x: (x[1], x[2], x[3] is not None, x[3] or 0, x[4])
    for k, d, at in probes:
        later = [b for b in builds if d is not None and at is not None and b[0] == d and b[1] is not None and b[1] >= at]
        want = min(later, key=order) if later else (None,) * 5
        assert got[k] == (want[3], want[4]), (k, d, at)
    parts = left.select("day", F.col("at").alias("_k")).repartitionByRange("day", "_k").withColumn("p", F.spark_partition_id()).where("day = 'hot'").groupBy("p").count().collect()
    assert len(parts) >= 3 and max(x["count"] for x in parts) < 0.6 * len(probes)
    assert L.asof_forward(left, right.limit(0), ["day"], "at", "t", ["v"]).where("v is not null").count() == 0
    assert L.asof_forward(left.limit(0), right, ["day"], "at", "t", ["v"]).count() == 0


def test_ordinal_groups_of_one_hot_group(spark, many_parts):
    r = random.Random(5)
    rows = [(None if k % 50 == 49 else "hot" if k % 10 else "small", None if r.random() < 0.05 else r.randrange(40) / 2, k) for k in range(2000)] + [("tiny", 1.0, 5000)]
    df = spark.createDataFrame(rows, "g string, x double, k int").repartition(5)
    got = {x.k: (x.ordinal, x.n, x.group_id) for x in K.ordinal(df, ["g"], "x", ["k"], least=10, groups=5).where("g is not null").collect()}
    for g in ("hot", "small"):
        order = sorted((x, k) for h, x, k in rows if h == g and x is not None)
        n = len(order)
        for place, (_, k) in enumerate(order, 1):
            assert got.pop(k) == (place, n, min(5, int((place - 1) * 5 / n) + 1))
    assert not got
    plain = {x.k: x.ordinal for x in K.ordinal(df, ["g"], "x", ["k"]).collect()}
    assert plain[5000] == 1


def test_rank_statistics_with_gaps(spark, many_parts):
    """Groups of any size: a label is ranked once for factors without gaps, and once for each with gaps."""
    r = random.Random(6)
    rows = [("hot" if k % 9 else "b", r.randrange(6) / 2, r.random(), None if r.random() < 0.3 else r.randrange(50) / 7, None if r.random() < 0.1 else r.randrange(30) / 3) for k in range(1500)]
    df = spark.createDataFrame(rows, "g string, f double, h double, gap double, y double").repartition(4)
    pairs = [("f", "y"), ("h", "y"), ("gap", "y"), ("f", "h")]
    columns = ["g", "factor", "label", "n_obs", "x_n_unique", "y_n_unique", F.round("corr", 9)]
    got, want = (sorted(map(str, m.rank_statistics(df, pairs, ["g"]).select(*columns).collect())) for m in (K, E))
    assert got == want and len(got) == 8
