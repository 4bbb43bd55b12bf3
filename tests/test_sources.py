"""CSV ingest, stages and the command line, and the streaming buckets."""

import json

import pytest
from pyspark.sql import functions as F

from bookpulse import cli
from bookpulse.operators import factors as B
from bookpulse.plans import catalogue, stages
from bookpulse.sources import events, files, ingest, tables
from bookpulse.sources.tables import read_many
from bookpulse.streaming.trades import streaming_imbalance


def _csv(path, rows, columns):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([",".join(columns), *(",".join(map(str, r)) for r in rows)]) + "\n")


TRADE = "SecuCode,TradingDay,DealTime,BuyID,SellID,DealID,Price,Volume,Side,Channel,BizIndex".split(",")
ORDER = "SecuCode,TradingDay,OrderTime,OrderID,Price,Volume,OrderType,Channel,BizIndex,DBOrderID,LastPrice".split(",")
SNAPSHOT = "SecuCode,TradingDay,TickTime,TickTimeDiff,Price,DealNum,Volume,Turnover,TotalDealNum,TotalVolume,TotalTurnover,TotalBidVolume,TotalAskVolume,WeightBidPrice,WeightAskPrice".split(",")
SNAPSHOT += [f"{f}{k}" for k in range(1, 11) for f in ("AskPrice", "AskVolume", "BidPrice", "BidVolume", "BidOrder", "AskOrder")]


def test_ingest(spark, tmp_path):
    turned = TRADE[::-1] + ["Unknown"]
    _csv(tmp_path / "in" / "b.csv", [[*range(len(TRADE)), "x"][:-1] + ["y"]], turned)
    _csv(tmp_path / "in" / "a.csv", [[1234567, 20251103, 93000000, "", "None", "null", "NULL", 2.5, 1, 1, 1]], TRADE)
    _csv(tmp_path / "in" / "below" / "c.csv", [[1]], ["x"])
    _csv(tmp_path / "in" / "d.txt", [[1]], ["x"])
    jobs = ingest.plan({"202511": {"trade": str(tmp_path / "in")}}, str(tmp_path / "out"))
    (target,) = ingest.run(spark, jobs)
    assert target.endswith("trade/month=202511")
    rows = {r.secu_code: r for r in spark.read.parquet(target).collect()}
    assert rows[1234567].symbol == "1234567" and rows[1234567].buy_id is None and rows[1234567].price is None and rows[1234567].volume == 2.5
    assert rows[1234567].event_time == 93000000 and rows[10].event_time == 8
    assert rows[10].symbol == "000010" and rows[10].biz_index == 0 and rows[10].source_month == "202511"
    assert ingest.run(spark, jobs) == [target]
    _csv(tmp_path / "bad" / "a.csv", [[1, 20251103, "noon", 1, 1, 1, 1, 1, 1, 1, 1]], TRADE)
    with pytest.raises(Exception):
        ingest.scan(spark, str(tmp_path / "bad" / "a.csv"), "trade", "202511").collect()
    with pytest.raises(ValueError, match="DealTime"):
        ingest.scan(spark, str(tmp_path / "in" / "below" / "c.csv"), "trade", "202511")
    with pytest.raises(FileNotFoundError):
        ingest.csv_files(spark, str(tmp_path / "none"))
    with pytest.raises(KeyError):
        ingest.plan({}, "x", ["202501"])


def test_ingest_of_orders_and_snapshots(spark, tmp_path):
    _csv(tmp_path / "order.csv", [[12, 20251103, 93000010, 5, 10.5, 300, 2, 1, 7, 8, "None"]], ORDER)
    _csv(tmp_path / "snapshot.csv", [[12, 20251103, 93003000, 3000, *range(11), *[k / 2 for k in range(60)]]], SNAPSHOT)
    o = ingest.scan(spark, str(tmp_path / "order.csv"), "order", "202511").first().asDict()
    assert o == {"symbol": "000012", "source_month": "202511", "secu_code": 12, "trading_day": 20251103, "event_time": 93000010, "order_id": 5, "price": 10.5, "volume": 300.0, "order_type": 2, "channel": 1, "biz_index": 7, "db_order_id": 8, "last_price": None}
    s = ingest.scan(spark, str(tmp_path / "snapshot.csv"), "snapshot", "202511").first()
    assert len(s) == 77 and (s.event_time, s.tick_time_diff, s.last_price, s.weight_ask_price) == (93003000, 3000, 0.0, 10.0)
    assert (s.ask_price_1, s.bid_price_1, s.ask_order_10) == (0.0, 1.0, 29.5)


def test_stages_end_to_end(spark, tmp_path):
    d, at = "/root/testdata/sf0.001", lambda n: str(tmp_path / n)
    events.snapshots(spark, d).write.parquet(at("snapshot"))
    events.trades(spark, d).write.parquet(at("trade"))
    h = ",".join(map(str, catalogue.HORIZONS))
    cli.main(["factors", "--snapshots", at("snapshot"), "--trades", at("trade"), "--out", at("f"), "--window-ms", str(catalogue.WINDOW_MS)])
    cli.main(["labels", "--source", at("f"), "--out", at("l"), "--horizons-ms", h])
    cli.main(["panel", "--source", at("l"), "--out", at("p")])
    cli.main(["evaluation", "--source", at("p"), "--root", at("r/eval"), "--least", "2", "--sweep", "2,3"])
    ts = at("r/eval/rank_ic_timeseries")
    cli.main(["diagnostics", "--panel-path", at("p"), "--timeseries", ts, "--root", at("r/diagnostics")])
    cli.main(["robustness", "--timeseries", ts, "--root", at("r/robustness")])
    cli.main(["grouping", "--panel-path", at("p"), "--root", at("r/grouping"), "--least", "2", "--groups", "2"])
    cli.main(["redundancy", "--panel-path", at("p"), "--timeseries", ts, "--summary", at("r/eval/rank_ic_summary"), "--root", at("r/redundancy"), "--least", "2"])
    out = cli.main(["figures", "--reports", at("r"), "--root", at("figures")])
    assert spark.read.parquet(out["factor_redundancy_heatmap"]).count() == 8 and len(out) == 4
    assert spark.read.parquet(at("r/eval/rank_ic_summary")).count() == 16
    before = json.dumps(sorted(x.name for x in (tmp_path / "p").iterdir()))
    stages.panel(spark, at("l"), at("p"))
    assert before == json.dumps(sorted(x.name for x in (tmp_path / "p").iterdir()))
    with pytest.raises(ValueError):
        cli.month("13")


def test_streaming_equals_batch(spark, tmp_path):
    rows = events.trades(spark, "/root/testdata/sf0.001")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streaming_imbalance(stream, catalogue.WINDOW_MS).writeStream.format("memory").queryName("imb").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("imb").drop("bucket_at").collect()}
    assert got == {tuple(r) for r in B.trade_imbalance(rows, catalogue.WINDOW_MS).collect()}


def test_footers_name_odd_files(spark, tmp_path):
    root = str(tmp_path / "in")
    good = spark.createDataFrame([(1, 2.0, "x")] * 3, "a int, b double, c string").coalesce(1)
    for k in range(5):
        good.write.parquet(f"{root}/deep/p{k}")
    good.drop("b").write.parquet(f"{root}/no_b")
    good.withColumn("b", F.lit("x")).write.parquet(f"{root}/text_b")
    found = files.footers(spark, root)
    assert found.count() == 5 * 3 + 2 + 3
    got = {(r.file.split("/")[-2], r.rows, r.problem) for r in files.odd_files(found, ["a", "b"], ["a", "b"]).collect()}
    assert got == {("no_b", 3, "missing columns: b"), ("text_b", 3, "not numeric: b")}
    assert [(r.file.split("/")[-2], r.column, r.type, r.usual) for r in files.drifted(found).collect()] == [("text_b", "b", "string", "double")]
    (tmp_path / "none").mkdir()
    for path in ("none", "nowhere"):
        with pytest.raises(FileNotFoundError):
            files.footers(spark, str(tmp_path / path))
    with pytest.raises(FileNotFoundError):
        read_many(spark, str(tmp_path / "nowhere"))


def test_headers_are_grouped_by_tasks(spark, tmp_path):
    for k in range(130):
        _csv(tmp_path / f"{k:03d}.csv", [[1, 2]], ["a", "b"] if k % 3 else ["b", "a"])
    names = [str(tmp_path / f"{k:03d}.csv") for k in range(130)]
    want = [[n for k, n in enumerate(names) if k % 3 == 0], [n for k, n in enumerate(names) if k % 3]]
    assert files.by_header(spark, names) == sorted(want) == files._by_header_here(spark, names)


def test_ingest_runs_jobs_at_once_and_stops_at_a_failure(spark, tmp_path):
    row = [1, 20251103, 93000000, 1, 1, 1, 1, 1, 1, 1, 1]
    for m in ("202501", "202502", "202503"):
        _csv(tmp_path / m / "a.csv", [row] * 3, TRADE)
    sources = {m: {"trade": str(tmp_path / m)} for m in ("202501", "202502", "202503")}
    jobs = ingest.plan(sources, str(tmp_path / "out"))
    assert ingest.run(spark, jobs) == [j.target for j in jobs] and all(spark.read.parquet(j.target).count() == 3 for j in jobs)
    jobs = ingest.plan(sources | {"202500": {"trade": str(tmp_path / "nowhere")}}, str(tmp_path / "again"), ["202500", "202501", "202502", "202503"])
    with pytest.raises(FileNotFoundError):
        ingest.run(spark, jobs, at_once=1)
    assert not (tmp_path / "again").exists()


def test_stage_rebuilds_and_survives(spark, tmp_path, monkeypatch):
    """Changed inputs and parameters rebuild; a failing build leaves the old set, a broken move is ended by the next run."""
    outputs, built = {n: str(tmp_path / "out" / n) for n in ("a", "b")}, []
    source = str(tmp_path / "in")
    spark.range(4).write.parquet(source)

    def run(k, fail=False):
        def build(at):
            built.append(k)
            n = spark.read.parquet(source).count()
            frames = {"a": spark.range(n * k), "b": spark.range(n * k)}
            return frames | ({"b": frames["b"].select(F.raise_error(F.lit("stop")).cast("long").alias("id"))} if fail else {})

        tables.stage(spark, outputs, build, inputs=[source], parameters=[k])
        return [spark.read.parquet(p).count() for p in outputs.values()]

    assert run(1) == [4, 4] and run(1) == [4, 4] and built == [1]
    assert run(2) == [8, 8] and built == [1, 2]
    spark.range(1).write.mode("append").parquet(source)
    assert run(2) == [10, 10] and built == [1, 2, 2]
    with pytest.raises(Exception, match="stop"):
        run(3, fail=True)
    assert [spark.read.parquet(p).count() for p in outputs.values()] == [10, 10] and run(2) == [10, 10] and len(built) == 4
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["a", "a.manifest.json", "b"]
    move, moved = tables._move, []

    def breaks(*args):
        if moved:
            raise OSError("broken off")
        moved.append(args)
        move(*args)

    monkeypatch.setattr(tables, "_move", breaks)
    with pytest.raises(OSError, match="broken off"):
        run(4)
    monkeypatch.setattr(tables, "_move", move)
    assert run(4) == [20, 20] and built[-1] == 4 and len(built) == 5


def test_panel_of_another_input_is_built_anew(spark, tmp_path):
    frame = spark.createDataFrame([(1, 2, "s", "m", 1.0, 2.0)], "trading_day int, event_time long, symbol string, source_month string, oir_1 double, fwd_ret_3000ms double")
    source, out = str(tmp_path / "l"), str(tmp_path / "p")
    for n in (1, 2):
        frame.write.mode("append").parquet(source)
        stages.panel(spark, source, out)
        assert spark.read.parquet(out).count() == n
