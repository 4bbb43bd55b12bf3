"""CSV files of book snapshots, orders and trades, normalised to typed Parquet."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from threading import Event

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookpulse.functions.exprs import zero_padded
from bookpulse.sources.files import by_header
from bookpulse.sources.tables import exists, file_system, write_parquet

BOOK_DEPTH = 10
NULL_TOKENS = ("", "None", "null", "NULL")

# Raw column names, their types, and our names. Each dataset has its own name for the time.
_SECURITY = {"SecuCode": ("bigint", "secu_code"), "TradingDay": ("int", "trading_day")}
_SNAPSHOT = {
    "TickTime": ("bigint", "event_time"),
    "TickTimeDiff": ("int", "tick_time_diff"),
    "Price": ("double", "last_price"),
    "DealNum": ("double", "deal_num"),
    "Volume": ("double", "volume"),
    "Turnover": ("double", "turnover"),
    "TotalDealNum": ("double", "total_deal_num"),
    "TotalVolume": ("double", "total_volume"),
    "TotalTurnover": ("double", "total_turnover"),
    "TotalBidVolume": ("double", "total_bid_volume"),
    "TotalAskVolume": ("double", "total_ask_volume"),
    "WeightBidPrice": ("double", "weight_bid_price"),
    "WeightAskPrice": ("double", "weight_ask_price"),
}
_LEVEL = {"AskPrice": "ask_price", "AskVolume": "ask_volume", "BidPrice": "bid_price", "BidVolume": "bid_volume", "BidOrder": "bid_order", "AskOrder": "ask_order"}
_ORDER = {
    "OrderTime": ("bigint", "event_time"),
    "OrderID": ("bigint", "order_id"),
    "Price": ("double", "price"),
    "Volume": ("double", "volume"),
    "OrderType": ("int", "order_type"),
    "Channel": ("int", "channel"),
    "BizIndex": ("bigint", "biz_index"),
    "DBOrderID": ("bigint", "db_order_id"),
    "LastPrice": ("double", "last_price"),
}
_TRADE = {
    "DealTime": ("bigint", "event_time"),
    "BuyID": ("bigint", "buy_id"),
    "SellID": ("bigint", "sell_id"),
    "DealID": ("bigint", "deal_id"),
    "Price": ("double", "price"),
    "Volume": ("double", "volume"),
    "Side": ("int", "side"),
    "Channel": ("int", "channel"),
    "BizIndex": ("bigint", "biz_index"),
}

SCHEMAS: dict[str, dict[str, tuple[str, str]]] = {
    "snapshot": _SECURITY | _SNAPSHOT | {f"{r}{k}": ("double", f"{n}_{k}") for k in range(1, BOOK_DEPTH + 1) for r, n in _LEVEL.items()},
    "order": _SECURITY | _ORDER,
    "trade": _SECURITY | _TRADE,
}


@dataclass(frozen=True)
class IngestJob:
    """All files of one dataset and month: Spark reads them in one go."""

    dataset: str
    month: str
    source: str
    target: str


def csv_files(spark: SparkSession, folder: str) -> list[str]:
    """The folder's CSV files, sorted; not those of folders below. Any file system that Spark reads will do."""
    fs, p = file_system(spark, folder)
    if not fs.exists(p):
        raise FileNotFoundError(folder)
    return sorted(f.getPath().toString() for f in fs.listStatus(p) if f.isFile() and f.getPath().getName().endswith(".csv"))


def plan(sources: Mapping[str, Mapping[str, str]], root: str, months: Iterable[str] | None = None, datasets: Iterable[str] | None = None) -> list[IngestJob]:
    """Jobs for the chosen months and datasets in the order given; KeyError for unknown ones. sources: month -> dataset -> folder."""
    jobs = []
    for m in months or sources:
        for d in datasets or sources[m]:
            SCHEMAS[d]
            jobs.append(IngestJob(d, m, sources[m][d], f"{root}/{d}/month={m}"))
    return jobs


def _typed(raw: str, kind: str) -> Column:
    """A cell as its type; a null token is NULL, and a bad cell fails the job, as ANSI casts do."""
    return F.when(~F.col(f"`{raw}`").isin(*NULL_TOKENS), F.col(f"`{raw}`")).cast(kind)


def scan(spark: SparkSession, source: str | Iterable[str], dataset: str, month: str) -> DataFrame:
    """Typed, renamed rows with ``symbol`` and ``source_month`` first. Columns are found by header name, never by place."""
    columns, parts = SCHEMAS[dataset], []
    for files in by_header(spark, [source] if isinstance(source, str) else source):
        raw = spark.read.option("header", "true").option("mode", "FAILFAST").option("emptyValue", "").csv(files)
        if missing := [c for c in columns if c not in raw.columns]:
            raise ValueError(f"{dataset}: missing columns {', '.join(missing)}")
        parts.append(raw.select(*[_typed(r, kind).alias(name) for r, (kind, name) in columns.items()]))
    typed = reduce(DataFrame.unionByName, parts)
    return typed.select(zero_padded(F.col("secu_code")).alias("symbol"), F.lit(month).alias("source_month"), *typed.columns)


def run(spark: SparkSession, jobs: Iterable[IngestJob], force: bool = False, at_once: int = 4) -> list[str]:
    """Build the targets that aren't there. Up to ``at_once`` jobs run at a time, so that a small month fills what a large one leaves free.

    The first failure stops the jobs that haven't begun, and is raised once those that have are done.
    """
    jobs, failed = list(jobs), Event()

    def build(j: IngestJob) -> None:
        if failed.is_set():
            return
        try:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{j.dataset}-{j.month}")  # (of use where spark.scheduler.mode is FAIR)
            write_parquet(scan(spark, csv_files(spark, j.source), j.dataset, j.month), j.target, sort_by=["symbol", "trading_day", "event_time"])
        except BaseException:
            failed.set()
            raise

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        begun = [pool.submit(inheritable_thread_target(spark)(build), j) for j in jobs if force or not exists(spark, j.target)]
    for f in begun:
        f.result()  # raises what failed
    return [j.target for j in jobs]
