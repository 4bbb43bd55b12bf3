"""The ``events`` table in the shape of market data: the last event of a symbol's hour is a snapshot, every event a trade."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    s = F.col("user_id") % 40
    v = F.floor("value")
    return e.select(
        "event_id", "ts", "event_type",
        F.lpad(s.cast("string"), 6, "0").alias("symbol"),
        F.date_format("ts", "yyyyMMdd").cast("int").alias("trading_day"),
        F.hour("ts").cast("bigint").alias("hh"), F.minute("ts").cast("bigint").alias("mi"), F.second("ts").cast("bigint").alias("se"), F.date_format("ts", "SSS").cast("bigint").alias("mss"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.round(F.lit(10.0) + s * 0.5 + (v % 3) * 0.01, 2).alias("bid_1"),
    )


def snapshots(spark: SparkSession, sf_dir: str, depth: int = 5) -> DataFrame:
    """One row per symbol, day and hour; the last event is found by a combinable maximum, with no sort."""
    keys = ["symbol", "trading_day", "hh"]
    last = _base(spark, sf_dir).groupBy(*keys).agg(F.max_by(F.struct("event_id", "event_type", "k", "bid_1"), F.struct("ts", "event_id")).alias("e")).select(*keys, "e.*")
    crossed = (F.col("event_type") == "error") & (F.col("k") % 4 == 0)
    d = F.when(crossed, F.lit(-0.01)).otherwise((1 + F.col("k") % 2) * 0.01)
    columns = []
    for n in range(1, depth + 1):
        volume = ((F.col("k") + 3 * (n - 1)) % 17 * 100 + 10).cast("double")
        columns += [
            F.round(F.col("bid_1") - F.lit(n - 1) * F.lit(0.01), 2).alias(f"bid_price_{n}"),
            F.round(F.col("bid_1") + d + F.lit(n - 1) * F.lit(0.01), 2).alias(f"ask_price_{n}"),
            (F.when(F.col("k") % 29 != 0, volume) if n == 1 else volume).alias(f"bid_volume_{n}"),
            ((F.col("event_id") + 2 * (n - 1)) % 13 * 100 + 5).cast("double").alias(f"ask_volume_{n}"),
        ]
    month = F.substring(F.col("trading_day").cast("string"), 1, 6)
    return last.select("symbol", month.alias("source_month"), "trading_day", (F.col("hh") * 10000000).alias("event_time"), *columns)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _base(spark, sf_dir)
    side = F.when(F.col("event_type").isin("view", "purchase"), 0).when(F.col("event_type").isin("click", "signup"), 1).otherwise(-11)
    return t.select(
        "symbol", F.substring(F.col("trading_day").cast("string"), 1, 6).alias("source_month"), "trading_day",
        (F.col("hh") * 10000000 + F.col("mi") * 100000 + F.col("se") * 1000 + F.col("mss")).alias("event_time"), F.col("event_id").alias("deal_id"),
        F.when(F.col("k") % 50 == 0, 0.0).otherwise(F.col("bid_1")).alias("price"), F.col("k").cast("double").alias("volume"), side.alias("side"),
    )
