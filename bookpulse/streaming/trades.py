"""Trade imbalance as a stream: the batch operator's right-closed buckets over late trades, with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookpulse.functions import exprs as X
from bookpulse.operators.factors import DAY


def streaming_imbalance(trades: DataFrame, window_ms: int = 3000, late: str = "10 seconds", windows=X.AUCTION_WINDOWS) -> DataFrame:
    """Imbalance of each bucket of a streaming ``trades``; a bucket is closed when the watermark passes its end.

    The bucket's end, as a timestamp, is the event time, so state is bounded by the buckets that may still change.
    """
    clock = X.bucket_end(X.clock_ms(), window_ms)
    day = F.to_timestamp(F.col("trading_day").cast("string"), "yyyyMMdd")
    rows = trades.where(X.in_windows(windows)).where(X.clean_trade())
    ended = rows.withColumns({"bucket_ms": clock, "bucket_at": F.timestamp_millis(F.unix_millis(day) + clock)}).withWatermark("bucket_at", late)
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("volume")).otherwise(0.0))
    sums = ended.groupBy(*DAY, "bucket_ms", "bucket_at").agg(side(0).alias("v0"), side(1).alias("v1"))
    return sums.select(*DAY, "bucket_ms", "bucket_at", X.safe_divide(F.col("v0") - F.col("v1"), F.col("v1") + F.col("v0")).alias("trade_imbalance_3s"))
