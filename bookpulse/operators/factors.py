"""Book factors of snapshots, and trade imbalance joined to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookpulse.functions import exprs as X
from bookpulse.operators import schema

DAY = ["symbol", "trading_day"]


def lags(frame: DataFrame, levels: Sequence[int] = (1,), tiebreak: Sequence[str] = ()) -> DataFrame:
    """Add prev_{field}_{level}: the row before, within symbol and day. One window for all."""
    w = Window.partitionBy(*DAY).orderBy("event_time", *tiebreak)
    return frame.withColumns({f"prev_{f}_{k}": F.lag(f"{f}_{k}").over(w) for k in levels for f in schema.BOOK_FIELDS})


def book_factors(
    frame: DataFrame,
    micro_price_levels: Sequence[int] = (1,),
    relative_spread_levels: Sequence[int] = (1,),
    oir_depths: Sequence[int] = (1, 5),
    book_slope_depths: Sequence[int] = (5,),
    flow_levels: Sequence[int] = (1,),
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Add the snapshot factors; one exchange for the lag window, one projection."""
    schema.check_snapshot(frame, max([*micro_price_levels, *relative_spread_levels, *oir_depths, *book_slope_depths, *flow_levels]))
    added = {f"micro_price_{k}": X.micro_price(k) for k in micro_price_levels}
    added |= {f"relative_spread_{k}": X.relative_spread(k) for k in relative_spread_levels}
    added |= {f"oir_{k}": X.oir(k) for k in oir_depths} | {f"book_slope_{k}": X.book_slope(k) for k in book_slope_depths}
    added |= {f"voi_{k}": X.voi(k) for k in flow_levels} | {f"ofi_{k}": X.ofi(k) for k in flow_levels}
    lagged = lags(frame, flow_levels, tiebreak)
    return lagged.select(*frame.columns, X.opaque(added))


def trade_imbalance(trades: DataFrame, window_ms: int = 3000, windows=X.AUCTION_WINDOWS) -> DataFrame:
    """Signed volume imbalance of each right-closed bucket: symbol, trading_day, bucket_ms, trade_imbalance_3s. Side 0 is positive."""
    schema.check_trades(trades)
    kept = trades.where(X.in_windows(windows)).where(X.clean_trade())
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("volume")).otherwise(0.0))
    sums = kept.groupBy(*DAY, X.bucket_end(X.clock_ms(), window_ms).alias("bucket_ms")).agg(side(0).alias("v0"), side(1).alias("v1"))
    return sums.select(*DAY, "bucket_ms", X.safe_divide(F.col("v0") - F.col("v1"), F.col("v1") + F.col("v0")).alias("trade_imbalance_3s"))


def with_trade_imbalance(snapshots: DataFrame, imbalance: DataFrame) -> DataFrame:
    """Left join on symbol, day and the bucket that ends at the snapshot; the right side has one row a key."""
    left = snapshots.withColumn("bucket_ms", X.clock_ms())
    return left.join(imbalance, [*DAY, "bucket_ms"], "left").select(*snapshots.columns, "trade_imbalance_3s")


def unpaired(snapshots: DataFrame, trades: DataFrame) -> DataFrame:
    """Symbols and months of snapshots without any trade."""
    keys = ["symbol", "source_month"]
    return snapshots.select(*keys).distinct().join(trades.select(*keys).distinct(), keys, "left_anti")
