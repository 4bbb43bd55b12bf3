"""Column expressions: quotes, book factors, integer clock, trade buckets, sessions, quantile groups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Continuous-auction windows as HHMMSSmmm, both ends included.
AUCTION_WINDOWS = ((93000000, 113000000), (130000000, 145700000))


def safe_divide(n: Column, d: Column) -> Column:
    """n / d where d > 0, else NULL (safe under ANSI mode)."""
    return F.when(d > 0, n / d)


def _book(field: str, level: int, prefix: str = "") -> Column:
    return F.col(f"{prefix}{field}_{level}")


def valid_quote(level: int = 1, prefix: str = "") -> Column:
    """Both prices there, positive and not crossed."""
    bid, ask = _book("bid_price", level, prefix), _book("ask_price", level, prefix)
    return bid.isNotNull() & ask.isNotNull() & (bid > 0) & (ask > 0) & (ask >= bid)


def mid_price(level: int = 1) -> Column:
    return (_book("bid_price", level) + _book("ask_price", level)) / 2


def micro_price(level: int = 1) -> Column:
    bid, ask, bid_v, ask_v = (_book(f, level) for f in ("bid_price", "ask_price", "bid_volume", "ask_volume"))
    return F.when(valid_quote(level), safe_divide(bid * ask_v + ask * bid_v, bid_v + ask_v))


def relative_spread(level: int = 1) -> Column:
    return F.when(valid_quote(level), safe_divide(_book("ask_price", level) - _book("bid_price", level), mid_price(level)))


def _total(terms: Sequence[Column]) -> Column:
    return reduce(add, terms)


def oir(depth: int) -> Column:
    """Order imbalance of the first levels; a missing volume counts as none, quotes aren't checked."""
    bid, ask = (_total([F.coalesce(_book(f, k), F.lit(0.0)) for k in range(1, depth + 1)]) for f in ("bid_volume", "ask_volume"))
    return safe_divide(bid - ask, bid + ask)


def book_slope(depth: int = 5) -> Column:
    """Imbalance of pressure, volume over distance from the middle, of the first levels."""
    mid = mid_price(1)

    def pressure(side: str) -> Column:
        terms = []
        for k in range(1, depth + 1):
            price, volume = _book(f"{side}_price", k), _book(f"{side}_volume", k)
            distance = mid - price if side == "bid" else price - mid
            terms.append(F.when(price.isNotNull() & volume.isNotNull() & (volume > 0) & (distance > 0), volume / distance).otherwise(0.0))
        return _total(terms)

    bid, ask = pressure("bid"), pressure("ask")
    return F.when(valid_quote(1), safe_divide(bid - ask, bid + ask))


def voi(level: int = 1, prev: str = "prev_") -> Column:
    """Volume order imbalance against the row before, where both prices stand still."""
    now, old = (lambda f: _book(f, level)), (lambda f: _book(f, level, prev))
    still = valid_quote(level) & valid_quote(level, prev) & (now("bid_price") == old("bid_price")) & (now("ask_price") == old("ask_price"))
    return F.when(still, (now("bid_volume") - old("bid_volume")) - (now("ask_volume") - old("ask_volume")))


def ofi(level: int = 1, prev: str = "prev_") -> Column:
    """Order flow imbalance against the row before."""
    now, old = (lambda f: _book(f, level)), (lambda f: _book(f, level, prev))
    arm = lambda taken, v: F.when(taken, v).otherwise(0.0)
    bid = arm(now("bid_price") >= old("bid_price"), now("bid_volume")) - arm(now("bid_price") <= old("bid_price"), old("bid_volume"))
    ask = arm(now("ask_price") <= old("ask_price"), now("ask_volume")) - arm(now("ask_price") >= old("ask_price"), old("ask_volume"))
    return F.when(valid_quote(level) & valid_quote(level, prev), bid - ask)


def clock_ms(time: Column | str = "event_time") -> Column:
    """HHMMSSmmm as milliseconds since midnight."""
    t = (F.col(time) if isinstance(time, str) else time).cast("long")
    part = lambda unit, n: F.call_function("mod", F.floor(t / unit), F.lit(n))
    return F.floor(t / 10_000_000) * 3_600_000 + part(100_000, 100) * 60_000 + part(1_000, 100) * 1_000 + t % 1_000


def bucket_end(ms: Column, window_ms: int) -> Column:
    """End of the right-closed bucket (end - window, end] that holds ms."""
    return F.when(ms % window_ms == 0, ms).otherwise((F.floor(ms / window_ms) + 1) * window_ms)


def in_windows(windows: Sequence[tuple[int, int]] = AUCTION_WINDOWS, time: str = "event_time") -> Column:
    """Inside any of the windows; on the bare column, so that scans can skip row groups."""
    if not windows:
        raise ValueError("at least one window is needed")
    return reduce(or_, [F.col(time).between(a, b) for a, b in windows])


def session(time: str = "event_time", windows: Sequence[tuple[int, int]] = AUCTION_WINDOWS) -> Column:
    (am, pm), t = windows, F.col(time)
    return F.when(t.between(*am), "am").when(t.between(*pm), "pm").otherwise("off_session")


def clean_trade() -> Column:
    """Trades that count: positive price and volume, a known side."""
    return reduce(and_, [F.col("price") > 0, F.col("volume").isNotNull(), F.col("volume") > 0, F.col("side").isin(0, 1)])


def quantile_group(rank: Column, n: Column, groups: int) -> Column:
    """Group 1 to ``groups`` of a row's 1-based rank among n; sizes differ from ntile's where n isn't divisible."""
    return F.least(F.greatest(F.floor((rank - 1.0) * groups / n).cast("int") + 1, F.lit(1)), F.lit(groups))


def zero_padded(number: Column, width: int = 6) -> Column:
    """Padded to width; longer numbers stay whole, which lpad alone would cut."""
    s = number.cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def month_of(day: str = "trading_day") -> Column:
    return F.substring(F.col(day).cast("string"), 1, 6)


def family(name: Column) -> Column:
    """A factor's name up to its first numbered part."""
    return F.regexp_replace(name, "_[0-9].*$", "")


def opaque(columns: dict[str, Column]) -> Column:
    """Named columns as a generator's output: filters aren't pushed through it and constraints not derived from it.

    Catalyst otherwise substitutes whole factor expressions into filters and constraints of later steps, which grows
    until the driver runs out of memory.
    """
    return F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
