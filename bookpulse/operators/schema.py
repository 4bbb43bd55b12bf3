"""Eager checks of schemas and parameters, and columns inferred from names. No check starts a job."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
BOOK_FIELDS = ("bid_price", "ask_price", "bid_volume", "ask_volume")
SORT_KEYS = ("symbol", "trading_day", "event_time")
TRADE_COLUMNS = ("symbol", "trading_day", "event_time", "price", "volume", "side")
FACTOR_PREFIXES = ("micro_price_", "relative_spread_", "oir_", "book_slope_", "voi_", "ofi_", "trade_imbalance_")
LABEL_PREFIX = "fwd_ret_"
PAIR_FIELDS = ("rank_ic", "n_obs", "factor_n_unique", "label_n_unique", "is_valid", "invalid_reason")


class SchemaError(ValueError):
    """A column is missing or has an unfit type."""


def need(df: DataFrame, columns: Iterable[str], numeric: Iterable[str] = ()) -> None:
    have = {f.name: f.dataType for f in df.schema}
    if missing := [c for c in columns if c not in have]:
        raise SchemaError(f"missing columns: {', '.join(sorted(missing))}")
    if odd := [c for c in numeric if not isinstance(have.get(c), NUMERIC)]:
        raise SchemaError(f"not numeric: {', '.join(sorted(odd))}")


def book_columns(depth: int) -> list[str]:
    return [f"{f}_{k}" for k in range(1, depth + 1) for f in BOOK_FIELDS]


def required_snapshot_columns(*levels: Iterable[int]) -> list[str]:
    return sorted([*SORT_KEYS, *book_columns(max(max(x) for x in levels))])


def check_snapshot(df: DataFrame, depth: int) -> None:
    need(df, [*SORT_KEYS, *book_columns(depth)], book_columns(depth))


def check_trades(df: DataFrame) -> None:
    need(df, TRADE_COLUMNS, TRADE_COLUMNS[1:])


def check_labels(df: DataFrame, price: str) -> None:
    quotes = ["bid_price_1", "ask_price_1"] if price == "mid_price_1" and price not in df.columns else [price]
    need(df, [*SORT_KEYS, *quotes], ["event_time", *quotes])


def horizons(values: Iterable[int]) -> list[int]:
    found = sorted({int(v) for v in values})
    if not found or found[0] <= 0:
        raise ValueError("horizons have to be positive, one at least")
    return found


def cross_section(value: int) -> int:
    if value <= 1:
        raise ValueError("a cross-section needs two rows at least")
    return value


def cross_sections(values: Iterable[int]) -> list[int]:
    return sorted({cross_section(v) for v in values})


def grouping_cross_section(least: int, groups: int) -> int:
    if groups < 2:
        raise ValueError("two groups at least are needed")
    return max(least, 2 * groups)


def selections(df: DataFrame, factors: Iterable[str] | None = None, labels: Iterable[str] | None = None, index: Iterable[str] = ()) -> tuple[list[str], list[str]]:
    """Factor and label columns, inferred by prefix and sorted where none are given."""
    f = list(factors or ()) or sorted(c for c in df.columns if c.startswith(FACTOR_PREFIXES))
    y = list(labels or ()) or sorted(c for c in df.columns if c.startswith(LABEL_PREFIX))
    if not f or not y:
        raise SchemaError("a factor and a label column are needed")
    need(df, [*index, *f, *y])
    return f, y


def factor_pairs(factors: list[str]) -> list[tuple[str, str]]:
    if len(factors) < 2:
        raise SchemaError("two factors at least are needed")
    return list(combinations(factors, 2))


def pairs_of_timeseries(df: DataFrame) -> tuple[list[str], list[str]]:
    """Factors and labels of a wide IC time series, from its column names; their whole product is required."""
    found = [c.split("__", 2)[1:] for c in df.columns if c.startswith("rank_ic__")]
    factors, labels = sorted({f for f, _ in found if f.startswith(FACTOR_PREFIXES)}), sorted({y for _, y in found if y.startswith(LABEL_PREFIX)})
    if not factors or not labels:
        raise SchemaError("no rank_ic__factor__label column")
    need(df, [f"{p}__{f}__{y}" for f in factors for y in labels for p in PAIR_FIELDS])
    return factors, labels
