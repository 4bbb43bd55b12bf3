"""Forward returns by a forward as-of join within symbol and day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookpulse.functions import exprs as X
from bookpulse.operators import schema
from bookpulse.operators.factors import DAY
from bookpulse.sources.tables import materialize


def base_price(df: DataFrame, price: str = "mid_price_1") -> Column:
    """The named price, or the middle of valid quotes where mid_price_1 isn't a column."""
    if price in df.columns:
        return F.col(price).cast("double")
    return F.when(X.valid_quote(1), X.mid_price(1))


def asof_forward(probes: DataFrame, builds: DataFrame, by: Sequence[str], at: str, time: str, carry: Sequence[str], tiebreak: Sequence[str] = ()) -> DataFrame:
    """For each probe the first build row with ``time`` >= ``at``: adds the columns ``carry`` (NULL if there is none); keeps all probes.

    Of builds at one time the smallest by tie-break, then by what is carried, is the match; a match whose carried values
    are NULL is one, and no later row is tried. A probe without a time, or with a NULL in ``by``, has none.

    Probes and builds are one union, dealt by range of (by, time), so that a day of any size lies in as many tasks as it
    needs. Inside a part the match is what a minimum over the later times has seen. Where a part has none, it is the first
    build of the nearest later part of the same ``by``: each part's first build, one row for a part and day, is carried
    backward over the boundaries.
    """
    keys, row = [f"_by{i}" for i in range(len(by))], F.struct(*(F.col(c) for c in probes.columns))
    build = F.struct(F.col(time).alias("_t"), *(F.col(c).alias(f"_tie{i}") for i, c in enumerate(tiebreak)), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)))
    dealt = lambda df, t: [*(F.col(c).alias(k) for c, k in zip(by, keys)), F.col(t).cast("long").alias("_k")]
    left = probes.select(*dealt(probes, at), row.alias("_row"))
    right = builds.where(F.col(time).isNotNull()).select(*dealt(builds, time), build.alias("_build"))
    both = left.unionByName(right, allowMissingColumns=True)
    # (written, as both readings below have to see the same parts; rows equal in by and time are in one part)
    placed = materialize(both.repartitionByRange(*keys, "_k").withColumn("_part", F.spark_partition_id()))
    here = Window.partitionBy("_part", *keys).orderBy(F.desc("_k")).rangeBetween(Window.unboundedPreceding, 0)
    seen = placed.withColumn("_hit", F.min("_build").over(here)).where("_row is not null").drop("_build")
    first = placed.groupBy(*keys, "_part").agg(F.min("_build").alias("_b"))
    after = Window.partitionBy(*keys).orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    later = first.select(*keys, "_part", F.first("_b", ignorenulls=True).over(after).alias("_later")).where("_later is not null")
    found = seen.join(later, [*keys, "_part"], "left").withColumn("_match", F.when(F.array_position(F.array(*(F.col(k).isNull() for k in (*keys, "_k"))), True) == 0, F.coalesce("_hit", "_later")))
    return found.select("_row.*", *(F.col(f"_match._c{i}").alias(c) for i, c in enumerate(carry)))


def forward_returns(frame: DataFrame, horizons_ms: Sequence[int] = (3000, 30000), price: str = "mid_price_1", tiebreak: Sequence[str] = ()) -> DataFrame:
    """Add label_time_ms_{h}ms, label_price_{h}ms and fwd_ret_{h}ms for each horizon.

    The match is by time only: a matched row without a valid price gives NULL, and no later row is tried; of rows at one
    time the smallest by ``tiebreak``, then by price counts. The day is a wall, the lunch break isn't. A frame that is
    matched with itself needs no union: sorted downwards by time, a horizon's match is the minimum of what stands a
    horizon or more before a row, which runs along. One exchange and one sort for all horizons.
    """
    schema.check_labels(frame, price)
    steps = schema.horizons(horizons_ms)
    timed = frame.select("*", X.opaque({"_t": X.clock_ms(), "_p": base_price(frame, price)}))
    w = Window.partitionBy(*DAY).orderBy(F.desc("_t"))
    row = F.when(F.col("_t").isNotNull(), F.struct("_t", *tiebreak, "_p"))
    found = timed.withColumns({f"_at_{h}": F.min(row).over(w.rangeBetween(Window.unboundedPreceding, -h)) for h in steps})
    # (a generator is given plain columns: Catalyst loses count of its input's columns when it prunes a struct below one)
    at = lambda h, field: F.when(F.col("_t").isNotNull(), F.col(f"_at_{h}.{field}")).alias(f"{field}_{h}")
    found = found.select(*frame.columns, "_t", "_p", *(at(h, field) for h in steps for field in ("_t", "_p")))
    added = {}
    for h in steps:
        later = F.col(f"_p_{h}")
        added |= {f"label_time_ms_{h}ms": F.col(f"_t_{h}"), f"label_price_{h}ms": later, f"fwd_ret_{h}ms": F.when((F.col("_p") > 0) & (later > 0), later / F.col("_p") - 1)}
    return found.select(*frame.columns, X.opaque(added))


def panel(frame: DataFrame, factors: Sequence[str] | None = None, labels: Sequence[str] | None = None, base: Sequence[str] = ("source_month",)) -> DataFrame:
    """Index, base, factor and label columns; order carries no meaning, so nothing is sorted."""
    index = ["trading_day", "event_time", "symbol"]
    f, y = schema.selections(frame, factors, labels, [*index, *base])
    return frame.select(*index, *base, *f, *y)
