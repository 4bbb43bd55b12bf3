"""Ranks, rank correlations and quantile groups of groups that no task can hold, from one sort by range over all tasks.

Rows are sorted by range of (group, value, tie-break), so that a group lies in as many tasks as it needs. Each part of a
group is numbered by itself and moved by what stands in the parts before, of which there is one row for a part and group.
The number of parts follows the number of rows (about ``PART_ROWS`` each), and so does that of the tasks that number them,
so a task's memory doesn't grow with the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookpulse.functions import exprs as X
from bookpulse.functions import stats as S
from bookpulse.operators import schema
from bookpulse.sources.tables import materialize


#: Rows of a part, about. The number of parts is given to Spark: where it isn't, adaptive execution joins partitions by
#: their compressed bytes, and rows that compress well end up in few tasks.
PART_ROWS = 250_000


def _parts(df: DataFrame, rows: int) -> int:
    """Parts of ``rows`` rows; one a core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // PART_ROWS))


def _dealt(rows: DataFrame, parts: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows, written in parts by range of ``by`` and ``order``; rows equal in these are in one part.

    Columns: _part, and _at, which rises with ``by`` and ``order`` by one a row inside a part.
    (Written, as both readings have to see the same parts.)
    """
    placed = rows.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order)
    return materialize(placed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))


def _offsets(placed: DataFrame, by: Sequence[str], weight: Column) -> DataFrame:
    """by, _part, _first (lowest _at of the group in the part), _before (weight of the group's parts before), _size (weight of the group).

    Written, so that Spark knows how small it is and doesn't shuffle the rows to meet it.
    """
    parts = placed.groupBy(*by, "_part").agg(F.sum(weight).alias("_held"), F.min("_at").alias("_first"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_held").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return materialize(parts.select(*by, "_part", "_first", before.alias("_before"), F.sum("_held").over(group).alias("_size")))


def centred_ranks(counts: DataFrame, by: Sequence[str], value: str, into: str) -> DataFrame:
    """by, value, ``into`` (mean rank of the value less the group's middle rank) of values with their numbers n."""
    held = materialize(counts.groupBy(*by, value).agg(F.sum("n").alias("n")))
    parts = _parts(held, held.count())
    placed = _dealt(held, parts, by, [value])
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("_part", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = placed.drop("_at").repartition(parts, "_part").withColumn("_inside", inside).join(_offsets(placed, by, F.col("n")), [*by, "_part"])
    return ranked.select(*by, value, (F.col("_before") + F.col("_inside") + (F.col("n") + 1) / 2 - (F.col("_size") + 1) / 2).alias(into))


def ordinal(rows: DataFrame, by: Sequence[str], value: str, tiebreak: Sequence[str], least: int = 1, groups: int | None = None) -> DataFrame:
    """Rows whose value isn't NULL with ordinal (place by value, then tie-break, from 1 on) and n (size of the group).

    With ``groups`` also group_id. Groups of fewer than ``least`` rows are left out. Rows equal in value and tie-break
    have places next to each other in no certain order. Values are sorted once; every row is in one task of many.
    """
    schema.need(rows, [*by, value, *tiebreak])
    filled = rows.where(F.col(value).isNotNull())
    placed = _dealt(filled, _parts(filled, filled.count()), by, [value, *tiebreak])
    found = placed.join(_offsets(placed, by, F.lit(1)).where(F.col("_size") >= least), [*by, "_part"])
    place = F.col("_before") + F.col("_at") - F.col("_first") + 1
    found = found.select(*rows.columns, place.cast("long").alias("ordinal"), F.col("_size").cast("long").alias("n"))
    return found if groups is None else found.withColumn("group_id", X.quantile_group(F.col("ordinal"), F.col("n"), groups))


def _labelled(rows: DataFrame, factors: Sequence[str], label: str, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """keys, _context, the factors, _part, _dense and _ry (the label's centred mean ranks), and the factors with a context of their own.

    Ranks are made once for all factors that have values wherever the label has, and once for each of the others.
    """
    n, *gaps = rows.agg(F.count(label), *(F.count_if(F.col(label).isNotNull() & F.col(f).isNull()) for f in factors)).first()
    holed = [f for f, gap in zip(factors, gaps) if gap]
    contexts = [F.struct(F.lit("").alias("_context"), F.lit(True).alias("_in"))] * (len(holed) < len(factors))
    contexts += [F.struct(F.lit(f).alias("_context"), F.col(f).isNotNull().alias("_in")) for f in holed]
    cells = rows.where(F.col(label).isNotNull()).select(*keys, *(F.col(f).cast("double").alias(f) for f in factors), F.col(label).cast("double").alias("_y"), F.inline(F.array(*contexts))).where("_in").drop("_in")
    by, parts = [*keys, "_context"], _parts(rows, n * len(contexts) - sum(gaps))
    placed = _dealt(cells, parts, by, ["_y"])
    here = Window.partitionBy("_part", *by).orderBy("_y")
    mean = (F.rank().over(here) + F.count("*").over(here.rangeBetween(Window.unboundedPreceding, Window.currentRow))) / 2  # of equal values' first and last place
    found = placed.drop("_at").repartition(parts, "_part").withColumns({"_inside": mean, "_dense": F.dense_rank().over(here)}).join(_offsets(placed, by, F.lit(1)), [*by, "_part"])
    return found.withColumn("_ry", F.col("_before") + F.col("_inside") - (F.col("_size") + 1) / 2).drop("_first", "_before", "_inside", "_size", "_y"), holed


def rank_statistics(df: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str], left: str = "factor", right: str = "label") -> DataFrame:
    """As ``evaluate.rank_statistics``: keys, pair, n_obs, x_n_unique, y_n_unique, corr; for groups of any size.

    A label's rows are sorted by range once, for all factors without gaps; a factor's distinct values are counted, which
    combines before the shuffle, and ranked as a table of their own, which Spark sends to all tasks where it is small.
    """
    parts = []
    for label in dict.fromkeys(y for _, y in pairs):
        factors = [f for f, y in pairs if y == label]
        rows, holed = _labelled(df.select(*keys, *dict.fromkeys([*factors, label])), factors, label, keys)
        own = lambda f: F.col("_context") == (f if f in holed else "")
        cells = F.inline(F.array(*(F.struct(F.lit(f).alias(left), F.when(own(f), F.col(f)).alias("_x")) for f in factors)))
        filled = df.where(F.col(label).isNotNull()).select(*keys, F.inline(F.array(*(F.struct(F.lit(f).alias(left), F.col(f).cast("double").alias("_x")) for f in factors)))).where("_x is not null")
        ranks = materialize(centred_ranks(filled.groupBy(*keys, left, "_x").agg(F.count("*").alias("n")), [*keys, left], "_x", "_rx"))
        met = rows.select(*keys, "_part", "_dense", "_ry", cells).where("_x is not null").join(ranks, [*keys, left, "_x"])
        # (a label's equal values are in one part, so its distinct values are those of its parts together)
        x, y = F.col("_rx"), F.col("_ry")
        here = met.groupBy(*keys, left, "_part").agg(F.count("*").alias("n"), F.max("_dense").alias("d"), F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"))
        sums = here.groupBy(*keys, left).agg(F.sum("n").alias("n_obs"), F.sum("d").cast("long").alias("y_n_unique"), *(F.sum(c).alias(c) for c in ("xy", "xx", "yy")))
        unique = ranks.groupBy(*keys, left).agg(F.count("*").alias("x_n_unique"))
        corr = S.quotient(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")).alias("corr")
        parts.append(sums.join(unique, [*keys, left]).select(*keys, left, F.lit(label).alias(right), "n_obs", "x_n_unique", "y_n_unique", corr))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
