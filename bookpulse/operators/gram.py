"""Rank correlations of all pairs of many columns at each stamp: one exchange of the rows as they are.

A pair is ranked over the rows where both its columns have values, so a column's ranks depend on its partner only through
the partner's NULLs. Columns that are NULL in the same rows of a stamp form a class; a column is ranked once for each
class it meets, not once for each partner. Which columns agree is found exactly: a row's NULLs are bits, and the bitwise
sum over a stamp of the bits that differ from a column's own names all columns that differ from it somewhere.

Rows are dealt by stamp once. Bits, ranks, the gathering of a row's ranks and the sums of their cross products all keep
that dealing, so F columns move F values a row, and the F * F products are made and summed where the rows are.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookpulse.functions import stats as S

#: Bits of a word of NULL flags (a long's, less its sign).
WORD = 63


def _words(nulls: list[Column]) -> list[Column]:
    """NULL flags as bits, WORD of them a long."""
    bit = lambda k, c: F.when(c, F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
    out = []
    for i in range(0, len(nulls), WORD):
        word = F.lit(0).cast("long")
        for k, c in enumerate(nulls[i : i + WORD]):
            word = word.bitwiseOR(bit(k, c))
        out.append(word)
    return out


def classed(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """keys, _row, _v (values) and _class (for each column the number of the first column that is NULL in the same rows of the stamp)."""
    rows = df.select(*keys, F.monotonically_increasing_id().alias("_row"), F.array(*(F.col(c).cast("double") for c in columns)).alias("_v")).repartition(*keys)
    null = lambda k: F.get("_v", F.lit(k)).isNull()
    words = [f"_w{i}" for i in range(-(-len(columns) // WORD))]
    rows = rows.withColumns(dict(zip(words, _words([null(k) for k in range(len(columns))]))))
    stamp = Window.partitionBy(*keys)
    differs = lambda k: [F.bit_or(F.when(null(k), F.bitwise_not(w)).otherwise(F.col(w))).over(stamp) for w in words]
    rows = rows.withColumns({f"_d{k}_{i}": d for k in range(len(columns)) for i, d in enumerate(differs(k))})

    def first(k: int) -> Column:
        """The lowest bit that isn't set among those that differ from column k; k's own never is."""
        ones = lambda w: F.bit_count(F.col(w).bitwiseAND(F.bitwise_not(F.col(w) + 1)))  # noqa: E731  below the lowest zero
        found = ones(f"_d{k}_{len(words) - 1}") + WORD * (len(words) - 1)
        for i in reversed(range(len(words) - 1)):
            w = f"_d{k}_{i}"
            full = F.col(w).bitwiseAND(F.lit((1 << WORD) - 1)) == (1 << WORD) - 1
            found = F.when(full, found).otherwise(ones(w) + WORD * i)
        return found.cast("int")

    return rows.select(*keys, "_row", "_v", F.array(*map(first, range(len(columns)))).alias("_class"))


def rank_statistics(df: DataFrame, columns: Sequence[str], keys: Sequence[str], left: str, right: str) -> DataFrame:
    """keys, ``left`` and ``right`` (columns in the order given), n_obs, x_n_unique, y_n_unique, corr: a row for each pair at each stamp.

    n_obs and what follows is NULL where no row has both values.
    """
    n, by = len(columns), [*keys, "_f", "_c"]
    rows = classed(df, columns, keys)
    # A row's cells: each of its columns with each class whose columns have values in the row as well.
    cells = f"""filter(flatten(transform(sequence(0, {n - 1}), f -> transform(array_distinct(_class), c -> named_struct('_f', f, '_c', c, '_x', if(get(_v, c) is null, null, get(_v, f)))))), s -> s._x is not null)"""
    long = rows.select(*keys, "_row", "_class", F.inline_outer(F.expr(cells)))
    whole, here = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_x")
    ranked = long.select(
        *keys, "_row", "_class", "_f", "_c", F.dense_rank().over(here).alias("_dense"),
        (S.average_rank("_x", by) - (F.count("*").over(whole) + 1) / 2).alias("_r"),
    )
    # (a row's cells come together again where they are; its classes are the same in all)
    gathered = ranked.groupBy(*keys, "_row").agg(
        F.first("_class").alias("_class"), F.map_from_entries(F.collect_list(F.when(F.col("_f").isNotNull(), F.struct((F.col("_f") * n + F.col("_c")).alias("k"), F.struct("_r", "_dense").alias("v"))))).alias("_m")
    )
    pair = lambda i, j: F.struct(F.lit(columns[i]).alias(left), F.lit(columns[j]).alias(right), F.lit(i).alias("_i"), F.lit(j).alias("_j"))
    pairs = gathered.select(*keys, "_m", "_class", F.inline(F.array(*(pair(i, j) for i, j in combinations(range(n), 2)))))
    at = lambda a, b: F.try_element_at("_m", (F.col(a) * n + F.get("_class", F.col(b))).cast("int"))
    met = pairs.select(*keys, left, right, at("_i", "_j").alias("_p"), at("_j", "_i").alias("_q"))
    x, y = F.col("_p._r"), F.col("_q._r")
    sums = met.groupBy(*keys, left, right).agg(
        F.count("_p").alias("_n"), F.max("_p._dense").alias("_dx"), F.max("_q._dense").alias("_dy"), F.sum(x * y).alias("_xy"), F.sum(x * x).alias("_xx"), F.sum(y * y).alias("_yy"),
    )
    some = lambda c: F.when(F.col("_n") > 0, F.col(c)).cast("long")
    corr = S.quotient(F.col("_xy"), F.sqrt("_xx") * F.sqrt("_yy"))
    return sums.select(*keys, left, right, some("_n").alias("n_obs"), some("_dx").alias("x_n_unique"), some("_dy").alias("y_n_unique"), corr.alias("corr"))
