"""Exact quantiles of groups of any size.

Spark's percentile and median hold all distinct values of a group in one task. Here equal values are counted first, the
counts are dealt to parts by ranges of (group, value), and running sums over the parts give every value its ranks. A quantile
is then picked by rank, and no task sees more than its part, however few groups there are.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators.scans import Running, dealt


def ranked_values(df: DataFrame, *, group: list[str], value: str, count: str | None = None) -> DataFrame:
    """(group, value, _c, _upto, _n): each group's distinct values, how often they occur, how many rows are not above, and all rows.

    Nulls don't count. count: a column of how many rows a row stands for. The table is written once.
    """
    times = F.sum(count) if count else F.count("*")
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(times.alias("_c"))
    key = group or ["_all"]
    rows = dealt(counts if group else counts.withColumn("_all", F.lit(0)), key=key, order=[value])
    rows = rows.running(_upto=Running("sum", F.col("_c"), own=True)).running(ahead=True, _above=Running("sum", F.col("_c"))).rows
    return rows.withColumn("_n", F.col("_upto") + F.coalesce("_above", F.lit(0))).drop("_part", "_above", *([] if group else ["_all"]))


def at_rank(rank: Column, value: str) -> Column:
    """An aggregate over ranked values: the value at a rank from 0."""
    return F.max(F.when((rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_c")), F.col(value)))


def quantile(p: float, value: str) -> Column:
    """An aggregate over ranked values: the quantile between the two nearest ranks, in proportion."""
    place = F.lit(p) * (F.col("_n") - 1)
    low, high = at_rank(F.floor(place), value), at_rank(F.ceil(place), value)
    part = F.max(place - F.floor(place))
    return F.when(low == high, low.cast("double")).otherwise((1 - part) * low + part * high)


def quantiles(df: DataFrame, *, group: list[str], value: str, named: dict[str, float], more: dict[str, Column] | None = None) -> DataFrame:
    """(group, a column for each quantile, and `more`, aggregates over ranked values), one row a group that has values."""
    rows = ranked_values(df, group=group, value=value)
    return rows.groupBy(*group).agg(*[quantile(p, value).alias(n) for n, p in named.items()], *[c.alias(n) for n, c in (more or {}).items()])


def beside(df: DataFrame, other: DataFrame, group: list[str], how: str = "inner") -> DataFrame:
    """df with the columns of other, which has one row a group; null groups meet, too."""
    if not group:
        return df.crossJoin(F.broadcast(other))  # one row
    named = other.withColumnsRenamed({c: f"_g{i}" for i, c in enumerate(group)})
    meet = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)])
    return df.join(named, meet, how).drop(*[f"_g{i}" for i in range(len(group))])


def with_quantiles(out: DataFrame, df: DataFrame, *, group: list[str], value: str, named: dict[str, float]) -> DataFrame:
    """out, one row a group of df, with quantiles of a value; null for groups without any."""
    return beside(out, quantiles(df, group=group, value=value, named=named), group, "left")
