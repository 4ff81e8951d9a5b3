"""Positional windows along sequences, outliers and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.quantiles import beside, quantiles, ranked_values, with_quantiles
from loomspan.session import kept, small


def grid(sizes: DataFrame, *, seq: str, start: str, end: str, step: int, width: int | None = None) -> DataFrame:
    """(seq, window, window_begin, window_end): windows every `step` from start to end; the last is cut at the end."""
    width = width or step
    n = F.greatest(F.ceil((F.col(end) - F.col(start)) / step).cast("int"), F.lit(1))
    rows = sizes.select(seq, start, end, F.explode(F.sequence(F.lit(0), n - 1)).alias("window"))
    low = (F.col(start) + F.col("window") * step).alias("window_begin")
    return rows.select(seq, "window", low, F.least(F.col(start) + F.col("window") * step + width, F.col(end)).alias("window_end"))


def by_midpoint(df: DataFrame, sizes: DataFrame, *, seq: str, begin: str, end: str, weight: str, start: str, stop: str, width: int) -> DataFrame:
    """(seq, window, window_begin, window_end, total): weights summed by the window of an interval's midpoint; 0 if none."""
    sizes = kept(sizes)  # read for its count, for the rows' places and for the grid
    placed = df.join(small(sizes.select(seq, F.col(start).alias("_s"))), seq)
    sums = placed.groupBy(seq, F.floor(((F.col(begin) + F.col(end)) / 2 - F.col("_s")) / width).cast("int").alias("window")).agg(F.sum(weight).alias("total"))
    return grid(sizes, seq=seq, start=start, end=stop, step=width).join(sums, [seq, "window"], "left").withColumn("total", F.coalesce("total", F.lit(0)))


def jumping(df: DataFrame, sizes: DataFrame, *, seq: str, begin: str, length: str, values: list[str], stop: str, width: int, jump: int, inclusive: bool = False) -> DataFrame:
    """Windows of a width with a gap of `jump` between: count, bases, and median, mean and deviation of each value.

    A row is in a window if its begin lies strictly inside (inclusive: at its edges too). Empty windows hold zeros, and the
    deviation of a single row is 0.
    """
    step = width + jump
    at = F.col(begin) % step
    inside = (at <= width) if inclusive else (at > 0) & (at < width)
    rows = df.where(inside).withColumn("window", F.floor(F.col(begin) / step).cast("int"))
    aggs = [F.count("*").alias("count"), F.sum(length).alias("bp")]
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_sd")]
    sums = rows.groupBy(seq, "window").agg(*aggs)
    for v in values:
        sums = with_quantiles(sums, rows, group=[seq, "window"], value=v, named={f"{v}_median": 0.5})
    sized = sizes.withColumn("_zero", F.lit(0))
    out = grid(sized, seq=seq, start="_zero", end=stop, step=step, width=width).join(sums, [seq, "window"], "left")
    return out.na.fill(0, [c for c in out.columns if c not in (seq, "window", "window_begin", "window_end")])


def band(mean: str, sd: str) -> tuple[Column, Column]:
    """Mean plus and minus a deviation, the lower end not below 0."""
    return F.greatest(F.col(mean) - F.col(sd), F.lit(0)), F.col(mean) + F.col(sd)


def counted(df: DataFrame, sizes: DataFrame, *, seq: str, position: str, start: str, stop: str, width: int, classes: dict[str, Column]) -> DataFrame:
    """(seq, window, window_begin, window_end, one count per class, total) of rows by the window of their position."""
    sizes = kept(sizes)  # read for its count, for the rows' places and for the grid
    placed = df.join(small(sizes.select(seq, F.col(start).alias("_s"))), seq).withColumn("window", F.floor((F.col(position) - F.col("_s")) / width).cast("int"))
    sums = placed.groupBy(seq, "window").agg(*[F.count_if(c).alias(n) for n, c in classes.items()], F.count("*").alias("total"))
    out = grid(sizes, seq=seq, start=start, end=stop, step=width).join(sums, [seq, "window"], "left")
    return out.na.fill(0, [*classes, "total"])


def outliers(df: DataFrame, *, group: list[str], value: str, factor: float = 1.5) -> DataFrame:
    """df with outlier: 'high' or 'low' beyond factor interquartile ranges (linear quantiles) of its group, else null."""
    cuts = quantiles(df, group=group, value=value, named={"_low": 0.25, "_high": 0.75})
    rows = beside(df.dropna(subset=group) if group else df, cuts, group, "left")
    low, high = F.col("_low"), F.col("_high")
    far = factor * (high - low)
    told = F.when(F.col(value) > high + far, "high").when(F.col(value) < low - far, "low")
    return rows.withColumn("outlier", told).drop("_low", "_high")


def max_normalised(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with columns divided by their maxima (null where that is 0)."""
    top = df.agg(*[F.max(c).alias(f"_{c}") for c in columns])
    rows = df.crossJoin(F.broadcast(top))  # one row
    return rows.withColumns({c: F.when(F.col(f"_{c}") != 0, F.col(c) / F.col(f"_{c}")) for c in columns}).drop(*[f"_{c}" for c in columns])


def without_top(df: DataFrame, value: str, k: int) -> DataFrame:
    """df without rows that hold one of its k largest distinct values."""
    top = df.select(value).distinct().orderBy(F.desc(value)).limit(k)
    return df.join(small(top), value, "left_anti")


def cut_offs(df: DataFrame, *, group: list[str], value: str, percents: list[float]) -> DataFrame:
    """(group, mean, low_p, high_p): the values at place int(n p / 200) from either end of the sorted values, for each p.

    Values are counted first, so that what is sorted by group is distinct values.
    """
    rows = ranked_values(df, group=group, value=value)
    at = lambda k: F.min(F.when(F.col("_upto") > k, F.col(value)))
    aggs = [(F.sum(F.col(value) * F.col("_c")) / F.sum("_c")).alias("mean")]
    for p in percents:
        k = F.floor(F.col("_n") * p / 200)
        aggs += [at(k).alias(f"low_{p:g}"), at(F.col("_n") - 1 - k).alias(f"high_{p:g}")]
    return rows.groupBy(*group).agg(*aggs)


def concatenated_axis(df: DataFrame, *, seq: str, position: str, order: str) -> DataFrame:
    """df with `axis`: position after the last positions of all sequences before it (by an order column, one value a sequence)."""
    ends = df.groupBy(seq).agg(F.max(position).alias("_m"), F.min(order).alias("_o"))
    w = Window.orderBy("_o", seq).rowsBetween(Window.unboundedPreceding, -1)  # one row a sequence
    starts = ends.select(seq, F.coalesce(F.sum("_m").over(w), F.lit(0)).alias("_before"))
    return df.join(starts, seq).withColumn("axis", F.col(position) + F.col("_before")).drop("_before")


def jumping_by_class(df: DataFrame, sizes: DataFrame, *, seq: str, begin: str, length: str, stop: str, width: int, jump: int, classes: list[str]) -> DataFrame:
    """(seq, window, window_begin, window_end, level, name, count, bp): inclusive jumping windows for each value of each class column.

    A row counts if its begin modulo width + jump is at most the width. Windows without rows of a class have none.
    """
    step = width + jump
    rows = df.where(F.col(begin) % step <= width).withColumn("window", F.floor(F.col(begin) / step).cast("int"))
    each = rows.select(seq, "window", length, F.explode(F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("name")) for c in classes])).alias("c"))
    sums = each.where("c.name is not null").groupBy(seq, "window", F.col("c.level").alias("level"), F.col("c.name").alias("name")).agg(F.count("*").alias("count"), F.sum(length).alias("bp"))
    return grid(sizes.withColumn("_zero", F.lit(0)), seq=seq, start="_zero", end=stop, step=step, width=width).join(sums, [seq, "window"])


def special_windows(df: DataFrame, *, seq: str, window: str, own: str, other: str, least: int = 300) -> DataFrame:
    """(seq, window, special): whether a window holds a row whose own or other copy number reaches a bound."""
    return df.groupBy(seq, window).agg(F.coalesce(F.bool_or((F.col(own) >= least) | (F.col(other) >= least)), F.lit(False)).alias("special"))


def outlier_summary(df: DataFrame, *, group: list[str], columns: list[str], factor: float = 1.5) -> DataFrame:
    """(group, column, n, sum, mean, median, max, high, low): each column's statistics and its numbers of outliers on either side."""
    rows = df.select(*group, F.expr(f"stack({len(columns)}, {', '.join(f'{c!r}, cast({c} as double)' for c in columns)}) as (column, value)"))
    keys = [*group, "column"]
    told = outliers(rows.where("value is not null"), group=keys, value="value", factor=factor)
    out = told.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum("value").alias("sum"),
        F.avg("value").alias("mean"),
        F.max("value").alias("max"),
        F.count_if(F.col("outlier") == "high").alias("high"),
        F.count_if(F.col("outlier") == "low").alias("low"),
    )
    return with_quantiles(out, rows, group=keys, value="value", named={"median": 0.5}).select(*keys, "n", "sum", "mean", "median", "max", "high", "low")


def relation_windows(df: DataFrame, sizes: DataFrame, *, seq: str, position: str, start: str, stop: str, width: int, relation: str, tier: str) -> DataFrame:
    """(seq, window, window_begin, window_end, relation, tier, count): points by window, relation of copy numbers and evidence tier."""
    sizes = kept(sizes)  # read for its count, for the rows' places and for the grid
    placed = df.join(small(sizes.select(seq, F.col(start).alias("_s"))), seq).withColumn("window", F.floor((F.col(position) - F.col("_s")) / width).cast("int"))
    sums = placed.groupBy(seq, "window", relation, tier).agg(F.count("*").alias("count"))
    return grid(sizes, seq=seq, start=start, end=stop, step=width).join(sums, [seq, "window"])


def one_sided_windows(df: DataFrame, sizes: DataFrame, *, seq: str, position: str, start: str, stop: str, width: int, own: str, other: str) -> DataFrame:
    """Windows with numbers of genes that the other species lacks: single (1:0) and several (n:0) copies, and their total."""
    lone = df.where(F.col(other) == 0)
    return counted(lone, sizes, seq=seq, position=position, start=start, stop=stop, width=width, classes={"single": F.col(own) == 1, "several": F.col(own) > 1})
