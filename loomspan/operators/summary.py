"""Multi-level summaries: totals, complements, modes, shares, diversity, histograms. Every operator takes column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.quantiles import beside, quantile, quantiles, ranked_values, with_quantiles
from loomspan.session import kept


def mode_or_null(df: DataFrame, group: list[str], value: str, name: str = "mode_raw") -> DataFrame:
    """(group, name): the most frequent value; null if several are equally frequent."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c"))
    like = counts.groupBy(*group, "_c").agg(F.count("*").alias("_n"), F.max(value).alias("_v"))
    best = like.groupBy(*group).agg(F.max(F.struct("_c", "_n", "_v")).alias("_top"))
    return best.select(*group, F.when(F.col("_top._n") == 1, F.col("_top._v")).alias(name))


def summarised(df: DataFrame, *, keys: list[str], naive: str, algor: str, overlapping: str, value: str) -> DataFrame:
    """Per keys: counts, naive, resolved and best bases; median, mean and modes of a value, over all rows and the best rows.

    Best rows are those not flagged as overlapping. Groups with a null key, or without a best row, are left out.
    """
    best = ~F.col(overlapping)
    rows = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("naive_numele"),
        F.sum(naive).alias("naive_totbp"),
        F.sum(algor).alias("algor_totbp"),
        F.count_if(best).alias("best_numele"),
        F.sum(F.when(best, F.col(naive))).alias("best_totbp"),
        F.avg(value).alias("value_mean"),
        F.mode(F.floor(value), True).alias("mode_floor"),
    ).where("best_numele > 0")
    out = with_quantiles(sums, rows, group=keys, value=value, named={"value_median": 0.5})
    return out.join(mode_or_null(rows, keys, value), keys, "left")


def rolled_up(df: DataFrame, *, by: list[str], levels: list[str], measures: dict[str, Column]) -> DataFrame:
    """One pass over all prefixes of `levels` within `by`: by, levels, level (0: the total of by), measures.

    Rows with null levels count in totals, and in prefixes up to the first null only.
    """
    filled = df.withColumns({f"_{c}": F.col(c) for c in levels})
    sets = [[*by, *[f"_{c}" for c in levels[:k]]] for k in range(len(levels) + 1)]
    grouped = filled.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in sets[-1]])
    out = grouped.agg(*[m.alias(n) for n, m in measures.items()], F.grouping_id().alias("_g"))
    depth = len(levels) - F.bit_count(F.col("_g"))
    out = out.withColumn("level", depth.cast("int"))
    whole = " and ".join(f"(level < {k + 1} or _{c} is not null)" for k, c in enumerate(levels))
    return out.where(whole).select(*by, *[F.col(f"_{c}").alias(c) for c in levels], "level", *measures)


def lattice(df: DataFrame, *, by: list[str], levels: list[str], value: str, sums: dict[str, Column], counted: str | None = None) -> DataFrame:
    """rolled_up's rows with sums and the median, mean and least mode of the floor of a value, from one pass over the rows.

    Rows are counted by (by, levels, value) first. Every prefix of the levels, and what needs sorted values, comes from that
    table, so raw rows are shuffled once and a median never waits for one group's values. sums: aggregates that add up. counted: how
    many rows a row of df stands for, all of one value.
    """
    known = F.coalesce(F.sum(F.when(F.col(value).isNotNull(), F.col(counted))), F.lit(0)) if counted else F.count(value)
    base = kept(df.groupBy(*by, *levels, value).agg(*[c.alias(n) for n, c in sums.items()], known.alias("_rows")))
    totals = {n: F.sum(n) for n in sums} | {"_t": F.sum(F.col(value) * F.col("_rows")), "_r": F.sum("_rows")}
    out = rolled_up(base, by=by, levels=levels, measures=totals)
    out = out.withColumn(f"{value}_mean", F.col("_t") / F.col("_r")).drop("_t", "_r")
    # (by, levels up to one, value): the prefixes of each counted row, null beyond
    cut = [F.struct(F.lit(k).alias("level"), *[(F.col(c) if i < k else F.lit(None).cast(base.schema[c].dataType)).alias(c) for i, c in enumerate(levels)]) for k in range(len(levels) + 1)]
    prefixes = base.where(F.col(value).isNotNull()).select(*by, F.explode(F.array(*cut)).alias("p"), F.col(value).alias("_v"), "_rows").select(*by, "p.*", "_v", "_rows")
    keys = [*by, "level", *levels]
    medians = ranked_values(prefixes, group=keys, value="_v", count="_rows").groupBy(*keys).agg(quantile(0.5, "_v").alias(f"{value}_median"))
    floors = prefixes.groupBy(*keys, F.floor("_v").alias("_f")).agg(F.sum("_rows").alias("_c"))
    modes = floors.groupBy(*keys).agg(F.max(F.struct("_c", (-F.col("_f")).alias("_f")))["_f"].alias("_m")).select(*keys, (-F.col("_m")).alias(f"{value}_mode_floor"))
    return beside(beside(out, medians, keys, "left"), modes, keys, "left")


def with_complement(totals: DataFrame, sizes: DataFrame, *, on: list[str], size: str, total: str, label: str, value: str) -> DataFrame:
    """(on, label, total): one row per key of sizes with what totals leave: size minus total."""
    both = sizes.join(totals.select(*on, F.col(total).alias("_t")), on, "left")
    return both.select(*on, F.lit(value).alias(label), (F.col(size) - F.coalesce("_t", F.lit(0))).alias(total))


def shares(df: DataFrame, *, within: list[str], value: str, share: str = "share") -> DataFrame:
    """df with value over its sum within the given columns (null where the sum is 0)."""
    total = F.sum(value).over(Window.partitionBy(*within)) if within else F.sum(value).over(Window.partitionBy(F.lit(1)))
    return df.withColumn(share, F.when(total != 0, F.col(value) / total))


def pooled_small(df: DataFrame, *, key: str, within: list[str], value: str, below: float, label: str = "Remaining", everywhere: bool = True) -> DataFrame:
    """(within, key, value): categories whose share is below a bound pooled under one label.

    everywhere: only those below it in every group of `within`; else each group pools its own.
    """
    rows = shares(df.groupBy(*within, key).agg(F.sum(value).alias(value)), within=within, value=value)
    small = F.col("share") < below
    if everywhere:
        keep = rows.groupBy(key).agg(F.max(~small).alias("_keep"))
        rows = rows.join(keep, key)
        small = ~F.col("_keep")
    name = F.when(small, F.lit(label)).otherwise(F.col(key)).alias(key)
    return rows.select(*within, name, value).groupBy(*within, key).agg(F.sum(value).alias(value))


def diversity(counts: DataFrame, *, group: list[str], count: str) -> DataFrame:
    """Diversity of a table with one row per group and type: types, Shannon, evenness, exp(Shannon), Gini-Simpson, its
    unbiased form and the inverse Simpson index. Evenness and the unbiased form are null where undefined."""
    rows = shares(counts.where(F.col(count) > 0), within=group, value=count, share="_p")
    out = rows.groupBy(*group).agg(
        F.count("*").alias("types"),
        F.sum(count).alias("individuals"),
        F.sum(-F.col("_p") * F.log("_p")).alias("shannon"),
        (1 - F.sum(F.col("_p") * F.col("_p"))).alias("gini_simpson"),
    )
    return out.withColumns(
        {
            "evenness": F.when(F.col("types") > 1, F.col("shannon") / F.log("types")),
            "exp_shannon": F.exp("shannon"),
            "unbiased_simpson": F.when(F.col("types") > 1, F.col("types") / (F.col("types") - 1) * F.col("gini_simpson")),
            "inverse_simpson": 1 / (1 - F.col("gini_simpson")),
        }
    ).drop("individuals")


def pair_diversity(counts: DataFrame, *, unit: str, kind: str, count: str) -> DataFrame:
    """diversity() of every unit and of every two units pooled (unit_a < unit_b; a single unit twice), with the pair's
    Shannon index less the mean of its units' own (`gain`; 0 for a single unit)."""
    units = counts.select(unit).distinct()
    a, b = units.select(F.col(unit).alias("unit_a")), units.select(F.col(unit).alias("unit_b"))
    pairs = a.join(b, F.col("unit_a") <= F.col("unit_b"))
    member = pairs.select("unit_a", "unit_b", F.explode(F.array_distinct(F.array("unit_a", "unit_b"))).alias(unit))
    pooled = member.join(counts, unit).groupBy("unit_a", "unit_b", kind).agg(F.sum(count).alias(count))
    out = diversity(pooled, group=["unit_a", "unit_b"], count=count)
    own = out.where("unit_a = unit_b").select(F.col("unit_a").alias(unit), F.col("shannon").alias("_own"))
    mean = member.join(own, unit).groupBy("unit_a", "unit_b").agg(F.avg("_own").alias("_mean"))
    return out.join(mean, ["unit_a", "unit_b"]).withColumn("gain", F.col("shannon") - F.col("_mean")).drop("_mean")


def length_stats(df: DataFrame, *, group: list[str], length: str) -> DataFrame:
    """Count, median, mean, max, min, sum of a length and its number in [1,10), [10,100), [100,1000), [1000,10000), 10000 and more."""
    x, c = F.col(length), F.col("_c")
    edges = [1, 10, 100, 1000, 10000]
    more = {"n": F.sum(c), "mean": F.sum(x * c) / F.sum(c), "max": F.max(x), "min": F.min(x), "sum": F.sum(x * c)}
    more |= {f"n_{a}_{b}": F.coalesce(F.sum(F.when((x >= a) & (x < b), c)), F.lit(0)) for a, b in zip(edges, edges[1:])}
    more |= {"n_10000": F.coalesce(F.sum(F.when(x >= 10000, c)), F.lit(0))}
    out = quantiles(df, group=group, value=length, named={"median": 0.5}, more=more)
    out = beside(df.select(*group).distinct(), out, group, "left") if group else out
    return out.na.fill(0, [c for c in out.columns if c not in group and c.startswith("n")]).select(*group, "n", "median", "mean", "max", "min", "sum", *[c for c in more if c.startswith("n_")])


def spread(df: DataFrame, *, group: list[str], value: str, factor: float = 1.96) -> DataFrame:
    """(group, median, low, high, told): the median, plus and minus factor standard deviations, and as text ('NA' if none)."""
    x, c, n = F.col(value), F.col("_c"), F.sum("_c")
    # both sums are about the mean of the group's distinct values, so that large values lose no digits
    rows = ranked_values(df, group=group, value=value)
    middle = rows.groupBy(*group).agg((F.sum(x * c) / n).alias("_m"))
    out = beside(rows, middle, group).groupBy(*group).agg(quantile(0.5, value).alias("median"), F.when(n > 1, F.sqrt(F.sum((x - F.col("_m")) ** 2 * c) / (n - 1))).alias("_sd"))
    out = beside(df.select(*group).distinct(), out, group, "left") if group else out
    half = F.floor(factor * F.col("_sd"))
    told = F.when(F.col("median").isNull() | half.isNull(), F.lit("NA")).otherwise(F.format_string("%s ± %s", F.col("median").cast("string"), half.cast("string")))
    return out.select(*group, "median", (F.col("median") - half).alias("low"), (F.col("median") + half).alias("high"), told.alias("told"))


def box_stats(df: DataFrame, *, group: list[str], value: str) -> DataFrame:
    """Quartiles, whiskers (furthest values within 1.5 interquartile ranges), mean and count of each group."""
    rows = ranked_values(df, group=group, value=value)
    n = F.sum("_c")
    quartiles = [quantile(p, value).alias(c) for c, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    q = rows.groupBy(*group).agg(*quartiles, (F.sum(F.col(value) * F.col("_c")) / n).alias("mean"), n.alias("n"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    ends = rows.select(*group, value).join(q, group).where(F.col(value).between(F.col("q1") - reach, F.col("q3") + reach))
    ends = ends.groupBy(*group).agg(F.min(value).alias("whisker_low"), F.max(value).alias("whisker_high"))
    return q.join(ends, group)


def histogram(df: DataFrame, *, group: list[str], value: str, width: float = 1.0, low: float = 0.0, log10: bool = False) -> DataFrame:
    """(group, bin, count, share): fixed-width bins of a value, or of its decimal logarithm (positive values only)."""
    x = F.log10(F.col(value)) if log10 else F.col(value)
    rows = df.where(F.col(value) > 0) if log10 else df.where(F.col(value).isNotNull())
    counts = rows.groupBy(*group, F.floor((x - low) / width).alias("bin")).agg(F.count("*").alias("count"))
    return shares(counts, within=group, value="count")


def sized_bins(df: DataFrame, *, group: list[str], size: str, step: int, stop: int) -> DataFrame:
    """(group, bin, count, weight, share, weight_share): sizes in steps (1 to step, ...), all above stop in one last bin."""
    top = (stop - 1) // step + 1
    b = F.when(F.col(size) > stop, F.lit(top)).otherwise(F.floor((F.col(size) - 1) / step)).cast("int").alias("bin")
    out = df.groupBy(*group, b).agg(F.count("*").alias("count"), F.sum(size).alias("weight"))
    return shares(shares(out, within=group, value="count"), within=group, value="weight", share="weight_share")


def banded(df: DataFrame, *, value: str, edge: float, band: str = "band") -> DataFrame:
    """df with each row once for each overlapping band it is in: All, and on its side of 1 and of edge (<1, <edge, >=edge)."""
    v = F.col(value)
    bands = F.array(F.lit("All"), F.when(v < 1, F.lit("<1")), F.when(v < edge, F.lit(f"<{edge:g}")), F.when(v >= edge, F.lit(f">={edge:g}")))
    return df.withColumn(band, F.explode(F.array_compact(bands)))


def weighted_stats(df: DataFrame, *, group: list[str], value: str, freq: str) -> DataFrame:
    """Mean, lower median, population deviation and the first values of the largest and least frequency of a histogram."""
    w = Window.partitionBy(*group).orderBy(value)
    run = df.where(F.col(freq) > 0).withColumns({"_run": F.sum(freq).over(w), "_all": F.sum(freq).over(Window.partitionBy(*group))})
    v, f = F.col(value), F.col(freq)
    mean, square = F.sum(v * f) / F.sum(f), F.sum(v * v * f) / F.sum(f)
    return run.groupBy(*group).agg(
        mean.alias("mean"),
        F.min(F.when(F.col("_run") * 2 >= F.col("_all"), v)).alias("median"),
        F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("stdev"),
        F.max(F.struct(f, -v))["col2"].alias("_top"),
        F.min(F.struct(f, v)).getField(value).alias("min_freq_at"),
    ).withColumn("max_freq_at", -F.col("_top")).drop("_top")


def local_extrema(df: DataFrame, *, group: list[str], value: str, freq: str) -> DataFrame:
    """(group, value, freq, extremum): strict local maxima and minima of a histogram; an edge counts on its one side."""
    w = Window.partitionBy(*group).orderBy(value)
    rows = df.select(*group, value, freq).withColumns({"_a": F.lag(freq).over(w), "_b": F.lead(freq).over(w)})
    up = F.coalesce(F.col(freq) > F.col("_a"), F.lit(True)) & F.coalesce(F.col(freq) > F.col("_b"), F.lit(True))
    down = F.coalesce(F.col(freq) < F.col("_a"), F.lit(True)) & F.coalesce(F.col(freq) < F.col("_b"), F.lit(True))
    return rows.withColumn("extremum", F.when(up, F.lit("max")).when(down, F.lit("min"))).where("extremum is not null").drop("_a", "_b")


def neighbourhood_extrema(df: DataFrame, *, group: list[str], value: str, freq: str, order: int) -> DataFrame:
    """(group, value, freq, extremum): rows not exceeded (or undercut) within `order` rows on either side, clipped at edges."""
    w = Window.partitionBy(*group).orderBy(value).rowsBetween(-order, order)
    rows = df.select(*group, value, freq).withColumns({"_hi": F.max(freq).over(w), "_lo": F.min(freq).over(w)})
    kind = F.when(F.col(freq) == F.col("_hi"), F.lit("max")).when(F.col(freq) == F.col("_lo"), F.lit("min"))
    return rows.withColumn("extremum", kind).where("extremum is not null").drop("_hi", "_lo")


def signed_stats(df: DataFrame, *, group: list[str], value: str, sign: str) -> DataFrame:
    """Count, mean and sample variance where rows of sign -1 take back rows of sign 1."""
    w, x = F.col(sign), F.col(value)
    sums = df.groupBy(*group).agg(F.sum(w).alias("n"), F.sum(w * x).alias("_s"), F.sum(w * x * x).alias("_q"))
    mean = F.col("_s") / F.col("n")
    return sums.select(*group, "n", F.when(F.col("n") > 0, mean).alias("mean"), F.when(F.col("n") > 1, (F.col("_q") - F.col("_s") * mean) / (F.col("n") - 1)).alias("variance"))


def expanded(df: DataFrame, freq: str) -> DataFrame:
    """Each row as often as its frequency says (weighted statistics need no expansion)."""
    return df.where(F.col(freq) > 0).withColumn("_x", F.explode(F.sequence(F.lit(1), F.col(freq).cast("int")))).drop("_x")


def legacy_summary(df: DataFrame, *, levels: list[str], bp: str, genome: int, by: list[str] | None = None) -> DataFrame:
    """Per prefix of levels (level 0: Total): number, share of all, bases, share of all bases and of a genome, mean length.

    by: one such table for each value of these columns, a sequence say, in one run.
    """
    keys = by or ["_all"]
    out = rolled_up(df if by else df.withColumn("_all", F.lit("all")), by=keys, levels=levels, measures={"elements": F.count("*"), "bp": F.sum(bp)})
    w = Window.partitionBy(*keys)
    n, b = F.max(F.when(F.col("level") == 0, F.col("elements"))).over(w), F.max(F.when(F.col("level") == 0, F.col("bp"))).over(w)
    out = out.withColumns(
        {"percent_elements": 100 * F.col("elements") / n, "percent_bp": 100 * F.col("bp") / b, "percent_genome": 100 * F.col("bp") / genome, "mean_length": F.col("bp") / F.col("elements")}
    )
    return out if by else out.drop("_all")


def divergence_table(df: DataFrame, sizes: DataFrame, *, group: list[str], on: str, bp: str, value: str, overlapping: str, size: str) -> DataFrame:
    """Per group, with overlapping rows Included and Excluded: megabases, percent of the size of `on`, and median, mean,
    deviation and maximum of a value, to two places."""
    kinds = F.array_compact(F.array(F.lit("Included"), F.when(~F.col(overlapping), F.lit("Excluded"))))
    rows = df.withColumn("overlap", F.explode(kinds))
    out = rows.groupBy(*group, "overlap").agg(F.sum(bp).alias("_bp"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.max(value).alias("max"))
    out = with_quantiles(out, rows, group=[*group, "overlap"], value=value, named={"median": 0.5})
    out = out.join(sizes.select(on, F.col(size).alias("_size")), on).withColumns({"mb": F.col("_bp") / 1e6, "percent": 100 * F.col("_bp") / F.col("_size")})
    return out.drop("_bp", "_size").withColumns({c: F.round(c, 2) for c in ("mb", "percent", "median", "mean", "sd", "max")})


def described(df: DataFrame, *, group: list[str], value: str, drop_zero: bool = True) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum of a value, zeros left out if asked."""
    rows = df.where(F.col(value) != 0) if drop_zero else df
    out = rows.groupBy(*group).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return with_quantiles(out, rows, group=group, value=value, named={"q25": 0.25, "q50": 0.5, "q75": 0.75})


def type_frequency(df: DataFrame, *, kind: str) -> DataFrame:
    """(kind, count, percent)."""
    out = df.groupBy(kind).agg(F.count("*").alias("count"))
    return shares(out, within=[], value="count").select(kind, "count", F.bround(100 * F.col("share"), 2).alias("percent"))


def readable(column: str, *, above: str, missing: str = "NA", residual: tuple[str, ...] = ()) -> Column:
    """A category for display: a missing one is named after the level above it; those on the residual list are null."""
    named = F.when(F.col(column).isNull() | (F.col(column) == missing), F.concat(F.col(above), F.lit(" (unknown)"))).otherwise(F.col(column))
    return F.when(~F.col(column).isin(*residual), named).when(F.col(column).isNull(), named) if residual else named


def content_table(df: DataFrame, *, by: list[str], levels: list[str], value: str, weight: str, edge: float) -> DataFrame:
    """(by, band, levels, level, weight, share): weight of every prefix of the levels in each band of a value, and its share in the band."""
    rows = banded(df, value=value, edge=edge)
    out = rolled_up(rows, by=[*by, "band"], levels=levels, measures={weight: F.sum(weight)}).where("level > 0")
    return shares(out, within=[*by, "band", "level"], value=weight)


def path_histograms(df: DataFrame, *, by: list[str], levels: list[str], value: str, width: float = 1.0, counted: str | None = None) -> DataFrame:
    """(by, levels, level, bin, count, share): a histogram of a value for every prefix of the levels (level 0: all).

    counted: how many rows a row of df stands for.
    """
    rows = df.where(F.col(value).isNotNull()).withColumn("bin", F.floor(F.col(value) / width))
    out = rolled_up(rows, by=[*by, "bin"], levels=levels, measures={"count": F.sum(counted) if counted else F.count("*")})
    return shares(out, within=[*by, *levels, "level"], value="count")


def stacked_occupancy(df: DataFrame, regions: DataFrame, *, seq: str, by: list[str], levels: list[str], weight: str) -> DataFrame:
    """(by, region, levels, weight): a weight by category in each set of sequences; regions: (seq, region), a sequence in several."""
    return df.join(regions.select(seq, "region").distinct(), seq).groupBy(*by, "region", *levels).agg(F.sum(weight).alias(weight))


def weighted_divergence(df: DataFrame, *, keys: list[str], value: str, bp: str) -> DataFrame:
    """(keys, bp, value_median, weighted): resolved bases, the median divergence in percent, and the bases it stands for."""
    out = with_quantiles(df.groupBy(*keys).agg(F.sum(bp).alias(bp)), df, group=keys, value=value, named={"value_median": 0.5})
    return out.withColumn("weighted", F.col("value_median") * F.col(bp) / 100)


def coordinates_table(regions: DataFrame, coverage: DataFrame, *, seq: str, columns: list[str], factor: float = 1.96) -> DataFrame:
    """(seq, percent, a cell per region): coverage, and of each kind of region median plus-minus factor deviations as text, or NA.

    regions: (seq, region, bp); coverage: (seq, percent).
    """
    cells = spread(regions, group=[seq, "region"], value="bp", factor=factor).select(seq, "region", "told")
    wide = cells.groupBy(seq).pivot("region", columns).agg(F.first("told"))
    return coverage.select(seq, "percent").join(wide, seq, "left").na.fill("NA", columns)
