"""Jobs: whole analyses from files to tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import cache, reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import cigar
from loomspan.operators import families, intervals, recode, summary, windows
from loomspan.session import kept, small
from loomspan.sources import readers

LEVELS = ["class", "subclass", "order", "superfam"]


def checked(repeats: dict[str, str], indices: dict[str, str]) -> None:
    """Every index belongs to a species with repeats."""
    if extra := sorted(set(indices) - set(repeats)):
        raise ValueError(f"indices of species without repeats: {', '.join(extra)}")


def loaded(spark: SparkSession, repeats: dict[str, str], indices: dict[str, str]) -> tuple[DataFrame, DataFrame | None]:
    """Preprocessed repeats of several species, and their index of subsets: None unless every species has one.

    Raises one error that lists all that is wrong: indices without repeats, species without rows, subsets that match no row.
    """
    checked(repeats, indices)
    seen = Observation()
    there = [F.count_if(F.col("Species") == s).alias(f"_{i}") for i, s in enumerate(repeats)]
    rows = kept(readers.preprocessed_repeats(spark, repeats).observe(seen, *there))  # the texts are read once
    faults = [f"no repeats of {s}" for i, s in enumerate(repeats) if not seen.get[f"_{i}"]]
    index = readers.subset_index(spark, indices) if indices else None
    if index is not None:
        ids = rows.select("Species", "sequid").distinct()
        hit = ids.withColumnRenamed("Species", "_sp").join(small(index), F.expr("Species = _sp and rlike(sequid, concat('(?i)', Pattern))"))
        unmatched = index.join(hit.select("Species", "Subset").distinct(), ["Species", "Subset"], "left_anti")
        faults += [f"subset {r['Subset']} of {r['Species']} matches no sequence" for r in unmatched.select("Species", "Subset").distinct().limit(100).collect()]
    if faults:
        raise ValueError("; ".join(faults))
    return rows, index if set(indices) == set(repeats) else None


def preprocess_repeats(spark: SparkSession, path: str, sequential: bool = False) -> DataFrame:
    """Raw annotation with bp_naive and bp_algor. sequential: the order-dependent rule, by place in the input.

    Rows are numbered once, in a table of their own: both uses see the same numbers, whatever is run again.
    """
    rows, seen = readers.observed_repeats(spark, path)
    rows = kept(rows.withColumn("_id", F.monotonically_increasing_id()))  # bad lines are counted in the same pass
    if seen.get["bad"]:
        raise ValueError(f"{seen.get['bad']} of {seen.get['lines']} lines without 15 fields and an optional mark: {seen.get['example']!r}")
    if sequential:
        won = intervals.resolve_overlap_sequential(rows, seq="sequid", begin="begin", end="end", score="score_SW", order="_id")
    else:
        won = intervals.resolve_overlap(rows, seq="sequid", begin="begin", end="end", score="score_SW", id="_id")
    return rows.join(won, ["sequid", "_id"]).select(*[c for c in rows.columns if c != "_id"], "bp_algor")  # won lies by these keys already


def repeat_summaries(rows: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """All levels of summary in one table: per species (and subset), for each prefix of the taxonomy.

    rows: preprocessed repeats with Species. index: (Species, Subset, Pattern, Bpsum), which adds Subset and a complement.
    """
    best = ~F.col("overlapping")
    sums = {
        "naive_numele": F.count("*"),
        "naive_totbp": F.sum("bp_naive"),
        "algor_totbp": F.sum("bp_algor"),
        "best_numele": F.count_if(best),
        "best_totbp": F.sum(F.when(best, F.col("bp_naive"))),
    }
    # rows are counted by sequence, label and value before they meet subsets and taxonomy
    by, keys = ["Species"], ["default_repclass", "perc_divg"]
    rows = kept(rows.groupBy(*by, *(["sequid"] if index is not None else []), *keys).agg(*[c.alias(n) for n, c in sums.items()]))
    if index is not None:
        ids = rows.select("Species", "sequid").distinct().join(small(index.withColumnRenamed("Species", "_sp")), F.expr("Species = _sp and rlike(sequid, concat('(?i)', Pattern))"))
        by = ["Species", "Subset"]
        rows = rows.join(ids.select("Species", "sequid", "Subset").distinct(), ["Species", "sequid"])
        rows = kept(rows.groupBy(*by, *keys).agg(*[F.sum(n).alias(n) for n in sums]))
    rows = recode.classified(rows, label="default_repclass")
    out = summary.lattice(rows, by=by, levels=LEVELS, value="perc_divg", sums={n: F.sum(n) for n in sums}, counted="naive_numele")
    out = out.withColumnsRenamed({f"perc_divg_{c}": f"divg_{c}" for c in ("median", "mean", "mode_floor")})
    out = out.withColumn("class", F.when(F.col("level") == 0, "TOTAL_REPETITIVE").otherwise(F.col("class")))
    if index is None:
        return out
    total = out.where("level = 0").select(*by, F.col("algor_totbp").alias("bp"))
    rest = summary.with_complement(total, index.groupBy("Species", "Subset").agg(F.sum("Bpsum").alias("_size")), on=by, size="_size", total="bp", label="class", value="NON_REPETITIVE")
    return out.unionByName(rest.select(*by, "class", F.lit(0).alias("level"), F.col("bp").alias("algor_totbp")), allowMissingColumns=True)


class Tables(Mapping):
    """Tables by name, each worked out when it is asked for, and once."""

    def __init__(self, **makers: Callable[[], DataFrame]) -> None:
        self._makers = {name: cache(make) for name, make in makers.items()}

    def __getitem__(self, name: str) -> DataFrame:
        return self._makers[name]()

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def repeat_distributions(rows: DataFrame) -> Mapping[str, DataFrame]:
    """Tables behind content, divergence-distribution and box plots, at all levels of the taxonomy."""
    # rows are counted by label and value before they meet the taxonomy: their text is read once, and few rows are rolled up
    keys = ["Species", "default_repclass", "perc_divg"]
    counted = cache(lambda: recode.classified(kept(rows.groupBy(*keys).agg(F.count("*").alias("_rows"), F.sum("bp_algor").alias("bp_algor"))), label="default_repclass"))
    whole = cache(lambda: recode.classified(rows, label="default_repclass"))
    return Tables(
        content=lambda: summary.content_table(counted(), by=["Species"], levels=LEVELS, value="perc_divg", weight="bp_algor", edge=5),
        divergence=lambda: summary.path_histograms(counted(), by=["Species"], levels=LEVELS, value="perc_divg", counted="_rows"),
        boxes=lambda: summary.box_stats(whole().where("class is not null"), group=["Species", "class"], value="perc_divg"),
        weighted=lambda: summary.weighted_divergence(whole(), keys=["Species", "class", "order", "superfam"], value="perc_divg", bp="bp_algor"),
    )


def diversity(rows: DataFrame, level: str | None = None) -> DataFrame:
    """(level, ...): diversity of every species and every pair of them, at a level of the taxonomy, or at all four in one table."""
    levels = [level] if level else LEVELS
    labels = kept(rows.groupBy("Species", "default_repclass").agg(F.count("*").alias("_rows")))  # few rows meet the taxonomy
    rows = recode.classified(labels, label="default_repclass")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("name")) for c in levels]))
    counts = kept(rows.select("Species", "_rows", each.alias("e")).where("e.name is not null").groupBy("Species", "e.level", "e.name").agg(F.sum("_rows").alias("n")))
    parts = [summary.pair_diversity(counts.where(F.col("level") == c), unit="Species", kind="name", count="n").withColumn("level", F.lit(c)) for c in levels]
    return reduce(DataFrame.unionByName, parts)


def alignment_stats(spark: SparkSession, path: str, patterns: list[tuple[str, str]]) -> Mapping[str, DataFrame]:
    """By side and subset: mapped and unmapped regions, alignment lengths, matches and mismatches with length statistics,
    indels, overlap of alignments; coverage and coordinates of each sequence."""
    rows = kept(readers.paf(spark, path).withColumn("_id", F.monotonically_increasing_id()))
    long = readers.sides(rows, ["_id", "ali_len", "matches", "mismatches", "dels_list", "incs_list"])
    table = recode.pattern_table(spark, patterns)
    subsets = kept(recode.pattern_matches(long, table, id="sequid", pattern="pattern").select("sequid", F.col("label").alias("subset")).distinct())
    # each alignment once a side, whatever the number of its subsets: what is told by sequence comes from these
    single = kept(long.join(subsets.select("sequid").distinct(), "sequid", "left_semi"))
    stretches = cache(lambda: kept(intervals.gaps(single.dropDuplicates(["sequid", "begin", "end"]), seq="sequid", begin="begin", end="end", length="length")))
    own = single.select("db", "sequid", F.expr("stack(3, 'ali_len', cast(ali_len as bigint), 'matches', cast(matches as bigint), 'mismatches', cast(mismatches as bigint)) as (region, bp)")).where("bp is not null")
    regions = cache(lambda: stretches().join(single.select("sequid", "db").distinct(), "sequid").select("db", "sequid", "region", "bp", "position"))
    told = cache(lambda: regions().drop("position").unionByName(own))
    gapped = cigar.indels(single, ["sequid", "db"]).withColumn("kind", cigar.swapped("kind", "db"))
    coverage = cache(lambda: intervals.covered(single, seq="sequid", begin="begin", end="end", length="length", closed=False))

    def overlap() -> DataFrame:
        won = intervals.alignment_overlap(rows, id="_id", sides={"Q": ("Qname", "Qstart", "Qend"), "T": ("Tname", "Tstart", "Tend")}, score="mapQ")
        both = readers.sides(won, ["_id", "Qalgorbp", "Talgorbp"]).join(subsets, "sequid")
        both = both.withColumns({"naive": F.col("end") - F.col("begin"), "algor": F.when(F.col("db") == "Q", F.col("Qalgorbp")).otherwise(F.col("Talgorbp"))})
        return intervals.overlap_report(both, group=["db", "subset"], seq="sequid", length="length", naive="naive", algor="algor")

    def coordinates() -> DataFrame:
        pieces = told().select("sequid", "region", "bp").unionByName(gapped.select("sequid", F.col("kind").alias("region"), F.col("size").cast("long").alias("bp")))
        return summary.coordinates_table(pieces, coverage(), seq="sequid", columns=["unmapped", "ali_len", "Del", "Ins"])

    def positions() -> DataFrame:
        centre = (F.floor(F.col("position") / 4) * 4 + 2).alias("centre")
        return regions().join(subsets, "sequid").groupBy("db", "subset", centre).agg(F.sum(F.when(F.col("region") == "mapped", F.col("bp")).otherwise(0)).alias("mapped"))

    return Tables(
        regions=lambda: summary.length_stats(told().join(subsets, "sequid"), group=["db", "subset", "region"], length="bp"),
        indels=lambda: summary.length_stats(gapped.join(subsets, "sequid"), group=["db", "subset", "kind"], length="size"),
        coverage=coverage,
        coordinates=coordinates,
        overlap=overlap,
        sizes=lambda: readers.sequence_sizes(single),
        positions=positions,
    )


def orthogroup_tables(rows: DataFrame, a: str, b: str, cap: int = 5) -> dict[str, DataFrame]:
    """Copy numbers, one-to-one pairs, occupancy, placement, links and their summary for two species."""
    names = [a, b]
    copies = families.copy_numbers(rows, group="OGid", species="Species", names=names)
    return {
        "copies": copies,
        "one_to_one": families.one_to_one(rows, group="OGid", species="Species", id="GeneID", a=a, b=b),
        "occupancy": families.occupancy(copies, a=a, b=b, cap=cap),
        "placement": families.placement_class(rows, group="OGid", species="Species", names=names, category="ScaffoldCategory"),
        "links": families.links(rows, group="OGid", species="Species", id="GeneID", a=a, b=b),
        "points": families.points(rows, group="OGid", species="Species", a=a, b=b),
        "summary": families.link_summary(rows, group="OGid", species="Species", a=a, b=b),
    }


def paranome_tables(families_df: DataFrame, models: DataFrame) -> dict[str, DataFrame]:
    """Presence, linkage, distances and statistics of gene families (family, gene) placed by gene models."""
    first = recode.first_per_key(models.select("gene", "sequid", F.col("start").alias("begin"), "end"), ["gene"], ["begin", "end", "sequid"])
    placed = families_df.join(first, "gene")
    return {
        "presence": families.presence(placed, family="family", seq="sequid"),
        "linkage": families.linkage(placed, family="family", seq="sequid"),
        "distances": families.pair_distances(placed, family="family", id="gene", seq="sequid", begin="begin", end="end"),
        "statistics": families.family_statistics(families_df, family="family"),
        "missing": families_df.join(first, "gene", "left_anti"),
    }


def segment_tables(segments: DataFrame, models: DataFrame) -> dict[str, DataFrame]:
    """Segments with their genes, pairs of segments with ratios, and sizes of multiplicons."""
    genes = models.where("feature in ('gene', 'mRNA')").select("gene", "sequid", F.col("start").alias("begin"), "end").dropDuplicates(["gene"])
    rich = families.segments_with_genes(segments, genes)
    pairs = families.paired_segments(rich)
    pairs = pairs.withColumns({f"{c}_ratio": families.ratio(f"{c}_a", f"{c}_b") for c in ("genes", "gene_length", "gene_distance")})
    return {"segments": rich, "pairs": pairs.withColumn("intra", F.col("sequid_a") == F.col("sequid_b")), "sizes": families.multiplicon_sizes(segments)}


def coverage_report(histograms: DataFrame, stats: DataFrame) -> DataFrame:
    """Per sample: mean, median, stdev, bases, and genome_size: read bases over mean coverage (modal: over the most frequent one)."""
    per = summary.weighted_stats(histograms, group=["sample"], value="covg", freq="freq")
    bases = stats.where("metric = 'bases mapped (cigar)'").select("sample", F.col("value").alias("bases"))
    return per.join(bases, "sample", "left").withColumns({"genome_size": F.col("bases") / F.col("mean"), "genome_size_modal": F.when(F.col("max_freq_at") != 0, F.col("bases") / F.col("max_freq_at"))})


def window_tables(rows: DataFrame, sizes: DataFrame, width: int = 10**6) -> DataFrame:
    """Resolved bases per window of each sequence, by midpoint; sizes: (sequid, start, end)."""
    return windows.by_midpoint(rows, sizes.withColumnsRenamed({"start": "_from", "end": "_to"}), seq="sequid", begin="begin", end="end", weight="bp_algor", start="_from", stop="_to", width=width)
