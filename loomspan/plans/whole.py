"""Registered queries of whole jobs, all their levels and tables, and of readers and operators that the others leave out."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from loomspan.functions import cigar
from loomspan.operators import families, intervals, recode
from loomspan.plans import jobs
from loomspan.plans.catalog import GENES, ITEMS, CIGAR, alignments, genes, items, query, rounded, table
from loomspan.plans.files import CLASSES, REPEATS, lines, paf_text, repeat_text
from loomspan.session import kept, scratch
from loomspan.sources import readers, writers
from loomspan.streaming import running

# Where the sample's labels belong.
PLACES = """(VALUES ('DNA/hAT', 'DNA', '1', 'TIR', 'hAT'), ('LINE/L1', 'Retrotransposon', 'NA', 'LINE', 'L1'), ('LTR/Gypsy', 'Retrotransposon', 'NA', 'LTR', 'Gypsy'), ('SINE/tRNA', 'Retrotransposon', 'NA', 'SINE', 'tRNA'),
 ('Simple_repeat', 'Tandem_repeat', 'Simple_repeat', 'NA', 'NA'), ('RC/Helitron', 'DNA', '2', 'Helitron', 'Helitron')) AS m(k, class, subclass, "order", superfam)"""


def two_species(spark, d) -> dict[str, str]:
    """Preprocessed tables of two species: odd and even suppliers' line items."""
    rows = jobs.preprocess_repeats(spark, repeat_text(spark, d))
    path = scratch(spark)  # both in one pass, a folder each
    kind = F.when(F.substring("sequid", 2, 9).cast("long") % 2 == 0, "even").otherwise("odd")
    writers.tsv(rows.withColumn("kind", kind), path, by=["kind"])
    return {name: f"{path}/kind={name}" for name in ("even", "odd")}


def subset_files(spark, d) -> dict[str, str]:
    """For each species all sequences, and those whose number ends in 1 or 2; sizes stand in for genomes."""
    one = table(spark, d, "region").limit(1)
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(p).alias("p"), F.lit(s).alias("s")) for n, p, s in (("Genome", "^s", 10**9), ("Some", "[12]$", 10**8))])).alias("r"))
    return {name: lines(spark, rows, F.col("r.n"), F.col("r.p"), F.col("r.s"), sep=" ") for name in ("even", "odd")}


SPECIES = REPEATS + ", sp AS (SELECT *, CASE WHEN CAST(substr(sequid, 2) AS BIGINT) % 2 = 0 THEN 'even' ELSE 'odd' END AS \"Species\" FROM rp)"
OWN = """, iv AS (SELECT row_number() OVER (ORDER BY sequid, b) AS i, * FROM sp), pts AS (SELECT sequid, b AS pt FROM iv UNION SELECT sequid, b + bp FROM iv), cuts AS (SELECT sequid, pt, lead(pt) OVER (PARTITION BY sequid ORDER BY pt) - pt AS len FROM pts)"""


@query(SPECIES + f""", j AS (SELECT sp.*, s."Subset", m.class, m.subclass, m."order", m.superfam FROM sp LEFT JOIN {PLACES} ON k = label
  JOIN (VALUES ('Genome', '^s'), ('Some', '[12]$')) AS s("Subset", p) ON regexp_matches(sequid, s.p)),
 g AS (SELECT "Species", "Subset", class, subclass, "order", superfam, 4 - grouping(class) - grouping(subclass) - grouping("order") - grouping(superfam) AS level, count(*) AS naive_numele, CAST(sum(bp) AS BIGINT) AS naive_totbp,
  count(*) FILTER (NOT overlapping) AS best_numele, CAST(sum(bp) FILTER (NOT overlapping) AS BIGINT) AS best_totbp, median(divg) AS divg_median, round(avg(divg), 6) AS divg_mean, mode(floor(divg)) AS any_mode
  FROM j GROUP BY "Species", "Subset", ROLLUP (class, subclass, "order", superfam))
 SELECT "Species", "Subset", CASE WHEN level = 0 THEN 'TOTAL_REPETITIVE' ELSE class END AS class, subclass, "order", superfam, CAST(level AS INTEGER) AS level, naive_numele, naive_totbp, best_numele, best_totbp, divg_median, divg_mean
 FROM g WHERE level = 0 OR class IS NOT NULL""")
def job_repeat_summaries_all(spark, d):
    """Two species and their subsets, checked and loaded from files: all five levels with medians. Complements are in job_complements."""
    rows, index = jobs.loaded(spark, two_species(spark, d), subset_files(spark, d))
    out = jobs.repeat_summaries(rows, index).where("class <> 'NON_REPETITIVE'")
    columns = ["Species", "Subset", *jobs.LEVELS, "level", "naive_numele", "naive_totbp", "best_numele", "best_totbp", "divg_median", F.round("divg_mean", 6).alias("divg_mean")]
    return out.select(*columns).withColumns({c: F.col(c).cast("long") for c in ("naive_totbp", "best_totbp")})


@query(SPECIES + """, b AS (SELECT "Species", sequid, unnest(range(b, b + bp)) AS base FROM sp), u AS (SELECT "Species", sequid, count(DISTINCT base) AS bp FROM b GROUP BY 1, 2)
 SELECT "Species", s."Subset", CAST(s.size - sum(bp) AS BIGINT) AS bp FROM u JOIN (VALUES ('Genome', '^s', 1000000000), ('Some', '[12]$', 100000000)) AS s("Subset", p, size) ON regexp_matches(sequid, s.p) GROUP BY 1, 2, s.size""")
def job_complements(spark, d):
    """What resolved repeats leave of each subset: the subset's size less the union of the repeats in it."""
    out = jobs.repeat_summaries(*jobs.loaded(spark, two_species(spark, d), subset_files(spark, d))).where("class = 'NON_REPETITIVE'")
    return out.select("Species", "Subset", F.col("algor_totbp").cast("long").alias("bp"))


@query(SPECIES + f""", l AS (SELECT "Species", v.level, v.name, count(*) AS n FROM sp JOIN {PLACES} ON k = label, LATERAL (VALUES ('class', class), ('subclass', subclass), ('order', "order"), ('superfam', superfam)) AS v(level, name) GROUP BY ALL),
 p AS (SELECT * FROM (VALUES ('even', 'even'), ('even', 'odd'), ('odd', 'odd')) AS x(unit_a, unit_b)),
 q AS (SELECT unit_a, unit_b, level, name, sum(n) AS n FROM p JOIN l ON "Species" = unit_a OR "Species" = unit_b GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY unit_a, unit_b, level) AS x FROM q)
 SELECT level, unit_a, unit_b, count(*) AS types, round(sum(-x * ln(x)), 6) AS shannon, round(1 - sum(x * x), 6) AS gini_simpson FROM s GROUP BY 1, 2, 3""")
def job_diversity(spark, d):
    """Every species and every pair of them, at all four levels of the taxonomy."""
    rows, _ = jobs.loaded(spark, two_species(spark, d), {})
    return rounded(jobs.diversity(rows).select("level", "unit_a", "unit_b", "types", "shannon", "gini_simpson"))


@query(SPECIES + ' SELECT "Species", name, count(*) AS n, CAST(sum(bp) AS BIGINT) AS bp, count(*) FILTER (overlapping) AS marked FROM sp GROUP BY 1, 2')
def source_several_species(spark, d):
    """Two preprocessed tables, read as one."""
    back = readers.preprocessed_repeats(spark, two_species(spark, d))
    return back.groupBy("Species", "name").agg(F.count("*").alias("n"), F.sum("bp_naive").alias("bp"), F.count_if("overlapping").alias("marked"))


@query("SELECT CAST(l_linenumber AS INTEGER) AS fields, count(*) AS n FROM (SELECT 12 + l_linenumber AS l_linenumber FROM lineitem) WHERE l_linenumber NOT IN (15) GROUP BY 1")
def source_bad_lines(spark, d):
    """Repeat lines of 13 to 19 fields: those of 15 are good, and those of 16 aren't, for want of the mark."""
    t = table(spark, d, "lineitem")
    text = F.concat_ws(" ", F.col("l_orderkey").cast("string"), F.array_repeat(F.lit("x"), (F.col("l_linenumber") + 11).cast("int")))
    bad = readers.bad_rows(spark, lines(spark, t, text))
    return bad.groupBy(F.size(F.split("value", " ")).alias("fields")).agg(F.count("*").alias("n"))


@query("SELECT string_split(r_name, ' ')[1] AS \"Species\", '^n' || n_nationkey AS \"Pattern\", CAST(n_nationkey AS BIGINT) * 10 AS \"Bpsum\" FROM nation JOIN region ON r_regionkey = n_regionkey")
def source_headed_index(spark, d):
    """A file for each region, whose first line names it; nations are its patterns."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    line = F.concat(F.lit("^n"), "n_nationkey", F.lit(" "), F.col("n_nationkey") * 10)
    files = n.groupBy("r_regionkey", "r_name").agg(F.concat_ws("\n", F.first("r_name"), F.collect_list(line)).alias("value"))
    path = scratch(spark)
    files.select("value", "r_regionkey").write.partitionBy("r_regionkey").text(path)
    return readers.headed_index(spark, path)


@query(REPEATS + f""" SELECT label, CASE WHEN m."order" = 'TIR' THEN 'DDE' ELSE m."order" END AS "order", count(*) AS n FROM rp LEFT JOIN {PLACES} ON k = label GROUP BY ALL""")
def taxonomy_older_order(spark, d):
    """The older naming of one order."""
    rows = recode.classified(readers.repeats(spark, repeat_text(spark, d)), label="default_repclass", v7=True)
    return rows.groupBy(F.col("default_repclass").alias("label"), "order").agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey, regexp_replace(regexp_replace(k, '^Supp_?1$', 'Chr1'), '^Supp_?(2)$', 'Chr\\1') AS whole, regexp_replace(regexp_replace(k, 'Supp_?1', 'Chr1', 'g'), 'Supp_?(2)', 'Chr\\1', 'g') AS part FROM (SELECT s_suppkey, 'Supp_' || s_suppkey AS k FROM supplier)""")
def renamed_by_patterns(spark, d):
    """Rules that must match whole ids, and rules that may hit longer ones, too."""
    rows = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("Supp_"), "s_suppkey").alias("k"))
    rules = [("Supp_?1", "Chr1"), ("Supp_?(2)", "Chr$1")]
    return rows.select("s_suppkey", recode.renamed_by_patterns("k", rules).alias("whole"), recode.renamed_by_patterns("k", rules, anchored=False).alias("part"))


@query("""SELECT p_partkey, coalesce(c, 'black') AS colour FROM part LEFT JOIN LATERAL (SELECT arg_max(k.c, k.o) AS c FROM (VALUES ('TIN', 'red', 1), ('PROMO', 'blue', 2), ('#3', 'green', 3)) AS k(t, c, o) WHERE contains(p_type, k.t) OR contains(p_brand, k.t)) ON true""")
def coloured(spark, d):
    keys = spark.createDataFrame([("TIN", "red", 1), ("PROMO", "blue", 2), ("#3", "green", 3)], "k string, c string, o int")
    return recode.coloured(table(spark, d, "part"), keys, columns=["p_type", "p_brand"], key="k", colour="c", order="o").select("p_partkey", "colour")


@query(ITEMS + """ SELECT seq, id, CASE WHEN e - b < 20 THEN greatest(b - 30, 0) ELSE b END AS b, least(CASE WHEN e - b < 20 THEN e + 30 ELSE e END, 4000) AS e FROM iv""")
def interval_padded_short(spark, d):
    """Short intervals are widened by a constant, long ones stay."""
    short = F.when(F.col("e") - F.col("b") < 20, 30).otherwise(0)
    return intervals.padded(items(spark, d), begin="b", end="e", length="size", by=short).select("seq", "id", "b", "e")


@query("""SELECT 'P' || s_suppkey AS pattern, 'p' || p_partkey AS header, CAST(2 AS BIGINT) AS begin, CAST(s_suppkey % 20 + 3 AS BIGINT) AS "end", substr(replace(p_name, ' ', ''), 3, s_suppkey % 20 + 1) AS sequence FROM part JOIN supplier ON contains('p' || p_partkey, 'p' || s_suppkey)""")
def source_fasta_regions(spark, d):
    """Stretches cut out of records whose header contains a supplier's name, whatever the case."""
    p = table(spark, d, "part").select(F.concat(F.lit(">p"), "p_partkey", F.lit("\n"), F.regexp_replace("p_name", " ", "\n")).alias("value"))
    path = scratch(spark)
    p.write.text(path)
    chunks = readers.fasta_chunks(spark, path, 16)
    regions = table(spark, d, "supplier").select(F.concat(F.lit("P"), "s_suppkey").alias("pattern"), F.lit(2).cast("long").alias("begin"), (F.col("s_suppkey") % 20 + 3).cast("long").alias("end"), F.lit("t").alias("tag"))
    return readers.excerpts(chunks, regions, 16).select("pattern", "header", "begin", "end", "sequence")


SIDES = """WITH a AS (SELECT CAST(l_quantity AS INTEGER) AS q, l_suppkey % 20 AS qs, l_partkey % 30 AS ts, l_orderkey % 3000 AS b FROM lineitem),
 s AS (SELECT 'Q' AS db, 'Q.q' || qs AS sequid, b, b + 2 * q + 1 AS e, 9000 AS size, 2 * q + 3 AS ali, 1 AS ins, 2 AS del FROM a UNION ALL SELECT 'T', 'T.t' || ts, b, b + 2 * q + 2, 8000, 2 * q + 3, 2, 1 FROM a)"""
MERGED = """, f AS (SELECT *, CASE WHEN b < max(e) OVER (PARTITION BY sequid ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s),
 n AS (SELECT *, sum(fresh) OVER (PARTITION BY sequid ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS k FROM f), u AS (SELECT db, sequid, k, min(b) AS b, max(e) AS e, any_value(size) AS size FROM n GROUP BY ALL),
 w AS (SELECT *, lag(e, 1, 0) OVER (PARTITION BY sequid ORDER BY b) AS before, lead(b) OVER (PARTITION BY sequid ORDER BY b) IS NULL AS last FROM u),
 g AS (SELECT db, sequid, 'mapped' AS region, b, e, size FROM w UNION ALL SELECT db, sequid, 'unmapped', before, b, size FROM w WHERE before <> b UNION ALL SELECT db, sequid, 'unmapped', e, size, size FROM w WHERE last AND e <> size)"""
SUBSETS = """(VALUES ('all', '.'), ('two', '2$')) AS p(subset, pattern)"""
PATTERNS = [("all", "."), ("two", "2$")]


@query(SIDES + f" SELECT db, subset, v.kind, count(*) AS n, median(v.size) AS median, avg(v.size) AS mean, max(v.size) AS max, CAST(sum(v.size) AS BIGINT) AS sum, count(*) FILTER (v.size < 10) AS n_1_10 FROM s JOIN {SUBSETS} ON regexp_matches(sequid, pattern), LATERAL (VALUES ('Ins', ins), ('Del', del)) AS v(kind, size) GROUP BY 1, 2, 3")
def job_alignment_indels(spark, d):
    """Lengths of insertions and deletions by side and subset; on the target side they change places."""
    out = jobs.alignment_stats(spark, paf_text(spark, d), PATTERNS)["indels"]
    return out.select("db", "subset", "kind", "n", "median", "mean", "max", "sum", "n_1_10")


@query(SIDES + MERGED + f" SELECT db, subset, region, count(*) AS n, median(e - b) AS median, max(e - b) AS max, CAST(sum(e - b) AS BIGINT) AS sum FROM g JOIN {SUBSETS} ON regexp_matches(sequid, pattern) GROUP BY 1, 2, 3")
def job_alignment_stretches(spark, d):
    """Mapped and unmapped stretches by side and subset."""
    out = jobs.alignment_stats(spark, paf_text(spark, d), PATTERNS)["regions"]
    return out.where("region in ('mapped', 'unmapped')").select("db", "subset", "region", "n", "median", "max", "sum")


@query(SIDES + MERGED + f" SELECT db, subset, CAST(floor(floor((b + e) / (0.02 * size)) / 4) * 4 + 2 AS BIGINT) AS centre, CAST(sum(CASE WHEN region = 'mapped' THEN e - b ELSE 0 END) AS BIGINT) AS mapped FROM g JOIN {SUBSETS} ON regexp_matches(sequid, pattern) GROUP BY 1, 2, 3")
def job_mapped_positions(spark, d):
    """Mapped bases in steps of four percent along the sequences."""
    return jobs.alignment_stats(spark, paf_text(spark, d), PATTERNS)["positions"].withColumn("centre", F.col("centre").cast("long"))


@query(SIDES + MERGED + """, c AS (SELECT sequid, 'ali_len' AS region, ali AS bp FROM s UNION ALL SELECT sequid, 'Ins', ins FROM s UNION ALL SELECT sequid, 'Del', del FROM s UNION ALL SELECT sequid, 'unmapped', e - b FROM g WHERE region = 'unmapped'),
 t AS (SELECT sequid, region, CASE WHEN count(*) > 1 THEN CAST(CAST(median(bp) AS DOUBLE) AS VARCHAR) || ' ± ' || CAST(floor(1.96 * stddev_samp(bp)) AS BIGINT) ELSE 'NA' END AS told FROM c GROUP BY 1, 2),
 x AS (SELECT sequid, CAST(10000 * sum(e - b) AS BIGINT) AS n, any_value(size) AS z FROM u GROUP BY 1),
 v AS (SELECT sequid, (n // z + CASE WHEN 2 * (n % z) > z OR (2 * (n % z) = z AND n // z % 2 = 1) THEN 1 ELSE 0 END) / 100 AS percent FROM x)
 SELECT v.sequid, v.percent, coalesce(max(told) FILTER (region = 'unmapped'), 'NA') AS unmapped, coalesce(max(told) FILTER (region = 'ali_len'), 'NA') AS ali_len, coalesce(max(told) FILTER (region = 'Del'), 'NA') AS "Del", coalesce(max(told) FILTER (region = 'Ins'), 'NA') AS "Ins"
 FROM v LEFT JOIN t USING (sequid) GROUP BY 1, 2""")
def job_coordinates(spark, d):
    """Coverage and typical lengths of each sequence, from the alignment text; every length counts."""
    return jobs.alignment_stats(spark, paf_text(spark, d), PATTERNS)["coordinates"]


@query(CIGAR + """, o AS (SELECT id, q, i, d, l_orderkey AS x FROM al JOIN (SELECT DISTINCT l_orderkey, l_orderkey * 10 + l_linenumber AS k FROM lineitem) ON k = id)
 SELECT v.op, count(*) AS n, CAST(sum(v.pos * v.place) AS BIGINT) AS places, CAST(sum(v.len) AS BIGINT) AS len FROM o, LATERAL (VALUES ('M', 0, q, x), ('I', 1, i, x + q), ('M', 2, q, x + q), ('D', 3, d, x + 2 * q), ('M', 4, q, x + 2 * q + d)) AS v(op, place, len, pos) GROUP BY 1""")
def cigar_operations(spark, d):
    """Every operation with where it starts on the target."""
    rows = alignments(spark, d).withColumn("x", F.floor(F.col("id") / 10))
    out = cigar.operations(rows, ["id"], "cg", "x")
    return out.groupBy("op").agg(F.count("*").alias("n"), F.sum(F.col("at") * F.col("place")).cast("long").alias("places"), F.sum("len").alias("len"))


SEGMENTS = """WITH sg AS (SELECT s_suppkey AS id, 'm' || (s_suppkey // (2 + s_suppkey % 2)) AS multiplicon, s_nationkey AS x, CAST(round(s_acctbal) AS BIGINT) AS size FROM supplier)"""


def segments(spark, d):
    t = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    return t.select(k.alias("id"), F.concat(F.lit("m"), F.floor(k / (2 + k % 2)).cast("long")).alias("multiplicon"), F.col("s_nationkey").alias("x"), F.round("s_acctbal").cast("long").alias("size"))


@query(SEGMENTS + """, two AS (SELECT *, count(*) OVER (PARTITION BY multiplicon) AS n, row_number() OVER (PARTITION BY multiplicon ORDER BY id) AS r FROM sg)
 SELECT a.multiplicon, a.id AS id_a, b.id AS id_b, a.x = b.x AS same, CASE WHEN a.size <> 0 AND b.size <> 0 THEN round(greatest(a.size / b.size, b.size / a.size), 6) END AS ratio FROM two a JOIN two b USING (multiplicon) WHERE a.n = 2 AND a.r = 1 AND b.r = 2""")
def segment_pairs(spark, d):
    """Segments of multiplicons of two, side by side, with the ratio of their sizes."""
    both = families.paired_segments(segments(spark, d), order="id")
    return rounded(both.select("multiplicon", "id_a", "id_b", (F.col("x_a") == F.col("x_b")).alias("same"), families.ratio("size_a", "size_b").alias("ratio")))


@query(SEGMENTS + " SELECT n AS segments, count(*) AS multiplicons FROM (SELECT count(*) AS n FROM sg GROUP BY multiplicon) GROUP BY 1")
def multiplicon_sizes(spark, d):
    return families.multiplicon_sizes(segments(spark, d))


@query(GENES + """, o AS (SELECT seq, count(*) AS n FROM ge GROUP BY 1), p AS (SELECT a.seq AS x, b.seq AS y, count(*) AS n FROM ge a JOIN ge b ON a.og = b.og AND a.gene < b.gene GROUP BY 1, 2)
 SELECT least(x, y) AS seq_a, greatest(x, y) AS seq_b, CAST(sum(n) AS BIGINT) AS pairs FROM p GROUP BY 1, 2""")
def family_pairs_counted(spark, d):
    """Pairs of family members on every two sequences, counted without being made."""
    out = families.pair_distances(genes(spark, d), family="og", id="gene", seq="seq", begin="b", end="e")
    return out.select(F.col("seq").alias("seq_a"), F.col("seq_r").alias("seq_b"), "pairs")


def fed(spark, d, rows, time: str, files: int = 4) -> str:
    """A folder of files that hold rows in order of time, written one after the other."""
    low, high = (x.timestamp() for x in rows.agg(F.min(time), F.max(time)).first())
    path = scratch(spark)
    part = F.floor((F.unix_timestamp(time) - math.floor(low)) * files / (high - low + 1))
    for k in range(files):
        rows.where(part == k).repartition(1).write.mode("append").parquet(path)  # read by many tasks, written by one
    return path


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, median(value) AS median, max(value) AS high FROM events WHERE user_id % 3 <> 0 GROUP BY 1")
def streaming_taken_back(spark, d):
    """Events in several batches; those of every third user are taken back in the end."""
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    signed = rows.withColumn("sign", F.lit(1)).unionByName(rows.where("user_id % 3 = 0").withColumn("sign", F.lit(-1)))
    out = running.kept_values(running.file_stream(spark, fed(spark, d, signed, "ts"), 1), group=["event_type"], value="value", sign="sign")
    last = running.drained(out, "update", key=["event_type"])
    return last.select("event_type", "n", F.round("mean", 6).alias("mean"), "low", "median", "high")


@query("""WITH m AS (SELECT max(epoch_ms(ts)) - 3600000 AS mark FROM events)
 SELECT CAST(floor(epoch(ts)) AS BIGINT) // 5400 * 5400 AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, m
 WHERE CAST(floor(epoch(ts)) AS BIGINT) % 5400 < 3600 AND (CAST(floor(epoch(ts)) AS BIGINT) // 5400 * 5400 + 5400) * 1000 <= mark GROUP BY 1, 2""")
def streaming_closed_windows(spark, d):
    """Windows that the watermark, an hour behind the latest event, has closed: each told once, in append mode."""
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = running.file_stream(spark, fed(spark, d, rows, "ts"), 1)
    out = running.jumping_windows(stream, time="ts", width=3600, jump=1800, group=["event_type"], value="value", late="1 hour")
    return running.drained(out).withColumn("total", F.round("total", 4))


@query("SELECT count(*) AS lines, count(*) FILTER (l_linenumber <> 3) AS bad FROM lineitem")
def source_lines_observed(spark, d):
    """Lines of 13 to 19 fields, counted while their table is written: one scan of the text."""
    t = table(spark, d, "lineitem")
    text = F.concat_ws(" ", F.col("l_orderkey").cast("string"), F.array_repeat(F.lit("1"), (F.col("l_linenumber") + 11).cast("int")))
    rows, seen = readers.observed_repeats(spark, lines(spark, t, text))
    written = kept(rows)
    return written.agg(F.lit(seen.get["lines"]).cast("long").alias("lines"), F.lit(seen.get["bad"]).cast("long").alias("bad"))


@query("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (l_quantity < 10) AS a, count(*) FILTER (l_discount > 0.05) AS b, count(*) FILTER (l_quantity < 10 OR l_discount > 0.05) AS c FROM lineitem)
 SELECT v.rule, v.removed, round_even(100.0 * v.removed / n, 2) AS percent FROM c, LATERAL (VALUES ('long', a), ('cheap', b), ('combined', c)) AS v(rule, removed)""")
def filter_observed(spark, d):
    """What two rules remove, counted while the rows that they keep are written."""
    rows, told = recode.filtered(table(spark, d, "lineitem"), {"long": F.col("l_quantity") >= 10, "cheap": F.col("l_discount") <= 0.05})
    kept(rows)
    return told()


@query("""SELECT o_orderkey % 4 AS round, 1 + o_orderkey % 2 AS replicate, count(*) AS n, round(sum(o_totalprice), 2) AS likelihood, CAST(sum(o_orderkey % 5) AS DOUBLE) AS a, CAST(sum(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 7 END) AS DOUBLE) AS c FROM orders GROUP BY 1, 2""")
def source_logs_typed(spark, d):
    """Logs under two headers with different parameters; values that are numbers come as numbers."""
    o = table(spark, d, "orders")
    third = F.col("o_orderkey") % 3 == 0
    head = F.concat(F.lit("Model\tReplicate\tlog-likelihood\toptimized_params("), F.when(third, "a, c)").otherwise("a, b)"))
    last = F.concat(F.col("o_orderkey") % 5, F.lit(","), F.when(third, (F.col("o_custkey") % 7).cast("string")).otherwise("none"))
    replicate = F.concat(F.lit("Round_"), F.col("o_orderkey") % 4, F.lit("_Replicate_"), 1 + F.col("o_orderkey") % 2)
    rows = readers.optimisation_logs(spark, lines(spark, o, head, F.concat_ws("\t", F.lit("x_1"), replicate, "o_totalprice", last), sep="\n"))
    value = lambda c: F.sum(F.col("numbers")[c])
    out = rows.groupBy(F.col("round").cast("long").alias("round"), F.col("replicate").cast("long").alias("replicate"))
    return out.agg(F.count("*").alias("n"), F.round(value("log-likelihood"), 2).alias("likelihood"), value("a").alias("a"), value("c").alias("c"))


@query("SELECT true AS about, true AS there, true AS differ")
def lines_sampled_twice(spark, d):
    """Samples of 1000 lines: within five standard deviations of that, all of the text, and other ones for another seed."""
    t = table(spark, d, "lineitem").withColumn("k", F.monotonically_increasing_id())
    path = lines(spark, t, "k", "l_orderkey")
    one, other = (kept(readers.sampled_lines(spark, path, 1000, seed)) for seed in (1, 2))
    there = one.join(spark.read.text(path), "value", "left_semi").count() == one.count()
    differ = one.join(other, "value", "left_anti").count() > 0
    return one.agg(F.count("*").between(840, 1160).alias("about"), F.lit(there).alias("there"), F.lit(differ).alias("differ"))
