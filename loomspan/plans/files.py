"""Registered queries of readers, writers and jobs: the driver's tables are written in a format's text, read back and analysed.

Line items are repeats (supplier = sequence), alignments, gene models and families; their texts go to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.taxonomy import MITE_RULES, RULES
from loomspan.operators import families, recode, summary, windows
from loomspan.plans import jobs
from loomspan.plans.catalog import query, rounded, table
from loomspan.session import scratch
from loomspan.sources import readers, writers


def lines(spark: SparkSession, df: DataFrame, *columns: Column | str, sep: str = "\t") -> str:
    """The folder of a text with one line a row."""
    path = scratch(spark)
    df.select(F.concat_ws(sep, *[c.cast("string") if isinstance(c, Column) else F.col(c).cast("string") for c in columns]).alias("value")).write.text(path)
    return path


CLASSES = ["DNA/hAT", "LINE/L1", "LTR/Gypsy", "SINE/tRNA", "Simple_repeat", "RC/Helitron", "nonsense"]


def repeat_text(spark: SparkSession, d: str) -> str:
    t = table(spark, d, "lineitem")
    kind = F.element_at(F.array(*map(F.lit, CLASSES)), (F.col("l_partkey") % len(CLASSES) + 1).cast("int"))
    begin = F.col("l_orderkey") % 5000 + 1
    mark = F.when(F.col("l_linenumber") == 7, "*")
    one = [F.lit(x) for x in ("(0)", "+", "1", "2", "(0)", "1")]
    return lines(
        spark, t, F.round(F.col("l_extendedprice") * 100).cast("long"), F.round(F.col("l_discount") * 100, 1), F.lit("0.5"), F.lit("0.0"), F.concat(F.lit("s"), "l_suppkey"), begin,
        begin + F.col("l_quantity").cast("int") - 1, one[0], one[1], F.concat(F.lit("fam"), F.col("l_partkey") % 50), kind, *one[2:], mark, sep=" ",
    )


REPEATS = f"""WITH rp AS (SELECT 's' || l_suppkey AS sequid, l_orderkey % 5000 + 1 AS b, CAST(l_quantity AS INTEGER) AS bp, CAST(round(l_extendedprice * 100) AS BIGINT) AS score, round(l_discount * 100, 1) AS divg,
 {CLASSES}[l_partkey % {len(CLASSES)} + 1] AS label, l_linenumber = 7 AS overlapping, 'fam' || (l_partkey % 50) AS name FROM lineitem)"""


@query(REPEATS + " SELECT sequid, label AS default_repclass, count(*) AS n, CAST(sum(bp) AS BIGINT) AS bp, count(*) FILTER (overlapping) AS marked, round(avg(divg), 6) AS divg FROM rp GROUP BY 1, 2")
def source_repeats(spark, d):
    rows = readers.repeats(spark, repeat_text(spark, d), fail=True)
    out = rows.groupBy("sequid", "default_repclass").agg(F.count("*").alias("n"), F.sum("bp_naive").alias("bp"), F.count_if("overlapping").alias("marked"), F.avg("perc_divg").alias("divg"))
    return rounded(out)


@query(REPEATS + " SELECT name, count(*) AS n, CAST(sum(bp) AS BIGINT) AS bp, count(*) FILTER (overlapping) AS marked FROM rp GROUP BY 1")
def source_preprocessed_repeats(spark, d):
    """Preprocessed tables go through a TSV of their own and come back with the species' name."""
    path = scratch(spark)
    rows = readers.repeats(spark, repeat_text(spark, d)).withColumn("bp_algor", F.col("bp_naive"))
    writers.tsv(rows, path)
    back = readers.preprocessed_repeats(spark, {"sp": path}).where("Species = 'sp'")
    return back.groupBy("name").agg(F.count("*").alias("n"), F.sum("bp_algor").alias("bp"), F.count_if("overlapping").alias("marked"))


@query(REPEATS + """, u AS (SELECT count(*) AS n, CAST(sum(bp) AS BIGINT) AS bp FROM rp), p AS (SELECT sequid, unnest(range(b, b + bp)) AS base FROM rp), k AS (SELECT count(*) AS bp FROM (SELECT DISTINCT sequid, base FROM p))
 SELECT u.n AS naive_numele, u.bp AS naive_totbp, k.bp AS algor_totbp FROM u, k""")
def job_repeat_summaries(spark, d):
    """Preprocessing and summaries from the raw text; the totals over all levels."""
    rows = jobs.preprocess_repeats(spark, repeat_text(spark, d)).withColumn("Species", F.lit("sp"))
    out = jobs.repeat_summaries(rows)
    return out.where("level = 0").select("naive_numele", F.col("naive_totbp").cast("long").alias("naive_totbp"), F.col("algor_totbp").cast("long").alias("algor_totbp"))


@query(REPEATS + """, c AS (SELECT CASE label WHEN 'DNA/hAT' THEN 'DNA' WHEN 'RC/Helitron' THEN 'DNA' WHEN 'Simple_repeat' THEN 'Tandem_repeat' ELSE 'Retrotransposon' END AS class, divg FROM rp WHERE label <> 'nonsense')
 SELECT class, CAST(floor(divg) AS BIGINT) AS bin, count(*) AS "count" FROM c GROUP BY 1, 2""")
def job_repeat_distributions(spark, d):
    """Histograms of divergence by class."""
    rows = readers.repeats(spark, repeat_text(spark, d)).withColumns({"Species": F.lit("sp"), "bp_algor": F.col("bp_naive")})
    return jobs.repeat_distributions(rows)["divergence"].where("level = 1").select("class", "bin", "count")


@query("""SELECT 's' || l_suppkey AS sequid, l_partkey % 5 AS c, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2""")
def source_legacy_repeats(spark, d):
    t = table(spark, d, "lineitem")
    part = [F.lit(x) for x in ("1.0", "0", "0")]
    path = lines(spark, t, F.col("l_quantity").cast("int"), *part, F.concat(F.lit("s"), "l_suppkey"), F.lit(1), F.lit(9), F.lit("(0)"), F.lit("+"), F.lit("n"), F.lit("x"), F.lit(1), F.lit(2), F.lit("(0)"), F.lit(1), F.concat(F.lit("c"), F.col("l_partkey") % 5), F.lit("a"), F.lit("b"), F.lit("d"), sep=" ")
    rows = readers.legacy_repeats(spark, path)
    return rows.groupBy("sequid", F.substring("Class", 2, 9).cast("long").alias("c")).agg(F.count("*").alias("n"), F.sum("score_SW").alias("q"))


@query("SELECT 'nation' || n_nationkey AS sequid, 0 AS start, CAST(n_regionkey AS BIGINT) * 1000 + 7 AS \"end\" FROM nation")
def source_sequence_index(spark, d):
    n = table(spark, d, "nation")
    out = readers.sequence_index(spark, lines(spark, n, F.concat(F.lit("nation"), "n_nationkey"), F.col("n_regionkey") * 1000 + 7, sep="  "))
    return out.select("sequid", F.col("start").cast("int").alias("start"), "end")


@query("SELECT 'sp' AS Species, r_name AS Subset, '^' || r_regionkey AS Pattern, CAST(r_regionkey AS BIGINT) * 10 AS Bpsum FROM region WHERE r_name NOT LIKE '% %'")
def source_subset_index(spark, d):
    r = table(spark, d, "region").where("r_name not like '% %'")
    return readers.subset_index(spark, {"sp": lines(spark, r, "r_name", F.concat(F.lit("^"), "r_regionkey"), F.col("r_regionkey") * 10, sep=" ")})


def paf_text(spark: SparkSession, d: str) -> str:
    t = table(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("int"))
    b, e = F.col("l_orderkey") % 3000, F.col("l_orderkey") % 3000 + 2 * F.col("q") + 1
    cg = F.concat(F.lit("cg:Z:"), "q", F.lit("M1I"), "q", F.lit("M2D"))
    return lines(
        spark, t, F.concat(F.lit("q"), F.col("l_suppkey") % 20), F.lit(9000), b, e, F.lit("+"), F.concat(F.lit("t"), F.col("l_partkey") % 30), F.lit(8000), b, e + 1, 2 * F.col("q") - F.col("l_linenumber") % 2,
        2 * F.col("q") + 3, F.col("l_linenumber"), F.lit("tp:A:P"), F.concat(F.lit("NM:i:"), F.col("l_linenumber") % 2 + 3), cg,
    )


@query("""WITH p AS (SELECT 'q' || (l_suppkey % 20) AS Qname, CAST(l_quantity AS INTEGER) AS q, l_linenumber % 2 AS x FROM lineitem)
 SELECT Qname, count(*) AS n, CAST(sum(2 * q - x) AS BIGINT) AS matches, CAST(sum(x) AS BIGINT) AS mismatches, count(*) AS insertions, CAST(2 * count(*) AS BIGINT) AS deletions,
 round(avg((2.0 * q - x) / (2 * q + 3)), 6) AS blast_identity, round(avg((2.0 * q - x) / (2 * q + 2)), 6) AS gap_compr_identity FROM p GROUP BY 1""")
def source_paf(spark, d):
    rows = readers.paf(spark, paf_text(spark, d), drop_empty=True)
    return rounded(rows.groupBy("Qname").agg(
        F.count("*").alias("n"), F.sum("matches").alias("matches"), F.sum("mismatches").cast("long").alias("mismatches"), F.sum("cig_insertions").alias("insertions"), F.sum("cig_deletions").alias("deletions"),
        F.avg("blast_identity").alias("blast_identity"), F.avg("gap_compr_identity").alias("gap_compr_identity"),
    ))


@query("""WITH p AS (SELECT CAST(l_quantity AS INTEGER) AS q, l_linenumber % 2 AS x, unnest(['Q', 'T']) AS db FROM lineitem)
 SELECT db, 'all' AS subset, v.region, count(*) AS n, CAST(sum(v.bp) AS BIGINT) AS sum FROM p, LATERAL (VALUES ('ali_len', 2 * q + 3), ('matches', 2 * q - x), ('mismatches', x)) AS v(region, bp) GROUP BY 1, 3""")
def job_alignment_regions(spark, d):
    """Alignment lengths, matches and mismatches by side, from the alignment text."""
    out = jobs.alignment_stats(spark, paf_text(spark, d), [("all", ".")])["regions"]
    return out.where("region not in ('mapped', 'unmapped')").select("db", "subset", "region", "n", "sum")


@query("""WITH s AS (SELECT 'Q.q' || (l_suppkey % 20) AS k, 9000 AS l, l_orderkey % 3000 AS b, l_orderkey % 3000 + 2 * CAST(l_quantity AS INTEGER) + 1 AS e FROM lineitem
  UNION ALL SELECT 'T.t' || (l_partkey % 30), 8000, l_orderkey % 3000, l_orderkey % 3000 + 2 * CAST(l_quantity AS INTEGER) + 2 FROM lineitem), b AS (SELECT DISTINCT k, unnest(range(b, e)) AS base FROM s),
 u AS (SELECT k, count(*) AS bp FROM b GROUP BY 1), n AS (SELECT k, any_value(l) AS size, CAST(sum(e - b) AS BIGINT) AS naive FROM s GROUP BY 1)
 SELECT left(k, 1) AS db, 'all' AS subset, v.algorithm, CAST(sum(v.bp) AS BIGINT) AS bp, round(100.0 * sum(v.bp) / sum(n.naive), 6) AS percent_naive, round(100.0 * sum(v.bp) / sum(n.size), 6) AS percent_subset
 FROM u JOIN n USING (k), LATERAL (VALUES ('naive', n.naive), ('algor', u.bp)) AS v(algorithm, bp) GROUP BY 1, 3""")
def job_alignment_overlap(spark, d):
    """Naive and resolved bases of both sides; resolved ones sum up to the bases covered."""
    return rounded(jobs.alignment_stats(spark, paf_text(spark, d), [("all", ".")])["overlap"])


def models(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    path = lines(spark, t, F.concat(F.lit("s"), F.col("l_suppkey") % 9), F.lit("x"), F.lit("gene"), "l_orderkey", F.col("l_orderkey") + F.col("l_quantity").cast("int"), F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit("ID=g"), "l_partkey", F.lit(";n=1")))
    return readers.gff3(spark, path)


@query("""SELECT 'g' || l_partkey AS gene, count(*) AS n, CAST(min(l_orderkey) AS BIGINT) AS first, CAST(max(l_orderkey + CAST(l_quantity AS INTEGER)) AS BIGINT) AS last FROM lineitem GROUP BY 1""")
def source_gff3(spark, d):
    return models(spark, d).groupBy("gene").agg(F.count("*").alias("n"), F.min("start").alias("first"), F.max("end").alias("last"))


@query("""WITH f AS (SELECT DISTINCT c_nationkey AS k, c_custkey AS g FROM customer) SELECT n AS size, count(*) AS families FROM (SELECT count(*) AS n FROM f GROUP BY k) GROUP BY 1""")
def source_family_lists(spark, d):
    """Families written a line each and read back."""
    path = scratch(spark)
    writers.family_lists(table(spark, d, "customer").select("c_nationkey", F.col("c_custkey").cast("string").alias("g")), path, family="c_nationkey", id="g")
    return readers.family_lists(spark, path).groupBy("family").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("families"))


@query("""WITH f AS (SELECT DISTINCT l_suppkey % 7 AS fam, 'g' || l_partkey AS gene FROM lineitem WHERE l_partkey % 2 = 0), m AS (SELECT 'g' || l_partkey AS gene, 's' || (l_suppkey % 9) AS seq, l_orderkey AS b, l_orderkey + CAST(l_quantity AS INTEGER) AS e FROM lineitem),
 o AS (SELECT gene, arg_min(seq, (b, e, seq)) AS seq FROM m GROUP BY 1) SELECT seq AS sequid, CAST(count(*) AS BIGINT) AS members FROM f JOIN o USING (gene) GROUP BY 1""")
def job_paranome(spark, d):
    """Families of genes placed by the first model of each gene; members by sequence."""
    fam = table(spark, d, "lineitem").where("l_partkey % 2 = 0").select((F.col("l_suppkey") % 7).alias("family"), F.concat(F.lit("g"), "l_partkey").alias("gene")).distinct()
    return jobs.paranome_tables(fam, models(spark, d))["presence"].groupBy("sequid").agg(F.sum("members").alias("members"))


def groups(spark: SparkSession, d: str) -> DataFrame:
    """Orthogroups written as TSV and read back: a part's line items, flags as species."""
    path, t = scratch(spark), table(spark, d, "lineitem")
    no = F.lit(False)
    names = [F.concat(F.lit("OG"), "l_partkey").alias("OGid"), F.lit("m").alias("Method"), F.col("l_returnflag").alias("Species"), F.lit("b").alias("BRAKER_status"), no.alias("ChimericGeneStatus")]
    names += [F.lit("x").alias(c) for c in ("RNAseq_status", "RNAseq_OGstatus", "GO_status", "GO_OGstatus")]
    names += [(F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("GeneID"), F.concat(F.lit("s"), "l_suppkey").alias("Scaffold"), F.when(F.col("l_suppkey") % 2 == 0, "Chr").otherwise("Scaffold").alias("ScaffoldCategory")]
    names += [F.lit(1).alias("GeneStart"), F.lit(2).alias("GeneEnd"), F.lit("1.1").alias("OGtype")]
    writers.tsv(t.select(*names), path)
    return readers.orthogroups(spark, path)


@query("""WITH n AS (SELECT l_partkey AS k, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
 SELECT least(a, 5) AS n_a, least(r, 5) AS n_b, count(*) AS groups FROM n GROUP BY 1, 2""")
def job_orthogroups(spark, d):
    return jobs.orthogroup_tables(groups(spark, d), "A", "R")["occupancy"]


@query("""SELECT 'm' || (s_suppkey % 5) AS genome, count(*) AS n, CAST(sum(s_nationkey) AS BIGINT) AS orders FROM supplier GROUP BY 1""")
def source_segments(spark, d):
    path, s = scratch(spark), table(spark, d, "supplier")
    writers.tsv(s.select("s_suppkey", F.lit(1).alias("m"), F.concat(F.lit("m"), F.col("s_suppkey") % 5).alias("genome"), F.lit("q").alias("l"), F.lit("a").alias("f"), F.lit("b").alias("e"), "s_nationkey"), path)
    return readers.segments(spark, path).groupBy("genome").agg(F.count("*").alias("n"), F.sum("order").alias("orders"))


HISTOGRAM = "WITH h AS (SELECT CAST(l_quantity AS BIGINT) AS covg, count(*) AS freq FROM lineitem GROUP BY 1), k AS (SELECT * FROM h WHERE covg < (SELECT max(covg) FROM h))"


def depths(spark: SparkSession, d: str) -> DataFrame:
    """A coverage histogram, one file; its last bin is not read."""
    path = scratch(spark)
    h = table(spark, d, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("cov")).agg(F.count("*").alias("Freq"))
    h.coalesce(1).write.option("header", True).csv(path)  # a histogram: one row a coverage
    return readers.coverage(spark, path).withColumn("sample", F.lit("s1"))


@query(HISTOGRAM + " SELECT covg, freq AS s1, CAST(0 AS BIGINT) AS s2 FROM k")
def source_coverage(spark, d):
    return readers.coverage_wide(depths(spark, d), ["s1", "s2"]).select("covg", "s1", F.col("s2").cast("long").alias("s2"))


@query(HISTOGRAM + """, m AS (SELECT sum(covg * freq) / sum(freq) AS mean, arg_max(covg, (freq, -covg)) AS modal FROM k), b AS (SELECT sum(l_orderkey) AS bases FROM lineitem)
 SELECT 's1' AS sample, round(mean, 6) AS mean, CAST(bases AS DOUBLE) AS bases, round(bases / mean, 3) AS genome_size, round(bases / modal, 3) AS genome_size_modal FROM m, b""")
def job_coverage_report(spark, d):
    """Genome size over mean and modal coverage; the bases come from a report's summary line."""
    total = table(spark, d, "lineitem").agg(F.sum("l_orderkey").alias("b"))
    stats = readers.stats_reports(spark, lines(spark, total, F.lit("SN"), F.lit("bases mapped (cigar):"), "b")).withColumn("sample", F.lit("s1"))
    out = jobs.coverage_report(depths(spark, d), stats)
    return out.select("sample", F.round("mean", 6).alias("mean"), "bases", F.round("genome_size", 3).alias("genome_size"), F.round("genome_size_modal", 3).alias("genome_size_modal"))


@query("SELECT 'p' || p_partkey AS header, length(replace(p_name, ' ', '')) AS n, substr(replace(p_name, ' ', ''), 3, 4) AS part FROM part")
def source_fasta(spark, d):
    """Records of two lines each; their lengths and an excerpt."""
    p = table(spark, d, "part").select(F.concat(F.lit(">p"), "p_partkey").alias("h"), F.regexp_replace("p_name", " ", "").alias("s"))
    rows = readers.fasta(spark, lines(spark, p, "h", F.substring("s", 1, 5), F.expr("substring(s, 6)"), sep="\n"))
    return rows.select("header", F.length("sequence").cast("long").alias("n"), F.substring("sequence", 3, 4).alias("part"))


@query("""SELECT 'x' AS model, o_orderkey % 4 AS round, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 2""")
def source_logs(spark, d):
    """Logs whose header comes again after every line."""
    o = table(spark, d, "orders")
    head = "Model\tReplicate\tlog-likelihood\toptimized_params(a, b)"
    path = lines(spark, o, F.lit(head), F.concat_ws("\t", F.lit("x_1"), F.concat(F.lit("Round_"), F.col("o_orderkey") % 4, F.lit("_Replicate_1")), "o_totalprice", F.lit("1,2")), sep="\n")
    rows = readers.optimisation_logs(spark, path)
    return rows.groupBy("model", F.col("round").cast("long").alias("round")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("values")["log-likelihood"].cast("double")), 2).alias("total"))


@query("SELECT p_partkey, CAST(length(p_name) - length(replace(p_name, ' ', '')) + CASE WHEN right(p_name, 1) = ' ' THEN 0 ELSE 1 END AS BIGINT) AS n FROM part")
def lines_split_after(spark, d):
    rows = readers.split_after(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", " ").where("p_name <> ''")
    return rows.groupBy("p_partkey").agg(F.count("*").alias("n"))


@query("SELECT count(*) BETWEEN 1 AND (SELECT count(*) FROM lineitem) AS within FROM lineitem")
def lines_sampled(spark, d):
    """About a thousand lines, whatever the text's size."""
    n = readers.sampled_lines(spark, repeat_text(spark, d), 1000)
    return n.agg(F.count("*").between(F.lit(1), F.lit(3000)).alias("within"))


@query('SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_tax), 2) AS tax FROM lineitem GROUP BY 1, 2')
def sink_partitioned(spark, d):
    path = scratch(spark)
    writers.partitioned(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_tax"), path, ["l_returnflag", "l_linestatus"])
    return spark.read.parquet(path).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_tax"), 2).alias("tax"))


@query("""WITH w AS (SELECT l_returnflag AS s, (l_partkey + l_partkey + CAST(l_quantity AS BIGINT)) / 2 // 100 AS k, sum(l_quantity) AS t FROM lineitem GROUP BY 1, 2), x AS (SELECT l_returnflag AS s, max(l_partkey) + 1 AS stop FROM lineitem GROUP BY 1)
 SELECT s AS sequid, CAST(sum(t) AS BIGINT) AS total FROM w JOIN x USING (s) WHERE k < greatest(ceil(stop / 100.0), 1) GROUP BY 1""")
def job_windows(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("sequid"), F.col("l_partkey").alias("begin"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"), F.col("l_quantity").cast("long").alias("bp_algor"))
    sizes = rows.groupBy("sequid").agg(F.lit(0).cast("long").alias("start"), (F.max("begin") + 1).alias("end"))
    return jobs.window_tables(rows, sizes, width=100).groupBy("sequid").agg(F.sum("total").alias("total"))


@query("""SELECT p_brand, count(*) AS n, count(*) FILTER (p_size & 5 = 0) AS unflagged, count(*) FILTER (p_size >= 45 AND p_partkey > 3500) AS high, count(*) FILTER (lower(p_type) LIKE '%large%') AS large,
 count(DISTINCT CASE WHEN regexp_matches(p_type, 'economy', 'i') THEN 'x' ELSE p_type END) AS types FROM part GROUP BY 1""")
def column_filters(spark, d):
    """Flag masks, presets, substrings and collapsed names."""
    t = table(spark, d, "part")
    flagged = recode.without_flags(t, "p_size", 5).groupBy("p_brand").agg(F.count("*").alias("unflagged"))
    one = t.groupBy("p_brand").agg(
        F.count("*").alias("n"),
        F.count_if(recode.preset("high", "p_size", "p_partkey")).alias("high"),
        F.count_if(recode.has_text("p_type", "LARGE")).alias("large"),
        F.count_distinct(recode.collapsed("p_type", "economy", "x")).alias("types"),
    )
    return one.join(flagged, "p_brand", "left").na.fill(0, ["unflagged"]).select("p_brand", "n", "unflagged", "high", "large", "types")


@query("SELECT p_type, p_brand, count(*) AS n FROM part WHERE (regexp_matches(p_type, 'LARGE') AND regexp_matches(p_brand, '1$')) OR (regexp_matches(p_type, '^S') AND regexp_matches(p_brand, '#3|#4')) GROUP BY 1, 2")
def pattern_pairs(spark, d):
    pairs = spark.createDataFrame([("LARGE", "1$"), ("^S", "#3|#4")], "pattern_a string, pattern_b string")
    return recode.matches_any_pair(table(spark, d, "part"), pairs, a="p_type", b="p_brand").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END AS rank, count(*) AS n FROM orders GROUP BY 1")
def category_order(spark, d):
    rank = recode.category_order("o_orderpriority", {"5-LOW": 0, "1-URGENT": 1})
    return table(spark, d, "orders").groupBy("o_orderpriority", rank.alias("rank")).agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean, round(avg(l_extendedprice) - stddev_samp(l_extendedprice) * 0.01, 4) AS low, round(avg(l_extendedprice) + stddev_samp(l_extendedprice) * 0.01, 4) AS high FROM lineitem GROUP BY 1")
def mean_band(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg("l_extendedprice").alias("mean"), (F.stddev_samp("l_extendedprice") * 0.01).alias("sd"))
    low, high = windows.band("mean", "sd")
    return rounded(t.select("l_returnflag", "mean", low.alias("low"), high.alias("high")), 4)


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS n, CAST(sum(l_linenumber * l_suppkey) AS BIGINT) AS s FROM lineitem")
def frequencies_expanded(spark, d):
    """Each line item as often as its line number says."""
    rows = summary.expanded(table(spark, d, "lineitem").select("l_linenumber", "l_suppkey"), "l_linenumber")
    return rows.agg(F.count("*").alias("n"), F.sum("l_suppkey").alias("s"))


@query("""SELECT CAST(CASE WHEN l_returnflag = 'A' THEN l_linenumber ELSE l_suppkey % 5 END AS INTEGER) AS own, CAST(CASE WHEN l_returnflag = 'A' THEN l_suppkey % 5 ELSE l_linenumber END AS INTEGER) AS other, count(*) AS n FROM lineitem GROUP BY ALL""")
def copy_classes(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", F.concat_ws(".", "l_linenumber", F.col("l_suppkey") % 5, F.lit(0)).alias("kind"))
    return families.copy_classes(rows, kind="kind", species="l_returnflag", names=["A", "R"]).groupBy("own", "other").agg(F.count("*").alias("n"))


@query("SELECT l_linenumber AS tier, count(DISTINCT l_partkey) AS groups FROM lineitem GROUP BY 1")
def quality_counts(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("og"), F.col("l_linenumber").alias("tier"))
    return families.quality_counts(rows, group="og", tier="tier")


@query(REPEATS + """ SELECT label AS default_repclass, m.class, m."order", count(*) AS "rows" FROM rp JOIN (VALUES ('DNA/hAT', 'DNA', 'TIR'), ('LINE/L1', 'Retrotransposon', 'LINE'), ('LTR/Gypsy', 'Retrotransposon', 'LTR'),
 ('SINE/tRNA', 'Retrotransposon', 'SINE'), ('Simple_repeat', 'Tandem_repeat', 'NA'), ('RC/Helitron', 'DNA', 'Helitron'), ('nonsense', NULL, NULL)) AS m(k, class, "order") ON k = label GROUP BY ALL""")
def classification_audit(spark, d):
    rows = recode.classified(readers.repeats(spark, repeat_text(spark, d)), label="default_repclass")
    return recode.classification_audit(rows, label="default_repclass").select("default_repclass", "class", "order", "rows")


def _label(rule: str) -> str:
    """A label that a rule's first alternative matches."""
    terms = [t[1:].removeprefix("i ") for t in rule.split("|")[0].split("&")]
    return "_".join(terms)


def _sql(rule: str) -> str:
    def term(t: str) -> str:
        if t.startswith("~i "):
            return f"contains(lower(k), '{t[3:].lower()}')"
        return {"=": f"k = '{t[1:]}'", "~": f"contains(k, '{t[1:]}')", "^": f"starts_with(k, '{t[1:]}')"}[t[0]]

    return " OR ".join("(" + " AND ".join(map(term, part.split("&"))) + ")" for part in rule.split("|"))


LABELS = sorted({_label(rule) for rule, _ in [*RULES, *MITE_RULES]} | {"nonsense"})
_CASES = " ".join(f"WHEN {_sql(rule)} THEN '{'|'.join(levels)}'" for rule, levels in reversed(RULES))
_MITES = " ".join(f"WHEN {_sql(rule)} THEN {str(flag).lower()}" for rule, flag in reversed(MITE_RULES))


@query(f"""WITH l AS (SELECT {LABELS}[l_partkey % {len(LABELS)} + 1] AS k FROM lineitem)
 SELECT k, CASE {_CASES} END AS path, CASE {_MITES} END AS mite, count(*) AS n FROM l GROUP BY ALL""")
def taxonomy_rules(spark, d):
    """A label for every rule; line items stand for annotations. path: the four levels; the last rule that matches wins."""
    k = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("l_partkey") % len(LABELS) + 1).cast("int"))
    rows = recode.classified(table(spark, d, "lineitem").select(k.alias("k")), label="k")
    path = F.when(F.col("class").isNotNull(), F.concat_ws("|", "class", "subclass", "order", "superfam"))
    return rows.groupBy("k", path.alias("path"), "mite").agg(F.count("*").alias("n"))
