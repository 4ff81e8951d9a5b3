"""Registered queries of the library proper: each operator on the driver's tables, with its SQL.

Intervals are line items: sequence = supplier, begin = ship day since 1990, end = begin + quantity - 1 (inclusive), score =
price in cents. Families are parts, species are return flags, taxonomies are region, nation, segment and priority.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import cigar
from loomspan.operators import families, intervals, recode, summary, windows
from loomspan.session import shipped
from loomspan.sources import readers
from loomspan.streaming import running

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DAY0 = "1990-01-01"


def item_id(t: DataFrame) -> Column:
    """Order and line don't tell line items apart; with part, supplier and quantity they do.

    From order 922,337 on that number is beyond a long (in the SQL, too); there a row's place in its file, below 0, is its id.
    """
    id, about = F.col("l_orderkey"), F.col("l_orderkey").cast("double")
    for radix, digit in ((10, F.col("l_linenumber")), (1000000, F.col("l_partkey")), (10000, F.col("l_suppkey")), (100, F.col("l_quantity").cast("long"))):
        id = F.try_add(F.try_multiply(id, F.lit(radix).cast("long")), digit)
        about = about * radix + digit
    id = F.when(F.abs(about) < 9.3e18, id)  # try_multiply throws and catches an error for each row beyond a long, which takes 100 times as long
    files = sorted({re.sub("^[a-z0-9]+:/+", "/", f) for f in t.inputFiles()})
    number = F.array_position(F.array(*map(F.lit, files)), F.regexp_replace("_metadata.file_path", "^[a-z0-9]+:/+", "/")) if len(files) > 1 else F.lit(1).cast("long")
    place = F.when(number > 0, -(number * (1 << 40) + F.col("_metadata.row_index"))).otherwise(F.raise_error(F.lit("a file that was not listed")))
    told = [F.col(c).isNotNull() for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")]
    return F.coalesce(id, F.when(reduce(and_, told), place))


def items(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(seq, b, e, score, id, flag, size) of line items, and more of their columns; size: length of every sequence."""
    t = table(spark, sf_dir, "lineitem")
    begin = F.datediff(F.to_date("l_shipdate"), F.lit(DAY0).cast("date")).cast("long")
    return t.select(
        F.col("l_suppkey").alias("seq"),
        begin.alias("b"),
        (begin + F.col("l_quantity").cast("long") - 1).alias("e"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("score"),
        item_id(t).alias("id"),
        F.col("l_returnflag").alias("flag"),
        F.lit(4000).cast("long").alias("size"),
        *more,
    )


ITEMS = f"""WITH iv AS (SELECT l_suppkey AS seq, date_diff('day', DATE '{DAY0}', CAST(l_shipdate AS DATE)) AS b,
  date_diff('day', DATE '{DAY0}', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) - 1 AS e,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS score, (((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS id, l_returnflag AS flag,
  CAST(4000 AS BIGINT) AS size FROM lineitem)"""
CUTS = """, cuts AS (SELECT seq, pt, lead(pt) OVER (PARTITION BY seq ORDER BY pt) - pt AS len FROM
  (SELECT seq, b AS pt FROM iv UNION SELECT seq, e + 1 FROM iv)),
 won AS (SELECT c.seq, c.pt, any_value(c.len) AS len, arg_max(i.id, (i.score, i.b, i.id)) AS id
  FROM cuts c JOIN iv i ON i.seq = c.seq AND i.b <= c.pt AND i.e >= c.pt GROUP BY c.seq, c.pt),
 per AS (SELECT iv.seq, iv.id, iv.flag, iv.e - iv.b + 1 AS naive, CAST(coalesce(w.bp, 0) AS BIGINT) AS bp FROM iv
  LEFT JOIN (SELECT seq, id, sum(len) AS bp FROM won GROUP BY seq, id) w ON w.seq = iv.seq AND w.id = iv.id)"""
ISLANDS = """, isl AS (SELECT *, sum(fresh) OVER (PARTITION BY seq ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS island FROM
  (SELECT *, CASE WHEN b > max(e) OVER (PARTITION BY seq ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
     THEN 1 WHEN row_number() OVER (PARTITION BY seq ORDER BY b, e) = 1 THEN 1 ELSE 0 END AS fresh FROM iv))"""


@query(ITEMS + CUTS + " SELECT seq, id, bp AS bp_algor FROM per")
def interval_resolved(spark, d):
    return intervals.resolve_overlap(items(spark, d), seq="seq", begin="b", end="e", score="score", id="id")


@query(ITEMS + CUTS + """, s AS (SELECT flag, CAST(sum(naive) AS BIGINT) AS naive,
  CAST(sum(CASE WHEN bp = naive THEN naive ELSE 0 END) AS BIGINT) AS best, CAST(sum(bp) AS BIGINT) AS algor FROM per GROUP BY flag)
 SELECT flag, algorithm, bp, round(100.0 * bp / naive, 6) AS percent_naive FROM (
  SELECT flag, 'naive' AS algorithm, naive AS bp, naive FROM s UNION ALL SELECT flag, 'best', best, naive FROM s
  UNION ALL SELECT flag, 'algor', algor, naive FROM s)""")
def interval_overlap_summary(spark, d):
    """Three estimators of covered bases; best takes intervals that lose nothing."""
    rows = items(spark, d)
    won = intervals.resolve_overlap(rows, seq="seq", begin="b", end="e", score="score", id="id")
    per = rows.join(won, ["seq", "id"]).withColumn("naive_bp", F.col("e") - F.col("b") + 1)
    per = per.withColumn("loses", F.col("bp_algor") != F.col("naive_bp"))
    out = intervals.estimators(per, group=["flag"], naive="naive_bp", algor="bp_algor", overlapping="loses")
    return out.withColumn("percent_naive", F.round("percent_naive", 6))


@query(ITEMS + ISLANDS + " SELECT seq, min(b) AS b, max(e) AS e, count(*) AS members FROM isl GROUP BY seq, island")
def interval_union(spark, d):
    return intervals.union(items(spark, d), seq="seq", begin="b", end="e")


@query(ITEMS + ISLANDS + """, u AS (SELECT seq, min(b) AS b, max(e) AS e FROM isl GROUP BY seq, island)
 SELECT seq, CAST(sum(e - b + 1) AS BIGINT) AS bp, CAST(4000 AS BIGINT) AS size, round_even(100 * sum(e - b + 1) / 4000.0, 2) AS percent FROM u GROUP BY seq""")
def interval_coverage(spark, d):
    return intervals.covered(items(spark, d), seq="seq", begin="b", end="e", length="size")


@query(ITEMS + ISLANDS + """, u AS (SELECT seq, min(b) AS b, max(e) AS e FROM isl GROUP BY seq, island), c AS (SELECT seq, sum(e - b + 1) AS bp FROM u GROUP BY seq)
 SELECT CAST(sum(bp) AS BIGINT) AS bp, CAST(count(*) * 4000 AS BIGINT) AS size, round_even(100 * sum(bp) / (count(*) * 4000.0), 2) AS percent FROM c""")
def interval_coverage_whole(spark, d):
    return intervals.covered_whole(items(spark, d), seq="seq", begin="b", end="e", length="size")


@query(ITEMS + """, o AS (SELECT seq, b, e + 1 AS e FROM iv), f AS (SELECT *, CASE WHEN b >= max(e) OVER (PARTITION BY seq ORDER BY b, e
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 WHEN row_number() OVER (PARTITION BY seq ORDER BY b, e) = 1 THEN 1 ELSE 0 END AS fresh FROM o),
 u AS (SELECT seq, min(b) AS b, max(e) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY seq ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS i FROM f) GROUP BY seq, i),
 g AS (SELECT *, lag(e, 1, 0) OVER (PARTITION BY seq ORDER BY b) AS prev, lead(b) OVER (PARTITION BY seq ORDER BY b) IS NULL AS last FROM u),
 p AS (SELECT seq, 'mapped' AS region, b AS begin, e AS "end" FROM g UNION ALL SELECT seq, 'unmapped', prev, b FROM g
   UNION ALL SELECT seq, 'unmapped', e, 4000 FROM g WHERE last)
 SELECT seq, region, begin, "end", "end" - begin AS bp, CAST(floor((begin + "end") / (0.02 * 4000)) AS INTEGER) AS position FROM p WHERE region = 'mapped' OR "end" <> begin""")
def interval_gaps(spark, d):
    rows = items(spark, d).withColumn("e", F.col("e") + 1)
    return intervals.gaps(rows, seq="seq", begin="b", end="e", length="size")


@query(ITEMS + " SELECT seq, b, gap FROM (SELECT seq, b, b - lag(e) OVER (PARTITION BY seq ORDER BY b, e) AS gap FROM iv) WHERE gap > 0")
def interval_consecutive_gaps(spark, d):
    return intervals.consecutive_gaps(items(spark, d), seq="seq", begin="b", end="e")


@query(ITEMS + ISLANDS + " SELECT seq, id FROM (SELECT *, count(*) OVER (PARTITION BY seq, island) AS n FROM isl) WHERE n > 1")
def interval_overlapping_ids(spark, d):
    return intervals.overlapping_ids(items(spark, d), seq="seq", begin="b", end="e", id="id")


@query(ITEMS + """ SELECT a.seq, a.flag, c.flag AS flag_r, count(*) AS pairs, CAST(sum(least(a.e, c.e) - greatest(a.b, c.b) + 1) AS BIGINT) AS bp
 FROM iv a JOIN iv c ON a.seq = c.seq AND a.b <= c.e AND a.e >= c.b WHERE a.flag = 'R' AND c.flag = 'A' GROUP BY 1, 2, 3""")
def interval_overlap_join(spark, d):
    rows = items(spark, d)
    both = intervals.overlap_join(rows.where("flag = 'R'"), rows.where("flag = 'A'"), seq="seq", begin="b", end="e")
    both = intervals.clipped(both, begin="b", end="e")
    return both.groupBy("seq", "flag", "flag_r").agg(F.count("*").alias("pairs"), F.sum(F.col("clip_end") - F.col("clip_begin") + 1).alias("bp"))


@query(ITEMS + " SELECT a.seq, count(*) AS pairs FROM iv a JOIN iv c ON a.seq = c.seq AND a.b <= c.e AND a.e >= c.b AND a.id < c.id GROUP BY a.seq")
def interval_overlapping_pairs(spark, d):
    return intervals.overlapping_pairs(items(spark, d), seq="seq", begin="b", end="e", id="id").groupBy("seq").agg(F.count("*").alias("pairs"))


@query(ITEMS + """ SELECT a.id, count(*) AS regions FROM iv a JOIN iv c ON a.seq = c.seq AND (a.b BETWEEN c.b AND c.e OR a.e BETWEEN c.b AND c.e)
 WHERE a.flag = 'R' AND c.flag = 'A' GROUP BY a.id""")
def interval_ends_inside(spark, d):
    rows = items(spark, d)
    both = intervals.ends_inside(rows.where("flag = 'R'"), rows.where("flag = 'A'"), seq="seq", begin="b", end="e")
    return both.groupBy("id").agg(F.count("*").alias("regions"))


@query(ITEMS + """ SELECT id, CASE WHEN seq IN (1, 2, 3) THEN 4000 - e ELSE b END AS b, CASE WHEN seq IN (1, 2, 3) THEN 4000 - b ELSE e END AS e,
 greatest(b - (e - b), 0) AS pad_b, least(e + (e - b), 4000) AS pad_e FROM iv""")
def interval_reversed_and_padded(spark, d):
    rows = items(spark, d)
    pad = intervals.padded(rows.withColumns({"pb": F.col("b"), "pe": F.col("e")}), begin="pb", end="pe", length="size", by=F.col("e") - F.col("b"))
    pad = pad.withColumnsRenamed({"pb": "pad_b", "pe": "pad_e"})
    return intervals.reversed_coordinates(pad, seq="seq", begin="b", end="e", length="size", ids=[1, 2, 3]).select("id", "b", "e", "pad_b", "pad_e")


@query()
def interval_resolved_sequential(spark, d):
    """The order-dependent rule has no SQL; tests fold by brute force."""
    return intervals.resolve_overlap_sequential(items(shipped(spark), d), seq="seq", begin="b", end="e", score="score", order="id")


def pairs_of_sides(spark, d) -> DataFrame:
    """Line items as alignments: supplier and part are the two sides, the ends exclusive."""
    return items(spark, d, "l_partkey").withColumnRenamed("l_partkey", "tseq").withColumn("e", F.col("e") + 1)


SIDES = ITEMS + """, sd AS (SELECT 'Q' AS side, seq, b, e, score, id FROM iv UNION ALL SELECT 'T', l_partkey, b, e, score, id FROM iv JOIN
  (SELECT l_partkey, (((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS k FROM lineitem) ON k = id),
 cuts AS (SELECT side, seq, pt, lead(pt) OVER (PARTITION BY side, seq ORDER BY pt) - pt AS len FROM (SELECT side, seq, b AS pt FROM sd UNION SELECT side, seq, e + 1 FROM sd)),
 won AS (SELECT c.side, c.seq, c.pt, any_value(c.len) AS len, arg_max(i.id, (i.score, i.b, i.id)) AS id FROM cuts c JOIN sd i ON i.side = c.side AND i.seq = c.seq AND i.b <= c.pt AND i.e >= c.pt GROUP BY 1, 2, 3),
 got AS (SELECT side, seq, id, sum(len) AS bp FROM won GROUP BY 1, 2, 3),
 per AS (SELECT sd.side, sd.seq, sd.id, sd.e - sd.b + 1 AS naive, CAST(coalesce(g.bp, 0) AS BIGINT) AS algor FROM sd LEFT JOIN got g ON g.side = sd.side AND g.seq = sd.seq AND g.id = sd.id)"""


@query(SIDES + " SELECT id, max(algor) FILTER (side = 'Q') AS Qalgorbp, max(algor) FILTER (side = 'T') AS Talgorbp FROM per GROUP BY id")
def interval_alignment_overlap(spark, d):
    """Both sides of an alignment: supplier and part positions of line items."""
    rows = pairs_of_sides(spark, d)
    return intervals.alignment_overlap(rows, id="id", sides={"Q": ("seq", "b", "e"), "T": ("tseq", "b", "e")}, score="score").select("id", "Qalgorbp", "Talgorbp")


@query(SIDES + """, s AS (SELECT side, seq % 3 AS subset, CAST(sum(naive) AS BIGINT) AS naive, CAST(sum(algor) AS BIGINT) AS algor, count(DISTINCT seq) * 4000 AS size FROM per GROUP BY 1, 2)
 SELECT side, subset, algorithm, bp, round(100.0 * bp / naive, 6) AS percent_naive, round(100.0 * bp / size, 6) AS percent_subset FROM s, LATERAL (VALUES ('naive', naive), ('algor', algor)) AS v(algorithm, bp)""")
def alignment_overlap_report(spark, d):
    """Naive and resolved bases by side and subset; a sequence's remainder by 3 is its subset."""
    rows = pairs_of_sides(spark, d)
    won = intervals.alignment_overlap(rows, id="id", sides={"Q": ("seq", "b", "e"), "T": ("tseq", "b", "e")}, score="score")
    side = lambda k, s, bp: F.struct(F.lit(k).alias("side"), F.col(s).alias("sequence"), F.col(bp).alias("algor"))
    long = won.select("b", "e", "size", F.explode(F.array(side("Q", "seq", "Qalgorbp"), side("T", "tseq", "Talgorbp"))).alias("s")).select("b", "e", "size", "s.*")
    long = long.withColumns({"subset": F.col("sequence") % 3, "naive": F.col("e") - F.col("b")})
    return rounded(intervals.overlap_report(long, group=["side", "subset"], seq="sequence", length="size", naive="naive", algor="algor"))


REGIONS = ITEMS + ISLANDS + """, o AS (SELECT seq, b, e + 1 AS e FROM iv), f AS (SELECT *, CASE WHEN b >= max(e) OVER (PARTITION BY seq ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1
   WHEN row_number() OVER (PARTITION BY seq ORDER BY b, e) = 1 THEN 1 ELSE 0 END AS fresh FROM o),
 u AS (SELECT seq, min(b) AS b, max(e) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY seq ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS i FROM f) GROUP BY seq, i),
 g AS (SELECT *, lag(e, 1, 0) OVER (PARTITION BY seq ORDER BY b) AS prev, lead(b) OVER (PARTITION BY seq ORDER BY b) IS NULL AS last FROM u),
 rg AS (SELECT seq, 'mapped' AS region, e - b AS bp FROM g UNION ALL SELECT seq, 'unmapped', b - prev FROM g WHERE b <> prev UNION ALL SELECT seq, 'unmapped', 4000 - e FROM g WHERE last AND e <> 4000
  UNION ALL SELECT seq, 'ali_len', e - b FROM o UNION ALL SELECT l_suppkey, 'matches', CAST(l_quantity AS BIGINT) - l_linenumber FROM lineitem)"""


def aligned_regions(spark, d) -> DataFrame:
    rows = items(spark, d, "l_linenumber").withColumn("e", F.col("e") + 1)
    rows = rows.withColumns({"ali_len": F.col("e") - F.col("b"), "matches": F.col("e") - F.col("b") - F.col("l_linenumber"), "subset": F.col("seq") % 3})
    return intervals.region_table(rows, keys=["subset"], seq="seq", begin="b", end="e", length="size", values=["ali_len", "matches"])


@query(REGIONS + " SELECT seq % 3 AS subset, region, count(*) AS n, round(median(bp), 4) AS median, CAST(sum(bp) AS BIGINT) AS sum, max(bp) AS max FROM rg GROUP BY 1, 2")
def alignment_regions(spark, d):
    out = summary.length_stats(aligned_regions(spark, d), group=["subset", "region"], length="bp")
    return out.select("subset", "region", "n", F.round("median", 4).alias("median"), "sum", "max")


@query(REGIONS + """, c AS (SELECT seq, round_even(100 * sum(e - b) / 4000.0, 2) AS percent FROM u GROUP BY 1),
 s AS (SELECT seq, region, CASE WHEN median(bp) IS NULL OR stddev_samp(bp) IS NULL THEN 'NA' ELSE CAST(median(bp) AS VARCHAR) || ' ± ' || CAST(CAST(floor(1.96 * stddev_samp(bp)) AS BIGINT) AS VARCHAR) END AS t FROM rg GROUP BY 1, 2)
 SELECT seq, any_value(percent) AS percent, coalesce(max(t) FILTER (region = 'unmapped'), 'NA') AS unmapped, coalesce(max(t) FILTER (region = 'ali_len'), 'NA') AS ali_len FROM c LEFT JOIN s USING (seq) GROUP BY seq""")
def coordinates_table(spark, d):
    rows = items(spark, d).withColumn("e", F.col("e") + 1)
    covered = intervals.covered(rows, seq="seq", begin="b", end="e", length="size", closed=False)
    return summary.coordinates_table(aligned_regions(spark, d), covered, seq="seq", columns=["unmapped", "ali_len"])


@query(ITEMS + """, n AS (SELECT *, row_number() OVER w AS r, lead(id) OVER w AS nxt, coalesce(lead(b) OVER w <= e, false) AS over FROM iv WINDOW w AS (PARTITION BY seq ORDER BY b, e, id)),
 c AS (SELECT *, r - row_number() OVER (PARTITION BY seq, over ORDER BY r) AS run FROM n), p AS (SELECT *, row_number() OVER (PARTITION BY seq, over, run ORDER BY r) AS k FROM c WHERE over)
 SELECT seq, id, nxt AS id_next FROM p WHERE k % 2 = 1""")
def interval_adjacent_pairs(spark, d):
    return intervals.adjacent_pairs(items(spark, d), seq="seq", begin="b", end="e", id="id")


@query(ITEMS + """ SELECT id, 'Q' AS side, CAST(seq AS VARCHAR) AS seq, greatest(b - 50, 0) AS "begin", least(e + 50, 4000) AS "end",
 'Q:' || seq || ':' || greatest(b - 50, 0) || '-' || least(e + 50, 4000) AS tag FROM iv""")
def interval_margins(spark, d):
    return intervals.margins(items(spark, d), sides={"Q": ("seq", "b", "e", "size")}, id="id", margin=50)


@query(ITEMS + " SELECT DISTINCT 'Q' AS db, seq, size FROM iv")
def sequence_sizes(spark, d):
    return readers.sequence_sizes(items(spark, d).withColumn("db", F.lit("Q")), seq="seq", length="size")


def levels(spark, d) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return rows.select("o_orderkey", "r_name", "n_name", "c_mktsegment", "o_orderpriority", F.floor(F.col("o_totalprice") / 1000).cast("long").alias("kilo"), F.col("o_totalprice").alias("price"), (F.col("o_orderkey") % 3 == 0).alias("flagged"))


LEVELS = """WITH lv AS (SELECT o_orderkey, r_name, n_name, c_mktsegment, o_orderpriority, CAST(floor(o_totalprice / 1000) AS BIGINT) AS kilo,
 o_totalprice AS price, o_orderkey % 3 = 0 AS flagged FROM orders JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query(LEVELS + """, a AS (SELECT r_name, c_mktsegment, count(*) AS naive_numele, CAST(sum(kilo) AS BIGINT) AS naive_totbp, CAST(sum(kilo) AS BIGINT) AS algor_totbp,
  count(*) FILTER (NOT flagged) AS best_numele, CAST(sum(kilo) FILTER (NOT flagged) AS BIGINT) AS best_totbp, round(median(kilo), 6) AS value_median,
  round(avg(kilo), 6) AS value_mean FROM lv GROUP BY 1, 2 HAVING count(*) FILTER (NOT flagged) > 0),
 k AS (SELECT r_name, c_mktsegment, kilo, count(*) AS c FROM lv GROUP BY 1, 2, 3), m AS (SELECT r_name, c_mktsegment, max(c) AS top FROM k GROUP BY 1, 2),
 z AS (SELECT k.r_name, k.c_mktsegment, min(kilo) AS mode_floor, CASE WHEN count(*) = 1 THEN min(kilo) END AS mode_raw FROM k JOIN m ON k.r_name = m.r_name
  AND k.c_mktsegment = m.c_mktsegment AND k.c = m.top GROUP BY 1, 2) SELECT a.*, z.mode_floor, z.mode_raw FROM a JOIN z USING (r_name, c_mktsegment)""")
def summary_by_group(spark, d):
    out = summary.summarised(levels(spark, d), keys=["r_name", "c_mktsegment"], naive="kilo", algor="kilo", overlapping="flagged", value="kilo")
    return out.withColumns({"value_median": F.round("value_median", 6), "value_mean": F.round("value_mean", 6)})


@query(LEVELS + """ SELECT r_name, n_name, c_mktsegment, o_orderpriority, CAST(4 - (grouping(n_name) + grouping(c_mktsegment) + grouping(o_orderpriority)) - 1 AS INTEGER) AS level,
 count(*) AS orders, CAST(sum(kilo) AS BIGINT) AS kilo FROM lv GROUP BY GROUPING SETS ((r_name), (r_name, n_name), (r_name, n_name, c_mktsegment), (r_name, n_name, c_mktsegment, o_orderpriority))""")
def summary_rollup(spark, d):
    return summary.rolled_up(levels(spark, d), by=["r_name"], levels=["n_name", "c_mktsegment", "o_orderpriority"], measures={"orders": F.count("*"), "kilo": F.sum("kilo")})


@query(LEVELS + " SELECT r_name, 'Non_repetitive' AS class, 100000000 - CAST(sum(kilo) AS BIGINT) AS total FROM lv GROUP BY r_name")
def summary_complement(spark, d):
    rows = levels(spark, d)
    sizes = table(spark, d, "region").select("r_name", F.lit(100000000).cast("long").alias("size")).join(rows.select("r_name").distinct(), "r_name")
    totals = rows.groupBy("r_name").agg(F.sum("kilo").alias("total"))
    return summary.with_complement(totals, sizes, on=["r_name"], size="size", total="total", label="class", value="Non_repetitive")


@query(LEVELS + """, t AS (SELECT r_name, n_name, sum(kilo) AS kilo FROM lv GROUP BY 1, 2), s AS (SELECT *, kilo / sum(kilo) OVER (PARTITION BY r_name) AS share FROM t)
 SELECT r_name, CASE WHEN share < 0.2 THEN 'All the rest' ELSE n_name END AS n_name, CAST(sum(kilo) AS BIGINT) AS kilo FROM s GROUP BY 1, 2""")
def summary_pooled(spark, d):
    return summary.pooled_small(levels(spark, d), key="n_name", within=["r_name"], value="kilo", below=0.2, label="All the rest", everywhere=False)


@query(LEVELS + """, t AS (SELECT r_name, o_orderpriority, sum(kilo) AS kilo FROM lv GROUP BY 1, 2), s AS (SELECT *, kilo / sum(kilo) OVER (PARTITION BY r_name) AS share FROM t),
 k AS (SELECT o_orderpriority, bool_or(share >= 0.2) AS keep FROM s GROUP BY 1)
 SELECT r_name, CASE WHEN keep THEN o_orderpriority ELSE 'Remaining' END AS o_orderpriority, CAST(sum(kilo) AS BIGINT) AS kilo FROM s JOIN k USING (o_orderpriority) GROUP BY 1, 2""")
def summary_pooled_everywhere(spark, d):
    return summary.pooled_small(levels(spark, d), key="o_orderpriority", within=["r_name"], value="kilo", below=0.2)


@query("""WITH c AS (SELECT user_id % 10 AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY bucket) AS p FROM c)
 SELECT bucket, count(*) AS types, round(sum(-p * ln(p)), 6) AS shannon, round(1 - sum(p * p), 6) AS gini_simpson,
 round(CASE WHEN count(*) > 1 THEN sum(-p * ln(p)) / ln(count(*)) END, 6) AS evenness, round(exp(sum(-p * ln(p))), 6) AS exp_shannon,
 round(CASE WHEN count(*) > 1 THEN count(*) / (count(*) - 1) * (1 - sum(p * p)) END, 6) AS unbiased_simpson, round(1 / sum(p * p), 6) AS inverse_simpson FROM s GROUP BY bucket""")
def diversity_by_group(spark, d):
    counts = table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("bucket"), "event_type").agg(F.count("*").alias("n"))
    return rounded(summary.diversity(counts, group=["bucket"], count="n"))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c, t in df.dtypes if t == "double"})


@query("""WITH c AS (SELECT user_id % 10 AS unit, event_type, count(*) AS n FROM events GROUP BY 1, 2), u AS (SELECT DISTINCT unit FROM c),
 p AS (SELECT a.unit AS ua, b.unit AS ub FROM u a JOIN u b ON a.unit <= b.unit), q AS (SELECT ua, ub, event_type, sum(n) AS n FROM p JOIN c ON c.unit = ua OR c.unit = ub GROUP BY 1, 2, 3),
 s AS (SELECT *, n / sum(n) OVER (PARTITION BY ua, ub) AS x FROM q), h AS (SELECT ua, ub, sum(-x * ln(x)) AS shannon FROM s GROUP BY 1, 2)
 SELECT h.ua AS unit_a, h.ub AS unit_b, round(h.shannon, 6) AS shannon, round(h.shannon - (a.shannon + b.shannon) / 2, 6) + 0.0 AS gain
 FROM h JOIN h a ON a.ua = h.ua AND a.ub = h.ua JOIN h b ON b.ua = h.ub AND b.ub = h.ub""")
def diversity_of_pairs(spark, d):
    counts = table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("unit"), "event_type").agg(F.count("*").alias("n"))
    out = rounded(summary.pair_diversity(counts, unit="unit", kind="event_type", count="n")).select("unit_a", "unit_b", "shannon", "gain")
    return out.withColumn("gain", F.col("gain") + F.lit(0.0))


@query("""SELECT o_orderpriority, count(x) AS n, round(median(x), 6) AS median, round(avg(x), 6) AS mean, max(x) AS max, min(x) AS min, CAST(sum(x) AS BIGINT) AS sum,
 count(*) FILTER (x >= 1 AND x < 10) AS n_1_10, count(*) FILTER (x >= 10 AND x < 100) AS n_10_100, count(*) FILTER (x >= 100 AND x < 1000) AS n_100_1000,
 count(*) FILTER (x >= 1000 AND x < 10000) AS n_1000_10000, count(*) FILTER (x >= 10000) AS n_10000
 FROM (SELECT o_orderpriority, CAST(floor(o_totalprice) AS BIGINT) AS x FROM orders) GROUP BY 1""")
def length_statistics(spark, d):
    rows = table(spark, d, "orders").select("o_orderpriority", F.floor("o_totalprice").cast("long").alias("x"))
    return rounded(summary.length_stats(rows, group=["o_orderpriority"], length="x"))


@query("""SELECT o_orderpriority, round(median(x), 6) AS median, round(median(x) - floor(1.96 * stddev_samp(x)), 6) AS low, round(median(x) + floor(1.96 * stddev_samp(x)), 6) AS high
 FROM (SELECT o_orderpriority, CAST(floor(o_totalprice) AS BIGINT) AS x FROM orders) GROUP BY 1""")
def value_spread(spark, d):
    rows = table(spark, d, "orders").select("o_orderpriority", F.floor("o_totalprice").cast("long").alias("x"))
    return rounded(summary.spread(rows, group=["o_orderpriority"], value="x").drop("told"))


@query("""WITH q AS (SELECT l_returnflag AS g, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3,
 avg(l_extendedprice) AS mean, count(*) AS n FROM lineitem GROUP BY 1)
 SELECT g AS l_returnflag, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(mean, 4) AS mean, n, round(min(x), 4) AS whisker_low, round(max(x), 4) AS whisker_high
 FROM q JOIN (SELECT l_returnflag AS r, l_extendedprice AS x FROM lineitem) ON r = g AND x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY g, q1, median, q3, mean, n""")
def box_statistics(spark, d):
    return rounded(summary.box_stats(table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice"), group=["l_returnflag"], value="l_extendedprice"), 4)


@query("""SELECT *, round("count" / sum("count") OVER (PARTITION BY l_returnflag), 6) AS share FROM (SELECT l_returnflag, CAST(floor(l_extendedprice / 5000) AS BIGINT) AS bin, count(*) AS "count" FROM lineitem GROUP BY 1, 2)""")
def value_histogram(spark, d):
    return rounded(summary.histogram(table(spark, d, "lineitem"), group=["l_returnflag"], value="l_extendedprice", width=5000))


@query("""SELECT l_returnflag, bin, "count", weight, round("count" / sum("count") OVER w, 6) AS share, round(weight / sum(weight) OVER w, 6) AS weight_share FROM
 (SELECT l_returnflag, CAST(CASE WHEN q > 40 THEN 8 ELSE floor((q - 1) / 5) END AS INTEGER) AS bin, count(*) AS "count", CAST(sum(q) AS BIGINT) AS weight
 FROM (SELECT l_returnflag, CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY 1, 2) WINDOW w AS (PARTITION BY l_returnflag)""")
def indel_size_bins(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("long").alias("q"))
    return rounded(summary.sized_bins(rows, group=["l_returnflag"], size="q", step=5, stop=40))


@query("""WITH b AS (SELECT l_returnflag, unnest(list_filter(['All', CASE WHEN p < 1 THEN '<1' END, CASE WHEN p < 5 THEN '<5' END, CASE WHEN p >= 5 THEN '>=5' END], lambda x: x IS NOT NULL)) AS band, q
 FROM (SELECT l_returnflag, l_discount * 100 AS p, CAST(l_quantity AS BIGINT) AS q FROM lineitem)), s AS (SELECT l_returnflag, band, CAST(sum(q) AS BIGINT) AS q FROM b GROUP BY 1, 2)
 SELECT *, round(q / sum(q) OVER (PARTITION BY band), 6) AS share FROM s""")
def divergence_bands(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_discount") * 100).alias("p"), F.col("l_quantity").cast("long").alias("q"))
    sums = summary.banded(rows, value="p", edge=5).groupBy("l_returnflag", "band").agg(F.sum("q").alias("q"))
    return rounded(summary.shares(sums, within=["band"], value="q"))


def depth_histogram(spark, d) -> DataFrame:
    n = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.sum(F.col("l_quantity").cast("long")).alias("covg"))
    return n.groupBy("l_returnflag", "covg").agg(F.count("*").alias("freq"))


DEPTH = """WITH n AS (SELECT l_orderkey, l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS covg FROM lineitem GROUP BY 1, 2), h AS (SELECT l_returnflag, covg, count(*) AS freq FROM n GROUP BY 1, 2)"""


@query(DEPTH + """, r AS (SELECT *, sum(freq) OVER (PARTITION BY l_returnflag ORDER BY covg) AS run, sum(freq) OVER (PARTITION BY l_returnflag) AS whole FROM h),
 t AS (SELECT l_returnflag, max(freq) AS hi, min(freq) AS lo FROM h GROUP BY 1)
 SELECT r.l_returnflag, round(sum(covg * freq) / sum(freq), 6) AS mean, min(covg) FILTER (run * 2 >= whole) AS median,
 round(sqrt(sum(covg * covg * freq) / sum(freq) - (sum(covg * freq) / sum(freq)) ** 2), 6) AS stdev, min(covg) FILTER (freq = lo) AS min_freq_at, min(covg) FILTER (freq = hi) AS max_freq_at
 FROM r JOIN t ON r.l_returnflag = t.l_returnflag GROUP BY 1""")
def coverage_statistics(spark, d):
    return rounded(summary.weighted_stats(depth_histogram(spark, d), group=["l_returnflag"], value="covg", freq="freq"))


@query(DEPTH + """, x AS (SELECT *, lag(freq) OVER w AS a, lead(freq) OVER w AS b FROM h WINDOW w AS (PARTITION BY l_returnflag ORDER BY covg))
 SELECT l_returnflag, covg, freq, CASE WHEN coalesce(freq > a, true) AND coalesce(freq > b, true) THEN 'max' ELSE 'min' END AS extremum FROM x
 WHERE (coalesce(freq > a, true) AND coalesce(freq > b, true)) OR (coalesce(freq < a, true) AND coalesce(freq < b, true))""")
def local_extrema(spark, d):
    return summary.local_extrema(depth_histogram(spark, d), group=["l_returnflag"], value="covg", freq="freq")


@query(DEPTH + """, x AS (SELECT *, max(freq) OVER w AS a, min(freq) OVER w AS b FROM h WINDOW w AS (PARTITION BY l_returnflag ORDER BY covg ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
 SELECT l_returnflag, covg, freq, CASE WHEN freq = a THEN 'max' ELSE 'min' END AS extremum FROM x WHERE freq = a OR freq = b""")
def neighbourhood_extrema(spark, d):
    return summary.neighbourhood_extrema(depth_histogram(spark, d), group=["l_returnflag"], value="covg", freq="freq", order=3)


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 4) AS variance FROM events WHERE event_id % 7 <> 0 GROUP BY 1")
def signed_statistics(spark, d):
    """All events added, every seventh taken back."""
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    rows = e.withColumn("w", F.lit(1)).unionByName(e.where("event_id % 7 = 0").withColumn("w", F.lit(-1)))
    out = summary.signed_stats(rows, group=["event_type"], value="value", sign="w")
    return out.withColumns({"mean": F.round("mean", 6), "variance": F.round("variance", 4)})


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 4) AS variance FROM events GROUP BY 1")
def streaming_statistics(spark, d):
    """Running statistics over a stream of event files."""
    out = running.statistics(running.file_stream(spark, f"{d}/events.parquet"), group=["event_type"], value="value")
    rows = running.drained(out, "complete")
    return rows.withColumns({"mean": F.round("mean", 6), "variance": F.round("variance", 4)})


@query("""SELECT CAST(floor(epoch(ts)) AS BIGINT) // 5400 * 5400 AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
 WHERE CAST(floor(epoch(ts)) AS BIGINT) % 5400 < 3600 GROUP BY 1, 2""")
def streaming_windows(spark, d):
    """Windows of an hour every 90 minutes over a stream of event files."""
    out = running.jumping_windows(running.file_stream(spark, f"{d}/events.parquet"), time="ts", width=3600, jump=1800, group=["event_type"], value="value")
    rows = running.drained(out, "complete")
    return rows.select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


PATTERNS = [("medium", "^medium$"), ("with_o", "o"), ("larger", "LARG"), ("any", ".")]
PATTERN_SQL = "(VALUES ('medium', '^medium$', 0), ('with_o', 'o', 1), ('larger', 'LARG', 2), ('any', '.', 3)) AS p(label, pattern, ord)"


@query(f"""WITH h AS (SELECT DISTINCT p_type, label FROM part, {PATTERN_SQL} WHERE regexp_matches(p_type, pattern, 'i')), c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1)
 SELECT label, CAST(sum(n) AS BIGINT) AS "rows", round_even(100 * sum(n) / (SELECT count(*) FROM part), 2) AS percent_rows, count(*) AS ids,
 round_even(100 * count(*) / (SELECT count(*) FROM c), 2) AS percent_ids FROM h JOIN c USING (p_type) GROUP BY label""")
def pattern_subset_check(spark, d):
    return recode.subset_check(table(spark, d, "part"), recode.pattern_table(spark, PATTERNS), id="p_type", pattern="pattern", label="label")


@query(f"SELECT label, count(*) AS parts, CAST(sum(p_size) AS BIGINT) AS size FROM part, {PATTERN_SQL} WHERE regexp_matches(p_type, pattern, 'i') GROUP BY 1")
def pattern_join(spark, d):
    both = recode.pattern_join(table(spark, d, "part"), recode.pattern_table(spark, PATTERNS), id="p_type", pattern="pattern")
    return both.groupBy("label").agg(F.count("*").alias("parts"), F.sum("p_size").alias("size"))


@query(f"""SELECT p_partkey, (SELECT label FROM (VALUES ('medium', '^medium$', 0), ('with_o', 'o', 1), ('larger', 'LARG', 2)) AS p(label, pattern, ord)
 WHERE regexp_matches(p_type, pattern, 'i') ORDER BY ord DESC LIMIT 1) AS subset FROM part""")
def pattern_label(spark, d):
    rows = recode.labelled(table(spark, d, "part"), recode.pattern_table(spark, PATTERNS[:3]), id="p_type", pattern="pattern", label="label", order="ord")
    return rows.select("p_partkey", "subset")


@query("""SELECT rule, removed, round_even(100.0 * removed / n, 2) AS percent FROM (SELECT count(*) AS n, count(*) FILTER (NOT l_quantity >= 10) AS q, count(*) FILTER (NOT l_extendedprice > 20000) AS x,
 count(*) FILTER (NOT (l_quantity >= 10 AND l_extendedprice > 20000)) AS c FROM lineitem), LATERAL (VALUES ('quantity', q), ('price', x), ('combined', c)) AS v(rule, removed)""")
def filter_audit(spark, d):
    return recode.filter_audit(table(spark, d, "lineitem"), {"quantity": F.col("l_quantity") >= 10, "price": F.col("l_extendedprice") > 20000})


TYPES = {"LARGE": "DNA/hAT", "SMALL": "LINE/L1", "MEDIUM": "LTR/Gypsy", "ECONOMY": "__ClassII_DNA_TcMar_nMITE", "PROMO": "SINE/tRNA", "STANDARD": "Simple_repeat"}


@query("""WITH t AS (SELECT split_part(p_type, ' ', 1) AS k FROM part) SELECT class, subclass, "order", superfam, mite, count(*) AS parts FROM t JOIN (VALUES
 ('LARGE', 'DNA', '1', 'TIR', 'hAT', NULL), ('SMALL', 'Retrotransposon', 'NA', 'LINE', 'L1', NULL), ('MEDIUM', 'Retrotransposon', 'NA', 'LTR', 'Gypsy', NULL),
 ('ECONOMY', 'DNA', '1', 'TIR', 'TcMar', false), ('PROMO', 'Retrotransposon', 'NA', 'SINE', 'tRNA', NULL), ('STANDARD', 'Tandem_repeat', 'Simple_repeat', 'NA', 'NA', NULL))
 AS m(k, class, subclass, "order", superfam, mite) USING (k) GROUP BY ALL""")
def taxonomy(spark, d):
    """Part types stand for repeat annotations."""
    names = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    rows = table(spark, d, "part").select(F.try_element_at(names, F.split("p_type", " ")[0]).alias("label")).where("label is not null")
    return recode.classified(rows, label="label").groupBy("class", "subclass", "order", "superfam", "mite").agg(F.count("*").alias("parts"))


@query("SELECT p_partkey, CASE p_brand WHEN 'Brand#11' THEN 'chr1' WHEN 'Brand#12' THEN 'chr2' ELSE p_brand END AS p_brand FROM part")
def renamed_ids(spark, d):
    names = spark.createDataFrame([("Brand#11", "chr1"), ("Brand#12", "chr2")], "old string, new string")
    return recode.renamed_ids(table(spark, d, "part"), names, column="p_brand").select("p_partkey", "p_brand")


@query("""SELECT c_custkey, lower(regexp_extract(c_name, '^([^0-9]*)', 1)) || lpad(regexp_extract(c_name, '([0-9]+)', 1), 20, '0') AS key FROM customer""")
def natural_key(spark, d):
    return table(spark, d, "customer").select("c_custkey", recode.natural_key("c_name").alias("key"))


def positions(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("seq"), F.col("l_partkey").alias("pos"), F.col("l_quantity").cast("long").alias("w"), F.col("l_extendedprice").alias("x"))


def extents(spark, d) -> DataFrame:
    return positions(spark, d).groupBy("seq").agg(F.lit(0).cast("long").alias("start"), (F.max("pos") + 1).alias("stop"))


POSITIONS = """WITH ps AS (SELECT l_returnflag AS seq, l_partkey AS pos, CAST(l_quantity AS BIGINT) AS w, l_extendedprice AS x FROM lineitem),
 ex AS (SELECT seq, max(pos) + 1 AS stop FROM ps GROUP BY 1), gr AS (SELECT seq, CAST(i AS INTEGER) AS "window", stop FROM ex, LATERAL (SELECT unnest(generate_series(0, CAST(greatest(ceil(stop / {step}.0), 1) AS BIGINT) - 1)) AS i))"""


@query(POSITIONS.format(step=50) + """ SELECT gr.seq, gr."window", CAST(gr."window" * 50 AS BIGINT) AS window_begin, least(gr."window" * 50 + 50, stop) AS window_end, CAST(coalesce(t, 0) AS BIGINT) AS total FROM gr
 LEFT JOIN (SELECT seq, CAST(floor((pos + pos + w) / 2 / 50) AS INTEGER) AS k, sum(w) AS t FROM ps GROUP BY 1, 2) s ON s.seq = gr.seq AND s.k = gr."window" """)
def windows_by_midpoint(spark, d):
    rows = positions(spark, d).withColumn("e", F.col("pos") + F.col("w"))
    return windows.by_midpoint(rows, extents(spark, d), seq="seq", begin="pos", end="e", weight="w", start="start", stop="stop", width=50)


@query(POSITIONS.format(step=60) + """ SELECT gr.seq, gr."window", gr."window" * 60 AS window_begin, least(gr."window" * 60 + 50, stop) AS window_end, coalesce(c, 0) AS "count", CAST(coalesce(bp, 0) AS BIGINT) AS bp,
 round(coalesce(m, 0), 4) AS x_median, round(coalesce(a, 0), 4) AS x_mean, round(coalesce(sd, 0), 4) AS x_sd FROM gr LEFT JOIN (SELECT seq, pos // 60 AS k, count(*) AS c, sum(w) AS bp, median(x) AS m, avg(x) AS a, stddev_samp(x) AS sd
 FROM ps WHERE pos % 60 > 0 AND pos % 60 < 50 GROUP BY 1, 2) s ON s.seq = gr.seq AND s.k = gr."window" """)
def windows_jumping(spark, d):
    sizes = extents(spark, d).select("seq", "stop")
    return rounded(windows.jumping(positions(spark, d), sizes, seq="seq", begin="pos", length="w", values=["x"], stop="stop", width=50, jump=10), 4)


@query(POSITIONS.format(step=100) + """ SELECT gr.seq, gr."window", CAST(gr."window" * 100 AS BIGINT) AS window_begin, least(gr."window" * 100 + 100, stop) AS window_end, coalesce(small, 0) AS small, coalesce(big, 0) AS big, coalesce(total, 0) AS total
 FROM gr LEFT JOIN (SELECT seq, pos // 100 AS k, count(*) FILTER (w < 10) AS small, count(*) FILTER (w >= 40) AS big, count(*) AS total FROM ps GROUP BY 1, 2) s ON s.seq = gr.seq AND s.k = gr."window" """)
def windows_counted(spark, d):
    return windows.counted(positions(spark, d), extents(spark, d), seq="seq", position="pos", start="start", stop="stop", width=100, classes={"small": F.col("w") < 10, "big": F.col("w") >= 40})


@query("""WITH q AS (SELECT o_orderpriority AS g, quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders GROUP BY 1)
 SELECT o_orderkey, CASE WHEN o_totalprice > b + 0.5 * (b - a) THEN 'high' WHEN o_totalprice < a - 0.5 * (b - a) THEN 'low' END AS outlier FROM orders JOIN q ON g = o_orderpriority""")
def outliers(spark, d):
    return windows.outliers(table(spark, d, "orders"), group=["o_orderpriority"], value="o_totalprice", factor=0.5).select("o_orderkey", "outlier")


@query("SELECT o_orderkey, round(o_totalprice / (SELECT max(o_totalprice) FROM orders), 8) AS o_totalprice FROM orders")
def max_normalised(spark, d):
    return rounded(windows.max_normalised(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]), 8)


@query("SELECT p_partkey, p_size FROM part WHERE p_size NOT IN (SELECT DISTINCT p_size FROM part ORDER BY p_size DESC LIMIT 3)")
def without_top(spark, d):
    return windows.without_top(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", 3)


@query("""WITH r AS (SELECT o_orderpriority AS g, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
 SELECT g AS o_orderpriority, round(avg(v), 4) AS mean, max(v) FILTER (r = floor(n * 5 / 200)) AS low_5, max(v) FILTER (r = n - 1 - floor(n * 5 / 200)) AS high_5 FROM r GROUP BY g""")
def cut_offs(spark, d):
    return windows.cut_offs(table(spark, d, "orders"), group=["o_orderpriority"], value="o_totalprice", percents=[5]).withColumn("mean", F.round("mean", 4))


@query("""WITH e AS (SELECT n_regionkey AS k, max(n_nationkey) AS m FROM nation GROUP BY 1), s AS (SELECT k, coalesce(sum(m) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e),
 c AS (SELECT c_custkey, c_nationkey FROM customer) SELECT c_custkey, CAST(n_nationkey + before AS BIGINT) AS axis FROM c JOIN nation ON n_nationkey = c_nationkey JOIN s ON k = n_regionkey""")
def concatenated_axis(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    axis = windows.concatenated_axis(n, seq="n_regionkey", position="n_nationkey", order="n_regionkey")
    return table(spark, d, "customer").join(axis, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("axis").cast("long").alias("axis"))


def genes(spark, d) -> DataFrame:
    t = table(spark, d, "lineitem")
    return t.select(F.col("l_partkey").alias("og"), F.col("l_returnflag").alias("species"), F.col("l_suppkey").alias("seq"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("gene"), F.col("l_orderkey").alias("b"), (F.col("l_orderkey") + F.col("l_quantity").cast("long")).alias("e"))


GENES = """WITH ge AS (SELECT l_partkey AS og, l_returnflag AS species, l_suppkey AS seq, l_orderkey * 10 + l_linenumber AS gene, l_orderkey AS b, l_orderkey + CAST(l_quantity AS BIGINT) AS e FROM lineitem),
 nn AS (SELECT og, count(*) FILTER (species = 'A') AS a, count(*) FILTER (species = 'R') AS r FROM ge GROUP BY 1)"""


@query(GENES + """, p AS (SELECT og, seq, count(*) AS n FROM ge GROUP BY 1, 2) SELECT x.seq AS seq_a, y.seq AS seq_b,
 CAST(sum(CASE WHEN x.seq = y.seq THEN x.n * (x.n - 1) // 2 ELSE ceil(x.n * y.n / 2) END) AS BIGINT) AS links FROM p x JOIN p y ON x.og = y.og AND x.seq <= y.seq GROUP BY 1, 2 HAVING links > 0""")
def family_linkage(spark, d):
    return families.linkage(genes(spark, d), family="og", seq="seq")


@query(GENES + """, q AS (SELECT least(x.seq, y.seq) AS seq, greatest(x.seq, y.seq) AS seq_r, CASE WHEN x.seq = y.seq THEN greatest(greatest(x.b, y.b) - least(x.e, y.e), 0) END AS d FROM ge x JOIN ge y ON x.og = y.og AND x.gene < y.gene)
 SELECT seq, seq_r, count(*) AS pairs, count(*) FILTER (d < 10000) AS near_4, count(*) FILTER (d >= 10000 AND d < 100000) AS near_5, count(*) FILTER (d >= 100000 AND d < 1000000) AS near_6,
 count(*) FILTER (d >= 1000000) AS far, CAST(sum(d) AS BIGINT) AS total, round(avg(d), 4) AS mean FROM q GROUP BY 1, 2""")
def family_pair_distances(spark, d):
    return families.pair_distances(genes(spark, d), family="og", id="gene", seq="seq", begin="b", end="e").withColumn("mean", F.round("mean", 4))


@query(GENES + """, n AS (SELECT og, species, count(*) AS n FROM ge GROUP BY 1, 2) SELECT count(*) FILTER (n > 1) AS families, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS paralogs,
 count(*) FILTER (n = 1) AS orphans, max(n) AS largest, CAST(sum(n) AS BIGINT) AS members FROM n""")
def family_statistics(spark, d):
    """A family is a part's line items of one flag."""
    return families.family_statistics(genes(spark, d).withColumn("family", F.struct("og", "species")), family="family")


@query(GENES + " SELECT og, count(*) AS size, array_to_string(list_sort(list(CAST(gene AS VARCHAR))), chr(9)) AS members FROM ge GROUP BY og")
def family_lists(spark, d):
    return families.member_lists(genes(spark, d).withColumn("gene", F.col("gene").cast("string")), family="og", id="gene")


@query(GENES + " SELECT og, count(*) FILTER (species = 'A') AS A, count(*) FILTER (species = 'N') AS N, count(*) FILTER (species = 'R') AS R FROM ge GROUP BY og")
def copy_numbers(spark, d):
    return families.copy_numbers(genes(spark, d), group="og", species="species", names=["A", "N", "R"])


@query("""WITH ge AS (SELECT l_orderkey AS og, l_returnflag AS species, max(l_orderkey * 10 + l_linenumber) AS gene, count(*) AS n FROM lineitem GROUP BY 1, 2)
 SELECT x.og, x.gene AS id_a, y.gene AS id_b FROM ge x JOIN ge y ON x.og = y.og AND x.species = 'A' AND y.species = 'R' WHERE x.n = 1 AND y.n = 1""")
def orthologs_one_to_one(spark, d):
    """Orders are the groups here: parts have many line items of each flag."""
    return families.one_to_one(genes(spark, d).withColumn("og", F.floor(F.col("gene") / 10)), group="og", species="species", id="gene", a="A", b="R")


@query(GENES + """, p AS (SELECT og, seq, count(*) AS n FROM ge GROUP BY 1, 2), f AS (SELECT x.seq AS seq_a, y.seq AS seq_b, count(*) AS families FROM p x JOIN p y ON x.og = y.og AND (x.seq < y.seq OR (x.seq = y.seq AND x.n > 1)) GROUP BY 1, 2),
 q AS (SELECT least(x.seq, y.seq) AS seq_a, greatest(x.seq, y.seq) AS seq_b, CASE WHEN x.seq = y.seq THEN greatest(greatest(x.b, y.b) - least(x.e, y.e), 0) END AS d FROM ge x JOIN ge y ON x.og = y.og AND x.gene < y.gene)
 SELECT f.seq_a, f.seq_b, any_value(families) AS families, count(*) AS pairs, CAST(sum(d) AS BIGINT) AS distance_sum, round(avg(d), 4) AS distance_mean FROM f JOIN q ON f.seq_a = q.seq_a AND f.seq_b = q.seq_b GROUP BY 1, 2""")
def family_presence_links(spark, d):
    out = families.presence_links(genes(spark, d), family="og", id="gene", seq="seq", begin="b", end="e")
    return out.withColumn("distance_mean", F.round("distance_mean", 4))


@query(GENES + """, p AS (SELECT og, seq, count(*) AS n, sum(count(*)) OVER (PARTITION BY og) AS w FROM ge GROUP BY 1, 2)
 SELECT seq, CAST(sum(n) AS BIGINT) AS members, count(*) FILTER (n = 1 AND w > 1) AS outsiders FROM p GROUP BY 1""")
def family_outsiders(spark, d):
    return families.outsiders(genes(spark, d), family="og", seq="seq")


@query("""WITH g AS (SELECT l_orderkey AS og, l_returnflag AS sp, l_orderkey * 10 + l_linenumber AS gene, l_suppkey % 3 AS seq, CAST(l_partkey AS BIGINT) AS b, l_partkey + CAST(l_quantity AS BIGINT) AS e FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey * 10 + l_linenumber) = 1),
 k AS (SELECT og FROM g GROUP BY 1 HAVING count(*) FILTER (sp = 'A') = 1 AND count(*) FILTER (sp = 'R') = 2)
 SELECT o.og, o.gene AS id_one, x.gene AS id_a, y.gene AS id_b, CASE WHEN x.seq <> y.seq THEN 4 WHEN greatest(greatest(x.b, y.b) - least(x.e, y.e), 0) < 500 THEN 1 ELSE 2 END AS type
 FROM k JOIN g o ON o.og = k.og AND o.sp = 'A' JOIN g x ON x.og = k.og AND x.sp = 'R' JOIN g y ON y.og = k.og AND y.sp = 'R' AND x.gene < y.gene""")
def paralog_links(spark, d):
    """One gene of a species with two of another: orders with one A and two R line items."""
    t = table(spark, d, "lineitem")
    rows = t.select(F.col("l_orderkey").alias("og"), F.col("l_returnflag").alias("sp"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("gene"), (F.col("l_suppkey") % 3).alias("seq"), F.col("l_partkey").alias("b"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("e"))
    # order and line don't tell line items apart
    once = rows.withColumn("_n", F.count("*").over(Window.partitionBy("gene"))).where("_n = 1").drop("_n")
    return families.paralog_links(once, group="og", species="sp", id="gene", seq="seq", begin="b", end="e", one="A", two="R", near=500)


@query(GENES + " SELECT count(*) FILTER (seq % 4 = 0) AS kept, count(*) FILTER (seq % 4 <> 0) AS removed FROM ge")
def genes_on_indexed(spark, d):
    index = table(spark, d, "supplier").where("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("seq"))
    return families.on_indexed(genes(spark, d), index, seq="seq")[1]


@query(GENES + """, s AS (SELECT l_suppkey AS id, 'm' || (l_suppkey % 50) AS mult, l_suppkey AS seq, min(l_orderkey) AS b, max(l_orderkey) AS e FROM lineitem GROUP BY 1, 2, 3)
 SELECT s.id, count(*) AS genes, CAST(floor(avg(ge.e - ge.b)) AS BIGINT) AS gene_length FROM s JOIN ge ON ge.seq = s.seq AND (ge.b BETWEEN s.b AND s.e OR ge.e BETWEEN s.b AND s.e) WHERE s.b < s.e GROUP BY 1""")
def segments_with_genes(spark, d):
    """A supplier's segment runs from its first order to its last; it holds the line items that begin or end inside."""
    rows = genes(spark, d)
    ends = rows.groupBy("seq").agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
    named = rows.select("seq", F.col("gene").cast("string").alias("gene"), "b", "e")
    ends = ends.select(F.col("seq").alias("id"), F.concat(F.lit("m"), F.col("seq") % 50).alias("multiplicon"), F.col("seq").alias("sequid"), F.concat(F.lit("lo"), "seq").alias("first"), F.concat(F.lit("hi"), "seq").alias("last"), F.lit(1).alias("order"), "lo", "hi")
    marks = ends.select(F.col("first").alias("gene"), F.lit(None).cast("long").alias("sequid"), F.col("lo").alias("begin"), F.col("lo").alias("end")).unionByName(ends.select(F.col("last").alias("gene"), F.lit(None).cast("long").alias("sequid"), F.col("hi").alias("begin"), F.col("hi").alias("end")))
    all_genes = named.select("gene", F.col("seq").cast("long").alias("sequid"), F.col("b").alias("begin"), F.col("e").alias("end")).unionByName(marks)
    out = families.segments_with_genes(ends.drop("lo", "hi").withColumn("sequid", F.col("sequid").cast("long")), all_genes)
    return out.select("id", "genes", F.col("gene_length").cast("long").alias("gene_length"))


@query(GENES + " SELECT least(a, 4) AS n_a, least(r, 4) AS n_b, count(*) AS groups FROM nn GROUP BY 1, 2")
def occupancy(spark, d):
    return families.occupancy(families.copy_numbers(genes(spark, d), group="og", species="species", names=["A", "R"]), a="A", b="R", cap=4)


@query(GENES + """ SELECT og, CASE WHEN coalesce(bool_and(seq % 2 = 0) FILTER (species IN ('A', 'R')), true) THEN 'major' WHEN bool_and(seq % 2 = 1) FILTER (species IN ('A', 'R')) THEN 'minor' ELSE 'mix' END AS placement FROM ge GROUP BY og""")
def placement_class(spark, d):
    rows = genes(spark, d).withColumn("cat", F.when(F.col("seq") % 2 == 0, "Chr").otherwise("Scaffold"))
    return families.placement_class(rows, group="og", species="species", names=["A", "R"], category="cat")


@query(GENES + " SELECT gene, count(*) OVER (PARTITION BY og, species) AS copies FROM ge")
def gene_copy_number(spark, d):
    return families.with_copy_number(genes(spark, d), group="og", species="species").select("gene", "copies")


@query(GENES + """ SELECT x.og, x.gene AS id_a, y.gene AS id_b, a || ':' || r AS relation FROM nn JOIN ge x ON x.og = nn.og AND x.species = 'A' JOIN ge y ON y.og = nn.og AND y.species = 'R' WHERE a > 0 AND r > 0 AND a + r <= 12""")
def ortholog_links(spark, d):
    return families.links(genes(spark, d), group="og", species="species", id="gene", a="A", b="R", most=12)


@query(GENES + " SELECT og, a AS n_a, r AS n_b, CASE WHEN a = r THEN 'equal' WHEN a > r THEN 'A' ELSE 'R' END AS more FROM nn WHERE a > 0 AND r > 0 AND a + r > 12")
def ortholog_points(spark, d):
    return families.points(genes(spark, d), group="og", species="species", a="A", b="R", above=12)


@query(GENES + """ SELECT kind, n AS groups, round_even(100.0 * n / w, 2) AS percent FROM (SELECT count(*) AS w, count(*) FILTER (a > 0 AND r > 0) AS i, count(*) FILTER (NOT (a > 0 AND r > 0)) AS x,
 count(*) FILTER (a > 0 AND r > 0 AND a + r <= 12) AS l, count(*) FILTER (a > 0 AND r > 0 AND a + r > 12) AS p FROM nn), LATERAL (VALUES ('included', i), ('removed', x), ('links', l), ('points', p)) AS v(kind, n)""")
def ortholog_link_summary(spark, d):
    return families.link_summary(genes(spark, d), group="og", species="species", a="A", b="R", most=12)


@query("""SELECT l_linestatus AS g, 1 + 3 - (CAST(bool_or(l_quantity > 49) AS INTEGER) + CAST(bool_or(l_discount > 0.09) AS INTEGER) + CAST(bool_or(l_tax < 0) AS INTEGER)) AS tier FROM lineitem GROUP BY 1""")
def evidence_tier(spark, d):
    rows = table(spark, d, "lineitem").withColumnRenamed("l_linestatus", "g")
    return families.quality_tier(rows, group="g", evidence=[F.col("l_quantity") > 49, F.col("l_discount") > 0.09, F.col("l_tax") < 0])


def alignments(spark, d) -> DataFrame:
    t = table(spark, d, "lineitem")
    q = F.col("l_quantity").cast("int").cast("string")
    text = F.concat(q, F.lit("M"), F.col("l_linenumber").cast("string"), F.lit("I"), q, F.lit("M"), (F.col("l_suppkey") % 7 + 1).cast("string"), F.lit("D"), q, F.lit("M"))
    return t.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), text.alias("cg"))


CIGAR = """WITH al AS (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_quantity AS INTEGER) AS q, l_linenumber AS i, l_suppkey % 7 + 1 AS d FROM lineitem)"""


@query(CIGAR + " SELECT id, CAST(3 * q AS BIGINT) AS cig_matches, CAST(i AS BIGINT) AS cig_insertions, CAST(d AS BIGINT) AS cig_deletions, CAST(2 AS INTEGER) AS cig_compressed FROM al")
def cigar_totals(spark, d):
    return cigar.parsed(alignments(spark, d), "cg").select("id", "cig_matches", "cig_insertions", "cig_deletions", "cig_compressed")


@query(CIGAR + """ SELECT op, len, count(*) AS "count" FROM (SELECT 'M' AS op, q AS len FROM al UNION ALL SELECT 'M', q FROM al UNION ALL SELECT 'M', q FROM al UNION ALL SELECT 'I', CAST(i AS INTEGER) FROM al UNION ALL SELECT 'D', CAST(d AS INTEGER) FROM al) GROUP BY 1, 2""")
def cigar_histogram(spark, d):
    return cigar.length_histogram(alignments(spark, d), "cg")


@query(CIGAR + " SELECT id, 'Ins' AS kind, CAST(i AS INTEGER) AS size FROM al UNION ALL SELECT id, 'Del', CAST(d AS INTEGER) FROM al")
def indel_list(spark, d):
    return cigar.indels(cigar.parsed(alignments(spark, d), "cg"), ["id"])


@query(LEVELS + """, g AS (SELECT r_name, n_name, 2 - grouping(r_name) - grouping(n_name) AS level, count(*) AS elements, CAST(sum(kilo) AS BIGINT) AS bp FROM lv GROUP BY ROLLUP (r_name, n_name)),
 t AS (SELECT count(*) AS n, sum(kilo) AS b FROM lv) SELECT r_name, n_name, CAST(level AS INTEGER) AS level, elements, bp, round(100.0 * elements / n, 6) AS percent_elements, round(100.0 * bp / b, 6) AS percent_bp,
 round(100.0 * bp / 1e9, 6) AS percent_genome, round(bp / elements, 6) AS mean_length FROM g, t""")
def summary_legacy(spark, d):
    return rounded(summary.legacy_summary(levels(spark, d), levels=["r_name", "n_name"], bp="kilo", genome=10**9))


@query(LEVELS + """, k AS (SELECT *, unnest(CASE WHEN flagged THEN ['Included'] ELSE ['Included', 'Excluded'] END) AS overlap FROM lv)
 SELECT r_name, c_mktsegment, overlap, round(sum(kilo) / 1e6, 2) AS mb, round(100.0 * sum(kilo) / 1e6, 2) AS percent, round(median(kilo), 2) AS median, round(avg(kilo), 2) AS mean, round(stddev_samp(kilo), 2) AS sd,
 CAST(max(kilo) AS DOUBLE) AS max FROM k GROUP BY 1, 2, 3""")
def summary_divergence_table(spark, d):
    rows = levels(spark, d)
    sizes = table(spark, d, "region").select("r_name", F.lit(10**6).cast("long").alias("size"))
    out = summary.divergence_table(rows, sizes, group=["r_name", "c_mktsegment"], on="r_name", bp="kilo", value="kilo", overlapping="flagged", size="size")
    return out.withColumn("max", F.col("max").cast("double"))


@query("""SELECT o_orderpriority, count(*) AS "count", round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, min(x) AS min, max(x) AS max, round(quantile_cont(x, 0.25), 4) AS q25, round(quantile_cont(x, 0.5), 4) AS q50,
 round(quantile_cont(x, 0.75), 4) AS q75 FROM (SELECT o_orderpriority, o_totalprice AS x FROM orders) WHERE x <> 0 GROUP BY 1""")
def described_values(spark, d):
    return rounded(summary.described(table(spark, d, "orders").select("o_orderpriority", F.col("o_totalprice").alias("x")), group=["o_orderpriority"], value="x"), 4)


@query("""SELECT event_type, count(*) AS "count", round_even(100.0 * count(*) / (SELECT count(*) FROM events), 2) AS percent FROM events GROUP BY 1""")
def type_frequency(spark, d):
    return summary.type_frequency(table(spark, d, "events"), kind="event_type")


@query(CIGAR + """ SELECT id, 3 * q / (3.0 * q + i + d) AS matches_per_base, (i + d) / (3.0 * q + i + d) AS edits_per_base, CAST(i + d AS BIGINT) AS perc_indel FROM al""")
def cigar_per_base(spark, d):
    rows = cigar.parsed(alignments(spark, d), "cg").withColumn("n", F.col("cig_matches") + F.col("cig_insertions") + F.col("cig_deletions"))
    rows = rows.withColumn("nm", F.col("cig_insertions") + F.col("cig_deletions"))
    out = cigar.per_base(rows, matches="cig_matches", ali_len="n", edits="nm", dels="cig_deletions", ins="cig_insertions")
    return out.select("id", "matches_per_base", "edits_per_base", "perc_indel")


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_suppkey % 5 = 0 AND l_partkey % 5 = 0 THEN 'minor/minor' WHEN l_suppkey % 5 = 0 OR l_partkey % 5 = 0 THEN 'minor/major' ELSE 'major/major' END AS pair,
 CASE WHEN l_suppkey % 5 = 0 THEN 'Qscf' ELSE 'Qchr' END || '_' || CASE WHEN l_partkey % 5 = 0 THEN 'Tscf' ELSE 'Tchr' END AS kind FROM lineitem""")
def pair_split(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_suppkey", "l_partkey")
    q, t = F.col("l_suppkey") % 5 == 0, F.col("l_partkey") % 5 == 0
    return recode.pair_split(rows, query_minor=q, target_minor=t).select("id", "pair", recode.pair_type(q, t).alias("kind"))


@query(ITEMS + """, t AS (SELECT iv.*, l_partkey AS tseq FROM iv JOIN (SELECT l_partkey, (((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS k FROM lineitem) ON k = id)
 SELECT id, seq, b AS "begin", e + 1 AS "end", tseq AS hit_by FROM t WHERE seq % 5 <> 0 AND tseq % 5 = 0 UNION ALL SELECT id, tseq, b, e + 1, seq FROM t WHERE tseq % 5 <> 0 AND seq % 5 = 0""")
def major_regions(spark, d):
    rows = pairs_of_sides(spark, d)
    return recode.major_regions(rows, sides={"Q": ("seq", "b", "e", F.col("seq") % 5 == 0), "T": ("tseq", "b", "e", F.col("tseq") % 5 == 0)}, id="id")


@query(LEVELS + """, x AS (SELECT *, unnest(list_filter(['All', CASE WHEN kilo < 1 THEN '<1' END, CASE WHEN kilo < 100 THEN '<100' END, CASE WHEN kilo >= 100 THEN '>=100' END], lambda v: v IS NOT NULL)) AS band FROM lv),
 g AS (SELECT r_name, band, n_name, c_mktsegment, CAST(2 - grouping(n_name) - grouping(c_mktsegment) AS INTEGER) AS level, CAST(sum(kilo) AS BIGINT) AS kilo FROM x GROUP BY GROUPING SETS ((r_name, band, n_name), (r_name, band, n_name, c_mktsegment)))
 SELECT *, round(kilo / sum(kilo) OVER (PARTITION BY r_name, band, level), 6) AS share FROM g""")
def content_by_level(spark, d):
    rows = levels(spark, d)
    return rounded(summary.content_table(rows, by=["r_name"], levels=["n_name", "c_mktsegment"], value="kilo", weight="kilo", edge=100))


@query(LEVELS + """, x AS (SELECT *, CAST(floor(kilo / 50) AS BIGINT) AS bin FROM lv), g AS (SELECT r_name, bin, n_name, c_mktsegment, CAST(2 - grouping(n_name) - grouping(c_mktsegment) AS INTEGER) AS level, count(*) AS "count"
  FROM x GROUP BY GROUPING SETS ((r_name, bin), (r_name, bin, n_name), (r_name, bin, n_name, c_mktsegment)))
 SELECT *, round("count" / sum("count") OVER (PARTITION BY r_name, n_name, c_mktsegment, level), 6) AS share FROM g""")
def histograms_by_path(spark, d):
    return rounded(summary.path_histograms(levels(spark, d), by=["r_name"], levels=["n_name", "c_mktsegment"], value="kilo", width=50))


@query(LEVELS + """, s AS (SELECT DISTINCT n_name, unnest(CASE WHEN n_name < 'F' THEN ['Genome', 'ChrX'] ELSE ['Genome', 'Autosomes'] END) AS region FROM lv)
 SELECT r_name, region, c_mktsegment, CAST(sum(kilo) AS BIGINT) AS kilo FROM lv JOIN s USING (n_name) GROUP BY 1, 2, 3""")
def occupancy_by_region(spark, d):
    rows = levels(spark, d)
    sets = rows.select("n_name", F.explode(F.array(F.lit("Genome"), F.when(F.col("n_name") < "F", "ChrX").otherwise("Autosomes"))).alias("region"))
    return summary.stacked_occupancy(rows, sets, seq="n_name", by=["r_name"], levels=["c_mktsegment"], weight="kilo")


@query(LEVELS + " SELECT r_name, c_mktsegment, CAST(sum(kilo) AS BIGINT) AS kilo, median(price) AS value_median, round(median(price) * sum(kilo) / 100, 3) AS weighted FROM lv GROUP BY 1, 2")
def divergence_weighted(spark, d):
    out = summary.weighted_divergence(levels(spark, d), keys=["r_name", "c_mktsegment"], value="price", bp="kilo")
    return out.withColumn("weighted", F.round("weighted", 3))


@query("""SELECT DISTINCT p_brand, CASE WHEN p_size % 4 = 0 THEN p_brand || ' (unknown)' WHEN p_size % 4 = 1 THEN p_brand || ' (unknown)' WHEN p_size % 4 = 2 THEN NULL ELSE 'kept' END AS name, p_size % 4 AS k FROM part""")
def readable_categories(spark, d):
    """Missing and NA categories take the name above; one is on the residual list."""
    k = F.col("p_size") % 4
    rows = table(spark, d, "part").select("p_brand", k.alias("k"), F.when(k == 1, "NA").when(k == 2, "rest").when(k == 3, "kept").alias("cat"))
    return rows.select("p_brand", summary.readable("cat", above="p_brand", residual=("rest",)).alias("name"), "k").distinct()


@query(POSITIONS.format(step=60) + """, c AS (SELECT seq, CAST(pos // 60 AS INTEGER) AS k, w, unnest([{{'level': 'small', 'name': CAST(w % 2 AS VARCHAR)}}, {{'level': 'large', 'name': CAST(w % 3 AS VARCHAR)}}]) AS c FROM ps WHERE pos % 60 <= 50)
 SELECT gr.seq, gr."window", gr."window" * 60 AS window_begin, least(gr."window" * 60 + 50, stop) AS window_end, c.c.level AS level, c.c.name AS name, count(*) AS "count", CAST(sum(w) AS BIGINT) AS bp FROM gr JOIN c ON c.seq = gr.seq AND c.k = gr."window" GROUP BY ALL""".replace("{{", "{").replace("}}", "}"))
def windows_jumping_by_class(spark, d):
    rows = positions(spark, d).withColumns({"small": F.col("w") % 2, "large": F.col("w") % 3})
    return windows.jumping_by_class(rows, extents(spark, d).select("seq", "stop"), seq="seq", begin="pos", length="w", stop="stop", width=50, jump=10, classes=["small", "large"])


@query('SELECT l_returnflag AS seq, CAST(l_partkey // 50 AS INTEGER) AS "window", bool_or(l_quantity >= 50 OR l_linenumber >= 50) AS special FROM lineitem GROUP BY 1, 2')
def windows_special(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("seq"), F.floor(F.col("l_partkey") / 50).cast("int").alias("window"), "l_quantity", "l_linenumber")
    return windows.special_windows(rows, seq="seq", window="window", own="l_quantity", other="l_linenumber", least=50)


@query("""WITH v AS (SELECT o_orderpriority AS g, 'o_totalprice' AS "column", CAST(o_totalprice AS DOUBLE) AS x FROM orders UNION ALL SELECT o_orderpriority, 'o_custkey', o_custkey FROM orders),
 q AS (SELECT g, "column", quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM v GROUP BY 1, 2)
 SELECT v.g AS o_orderpriority, v."column", count(*) AS n, round(sum(x), 2) AS sum, round(avg(x), 4) AS mean, round(median(x), 4) AS median, max(x) AS max, count(*) FILTER (x > b + 0.5 * (b - a)) AS high, count(*) FILTER (x < a - 0.5 * (b - a)) AS low
 FROM v JOIN q ON q.g = v.g AND q."column" = v."column" GROUP BY 1, 2""")
def outlier_counts(spark, d):
    out = windows.outlier_summary(table(spark, d, "orders"), group=["o_orderpriority"], columns=["o_totalprice", "o_custkey"], factor=0.5)
    return out.withColumns({"sum": F.round("sum", 2), "mean": F.round("mean", 4), "median": F.round("median", 4)})


@query(POSITIONS.format(step=100) + """, r AS (SELECT seq, CAST(pos // 100 AS INTEGER) AS k, w % 3 AS relation, w % 2 AS tier, count(*) AS c FROM ps GROUP BY ALL)
 SELECT gr.seq, gr."window", CAST(gr."window" * 100 AS BIGINT) AS window_begin, least(gr."window" * 100 + 100, stop) AS window_end, relation, tier, c AS "count" FROM gr JOIN r ON r.seq = gr.seq AND r.k = gr."window" """)
def windows_by_relation(spark, d):
    rows = positions(spark, d).withColumns({"relation": F.col("w") % 3, "tier": F.col("w") % 2})
    return windows.relation_windows(rows, extents(spark, d), seq="seq", position="pos", start="start", stop="stop", width=100, relation="relation", tier="tier")


@query(POSITIONS.format(step=100) + """, r AS (SELECT seq, pos // 100 AS k, count(*) FILTER (w % 4 = 1) AS single, count(*) FILTER (w % 4 > 1) AS several, count(*) AS total FROM ps WHERE w % 3 = 0 GROUP BY 1, 2)
 SELECT gr.seq, gr."window", CAST(gr."window" * 100 AS BIGINT) AS window_begin, least(gr."window" * 100 + 100, stop) AS window_end, coalesce(single, 0) AS single, coalesce(several, 0) AS several, coalesce(total, 0) AS total FROM gr LEFT JOIN r ON r.seq = gr.seq AND r.k = gr."window" """)
def windows_one_sided(spark, d):
    rows = positions(spark, d).withColumns({"own": F.col("w") % 4, "other": F.col("w") % 3})
    return windows.one_sided_windows(rows, extents(spark, d), seq="seq", position="pos", start="start", stop="stop", width=100, own="own", other="other")


@query(LEVELS + """, g AS (SELECT r_name, n_name, c_mktsegment, CAST(2 - grouping(n_name) - grouping(c_mktsegment) AS INTEGER) AS level, count(*) AS elements, CAST(sum(kilo) AS BIGINT) AS bp FROM lv
  GROUP BY GROUPING SETS ((r_name), (r_name, n_name), (r_name, n_name, c_mktsegment))), t AS (SELECT r_name, count(*) AS n, sum(kilo) AS b FROM lv GROUP BY 1)
 SELECT g.*, round(100.0 * elements / n, 6) AS percent_elements, round(100.0 * bp / b, 6) AS percent_bp, round(100.0 * bp / 1e9, 6) AS percent_genome, round(bp / elements, 6) AS mean_length FROM g JOIN t USING (r_name)""")
def summary_legacy_by(spark, d):
    """The older summary once for each region, in one run."""
    return rounded(summary.legacy_summary(levels(spark, d), levels=["n_name", "c_mktsegment"], bp="kilo", genome=10**9, by=["r_name"]))
