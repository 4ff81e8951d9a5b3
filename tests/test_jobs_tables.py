"""Jobs work out only the tables that are asked for."""

import pytest
from pyspark.sql import functions as F

from loomspan.operators import intervals, summary
from loomspan.plans import jobs, whole
from loomspan.plans.files import paf_text, repeat_text
from loomspan.sources import readers, writers

DATA = "/root/testdata/sf0.001"


def refuse(*args, **kwargs):
    raise AssertionError("not asked for")


def test_repeat_distributions(spark, monkeypatch):
    rows = readers.repeats(spark, repeat_text(spark, DATA)).withColumns({"Species": F.lit("sp"), "bp_algor": F.col("bp_naive")})
    for name in ("box_stats", "weighted_divergence", "content_table"):
        monkeypatch.setattr(summary, name, refuse)
    tables = jobs.repeat_distributions(rows)
    assert list(tables) == ["content", "divergence", "boxes", "weighted"]
    assert tables["divergence"].where("level = 0").agg(F.sum("count")).first()[0] == rows.count()
    with pytest.raises(AssertionError):
        tables["boxes"]


def test_alignment_stats(spark, monkeypatch):
    for name in ("alignment_overlap", "covered"):
        monkeypatch.setattr(intervals, name, refuse)
    tables = jobs.alignment_stats(spark, paf_text(spark, DATA), [("all", ".")])
    assert tables["indels"].count() == 4 and tables["sizes"].count() > 2
    assert tables["regions"] is tables["regions"]


def test_rows_are_counted_before_they_are_classified(spark, monkeypatch):
    """What meets the taxonomy grows with labels and values, not with rows."""
    rows = readers.repeats(spark, repeat_text(spark, DATA)).withColumns({"Species": F.lit("sp"), "bp_algor": F.col("bp_naive")})
    seen, classified = [], jobs.recode.classified
    monkeypatch.setattr(jobs.recode, "classified", lambda df, **how: seen.append(df.count()) or classified(df, **how))
    jobs.repeat_distributions(rows)["divergence"]
    assert seen == [rows.select("Species", "default_repclass", "perc_divg").distinct().count()] and seen[0] < 200 < rows.count()


def test_few_rows_meet_subsets_and_taxonomy(spark, monkeypatch):
    """Diversity and summaries count rows by label (and value) first, too."""
    rows = readers.repeats(spark, repeat_text(spark, DATA)).withColumns({"Species": F.lit("sp"), "bp_algor": F.col("bp_naive")})
    index = spark.createDataFrame([("sp", "Genome", "^s", 10**9), ("sp", "Some", "[12]$", 10**8)], "Species string, Subset string, Pattern string, Bpsum long")
    seen, classified = [], jobs.recode.classified
    monkeypatch.setattr(jobs.recode, "classified", lambda df, **how: seen.append(df.count()) or classified(df, **how))
    jobs.diversity(rows)
    assert seen == [rows.select("default_repclass").distinct().count()]
    out = jobs.repeat_summaries(rows, index)
    values = rows.select("default_repclass", "perc_divg").distinct().count()
    assert values <= seen[1] <= 2 * values < rows.count()
    total = out.where("level = 0 and Subset = 'Genome' and class = 'TOTAL_REPETITIVE'").first()
    assert (total["naive_numele"], total["naive_totbp"]) == tuple(rows.agg(F.count("*"), F.sum("bp_naive")).first())


def test_species_are_written_in_one_pass(spark, tmp_path, monkeypatch):
    """A folder for each value, with a header and without the column."""
    writers.tsv(spark.sql("select id, id % 2 as k, if(id = 3, null, 'x') as t from range(6)"), f"{tmp_path}/t", by=["k"])
    back = spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/t/k=1")
    assert sorted((r["id"], r["t"]) for r in back.collect()) == [("1", "x"), ("3", "NA"), ("5", "x")] and back.columns == ["id", "t"]
    kept = []
    monkeypatch.setattr(whole, "kept", lambda df: kept.append(df) or df)
    paths = whole.two_species(spark, DATA)
    assert not kept and list(paths) == ["even", "odd"]
    both = readers.preprocessed_repeats(spark, paths)
    assert both.groupBy("Species").count().count() == 2 and both.count() == readers.repeats(spark, repeat_text(spark, DATA)).count()
