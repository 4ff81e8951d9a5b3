"""Audits that come with the pass that writes a table."""

import pytest
from pyspark.sql import functions as F

from loomspan.operators import recode
from loomspan.plans import jobs
from loomspan.session import kept
from loomspan.sources import readers

LINE = "100 1.0 0.0 0.0 s{0} {1} {2} (0) + fam DNA/hAT 1 2 (0) {0}"


def file(tmp_path, name, lines):
    path = tmp_path / name
    path.write_text("\n".join(lines))
    return str(path)


def test_lines_are_counted_while_written(spark, tmp_path):
    good = [LINE.format(k, 1 + k, 9 + k) + (" *" if k % 3 == 0 else "") for k in range(20)]
    path = file(tmp_path, "good.out", ["  SW header", "score", "", *good])
    rows, seen = readers.observed_repeats(spark, path)
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert kept(rows).count() == 20 and (seen.get["lines"], seen.get["bad"], seen.get["example"]) == (20, 0, None)
    assert jobs.preprocess_repeats(spark, path).count() == 20
    bad = file(tmp_path, "bad.out", [*good, good[0] + " x", "7 too few"])
    with pytest.raises(ValueError, match="2 of 22 lines without 15 fields"):
        jobs.preprocess_repeats(spark, bad)
    assert readers.bad_rows(spark, bad).count() == 2


def test_filters_tell_what_they_removed(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 10 != 0, F.col("id") % 7).alias("x"))
    rules = {"even": F.col("id") % 2 == 0, "small": F.col("x") < 4}
    rows, told = recode.filtered(df, rules)
    assert kept(rows).count() == df.where(rules["even"] & rules["small"]).count()
    assert sorted(map(tuple, told().collect())) == sorted(map(tuple, recode.filter_audit(df, rules).collect()))


def test_faults_of_loading_come_together(spark, tmp_path):
    header = "score divg del ins sequid begin end orient name label overlapping bp_naive bp_algor"
    full = file(tmp_path, "a.tsv", [header, "100 1.0 0.0 0.0 chr1 1 9 + fam DNA/hAT true 9 9"])
    empty, index = file(tmp_path, "b.tsv", [header]), file(tmp_path, "i.idx", ["Genome ^chr 100", "Minor ^scaff 50"])
    rows, none = jobs.loaded(spark, {"one": full}, {})
    assert rows.count() == 1 and none is None
    with pytest.raises(ValueError, match="no repeats of two; subset Minor of one matches no sequence"):
        jobs.loaded(spark, {"one": full, "two": empty}, {"one": index})
