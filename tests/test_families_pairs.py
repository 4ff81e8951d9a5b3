"""Pairs of sequences over families: how many rows are sent, and sequences that are in very many families."""

from collections import Counter

from pyspark.sql import functions as F

from loomspan.operators import families

KEYS = {"family": "f", "id": "id", "seq": "s", "begin": "b", "end": "e"}


def table(spark, n=400):
    df = spark.range(n).select("id", (F.col("id") % 40).alias("f"), (F.xxhash64("id") % 17 + 17).alias("s"), (F.col("id") * 7000).alias("b"))
    return df.withColumn("e", F.col("b") + 50)


def wanted(rows):
    n = Counter((r["f"], r["s"]) for r in rows)
    links, both = Counter(), Counter()
    for (f, a), x in n.items():
        for (g, b), y in n.items():
            if f == g and a <= b:
                links[a, b] += x * (x - 1) // 2 if a == b else -(-x * y // 2)
                both[a, b] += a < b or x > 1
    return {k: v for k, v in links.items() if v}, {k: v for k, v in both.items() if v}


def test_sequences_in_many_families(spark, monkeypatch):
    for often, meeting in ((10, 256), (10, 3), (100_000, 3)):
        monkeypatch.setattr(families, "OFTEN", often, raising=False)
        monkeypatch.setattr(families, "MEETING", meeting)
        df = table(spark)
        links, both = wanted(df.collect())
        assert {(r["seq_a"], r["seq_b"]): r["links"] for r in families.linkage(df, family="f", seq="s").collect()} == links
        assert {(r["seq_a"], r["seq_b"]): r["families"] for r in families.presence_links(df, **KEYS).collect()} == both


def test_pairs_are_summed_where_they_are_made(spark):
    """Sequences are sent with those behind them, and no pair of a family goes through an exchange of its own."""
    df = table(spark)
    plan = families.linkage(df, family="f", seq="s")._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("Generate")]
    assert "Exchange" not in top


def test_members_without_place_count_for_families_only(spark):
    rows = [(1, 1, 1, 0, 5), (1, 2, 2, 0, 5), (1, 3, 2, None, 5), (2, 4, 1, 0, 5), (2, 5, 2, None, 5)]
    df = spark.createDataFrame(rows, "f int, id long, s int, b long, e long")
    got = {(r["seq_a"], r["seq_b"]): (r["families"], r["pairs"]) for r in families.presence_links(df, **KEYS).collect()}
    assert got == {(1, 2): (2, 1), (2, 2): (1, None)}
