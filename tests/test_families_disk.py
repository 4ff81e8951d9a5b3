"""Pairs of sequences over families: what goes through exchanges, where families lie on sequences that are near in order."""

from collections import Counter

from pyspark.sql import functions as F

from loomspan.operators import families

KEYS = {"family": "f", "id": "id", "seq": "s", "begin": "b", "end": "e"}


def exchanged(df):
    """Bytes and rows that a result's plan sends through exchanges when it runs."""
    run = df._jdf.queryExecution()
    run.toRdd().count()
    bytes = rows = 0
    plans = [run.executedPlan()]
    while plans:
        plan = plans.pop()
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            plans.append(plan.executedPlan())
        elif "QueryStage" in name:
            plans.append(plan.plan())
        else:
            if name == "Exchange":
                metrics = plan.metrics()
                bytes += metrics.apply("dataSize").value()
                rows += metrics.apply("shuffleRecordsWritten").value()
            children = plan.children()
            plans.extend(children.apply(i) for i in range(children.size()))
    return bytes, rows


def groups(spark):
    """Eight groups of 100 families, each family on all 20 sequences of its group."""
    df = spark.range(16_000).select("id", F.floor(F.col("id") / 20).alias("f"), (F.floor(F.col("id") / 2000) * 20 + F.col("id") % 20).alias("s"), (F.col("id") * 7000).alias("b"))
    return df.withColumn("e", F.col("b") + 50)


def test_lists_are_sent_once_to_a_range(spark, monkeypatch):
    monkeypatch.setattr(families, "PAIRS", 21_000)
    pairs = families._pairs_of_sequences(groups(spark), "f", "s")
    n = 8 * 100 * 210
    assert exchanged(pairs)[0] < n * 16
    assert pairs.count() == n
    assert {r["links"] for r in families.linkage(groups(spark), family="f", seq="s").collect()} == {100}


def test_counted_pairs_are_not_joined_by_exchange(spark, monkeypatch):
    monkeypatch.setattr(families, "PAIRS", 21_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = families.presence_links(groups(spark), **KEYS)
        assert exchanged(out)[1] < 8 * 190
        assert Counter(tuple(r)[2:] for r in out.collect()) == {(100, 100, None, None): 8 * 190}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_two_members_and_more(spark):
    """Two members' distance is told without a scan; members of equal id are no pair; more than two are scanned."""
    rows = [(1, 1, "x", 0, 10), (1, 2, "x", 2000, 2010), (2, 3, "x", 0, 10), (2, 4, "x", 5, 20), (3, 5, "y", 0, 10), (3, 5, "y", 90_000, 90_010), (4, 6, "y", 0, 1), (4, 7, "y", 20_001, 20_002), (4, 8, "y", 2 * 10**6, 2 * 10**6)]
    got = {r["s"]: r.asDict() for r in families.pair_distances(spark.createDataFrame(rows, "f int, id long, s string, b long, e long"), **KEYS).collect()}
    assert got["x"] == {"s": "x", "s_r": "x", "pairs": 2, "near_4": 2, "near_5": 0, "near_6": 0, "far": 0, "total": 1990, "mean": 995.0}
    total = 20_000 + 2 * 10**6 - 1 + 2 * 10**6 - 20_002
    assert got["y"] == {"s": "y", "s_r": "y", "pairs": 3, "near_4": 0, "near_5": 1, "near_6": 0, "far": 2, "total": total, "mean": total / 3}
