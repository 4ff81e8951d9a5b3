"""Ids of line items whose number is beyond a long."""

import time

from pyspark.sql import functions as F

from loomspan.plans.catalog import QUERIES, items, pairs_of_sides, table

DATA = "/root/testdata/sf0.001"


def test_large_keys(spark, tmp_path):
    t = table(spark, DATA, "lineitem")
    shifted = t.withColumns({"l_orderkey": F.col("l_orderkey") + 9 * 10**6, "l_partkey": F.col("l_partkey") + 10**6, "l_suppkey": F.col("l_suppkey") + 50000})
    t.union(shifted).repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    old = {r["id"] for r in items(spark, DATA).collect()}
    new = [r["id"] for r in items(spark, str(tmp_path)).collect()]
    assert len(set(new)) == len(new) == 2 * t.count()
    assert {i for i in new if i >= 0} == old
    assert sorted(r["id"] for r in pairs_of_sides(spark, str(tmp_path)).collect()) == sorted(new)
    per = QUERIES["interval_resolved"](spark, str(tmp_path)).groupBy((F.col("id") < 0).alias("large")).agg(F.sum("bp_algor").alias("bp"), F.count("*").alias("n")).collect()
    assert per[0]["bp"] == per[1]["bp"] and per[0]["n"] == per[1]["n"] == t.count()


def test_large_keys_are_no_slower(spark, tmp_path):
    """A row beyond a long costs no error that is thrown and caught."""

    def seconds(shift: int) -> float:
        rows = spark.range(200_000).select(
            (F.floor(F.col("id") / 4) + shift).alias("l_orderkey"), (F.col("id") % 4).cast("int").alias("l_linenumber"), (F.col("id") % 20000 + shift).alias("l_partkey"), (F.col("id") % 1000 + shift).alias("l_suppkey"),
            F.lit(5.0).alias("l_quantity"), F.lit(1.5).alias("l_extendedprice"), F.lit("A").alias("l_returnflag"), F.lit("1995-01-02").cast("timestamp").alias("l_shipdate"),
        )
        rows.coalesce(1).write.parquet(f"{tmp_path}/{shift}/lineitem.parquet")
        start = time.monotonic()
        assert items(spark, f"{tmp_path}/{shift}").agg(F.count_if((F.col("id") < 0) == (shift > 1))).first()[0] == 200_000
        return time.monotonic() - start

    seconds(0)
    small = seconds(1)
    assert seconds(2_000_000) < 3 * small + 1.5
