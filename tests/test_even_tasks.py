"""Few keys with many rows: neither a sink nor windows put a key's rows into one task."""

from pathlib import Path

from pyspark.sql import functions as F

from loomspan.operators import windows
from loomspan.sources import writers


def test_a_value_of_many_rows_is_written_by_several_tasks(spark, tmp_path):
    df = spark.range(400_000, numPartitions=8).select((F.col("id") % 2).alias("k"), F.xxhash64("id").alias("x"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200KB")
    try:
        writers.partitioned(df, str(tmp_path / "out"), ["k"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert all(len(list(Path(tmp_path, "out", f"k={k}").glob("*.parquet"))) > 1 for k in (0, 1))
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.count("*"), F.bit_xor("x")).first() == df.agg(F.count("*"), F.bit_xor("x")).first()


def test_rows_meet_few_sequences_without_an_exchange(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("s"), F.col("id").alias("b"), (F.col("id") + 3).alias("e"), F.lit(1).alias("w"))
    sizes = df.groupBy("s").agg(F.lit(0).cast("long").alias("start"), F.max("b").alias("stop"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = windows.by_midpoint(df, sizes, seq="s", begin="b", end="e", weight="w", start="start", stop="stop", width=100)
        plan = out._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("BroadcastHashJoin") == 1 and plan.count("SortMergeJoin") == 1
    assert out.agg(F.sum("total")).first()[0] == 999
