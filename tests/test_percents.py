"""Coverage in percent is rounded as in the SQL, also where two places are a half."""

import duckdb
from pyspark.sql import functions as F

from loomspan.operators import intervals
from loomspan.plans.catalog import ORACLE_SQL, QUERIES

KEYS = {"seq": "seq", "begin": "b", "end": "e", "length": "size"}


def test_every_share_of_a_sequence(spark):
    df = spark.range(1, 4001).select(F.col("id").alias("seq"), F.lit(1).cast("long").alias("b"), F.col("id").alias("e"), F.lit(4000).cast("long").alias("size"))
    got = {r["bp"]: r["percent"] for r in intervals.covered(df, **KEYS).collect()}
    assert got == dict(duckdb.sql("SELECT n, round_even(100 * n / 4000.0, 2) FROM range(1, 4001) t(n)").fetchall())
    assert [intervals.covered_whole(df.where(F.col("seq") == n), **KEYS).first()["percent"] for n in (23, 49)] == [0.57, 1.23]


def test_queries_are_as_their_sql(spark, tmp_path):
    rows = [(s, 1, 0, s, float(n), 1.0, "A", day) for s, parts in ((1, (23,)), (2, (49,)), (3, (45, 42))) for day, n in zip(("1995-01-01", "1996-01-01"), parts)]
    names = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate string")
    df.withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp")).select(*names).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    for name in ("interval_coverage", "interval_coverage_whole", "coordinates_table", "interval_gaps"):
        result = QUERIES[name](spark, str(tmp_path))
        sql = con.execute(ORACLE_SQL[name])
        columns = [c[0] for c in sql.description]
        assert sorted(map(tuple, result.select(*columns).collect()), key=str) == sorted(sql.fetchall(), key=str), name
