"""Shared pieces: scratch tables, size-checked joins, components, global ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.session import scratch, shipped  # noqa: F401

#: Bytes of a table up to which a join side is broadcast; beyond it Spark shuffles.
BROADCAST_BYTES = 8_000_000


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, and a lost executor costs no recomputation."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def dropped(table: DataFrame) -> None:
    """Removes a written table that nothing reads any more."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._scratch)
    path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def sized(ids: DataFrame, width: int = 8) -> DataFrame:
    """ids (a narrow table already written, at most `width` bytes a row) with a broadcast hint only if a count proves it small."""
    limit = BROADCAST_BYTES // width
    return F.broadcast(ids) if ids.limit(limit + 1).count() <= limit else ids


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores as it takes to be none of the columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links to (node, component): the smallest node reachable.

    Alternating large-star and small-star rounds; every round's links are written to the shared folder. A hub's
    smallest neighbour is found by a pre-aggregated group-by, so no neighbour list is ever gathered.
    """
    links = written(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    )
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(low, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u != v")
            .distinct()
        )
        links = written(small)
        # done when links are stars: no node has two centres, and no centre has a centre
        roles = links.select(F.col("u").alias("n"), F.lit(1).alias("leaf"), F.lit(0).alias("hub")).unionAll(links.select("v", F.lit(0), F.lit(1)))
        if roles.groupBy("n").agg(F.sum("leaf").alias("a"), F.max("hub").alias("b")).where("a + b > 1").isEmpty():
            return links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )


def ranked(df: DataFrame, order: list, rank: str, size: str | None = None, before: str | None = None) -> DataFrame:
    """df (narrow: it is written once) with its global rank from 0 and, for a size column, the sum of sizes before it.

    Rows are range-partitioned and sorted by `order`, which should end in a unique column so that no range is hot; the
    only global step is a prefix sum over one count per partition.
    """
    parts = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    total = F.sum(size) if size else F.lit(0)
    sums = parts.groupBy("_part").agg(F.count("*").alias("_n"), total.cast("long").alias("_s"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "_part",
        F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_s0"),
    )
    within = Window.partitionBy("_part").orderBy(*order)
    out = parts.join(F.broadcast(starts), "_part").withColumn(rank, F.col("_n0") + F.row_number().over(within) - 1)
    if size and before:
        run = F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, -1))
        out = out.withColumn(before, (F.col("_s0") + F.coalesce(run, F.lit(0))).cast("long"))
    return out.drop("_part", "_n0", "_s0")
