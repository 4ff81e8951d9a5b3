"""Running statistics and jumping windows over file streams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomspan.session import scratch, shipped


def file_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder, oldest first, or of one file; files: how many a batch may have."""
    schema = spark.read.parquet(path).schema
    if files:
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    folder, _, name = path.rpartition("/")
    one = spark.read.parquet(path).inputFiles()
    if len(one) == 1 and one[0].rstrip("/").endswith(name):
        return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return spark.readStream.schema(schema).parquet(path)


def statistics(df: DataFrame, *, group: list[str], value: str, sign: str | None = None) -> DataFrame:
    """Count, mean and sample variance, kept up as rows come in; rows of sign -1 take back rows of sign 1."""
    w = F.col(sign) if sign else F.lit(1)
    x = F.col(value)
    sums = df.where(x.isNotNull()).groupBy(*group).agg(F.sum(w).alias("n"), F.sum(w * x).alias("_s"), F.sum(w * x * x).alias("_q"))
    mean = F.when(F.col("n") > 0, F.col("_s") / F.col("n"))
    return sums.select(*group, F.col("n").cast("long").alias("n"), mean.alias("mean"), F.when(F.col("n") > 1, (F.col("_q") - F.col("_s") * mean) / (F.col("n") - 1)).alias("variance"))


class _Multiset(StatefulProcessor):
    """The values of a group, each with how often it is there: a map state, which Spark keeps, restores and clears.

    A value that is taken back goes from the map, so that minimum, maximum and median can be taken back, too. One that is
    taken back before it comes counts as negative until then.
    """

    def __init__(self, group: list[str], value: str, sign: str | None) -> None:
        self.group, self.value, self.sign = group, value, sign

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "value double", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        changed: dict[float, int] = {}
        for part in rows:
            known = part[part[self.value].notna()]
            signs = known[self.sign].astype("int64") if self.sign else pd.Series(1, index=known.index)
            sums = signs.groupby(known[self.value].astype(float), sort=False).sum()
            for x, w in zip(sums.index.tolist(), sums.tolist()):
                changed[x] = changed.get(x, 0) + w
        for x, w in changed.items():
            if w:
                n = self.counts.getValue((x,))
                n = w + (n[0] if n else 0)
                self.counts.updateValue((x,), (n,)) if n else self.counts.removeKey((x,))
        there = sorted((k[0], v[0]) for k, v in self.counts.iterator() if v[0] > 0)
        out = dict(zip(self.group, ([k] for k in key)))
        yield pd.DataFrame(out | {c: pd.Series([v], dtype="Int64" if c == "n" else "float64") for c, v in _told(there).items()})

    def close(self) -> None:
        pass


def _told(there: list[tuple[float, int]]) -> dict[str, float | None]:
    """Statistics of sorted values with their counts."""
    n = sum(c for _, c in there)
    if not n:
        return {"n": 0, "mean": None, "variance": None, "low": None, "median": None, "high": None}
    mean = math.fsum(x * c for x, c in there) / n
    variance = math.fsum((x - mean) ** 2 * c for x, c in there) / (n - 1) if n > 1 else None
    at, middle = 0, []
    for x, c in there:
        middle += [x] * (sum(at <= k < at + c for k in ((n - 1) // 2, n // 2)))
        at += c
    return {"n": n, "mean": mean, "variance": variance, "low": there[0][0], "median": sum(middle) / 2, "high": there[-1][0]}


def kept_values(df: DataFrame, *, group: list[str], value: str, sign: str | None = None) -> DataFrame:
    """(group, n, mean, variance, low, median, high): a group's statistics whenever it changes (update mode).

    Rows of sign -1 take back rows of sign 1. State lies in Spark's state store and grows with a group's distinct values.
    """
    spark = shipped(df.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in group)
    types = f"{keys}, n long, mean double, variance double, low double, median double, high double"
    rows = df.select(*group, value, *([sign] if sign else []))
    return rows.groupBy(*group).transformWithStateInPandas(_Multiset(group, value, sign), types, "Update", "None")


def jumping_windows(df: DataFrame, *, time: str, width: int, jump: int, group: list[str], value: str, late: str | None = None) -> DataFrame:
    """Windows of `width` seconds with `jump` seconds between them: (window_start in epoch seconds, group, n, total).

    late: how far behind the latest time a row may come. In append mode a window is told once, when no row for it or for the
    jump behind it can come any more; rows that come later yet are dropped and counted (see drained).
    """
    step = f"{width + jump} seconds"
    rows = df.withWatermark(time, late) if late else df
    rows = rows.withColumn("_w", F.window(time, step)).where(F.unix_timestamp(time) < F.unix_timestamp("_w.start") + width)
    return rows.groupBy("_w", *group).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.unix_timestamp("_w.start").alias("window_start"), *group, "n", "total")


def drained(stream: DataFrame, mode: str = "append", *, key: list[str] | None = None, root: str | None = None, told: dict | None = None) -> DataFrame:
    """All that a stream gives for the files there now, written as Parquet in the shared folder and read from there.

    Each batch has a folder, which a retry writes anew. In complete mode the last batch's result is what stays, in update
    mode the last row of each key. root: a folder with the state and results of calls before, which this one goes on from.
    told: gets the number of rows that came too late for the watermark.
    """
    spark, root = stream.sparkSession, root or scratch(stream.sparkSession)
    out = f"{root}/out"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/{number}")

    q = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if told is not None:
        told["late"] = sum(op.numRowsDroppedByWatermark for p in q.recentProgress for op in p.stateOperators)
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])).option("recursiveFileLookup", "true").parquet(out)
    if mode == "update":
        columns = [c for c in stream.columns if c not in key]
        return rows.groupBy(*key).agg(F.max_by(F.struct(*columns), "_batch").alias("_r")).select(*key, "_r.*")
    return rows.drop("_batch")
