"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tsv(df: DataFrame, path: str, decimals: int | None = None, by: list[str] | None = None) -> None:
    """Tab-separated text with NA for null; doubles with a fixed number of decimals if asked. by: a folder for each value of these columns, which the text then lacks."""
    if decimals is not None:
        df = df.withColumns({c: F.format_string(f"%.{decimals}f", F.col(c)) for c, t in df.dtypes if t in ("double", "float")})
    df.write.partitionBy(*by or []).option("sep", "\t").option("header", True).option("nullValue", "NA").option("emptyValue", "").csv(path)


def family_lists(df: DataFrame, path: str, *, family: str, id: str) -> None:
    """One family a line, tab-joined, largest first."""
    rows = df.groupBy(family).agg(F.count("*").alias("_n"), F.array_join(F.sort_array(F.collect_list(id)), "\t").alias("value"))
    rows.repartitionByRange(F.desc("_n"), family).sortWithinPartitions(F.desc("_n"), family).select("value").write.text(path)


def partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """A folder for each value of `by`; a value of many rows is written by several tasks, each of a bounded size."""
    df.hint("rebalance", *by).write.partitionBy(*by).parquet(path)
