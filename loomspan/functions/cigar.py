"""Alignment strings: M, I, D lengths, histograms and identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lengths(cigar: str, op: str) -> Column:
    """Array of the lengths of one operation; null for a null string."""
    return F.transform(F.regexp_extract_all(cigar, F.lit(f"(\\d+){op}"), F.lit(1)), lambda x: x.cast("int"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)


def parsed(df: DataFrame, cigar: str, ops: str = "MID") -> DataFrame:
    """df with cig_<op> (total bases) for each operation, cig_compressed (number of gaps), dels_list and incs_list."""
    names = {"M": "cig_matches", "I": "cig_insertions", "D": "cig_deletions"}
    df = df.withColumns({"dels_list": lengths(cigar, "D"), "incs_list": lengths(cigar, "I")})
    df = df.withColumns({names.get(o, f"cig_{'equal' if o == '=' else o}"): total(lengths(cigar, o)) for o in ops})
    return df.withColumn("cig_compressed", F.size("dels_list") + F.size("incs_list"))


def identities(df: DataFrame, *, matches: str, ali_len: str, edits: str) -> DataFrame:
    """df (parsed) with blast_identity, gap_compr_identity and mismatches."""
    return df.withColumns(
        {
            "blast_identity": F.col(matches) / F.col(ali_len),
            "gap_compr_identity": F.col(matches) / (F.col("cig_matches") + F.col("cig_compressed")),
            "mismatches": F.col(edits) - (F.col("cig_insertions") + F.col("cig_deletions")),
        }
    )


def indels(df: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, kind, size): one row per deletion and insertion of a parsed table."""
    one = lambda kind, column: F.transform(column, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("size")))
    return df.select(*keep, F.explode(F.concat(one("Del", "dels_list"), one("Ins", "incs_list"))).alias("e")).select(*keep, "e.kind", "e.size")


def swapped(kind: str, side: str, target: str = "T") -> Column:
    """Kind of an indel as seen from a side: deletions and insertions change places on the target."""
    other = F.when(F.col(kind) == "Del", "Ins").otherwise("Del")
    return F.when(F.col(side) == target, other).otherwise(F.col(kind))


def operations(df: DataFrame, keep: list[str], cigar: str, start: str | None = None) -> DataFrame:
    """(keep, place, op, len[, at]): every operation in order; at: where on the target it starts (insertions take no room)."""
    parts = F.regexp_extract_all(cigar, F.lit("(\\d+[MIDNSHP=X])"), F.lit(1))
    own = df.withColumn("_row", F.monotonically_increasing_id()) if start else df
    rows = own.select(*keep, *(["_row", F.col(start).alias("_start")] if start else []), F.posexplode(parts).alias("place", "_p"))
    rows = rows.withColumns({"op": F.regexp_extract("_p", "\\d+(.)", 1), "len": F.regexp_extract("_p", "(\\d+)", 1).cast("int")})
    if start:
        room = F.when(F.col("op").isin("I", "S", "H", "P"), 0).otherwise(F.col("len"))
        w = Window.partitionBy("_row").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("at", F.col("_start") + F.coalesce(F.sum(room).over(w), F.lit(0)))
    return rows.select(*keep, "place", "op", "len", *(["at"] if start else []))


def length_histogram(df: DataFrame, cigar: str) -> DataFrame:
    """(op, len, count) over a table."""
    return operations(df, [], cigar).groupBy("op", "len").agg(F.count("*").alias("count"))


def per_base(df: DataFrame, *, matches: str, ali_len: str, edits: str, dels: str, ins: str) -> DataFrame:
    """df with matches_per_base and edits_per_base of the alignment, and perc_indel, the sum of two percentages."""
    return df.withColumns({"matches_per_base": F.col(matches) / F.col(ali_len), "edits_per_base": F.col(edits) / F.col(ali_len), "perc_indel": F.col(dels) + F.col(ins)})
