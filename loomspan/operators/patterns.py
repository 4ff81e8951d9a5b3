"""Many patterns against many ids: an index of short texts instead of a loop over all pairs.

A match of a pattern must contain the pattern's longest literal stretch. Of that stretch's grams (three letters) the one that
fewest ids have is the key of an equi-join with the ids' grams, and only what meets there is matched. Patterns without such
a stretch (alternatives, short ones) go through a loop, as all do when they are few.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.session import kept, small

#: Letters of a gram, and patterns up to which a loop over all pairs is as good.
GRAM, FEW = 3, 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """ASCII letters in lower case, letter by letter, as patterns that ignore case take them."""
    return F.translate(text, _UPPER, _LOWER)


def required(pattern: Column) -> Column:
    """The longest text (folded) that whatever matches a regular expression must contain; empty if none can be told.

    Groups, alternatives, and escapes other than classes of characters and escaped signs tell nothing.
    """
    gap = "\u0001"
    text = pattern
    for part in (r"\\.", r"\[\^?\]?[^\]]*\]", r".\{[^}]*\}", r".[*?]", r"[*?+{}^$.\]]"):
        text = F.regexp_replace(text, part, gap)
    longest = F.aggregate(F.split(text, gap), F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    unclear = pattern.rlike(r"[|()]|\\[xucpPkN0-9QE]|\[[^\]]*(\[|&&)")
    return F.when(pattern.isNull() | unclear, "").otherwise(folded(longest))


def _grams(text: Column) -> Column:
    n = F.length(text)
    every = F.when(n >= GRAM, F.sequence(F.lit(1), n - GRAM + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(every, lambda i: F.substring(text, i, F.lit(GRAM))))


def meeting(ids: DataFrame, patterns: DataFrame, *, id: str, literal: Column, test: Column, fold: Callable[[Column], Column] = folded) -> DataFrame:
    """All rows of ids and patterns together for which the test holds.

    literal: of patterns' columns, a text that the id must contain, folded, if the test holds; it may be empty. test: a
    condition on both sides' columns, which must have different names. ids are distinct.
    """
    if patterns.limit(FEW + 1).count() <= FEW:
        return ids.join(F.broadcast(patterns), test)
    columns = [*ids.columns, *patterns.columns]
    rows = kept(patterns.withColumn("_literal", F.coalesce(literal, F.lit(""))).withColumn("_p", F.monotonically_increasing_id()))
    grams = kept(ids.select("*", F.explode(_grams(fold(F.col(id)))).alias("_gram")))
    often = grams.groupBy("_gram").agg(F.count("*").alias("_often"))
    own = rows.where(F.length("_literal") >= GRAM).select("_p", F.explode(_grams(F.col("_literal"))).alias("_gram")).join(often, "_gram", "left")
    # a gram that no id has rules the pattern out
    keys = own.groupBy("_p").agg(F.min_by("_gram", "_often").alias("_gram"), F.count_if(F.col("_often").isNull()).alias("_none")).where("_none = 0")
    met = grams.join(rows.join(keys.drop("_none"), "_p"), "_gram").where(test).select(*columns)
    return met.unionByName(ids.join(small(rows.where(F.length("_literal") < GRAM)), test).select(*columns))
