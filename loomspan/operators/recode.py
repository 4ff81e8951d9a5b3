"""Filters, pattern joins, label recoding and the rule-based taxonomy."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions.taxonomy import MITE_RULES, RULES, condition
from loomspan.operators.patterns import meeting, required
from loomspan.session import small


def like(column: str, pattern: str) -> Column:
    """Case-insensitive regular-expression match."""
    return F.col(column).rlike(f"(?i){pattern}")


def has_text(column: str, part: str) -> Column:
    """Case-insensitive substring match."""
    return F.lower(column).contains(part.lower())


def pattern_matches(df: DataFrame, patterns: DataFrame, *, id: str, pattern: str) -> DataFrame:
    """(id, columns of patterns) for each distinct id and each pattern it matches, ignoring case.

    Matching runs on distinct ids only, so join the result back by id. Many patterns are found by an index of short texts.
    """
    ids = df.where(F.col(id).isNotNull()).select(id).distinct()
    return meeting(ids, patterns, id=id, literal=required(F.col(pattern)), test=F.expr(f"rlike({id}, concat('(?i)', {pattern}))"))


def pattern_join(df: DataFrame, patterns: DataFrame, *, id: str, pattern: str) -> DataFrame:
    """df many-to-many with the patterns that its id matches."""
    return df.join(pattern_matches(df, patterns, id=id, pattern=pattern), id)


def labelled(df: DataFrame, patterns: DataFrame, *, id: str, pattern: str, label: str, order: str, name: str = "subset") -> DataFrame:
    """df with the label of the last matching pattern (by order); null where none matches."""
    found = pattern_matches(df, patterns, id=id, pattern=pattern)
    last = found.groupBy(id).agg(F.max_by(label, order).alias(name))
    return df.join(last, id, "left")


def subset_check(df: DataFrame, patterns: DataFrame, *, id: str, pattern: str, label: str) -> DataFrame:
    """(label, rows, percent_rows, ids, percent_ids): what each subset's patterns match of the whole table."""
    counts = df.where(F.col(id).isNotNull()).groupBy(id).agg(F.count("*").alias("_n"))
    whole = counts.agg(F.sum("_n").alias("_rows"), F.count("*").alias("_ids"))
    hits = meeting(counts, patterns, id=id, literal=required(F.col(pattern)), test=F.expr(f"rlike({id}, concat('(?i)', {pattern}))")).select(label, id, "_n").distinct()
    per = hits.groupBy(label).agg(F.sum("_n").alias("rows"), F.count("*").alias("ids"))
    per = per.crossJoin(F.broadcast(whole))  # one row
    return per.select(label, "rows", F.bround(100 * F.col("rows") / F.col("_rows"), 2).alias("percent_rows"), "ids", F.bround(100 * F.col("ids") / F.col("_ids"), 2).alias("percent_ids"))


def _removals(rules: dict[str, Column]) -> tuple[list[str], list[Column]]:
    """Names of the rules (keep conditions) and of all together, and aggregates of all rows and of those that each removes."""
    every = reduce(lambda a, b: a & b, rules.values())
    named = {**rules, "combined": every}
    return list(named), [F.count("*").alias("_n"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"_{i}") for i, c in enumerate(named.values())]]


def _audit_table(one: DataFrame, names: list[str]) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"_{i}").alias("removed")) for i, k in enumerate(names)]))
    return one.select("_n", rows.alias("r")).select("r.rule", "r.removed", F.bround(100 * F.col("r.removed") / F.col("_n"), 2).alias("percent"))


def filter_audit(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, removed, percent): rows that each rule (a keep condition) and all of them together remove."""
    names, counts = _removals(rules)
    return _audit_table(df.agg(*counts), names)


def filtered(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """The rows that all rules keep, and filter_audit's table, counted in the pass that first writes or counts these rows.

    Ask for the table after that pass; it waits for it.
    """
    seen = Observation()
    names, counts = _removals(rules)
    kept_rows = df.observe(seen, *counts).where(reduce(lambda a, b: a & b, rules.values()))
    columns = ["_n", *[f"_{i}" for i in range(len(names))]]

    def told() -> DataFrame:
        schema = ", ".join(f"{c} long" for c in columns)
        return _audit_table(df.sparkSession.createDataFrame([tuple(seen.get[c] for c in columns)], schema), names)

    return kept_rows, told


#: Alignment filter presets: (mapping quality at least, alignment length above). Fixed values.
PRESETS = {"low": (0, 600), "high": (45, 3500), "strict": (60, 5000)}


def preset(name: str, quality: str, length: str) -> Column:
    least, above = PRESETS[name]
    return (F.col(quality) >= least) & (F.col(length) > above)


def without_flags(df: DataFrame, flag: str, mask: int = 2304) -> DataFrame:
    """Rows with none of the mask's flag bits set (2304: neither secondary nor supplementary)."""
    return df.where(F.col(flag).bitwiseAND(F.lit(mask)) == 0)


def pair_type(query_minor: Column, target_minor: Column) -> Column:
    """Type of a pair of sequences by which of them are minor scaffolds."""
    side = lambda minor, a, b: F.when(minor, F.lit(b)).otherwise(F.lit(a))
    return F.concat(side(query_minor, "Qchr", "Qscf"), F.lit("_"), side(target_minor, "Tchr", "Tscf"))


def matches_any_pair(df: DataFrame, pairs: DataFrame, *, a: str, b: str) -> DataFrame:
    """Rows of df of which some (pattern_a, pattern_b) of a hand-written list matches both columns."""
    keys = df.select(a, b).distinct()
    keys = meeting(keys, pairs.select("pattern_a", "pattern_b"), id=a, literal=required(F.col("pattern_a")), test=F.expr(f"rlike({a}, pattern_a) and rlike({b}, pattern_b)")).select(a, b).distinct()
    return df.join(keys, [a, b], "left_semi")


def renamed_ids(df: DataFrame, names: DataFrame, *, column: str, old: str = "old", new: str = "new") -> DataFrame:
    """df with ids replaced by an exact table of names (unique old names); others stay."""
    table = names.select(F.col(old).alias("_old"), F.col(new).alias("_new"))
    return df.join(table, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def renamed_by_patterns(column: str, rules: list[tuple[str, str]], anchored: bool = True) -> Column:
    """column with regular expressions replaced in order; anchored: a rule must match the whole id."""
    return reduce(lambda c, r: F.regexp_replace(c, f"^(?:{r[0]})$" if anchored else r[0], r[1]), rules, F.col(column))


def collapsed(column: str, pattern: str, label: str) -> Column:
    """column with every id that matches (ignoring case) replaced by one label."""
    return F.when(like(column, pattern), F.lit(label)).otherwise(F.col(column))


def coloured(df: DataFrame, keys: DataFrame, *, columns: list[str], key: str, colour: str, order: str, default: str = "black") -> DataFrame:
    """df with the colour of the last key (by order) that is part of any of the columns."""
    ids = df.select(*columns).distinct()
    hit = reduce(lambda a, b: a | b, [F.col(c).contains(F.col(key)) for c in columns])
    found = ids.join(small(keys), hit).groupBy(*columns).agg(F.max_by(colour, order).alias("colour"))
    return df.join(found, columns, "left").withColumn("colour", F.coalesce("colour", F.lit(default)))


def classified(df: DataFrame, *, label: str, v7: bool = False) -> DataFrame:
    """df with class, subclass, order, superfam (string "NA": no such level; null: no rule matched) and mite.

    Rules run in order and the last match wins. They are applied to distinct labels, which are joined back.
    v7: the older naming of one order (DDE for TIR).
    """
    names = ["class", "subclass", "order", "superfam"]
    labels = df.where(F.col(label).isNotNull()).select(label).distinct()
    pick = None
    for rule, levels in RULES:
        c = condition(label, rule)
        told = [F.lit("DDE" if v7 and x == "TIR" and i == 2 else x) for i, x in enumerate(levels)]
        value = F.struct(*[v.alias(n) for v, n in zip(told, names)])
        pick = [(c, value)] if pick is None else [(c, value), *pick]
    chain = None
    for c, value in pick:
        chain = F.when(c, value) if chain is None else chain.when(c, value)
    mite = None
    for rule, flag in reversed(MITE_RULES):
        mite = F.when(condition(label, rule), F.lit(flag)) if mite is None else mite.when(condition(label, rule), F.lit(flag))
    told = labels.withColumn("_t", chain).select(label, *[F.col(f"_t.{n}").alias(n) for n in names], mite.alias("mite"))
    return df.drop(*names, "mite").join(told, label, "left")


def classification_audit(df: DataFrame, *, label: str) -> DataFrame:
    """Distinct labels with the levels they were given, and how many rows have them."""
    return df.groupBy(label, "class", "subclass", "order", "superfam", "mite").agg(F.count("*").alias("rows"))


def natural_key(column: str) -> Column:
    """Sort key under which numbers in a string count by value (Scaffold_2 before Scaffold_11)."""
    parts = F.regexp_extract_all(F.lower(column), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(x, 20, "0")).otherwise(x)), "")


def category_order(column: str, ranks: dict[str, int]) -> Column:
    """Rank of a category in a custom order; unknown ones last."""
    table = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    return F.coalesce(F.element_at(table, F.col(column)), F.lit(max(ranks.values(), default=0) + 1))


def prefixed(column: str, prefix: str, separator: str = ".") -> Column:
    return F.concat_ws(separator, F.lit(prefix), F.col(column))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def pattern_table(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """(label, pattern, ord) of a hand-written list."""
    return spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(rows)], "label string, pattern string, ord int")


def pair_split(df: DataFrame, *, query_minor: Column, target_minor: Column) -> DataFrame:
    """df with pair: major/major, minor/minor, or minor/major whichever side the minor scaffold is on."""
    both = F.when(query_minor & target_minor, "minor/minor").when(query_minor | target_minor, "minor/major").otherwise("major/major")
    return df.withColumn("pair", both)


def major_regions(df: DataFrame, *, sides: dict[str, tuple[str, str, str, Column]], id: str) -> DataFrame:
    """(id, seq, begin, end, hit_by): regions of major sequences that minor ones are aligned to, as in a BED file.

    sides: of query and target their sequence, begin, end, and whether the sequence is minor.
    """
    (a, b), out = list(sides), None
    for here, there in ((a, b), (b, a)):
        s, lo, hi, minor = sides[here]
        other, _, _, other_minor = sides[there]
        part = df.where(~minor & other_minor).select(id, F.col(s).alias("seq"), F.col(lo).alias("begin"), F.col(hi).alias("end"), F.col(other).alias("hit_by"))
        out = part if out is None else out.unionByName(part)
    return out
