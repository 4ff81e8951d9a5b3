"""Gene families, orthogroups, links and colinear segments."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.intervals import distance, ends_inside
from loomspan.operators.scans import Running, dealt
from loomspan.session import kept, small


def presence(df: DataFrame, *, family: str, seq: str) -> DataFrame:
    """(family, seq, members)."""
    return df.groupBy(family, seq).agg(F.count("*").alias("members"))


#: Sequences of a family that meet in one row.
MEETING = 256
#: Pairs of sequences that a task adds up.
PAIRS = 4_000_000
#: Families of a sequence beyond which several ranges share it, and several tasks add up its pairs.
OFTEN = 100_000


def _members(df: DataFrame, family: str, seq: str, counts: dict[str, Column], more: dict[str, Column] | None = None) -> DataFrame:
    """(_f, seq, *counts, *more), written: what a family's members on a sequence add up to; without null families and sequences."""
    known = df.where(F.col(family).isNotNull() & F.col(seq).isNotNull()).groupBy(F.col(family).alias("_f"), F.col(seq).alias("seq"))
    return kept(known.agg(*[c.cast("long").alias(n) for n, c in counts.items()], *[c.alias(n) for n, c in (more or {}).items()]))


def _ranges(p: DataFrame, tasks: int) -> tuple[DataFrame, bool]:
    """p with _r, the range of sequences in order that a row is in (as many ranges as tasks, of about as many rows), and whether a
    sequence may be in several ranges. Ranges ascend with the sequence."""
    per = p.groupBy("seq").agg(F.count("*").alias("_c")).withColumn("_all", F.lit(0))
    places = dealt(per, key=["_all"], order=["seq"]).running(_before=Running("sum", F.col("_c"))).rows
    places = kept(places.select("seq", "_c", F.coalesce("_before", F.lit(0)).alias("_before")))
    often = F.col("_c") > OFTEN
    several = not places.where(often).isEmpty()
    total = places.agg(F.coalesce(F.sum("_c"), F.lit(0))).first()[0]
    width = min(max(1, -(-total // tasks)), OFTEN) if several else max(1, -(-total // tasks))
    place = F.col("_before") + F.when(often, F.pmod(F.xxhash64("_f"), F.col("_c"))).otherwise(0)
    return p.join(places, "seq").withColumn("_r", F.floor(place / width).cast("int")).drop("_c", "_before"), several


def _pairs_of_sequences(df: DataFrame, family: str, seq: str, counts: dict[str, Column] | None = None, members: DataFrame | None = None) -> DataFrame:
    """(seq_a, seq_b, a, b[, _r]), seq_a <= seq_b: the sequences of each family, two by two, and the counts of members on them (structs).

    A family's sequences are gathered in one row, in order. It is sent once to each range of sequences that it has some in, with
    those behind them: far fewer rows than pairs, and pairs are made where they are added up. A family on many sequences is cut
    into blocks of them, and every two blocks meet in a row of their own. All pairs of a sequence seq_a are in its range _r; there is
    no _r if a sequence is in so many families that several ranges share it. members: _members of df, if known.
    """
    counts = counts or {"n": F.count("*")}
    p = _members(df, family, seq, counts) if members is None else members.select("_f", "seq", *counts)
    sizes = kept(p.groupBy("_f").agg(F.count("*").alias("_n")))
    pairs = sizes.agg(F.coalesce(F.sum(F.col("_n").cast("double") * (F.col("_n") + 1) / 2), F.lit(0.0))).first()[0]
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, int(pairs // PAIRS) + 1)
    large = sizes.where(F.col("_n") > MEETING).select("_f", F.ceil(F.col("_n") / MEETING).cast("int").alias("_blocks"))
    p, several = _ranges(p, tasks)
    if large.isEmpty():
        columns = ["seq", *counts, "_r"]
        cells = p.select("_f", F.struct(*columns).alias("m")).repartition(tasks, "_f").groupBy("_f").agg(F.sort_array(F.collect_list("m")).alias("all"))
        one = F.lit(True)
    else:
        columns = ["seq", *counts, "_r", "_block"]
        p = p.join(large, "_f", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
        p = p.withColumn("_block", F.pmod(F.xxhash64("seq"), F.col("_blocks")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_o")
        cells = p.select("_f", F.struct(*columns).alias("m"), F.col("_block"), other)
        cells = cells.select("_f", F.least("_block", "_o").alias("_x"), F.greatest("_block", "_o").alias("_y"), "m").repartition(tasks, "_f", "_x", "_y")
        cells = cells.groupBy("_f", "_x", "_y").agg(F.sort_array(F.collect_list("m")).alias("all"))
        one = F.col("_x") == F.col("_y")
    each = cells.select("all", one.alias("_one"), F.explode(F.array_distinct("all._r")).alias("_r"))
    first = F.array_position("all._r", F.col("_r")).cast("int")
    here = F.size(F.filter("all", lambda m: m["_r"] == F.col("_r")))
    each = each.select("_r", "_one", here.alias("_here"), F.slice("all", first, F.size("all")).alias("all"))
    sent = [c for c in columns if c != "_r"]
    rows = each.select("_r", "_one", "_here", *[F.col(f"all.{c}").alias(f"_m_{c}") for c in sent]).repartition(tasks, "_r")
    rows = rows.select("_r", "_one", F.arrays_zip(*[f"_m_{c}" for c in sent]).alias("all"), F.explode(F.sequence(F.lit(1), F.col("_here"))).alias("i"))
    behind, a = F.slice("all", F.col("i"), F.size("all")), F.element_at("all", F.col("i"))
    rows = rows.select("_r", "_one", a.alias("a"), behind.alias("b"))
    if "_block" in sent:
        rows = rows.withColumn("b", F.when(F.col("_one"), F.col("b")).otherwise(F.filter("b", lambda b: b["_m__block"] != F.col("a._m__block"))))
    both = rows.select("_r", "a", F.explode("b").alias("b"))
    side = lambda s: F.struct(*[F.col(f"{s}._m_{n}").alias(n) for n in counts]).alias(s)
    return both.select(F.col("a._m_seq").alias("seq_a"), F.col("b._m_seq").alias("seq_b"), side("a"), side("b"), *([] if several else ["_r"]))


def _summed_pairs(df: DataFrame, family: str, seq: str, counts: dict[str, Column], sums: dict[str, Column], members: DataFrame | None = None) -> DataFrame:
    """(seq_a, seq_b, *sums), seq_a <= seq_b: sums over the families that are on both sequences.

    counts: of a family's members on a sequence; sums: what a family adds, from a.<count>, b.<count>, seq_a and seq_b.
    """
    both = _pairs_of_sequences(df, family, seq, counts, members)
    keys = [c for c in both.columns if c not in ("a", "b")]  # _r goes with seq_a: grouped by it, too, the rows stay where they are
    return both.groupBy(*keys).agg(*[F.sum(c).cast("long").alias(n) for n, c in sums.items()]).drop("_r")


def _pairs(count: str) -> Column:
    """How many pairs the members on seq_a and seq_b make."""
    return F.when(F.col("seq_a") == F.col("seq_b"), F.expr(f"a.{count} * (a.{count} - 1) div 2")).otherwise(F.col(f"a.{count}") * F.col(f"b.{count}"))


def linkage(df: DataFrame, *, family: str, seq: str) -> DataFrame:
    """(seq_a, seq_b, links), seq_a <= seq_b: over families, n(n-1)/2 within a sequence and ceil(n1 n2 / 2) between two."""
    n = F.when(F.col("seq_a") == F.col("seq_b"), _pairs("n")).otherwise(F.ceil(_pairs("n") / 2))
    return _summed_pairs(df, family, seq, {"n": F.count("*")}, {"links": n}).where("links > 0")


def family_pairs(df: DataFrame, *, family: str, id: str) -> DataFrame:
    """All unordered pairs within a family: df's columns, and the other member's with the suffix _r."""
    other = df.toDF(*[f"{c}_r" for c in df.columns])
    return df.join(other, (F.col(family) == F.col(f"{family}_r")) & (F.col(id) < F.col(f"{id}_r")))


#: Bounds of the distance classes.
NEAR = (10**4, 10**5, 10**6)


def _reach(placed: Column, begin: str, end: str) -> dict[str, Column]:
    """For _members: the last begin and first end of a family on a sequence, where two members are placed; they tell their distance."""
    two = F.count_if(placed) == 2
    late, early = (F.when(placed, F.col(c).cast("long")) for c in (begin, end))
    return {"_late": F.when(two, F.max(late)), "_early": F.when(two, F.min(early))}


def _far_apart(rows: DataFrame, members: DataFrame, placed: str, *, family: str, seq: str, begin: str, end: str) -> DataFrame:
    """(_s, _n<bound>..., total): how many pairs of members on a sequence are at least so far apart, and their summed distance.

    members: _members with _reach; placed: the count of those that are rows here. Two members' distance is told by their reach.
    Of three and more, the distance is how far the later begin lies behind the earlier end, so a scan over begins and ends in
    order, each end shifted by each bound, counts at every begin the ends that lie further back. Members alone with their
    family on a sequence take no part.
    """
    apart = F.greatest(F.col("_late") - F.col("_early"), F.lit(0))
    two = members.where(F.col(placed) == 2).select(F.col("seq").alias("_s"), apart.alias("_d"))
    far = two.groupBy("_s").agg(*[F.count_if(F.col("_d") >= t).alias(f"_n{t}") for t in NEAR], F.sum("_d").alias("total"))
    several = members.where(F.col(placed) > 2).select("_f", F.col("seq").alias("_s"))
    if several.isEmpty():
        return far
    rows = rows.join(small(several), (F.col(family) == F.col("_f")) & (F.col(seq) == F.col("_s")), "left_semi")
    kinds = [("_begin", F.col(begin)), *[(f"_t{t}", F.col(end) + t) for t in (0, *NEAR)]]
    event = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), at.cast("long").alias("at"), F.col(end).cast("long").alias("end")) for k, at in kinds]))
    events = rows.select(family, seq, event.alias("e")).select(family, seq, (F.col("e.kind") == "_begin").alias("_start"), F.col("e.at").alias("_at"), "e.kind", "e.end")
    counted = {f"_n{t}": Running("sum", F.when(F.col("kind") == f"_t{t}", 1)) for t in (0, *NEAR)}
    counted["_ends"] = Running("sum", F.when(F.col("kind") == "_t0", F.col("end")))
    # ends at a place come before begins there
    seen = dealt(events, key=[family, seq], order=["_at", "_start"]).running(**counted).rows.where("_start").na.fill(0, [*counted])
    seen = seen.select(F.col(seq).alias("_s"), *[f"_n{t}" for t in NEAR], (F.col("_at") * F.col("_n0") - F.col("_ends")).alias("total"))
    return far.unionByName(seen).groupBy("_s").agg(*[F.sum(c).alias(c) for c in far.columns[1:]])


def pair_distances(df: DataFrame, *, family: str, id: str, seq: str, begin: str, end: str) -> DataFrame:
    """(seq, seq_r, pairs, near_4, near_5, near_6, far, total, mean): family pairs by distance below 10^4, 10^5, 10^6.

    Pairs on different sequences have no distance; the two sequences are put in order. Members without family, id, sequence
    or coordinates take no part, and members of equal id are no pair. Pairs are counted, not made, so a family may have any
    size: it is dealt to many tasks.
    """
    rows = df.dropna(subset=[family, id, seq, begin, end])
    out = _distances(rows, *_placed_pairs(rows, family, seq, begin, end), "n", family=family, id=id, seq=seq, begin=begin, end=end)
    return out.where("pairs > 0")


def _placed_pairs(rows: DataFrame, family: str, seq: str, begin: str, end: str) -> tuple[DataFrame, DataFrame]:
    """The pairs (seq_a, seq_b, pairs) of rows that are all placed, written, and the rows' _members."""
    counts = {"n": F.count("*")}
    members = _members(rows, family, seq, counts, _reach(F.lit(True), begin, end))
    return kept(_summed_pairs(rows, family, seq, counts, {"pairs": _pairs("n")}, members)), members


def _distances(df: DataFrame, pairs: DataFrame, members: DataFrame, placed: str, *, family: str, id: str, seq: str, begin: str, end: str, more: tuple[str, ...] = ()) -> DataFrame:
    """pair_distances of rows without nulls, whose pairs (seq_a, seq_b, pairs, *more) are counted; also where there are 0 pairs."""
    rows = df.select(family, id, seq, begin, end)
    places = {"seq": seq, "begin": begin, "end": end}

    def measured(pairs: DataFrame, far: DataFrame) -> DataFrame:
        """Only a sequence with itself has distances, so no other row is joined."""
        own = F.col("seq_a") == F.col("seq_b")
        return pairs.where(own).join(far, F.col("seq_a") == F.col("_s"), "left").drop("_s").unionByName(pairs.where(~own), allowMissingColumns=True)

    counts = measured(pairs, _far_apart(rows, members, placed, family=family, **places))
    again = kept(rows.groupBy(family, id).agg(F.count("*").alias("_c")).where("_c > 1").drop("_c"))
    if not again.isEmpty():  # what members of equal id would count is taken off
        same = kept(rows.join(small(again), [family, id]).withColumn("_same", F.struct(family, id)))
        names = [c for c in counts.columns if c not in ("seq_a", "seq_b", *more)]
        fewer, among = _placed_pairs(same, "_same", **places)
        less = measured(fewer, _far_apart(same, among, "n", family="_same", **places))
        less = kept(less.select("seq_a", "seq_b", *[F.col(c).alias(f"_{c}_less") for c in names]))
        counts = counts.join(small(less), ["seq_a", "seq_b"], "left")
        counts = counts.withColumns({c: F.col(c) - F.coalesce(f"_{c}_less", F.lit(0)) for c in names})
    within = [F.col("pairs"), *[F.col(f"_n{t}") for t in NEAR]]
    near = [F.coalesce(a - b, F.lit(0)).alias(f"near_{len(str(t)) - 1}") for a, b, t in zip(within, within[1:], NEAR)]
    own = F.col("seq_a") == F.col("seq_b")
    return counts.select(
        F.col("seq_a").alias(seq), F.col("seq_b").alias(f"{seq}_r"), "pairs", *near, F.coalesce(within[-1], F.lit(0)).alias("far"),
        F.when(own, F.col("total")).alias("total"), F.when(own, F.col("total") / F.nullif("pairs", F.lit(0))).alias("mean"), *more,
    )


def family_statistics(df: DataFrame, *, family: str) -> DataFrame:
    """One row: families (two or more members), paralogs, orphans, largest family, members."""
    n = df.groupBy(family).agg(F.count("*").alias("_n"))
    return n.agg(
        F.count_if(F.col("_n") > 1).alias("families"),
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("paralogs"),
        F.count_if(F.col("_n") == 1).alias("orphans"),
        F.max("_n").alias("largest"),
        F.sum("_n").alias("members"),
    )


def member_lists(df: DataFrame, *, family: str, id: str) -> DataFrame:
    """(family, size, members): sorted ids, tab-joined."""
    return df.groupBy(family).agg(F.count("*").alias("size"), F.array_join(F.sort_array(F.collect_list(id)), "\t").alias("members"))


def copy_numbers(df: DataFrame, *, group: str, species: str, names: list[str]) -> DataFrame:
    """(group, one count per species); 0 if none."""
    return df.groupBy(group).pivot(species, names).agg(F.count(F.lit(1))).na.fill(0, names)


def one_to_one(df: DataFrame, *, group: str, species: str, id: str, a: str, b: str) -> DataFrame:
    """(group, a's id, b's id) of groups with one member of each of two species, whatever the others have."""
    n = lambda s: F.count_if(F.col(species) == s)
    pick = lambda s: F.max(F.when(F.col(species) == s, F.col(id)))
    out = df.where(F.col(species).isin(a, b)).groupBy(group).agg(n(a).alias("_a"), n(b).alias("_b"), pick(a).alias("id_a"), pick(b).alias("id_b"))
    return out.where("_a = 1 and _b = 1").select(group, "id_a", "id_b")


def occupancy(copies: DataFrame, *, a: str, b: str, cap: int) -> DataFrame:
    """(n_a, n_b, groups): groups by copy numbers, from cap on together."""
    return copies.groupBy(F.least(F.col(a), F.lit(cap)).alias("n_a"), F.least(F.col(b), F.lit(cap)).alias("n_b")).agg(F.count("*").alias("groups"))


def placement_class(df: DataFrame, *, group: str, species: str, names: list[str], category: str, major: str = "Chr", minor: str = "Scaffold") -> DataFrame:
    """(group, placement): major, minor or mix by where its members of the species lie; without such members, major."""
    mine = F.col(species).isin(names)
    out = df.groupBy(group).agg(
        F.every(F.when(mine, F.col(category) == major)).alias("_maj"),
        F.every(F.when(mine, F.col(category) == minor)).alias("_min"),
    )
    kind = F.when(F.coalesce("_maj", F.lit(True)), "major").when(F.col("_min"), "minor").otherwise("mix")
    return out.select(group, kind.alias("placement"))


def with_copy_number(df: DataFrame, *, group: str, species: str) -> DataFrame:
    return df.withColumn("copies", F.count("*").over(Window.partitionBy(group, species)))


def quality_tier(df: DataFrame, *, group: str, evidence: list[Column]) -> DataFrame:
    """(group, tier): 1 + the number of kinds of evidence (in order of weight) that no member has, up to the first found."""
    flags = df.groupBy(group).agg(*[F.bool_or(c).alias(f"_{i}") for i, c in enumerate(evidence)])
    have = F.aggregate(F.array(*[F.coalesce(F.col(f"_{i}"), F.lit(False)).cast("int") for i in range(len(evidence))]), F.lit(0), lambda s, x: s + x)
    return flags.select(group, (len(evidence) + 1 - have).alias("tier"))


def links(df: DataFrame, *, group: str, species: str, id: str, a: str, b: str, most: int = 3) -> DataFrame:
    """(group, id_a, id_b, relation): every member of a with every one of b, in groups that have both and at most `most` members."""
    rows = df.where(F.col(species).isin(a, b)).select(group, species, id)
    n = rows.groupBy(group).agg(F.count_if(F.col(species) == a).alias("_a"), F.count_if(F.col(species) == b).alias("_b"))
    n = n.where((F.col("_a") > 0) & (F.col("_b") > 0) & (F.col("_a") + F.col("_b") <= most))
    left = rows.where(F.col(species) == a).select(group, F.col(id).alias("id_a"))
    right = rows.where(F.col(species) == b).select(group, F.col(id).alias("id_b"))
    return left.join(n, group).join(right, group).select(group, "id_a", "id_b", F.concat_ws(":", "_a", "_b").alias("relation"))


def points(df: DataFrame, *, group: str, species: str, a: str, b: str, above: int = 3) -> DataFrame:
    """(group, n_a, n_b, more): groups with both species and more than `above` members, and which species has more copies."""
    n = df.groupBy(group).agg(F.count_if(F.col(species) == a).alias("n_a"), F.count_if(F.col(species) == b).alias("n_b"))
    n = n.where((F.col("n_a") > 0) & (F.col("n_b") > 0) & (F.col("n_a") + F.col("n_b") > above))
    return n.withColumn("more", F.when(F.col("n_a") == F.col("n_b"), "equal").when(F.col("n_a") > F.col("n_b"), F.lit(a)).otherwise(F.lit(b)))


def link_summary(df: DataFrame, *, group: str, species: str, a: str, b: str, most: int = 3) -> DataFrame:
    """(kind, groups, percent): groups with both species, lacking one, linked, and drawn as points."""
    n = df.groupBy(group).agg(F.count_if(F.col(species) == a).alias("_a"), F.count_if(F.col(species) == b).alias("_b"))
    both = (F.col("_a") > 0) & (F.col("_b") > 0)
    small = F.col("_a") + F.col("_b") <= most
    kinds = {"included": both, "removed": ~both, "links": both & small, "points": both & ~small}
    one = n.agg(F.count("*").alias("_n"), *[F.count_if(c).alias(k) for k, c in kinds.items()])
    rows = one.select("_n", F.expr(f"stack({len(kinds)}, {', '.join(f'{k!r}, {k}' for k in kinds)}) as (kind, groups)"))
    return rows.select("kind", "groups", F.bround(100 * F.col("groups") / F.col("_n"), 2).alias("percent"))


def paralog_type(seq_a: str, seq_b: str, apart: Column, near: int = 10**6) -> Column:
    """4: on different sequences; 1: nearer than `near`; 2: further."""
    return F.when(F.col(seq_a) != F.col(seq_b), 4).when(apart < near, 1).otherwise(2)


def segments_with_genes(segments: DataFrame, genes: DataFrame) -> DataFrame:
    """Segments (id, multiplicon, sequid, first, last, order) with begin, end, genes, mean gene length and mean distance.

    genes: (gene, sequid, begin, end). A segment runs from its first gene's begin to its last gene's end; unsorted ones go. It
    holds the genes of its sequence whose begin or end is inside.
    """
    first = genes.select(F.col("gene").alias("first"), F.col("begin").alias("seg_begin"))
    last = genes.select(F.col("gene").alias("last"), F.col("end").alias("seg_end"))
    placed = segments.join(first, "first").join(last, "last").where("seg_begin < seg_end")
    regions = placed.select("sequid", F.col("seg_begin").alias("begin"), F.col("seg_end").alias("end"), "id")
    inside = ends_inside(genes.select("sequid", "begin", "end"), regions, seq="sequid", begin="begin", end="end")
    inside = inside.select(F.col("id_r").alias("id"), "begin", "end")
    w = Window.partitionBy("id").orderBy("begin", "end")
    inside = inside.withColumns({"_len": F.col("end") - F.col("begin"), "_gap": F.lead("begin").over(w) - F.col("end")})
    per = inside.groupBy("id").agg(F.count("*").alias("genes"), F.floor(F.avg("_len")).alias("gene_length"), F.floor(F.avg("_gap")).alias("gene_distance"))
    return placed.join(per, "id", "left")


def paired_segments(segments: DataFrame, *, multiplicon: str = "multiplicon", order: str = "order") -> DataFrame:
    """The two segments of each multiplicon of size 2 side by side (suffixes _a and _b)."""
    two = segments.withColumn("_n", F.count("*").over(Window.partitionBy(multiplicon))).where("_n = 2").drop("_n")
    two = two.withColumn("_r", F.row_number().over(Window.partitionBy(multiplicon).orderBy(order)))
    side = lambda r, s: two.where(F.col("_r") == r).drop("_r").toDF(*[c if c == multiplicon else f"{c}_{s}" for c in segments.columns])
    return side(1, "a").join(side(2, "b"), multiplicon)


def multiplicon_sizes(segments: DataFrame, *, multiplicon: str = "multiplicon") -> DataFrame:
    return segments.groupBy(multiplicon).agg(F.count("*").alias("segments")).groupBy("segments").agg(F.count("*").alias("multiplicons"))


def ratio(a: str, b: str) -> Column:
    """The larger over the smaller; null if one is 0."""
    return F.when((F.col(a) != 0) & (F.col(b) != 0), F.greatest(F.col(a) / F.col(b), F.col(b) / F.col(a)))


def copy_classes(df: DataFrame, *, kind: str, species: str, names: list[str]) -> DataFrame:
    """df with own and other: the copy numbers of a row's species and of the other one, from a text like '2.1.0'."""
    parts = F.split(kind, "\\.")
    n = lambda i: F.try_element_at(parts, F.lit(i + 1)).try_cast("int")
    first = F.col(species) == names[0]
    return df.withColumns({"own": F.when(first, n(0)).otherwise(n(1)), "other": F.when(first, n(1)).otherwise(n(0))})


def quality_counts(df: DataFrame, *, group: str, tier: str) -> DataFrame:
    return df.groupBy(tier).agg(F.count_distinct(group).alias("groups"))


def presence_links(df: DataFrame, *, family: str, id: str, seq: str, begin: str, end: str) -> DataFrame:
    """(seq_a, seq_b, families, pairs, distance_sum, distance_mean): families present on both sequences, and pairs of their members.

    A sequence with itself counts its families of two or more members there; distances are of pairs on one sequence.
    """
    placed = reduce(and_, [F.col(c).isNotNull() for c in (family, id, seq, begin, end)])
    counts = {"n": F.count("*"), "placed": F.count_if(placed)}
    members = _members(df, family, seq, counts, _reach(placed, begin, end))
    on_both = F.when((F.col("seq_a") < F.col("seq_b")) | (F.col("a.n") > 1), 1).otherwise(0)
    both = _summed_pairs(df, family, seq, counts, {"families": on_both, "pairs": _pairs("placed")}, members)
    both = kept(both.where("families > 0"))
    d = _distances(df.where(placed), both, members, "placed", family=family, id=id, seq=seq, begin=begin, end=end, more=("families",))
    some = lambda c: F.when(F.col("pairs") > 0, F.col(c))
    return d.select(F.col(seq).alias("seq_a"), F.col(f"{seq}_r").alias("seq_b"), "families", some("pairs").alias("pairs"), some("total").alias("distance_sum"), some("mean").alias("distance_mean"))


def outsiders(df: DataFrame, *, family: str, seq: str) -> DataFrame:
    """(seq, members, outsiders): genes of each sequence, and those whose family has no other member there but has some elsewhere."""
    p = presence(df.where(F.col(family).isNotNull() & F.col(seq).isNotNull()), family=family, seq=seq)
    all_members = p.groupBy(family).agg(F.sum("members").alias("_all"))
    alone = (F.col("members") == 1) & (F.col("_all") > 1)
    return p.join(all_members, family).groupBy(seq).agg(F.sum("members").alias("members"), F.count_if(alone).alias("outsiders"))


def paralog_links(df: DataFrame, *, group: str, species: str, id: str, seq: str, begin: str, end: str, one: str, two: str, near: int = 10**6) -> DataFrame:
    """(group, id_one, id_a, id_b, type): groups of three with one gene of a species and two of another, and how the two lie (paralog_type)."""
    rows = df.where(F.col(species).isin(one, two))
    n = rows.groupBy(group).agg(F.count_if(F.col(species) == one).alias("_1"), F.count_if(F.col(species) == two).alias("_2"))
    rows = rows.join(n.where("_1 = 1 and _2 = 2").select(group), group)
    single = rows.where(F.col(species) == one).select(group, F.col(id).alias("id_one"))
    pairs = family_pairs(rows.where(F.col(species) == two).select(group, id, seq, begin, end), family=group, id=id)
    apart = distance(begin, end, f"{begin}_r", f"{end}_r")
    told = pairs.select(group, F.col(id).alias("id_a"), F.col(f"{id}_r").alias("id_b"), paralog_type(seq, f"{seq}_r", apart, near).alias("type"))
    return single.join(told, group).select(group, "id_one", "id_a", "id_b", "type")


def on_indexed(genes: DataFrame, index: DataFrame, *, seq: str) -> tuple[DataFrame, DataFrame]:
    """The genes on indexed sequences, and one row (kept, removed) of how many there were."""
    known = index.select(seq).distinct().withColumn("_known", F.lit(True))
    told = genes.join(known, seq, "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    return told.where("_known").drop("_known"), told.agg(F.count_if("_known").alias("kept"), F.count_if(~F.col("_known")).alias("removed"))
