"""Document fingerprints by SimHash (operator 1), with DataFrame functions only.

A text's terms are its overlapping pairs of words (of a one-word text, the word), lower-cased; a term's weight is how often
it occurs. Each occurrence's 64-bit hash votes +1 or -1 on every bit. Votes are counted in packed form: of the eight
shifts of a hash, each masked to one bit a byte, up to 127 can be added before the signed sum overflows. So a block of 127 terms
takes eight sums, and blocks are unpacked into 64 votes once each.

Near fingerprints are found in permuted block tables: 64 bits are cut into radius + 2 blocks; two fingerprints within the
radius agree on at least two whole blocks, so one table for each pair of blocks, keyed by their bits, misses none.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import or_empty, written

BITS, LANE = 64, 127
ONES = 0x0101010101010101
#: Documents, by id, of one window on average; a window of ids is the unit in which texts meet their successors.
IDS = 64
#: Ranges of ids with about as many documents each; within a range, windows are equally wide.
RANGES = 1024


def _voted(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and fingerprint (long) of each row; keys must tell rows apart. Zero votes, as of an empty text, give bit 0."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    w = rows.select(*keys, words.alias("_w"))
    at = w.select(*keys, "_w", F.explode_outer(F.when(F.size("_w") > 0, F.sequence(F.lit(0), F.greatest(F.size("_w") - 2, F.lit(0))))).alias("_i"))
    term = F.when(F.col("_i").isNotNull(), F.xxhash64(F.get("_w", F.col("_i")), F.coalesce(F.get("_w", F.col("_i") + 1), F.lit(""))))
    h = at.select(*keys, F.floor(F.col("_i") / LANE).alias("_block"), term.alias("_h"))
    lanes = [F.sum(F.shiftrightunsigned("_h", k).bitwiseAND(F.lit(ONES))).alias(f"_s{k}") for k in range(8)]
    packed = h.groupBy(*keys, "_block").agg(F.count("_h").alias("_n"), *lanes)
    votes = [F.sum(F.shiftrightunsigned(f"_s{k}", 8 * j).bitwiseAND(F.lit(255))).alias(f"_v{8 * j + k}") for j in range(8) for k in range(8)]
    told = packed.groupBy(*keys).agg(F.sum("_n").alias("_n"), *votes)
    bits = [F.when(2 * F.col(f"_v{b}") > F.col("_n"), F.lit((1 << b) - (1 << 64) * (b == 63))).otherwise(F.lit(0)) for b in range(BITS)]
    whole = bits[0]
    for b in bits[1:]:
        whole = whole.bitwiseOR(b)
    return told.select(*keys, whole.cast("long").alias("fingerprint"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fingerprint): one row for each distinct (doc_id, text), null ids included; a null text counts as empty.

    A text without words has the fingerprint 0. Other columns, whatever their names, take no part.
    """
    rows = docs.select("doc_id", or_empty(F.col("text")).alias("_text")).withColumn("text_hash", F.sha2("_text", 256))
    return _voted(rows.dropDuplicates(["doc_id", "text_hash"]), ["doc_id", "text_hash"], "_text")


def likeness(a: str, b: str) -> Column:
    """Share of equal bits of two fingerprints."""
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / BITS


def hexed(fingerprint: str) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def _tables(fps: DataFrame, radius: int) -> DataFrame:
    """fps once for each table, with the table's number and its key bits."""
    n = radius + 2
    edges = [BITS * i // n for i in range(n + 1)]
    masks = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(n)]
    signed = lambda x: x - (1 << 64) * (x >= 1 << 63)
    keys = [F.struct(F.lit(t).alias("table"), F.col("fingerprint").bitwiseAND(F.lit(signed(masks[a] | masks[b]))).alias("bits")) for t, (a, b) in enumerate(combinations(range(n), 2))]
    return fps.withColumn("_k", F.explode(F.array(*keys))).withColumns({"_table": F.col("_k.table"), "_bits": F.col("_k.bits")}).drop("_k")


def within(queries: DataFrame, index: DataFrame, radius: int = 3) -> DataFrame:
    """(query, fingerprint, distance): all fingerprints of index within the radius of each distinct one of queries.

    Both have a column fingerprint; null ones take no part.
    """
    q = queries.where("fingerprint is not null").select("fingerprint").distinct()
    x = index.where("fingerprint is not null").select("fingerprint").distinct()
    q = _tables(q, radius).withColumnRenamed("fingerprint", "query")
    both = q.join(_tables(x, radius), ["_table", "_bits"])
    far = F.bit_count(F.col("query").bitwiseXOR(F.col("fingerprint"))).cast("int")
    return both.select("query", "fingerprint", far.alias("distance")).where(F.col("distance") <= radius).distinct()


def _windows(docs: DataFrame) -> Column:
    """The window of a document, in ascending order of doc_id: a range between quantiles, then equal widths within it.

    The driver gets RANGES quantiles and counts. Ids may be dense, sparse or hashed, in any mixture of ranges.
    """
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"))
    steps = F.array(*[F.lit(k / RANGES) for k in range(RANGES + 1)])
    edges = sorted(set(ids.agg(F.percentile_approx("doc_id", steps, 10000)).first()[0] or []))
    number = lambda c: F.size(F.filter(F.array(*[F.lit(e) for e in edges[1:-1]]).cast("array<bigint>"), lambda e: e <= c)) if len(edges) > 2 else F.lit(0)
    c = F.col("doc_id").cast("long")
    found = {r["r"]: r for r in ids.groupBy(number(c).alias("r")).agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).collect()}
    held = [found.get(r) for r in range(max(found, default=-1) + 1)]
    lows = F.array(*[F.lit(float(h["low"] if h else 0)) for h in held]).cast("array<double>")
    widths = F.array(*[F.lit(max(1.0, (h["high"] - h["low"] + 1) * IDS / h["n"]) if h else 1.0) for h in held]).cast("array<double>")
    within = F.floor((c.cast("double") - F.get(lows, number(c))) / F.get(widths, number(c)))
    return (number(c).cast("long") * (1 << 48) + within).cast("long")


def _next_texts(docs: DataFrame) -> DataFrame:
    """(_bin, doc_id, _k, text, next_id, next_text) by ascending id; the last is followed by the first.

    Rows of one doc_id are numbered (_k) by their texts; the next document is the first row of the next id. A window's last
    document gets the first of the next window that has any, found over the list of windows. Null ids have no place.
    """
    bin = _windows(docs)  # told once: quantiles of many ids may come out otherwise another time
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), or_empty(F.col("text")).alias("text"))
    rows = rows.withColumn("_bin", bin).where("_bin is not null")  # as joins infer, so that both uses share a shuffle
    order, same = Window.partitionBy("_bin").orderBy("doc_id", "text"), Window.partitionBy("_bin", "doc_id").orderBy("text")
    rows = rows.withColumns({"_next_id": F.lead("doc_id").over(order), "_next_text": F.lead("text").over(order), "_n": F.row_number().over(order)})
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = rows.withColumns({"_k": F.row_number().over(same), "_next_id": F.last("_next_id").over(whole), "_next_text": F.last("_next_text").over(whole)})
    bins = written(docs.where("doc_id is not null").select(bin.alias("_bin")).distinct())
    firsts = seen.where("_n = 1").select("_bin", F.col("doc_id").alias("_first_id"), F.col("text").alias("_first_text"))
    firsts = firsts.withColumnRenamed("_bin", "_next_bin").join(_next_bins(bins), "_next_bin").select("_bin", "_first_id", "_first_text")
    return seen.join(firsts, "_bin", "left").select(
        "_bin",
        "doc_id",
        "_k",
        "text",
        F.coalesce("_next_id", "_first_id").alias("next_id"),
        F.when(F.col("_next_id").isNull(), F.col("_first_text")).otherwise(F.col("_next_text")).alias("next_text"),
    )


def _next_bins(bins: DataFrame) -> DataFrame:
    """(_bin, _next_bin) in ascending order, the last followed by the first; only one row for each range is windowed as a whole."""
    inner = bins.select("_bin", F.shiftright("_bin", 48).alias("_up")).withColumn("_next_bin", F.lead("_bin").over(Window.partitionBy("_up").orderBy("_bin")))
    whole = Window.orderBy("_up")
    ends = inner.groupBy("_up").agg(F.min("_bin").alias("_low"))
    first = F.first("_low").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = ends.select("_up", F.coalesce(F.lead("_low").over(whole), first).alias("_after"))
    return inner.join(ends, "_up").select("_bin", F.coalesce("_next_bin", "_after").alias("_next_bin"))


def compared(docs: DataFrame, radius: int = 3, every: int = 50) -> DataFrame:
    """The digest of operator 1 of every row.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and near_count: for ids
    divisible by `every`, how many other rows' fingerprints the block tables find within the radius (else null). A null text
    counts as empty. A row without doc_id has no next document: its edited text is its own, near_next is null. Repeated rows
    stay; the next document of a repeated id is that of the id, and as next document it counts with its smallest text.
    """
    rows = _next_texts(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("_bin", "doc_id", "_k", "next_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("text").alias("t")), F.struct(F.lit(1).alias("e"), F.col("edited").alias("t"))))
    sha = F.sha2("edited", 256).alias("edited_sha256")
    keys = ["_bin", "doc_id", "_k", "next_id", "n_chars", "edited_sha256"]
    each = rows.select("_bin", "doc_id", "_k", "next_id", "n_chars", sha, kinds.alias("k")).select(*keys, F.col("k.e").alias("_e"), F.col("k.t").alias("_t"))
    marks = _voted(each, [*keys, "_e"], "_t").groupBy(*keys).agg(
        F.max(F.when(F.col("_e") == 0, F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(F.col("_e") == 1, F.col("fingerprint"))).alias("_edited"),
    )
    marks = marks.drop("_bin").unionByName(_placeless(docs))
    marks = written(marks)
    held = marks.groupBy("fingerprint").count()
    found = within(marks.where(F.col("doc_id") % every == 0), marks, radius).join(held, "fingerprint")
    near = found.groupBy(F.col("query").alias("fingerprint")).agg((F.sum("count") - 1).alias("_near"))
    following = marks.where("_k = 1").select(F.col("doc_id").alias("next_id"), F.col("fingerprint").alias("_next"))
    out = marks.join(following, "next_id", "left").join(near, "fingerprint", "left")
    return out.select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        hexed("fingerprint").alias("fingerprint"),
        hexed("_edited").alias("edited_fingerprint"),
        likeness("fingerprint", "_edited").alias("near_edited"),
        likeness("fingerprint", "_next").alias("near_next"),
        F.when(F.col("doc_id") % every == 0, F.col("_near")).alias("near_count"),
    )


def _placeless(docs: DataFrame) -> DataFrame:
    """Marks of the rows without doc_id; equal texts are fingerprinted once."""
    text = docs.where("doc_id is null").select(or_empty(F.col("text")).alias("_t"))
    kinds = text.groupBy("_t").agg(F.count("*").alias("_c")).select("_t", "_c", F.sha2("_t", 256).alias("edited_sha256"), F.length("_t").cast("long").alias("n_chars"))
    told = _voted(kinds, ["edited_sha256", "n_chars", "_c"], "_t")
    each = told.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_c").cast("int"))))
    none = F.lit(None).cast("long")
    return each.select(none.alias("doc_id"), "_k", none.alias("next_id"), "n_chars", "edited_sha256", "fingerprint", F.col("fingerprint").alias("_edited"))


