"""MinHash near-dedup with HyperMinHash registers (operator 8).

One 64-bit hash per shingle. Its top bits choose a bucket; of the smallest rest in a bucket the register keeps the count
of leading zeros (6 bits) and the next mantissa bits (10): 128 registers of 2 bytes. Empty buckets are filled from others
by fixed probe sequences, so that short documents band as well as long ones. Bands of registers propose candidates, a
collision-corrected Jaccard estimate with a wide margin and the set sizes discard hopeless ones, and the rest are
confirmed on the full shingle sets.

No bucket is expanded into all its pairs: equal sets are merged first, and each bucket links its members to its smallest
one. In buckets that still hold several components, rounds of random hubs follow, each comparing a member with one other.
What is left is settled by prefix filtering: with shingles in one fixed order, two sets that reach the threshold share one of
their first n - ceil(t n) + 1. The order is from rare to common, so documents that share no more than a common passage
don't meet. Of those that meet, members outside a shingle's largest component are queries against the others: as pairs in
small neighbourhoods, in blocks in large ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import components, sized, unused, written

BUCKET_BITS, MANTISSA = 7, 10
BUCKETS = 1 << BUCKET_BITS
ROWS = 4
#: The estimate may not discard pairs of small sets; above, it must fall this far below the threshold to do so.
ESTIMATE_FROM, MARGIN = 64, 0.35
#: Rounds in which a bucket's members meet random hubs, each of about so many members.
ROUNDS, SALTED = 1, 16
#: Cells of the table of shingle counts that orders shingles from rare to common.
CELLS = 1 << 18
#: Pairs of a component's neighbourhood above which it is compared in blocks of at most SIDE by SIDE documents (on average).
PAIRS, SIDE = 1 << 12, 256
_PROBES = np.random.default_rng(8).integers(0, BUCKETS, (BUCKETS, 512))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles; words are hashed once per worker."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > 200_000:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.width, len(words))
        out = np.full(len(h) - k + 1, np.uint64(k))
        for i in range(k):
            out = out * _ODD + h[i : len(h) - k + 1 + i]
        return np.unique(mixed(out))


def registers(hashes: np.ndarray) -> np.ndarray:
    """BUCKETS uint16 registers of a sorted hash set."""
    low = np.uint64(64 - BUCKET_BITS)
    bucket = (hashes >> low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    rest = (hashes[first] & ((np.uint64(1) << low) - np.uint64(1))) >> np.uint64(64 - BUCKET_BITS - 52)
    zeros = 52 - np.frexp(rest.astype(np.float64))[1]
    mantissa = ((rest << (zeros + 1).astype(np.uint64)) >> np.uint64(52 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    out, full = np.zeros(BUCKETS, np.uint16), np.zeros(BUCKETS, bool)
    out[bucket[first]] = (zeros.astype(np.uint64) << np.uint64(MANTISSA)) | mantissa
    full[bucket[first]] = True
    empty = np.flatnonzero(~full)
    if len(empty):
        probes = _PROBES[empty]
        hit = full[probes]
        out[empty] = np.where(hit.any(1), out[probes[np.arange(len(empty)), hit.argmax(1)]], out[bucket[first[0]]])
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    keys = np.ascontiguousarray(regs).view(np.uint64)
    return mixed(keys + np.arange(1, len(keys) + 1, dtype=np.uint64) * _ODD).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard estimate from registers; two unlike registers agree by chance with probability about 2^-mantissa / 3."""
    chance = 2.0**-MANTISSA / 3
    return max(0.0, ((a == b).mean() - chance) / (1 - chance))


def signatures(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, set_id, registers, bands) of every text; set_id is null for a text without words."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler(width)
        for part in parts:
            rows = []
            for i, text in zip(part["doc_id"], part["text"]):
                h = shingles(text)
                if len(h):
                    regs = registers(h)
                    rows.append((i, len(h), xxhash.xxh128_digest(h.tobytes()), regs.tobytes(), band_keys(regs)))
                else:
                    rows.append((i, 0, None, None, None))
            out = pd.DataFrame(rows, columns=["doc_id", "n_shingles", "set_id", "registers", "bands"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    schema = "doc_id long, n_shingles long, set_id binary, registers binary, bands array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, schema)


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc_id, hashes) of the documents in ids (written): their shingle sets as sorted 64-bit hashes."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler(width)
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"], "hashes": [shingles(t).tobytes() for t in part["text"]]})

    rows = docs.select(F.col("doc_id").cast("long"), "text").join(sized(ids), "doc_id", "left_semi")
    return written(rows.mapInPandas(run, "doc_id long, hashes binary"))


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(key, rep): the prefix of each document's shingles, rarest first by a bounded table of counts of hash cells."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CELLS, np.int64)
        for part in parts:
            for x in part["hashes"]:
                np.add.at(total, np.frombuffer(x, np.uint64) % np.uint64(CELLS), 1)
        cell = np.flatnonzero(total)
        yield pd.DataFrame({"cell": cell, "n": total[cell]})

    counts = sets.mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    held = np.zeros(CELLS, np.int64)
    held[counts["cell"].to_numpy()] = counts["n"]
    held = sets.sparkSession.sparkContext.broadcast(held)

    def first(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            keys = []
            for x in part["hashes"]:
                x = np.frombuffer(x, np.uint64)
                order = np.lexsort((x, held.value[x % np.uint64(CELLS)]))
                keys.append(x[order[: len(x) - -(-percent * len(x) // 100) + 1]].view(np.int64))
            yield pd.DataFrame({"rep": part["doc_id"], "keys": keys})

    return sets.mapInPandas(first, "rep long, keys array<long>").select(F.explode("keys").alias("key"), "rep")


def _grid(lab: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The confirmed pairs (u, v) between members with c != label (queries) and all members of other components, of each label.

    lab: (label, rep, c, blocks, chunks). Members are cut into blocks and queries into chunks of bounded size; a task
    holds one of each and gives back links only.
    """
    lab = lab.join(sets.withColumnRenamed("doc_id", "rep"), "rep")
    block, chunk = F.pmod(F.hash("rep"), "blocks").cast("int"), F.pmod(F.hash("rep"), "chunks").cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = lab.select("label", block.alias("block"), upto("chunks").alias("chunk"), "rep", "c", "hashes")
    asked = lab.where("c != label").select("label", upto("blocks").alias("block"), chunk.alias("chunk"), "rep", "c", "hashes")
    asked = asked.toDF("q_label", "q_block", "q_chunk", "q_rep", "q_c", "q_hashes")

    def run(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and len(q):
            held = [np.frombuffer(b, np.uint64) for b in x["hashes"]]
            sizes = np.array([len(h) for h in held])
            known, place = np.unique(np.concatenate(held), return_inverse=True)
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            reps, comps = x["rep"].to_numpy(), x["c"].to_numpy()
            for i, c, b in zip(q["q_rep"], q["q_c"], q["q_hashes"]):
                b = np.frombuffer(b, np.uint64)
                at = np.minimum(np.searchsorted(known, b), len(known) - 1)
                flag = np.zeros(len(known), np.int64)
                flag[at[known[at] == b]] = 1
                both = np.add.reduceat(flag[place], starts)
                near = (100 * both >= percent * (sizes + len(b) - both)) & (comps != c)
                out += [(min(i, j), max(i, j)) for j in reps[near]]
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    cells = members.groupBy("label", "block", "chunk").cogroup(asked.groupBy("q_label", "q_block", "q_chunk"))
    return cells.applyInPandas(run, "u long, v long").distinct()


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets reach the threshold."""
    sets = _sets(docs, written(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()), width)

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    left = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("hashes").alias("a")), "u")
    right = sets.select(F.col("doc_id").alias("v"), F.col("hashes").alias("b"))
    return left.join(right, "v").where(near("a", "b")).select("u", "v")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    A text without words has an empty set, is linked with nothing and kept. Rows with a null doc_id are kept with a null
    component. Equal sets (also repeated rows) are one class; rows that share a doc_id count as one document. Other columns
    of docs are not read.
    """
    marks = written(signatures(docs, width))
    classes = written(
        marks.where("set_id is not null and doc_id is not null")
        .groupBy("set_id")
        .agg(F.min(F.struct("doc_id", "n_shingles", "registers", "bands")).alias("r"))
        .select("set_id", F.col("r.doc_id").alias("rep"), F.col("r.n_shingles").alias("n"), "r.registers", "r.bands")
    )
    rows = classes.select(F.explode("bands").alias("key"), "rep")
    # shared keys are a table of their own, so that the join of a hot key's rows can be split
    shared = written(rows.groupBy("key").agg(F.count("*").alias("m"), F.min("rep").alias("hub")).where("m > 1").select("key", "hub"))
    members = written(rows.join(sized(shared, 16), "key"))
    chance = F.lit(percent / 100 - MARGIN)

    @F.pandas_udf("double")
    def guess(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([estimate(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16)) for x, y in zip(a, b)], dtype=float)

    def hopeful(pairs: DataFrame) -> DataFrame:
        """Written candidate pairs that set sizes and the estimate don't rule out."""
        u = classes.select(F.col("rep").alias("u"), F.col("n").alias("nu"), F.col("registers").alias("ru"))
        v = classes.select(F.col("rep").alias("v"), F.col("n").alias("nv"), F.col("registers").alias("rv"))
        least, most = F.least("nu", "nv"), F.greatest("nu", "nv")
        kept = pairs.join(u, "u").join(v, "v").where(100 * least >= percent * most)
        return written(kept.where((least < ESTIMATE_FROM) | (guess("ru", "rv") >= chance)).select("u", "v"))

    stars = hopeful(members.where("rep != hub").select(F.col("hub").alias("u"), F.col("rep").alias("v")).distinct())
    links = written(_confirmed(stars, docs, width, percent))
    found = written(components(links))

    def confirmed(pairs: DataFrame) -> bool:
        """Confirms pairs not seen before; True if that joined components."""
        nonlocal seen, links, found
        rest = hopeful(pairs.distinct().join(seen, ["u", "v"], "left_anti"))
        seen = seen.union(rest)
        if rest.isEmpty():
            return False
        more = written(_confirmed(rest, docs, width, percent))
        if more.isEmpty():
            return False
        links = links.union(more)
        found = written(components(links))
        return True

    def divided(rows: DataFrame) -> DataFrame:
        """Of (key, rep): the rows of keys with several components, with the component, the key's rows and its largest component."""
        placed = rows.join(found.withColumnRenamed("node", "rep"), "rep", "left")
        placed = placed.select("key", "rep", F.coalesce("component", "rep").alias("c"))
        per = placed.groupBy("key", "c").agg(F.count("*").alias("m"))
        split = per.groupBy("key").agg(F.count("*").alias("n"), F.sum("m").alias("m"), F.max(F.struct("m", "c")).alias("top"))
        split = written(split.where("n > 1").select("key", "m", F.col("top.c").alias("top")))
        return written(placed.join(sized(split, 24), "key"))

    seen, few = stars, divided(members)
    for turn in range(1, ROUNDS + 1):
        if few.isEmpty():
            break
        salt = F.pmod(F.xxhash64("rep", F.lit(turn)), F.ceil(F.col("m") / SALTED))
        salted = few.withColumns({"salt": salt, "h": F.xxhash64("rep", F.lit(-turn))})
        hubs = salted.groupBy("key", "salt").agg(F.min(F.struct("h", "rep", "c")).alias("hub"))
        pairs = salted.join(hubs, ["key", "salt"]).where("c != hub.c")
        confirmed(pairs.select(F.least("rep", "hub.rep").alias("u"), F.greatest("rep", "hub.rep").alias("v")))
        few = divided(few.select("key", "rep"))
    if not few.isEmpty():
        sets = _sets(docs, written(few.select(F.col("rep").alias("doc_id")).distinct()), width)
        few = divided(_prefixes(sets, percent))
        lab = written(few.select(F.col("top").alias("label"), "rep", "c").distinct())
        size = lab.groupBy("label").agg(F.count("*").alias("m"), F.count_if(F.col("c") != F.col("label")).alias("o"))
        large = F.col("o") * F.col("m") > PAIRS
        size = size.where(large).select("label", *[F.ceil(F.col(x) / SIDE).cast("int").alias(n) for x, n in (("m", "blocks"), ("o", "chunks"))])
        size = written(size)
        more = written(_grid(lab.join(size, "label"), sets, percent))
        if not more.isEmpty():
            links = links.union(more)
            found = written(components(links))
        few = few.join(size, few["top"] == size["label"], "left_anti")
        odd = few.where("c != top").select("key", F.col("rep").alias("u"), F.col("c").alias("cu"))
        across = odd.join(few.select("key", F.col("rep").alias("v"), F.col("c").alias("cv"), "top"), "key")
        across = across.where((F.col("cu") != F.col("cv")) & ((F.col("cv") == F.col("top")) | (F.col("u") < F.col("v"))))
        confirmed(across.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
    named = classes.select("set_id", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("set_id", F.coalesce("component", "rep").alias("component_id"))
    out = marks.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """docs, all columns, with one document (the smallest doc_id) of each near-duplicate group.

    Rows without doc_id and texts without words stay; rows that share a doc_id stay or go together; other columns are kept,
    whatever their names.
    """
    (mark,) = unused(docs.columns, "gone")
    gone = written(near_duplicates(docs, width, percent).where("not kept").select(F.col("doc_id").alias(mark)).distinct())
    return docs.join(sized(gone), docs["doc_id"] == gone[mark], "left_anti")
