"""Approximate nearest neighbours by stable projections (operator 3).

Vectors are projected to a few dimensions by Gaussian (2-stable) random directions: the squared projected distance over
the squared true distance follows a chi-square law. A kd-tree over the projected points hands out a query's points in
order of projected distance; each is verified with its true distance. The search stops when the law says that a point
closer than the k-th best so far would, with the wanted probability, already have been met.

Inner product is made Euclidean by one more coordinate, sqrt(M^2 - |x|^2), with M the largest norm (0 for queries). The
coordinate would drown the distances if norms differ much, so a block's rows are cut into ranges of like norms, each with
its own M and tree; they are searched from large norms to small, until norms alone rule the rest out.

The tree's upper levels are cut at medians of a bounded sample of projected points and deal all rows to blocks; the lower
levels are built in the task that holds a block. A query first searches the block that it lies in, and takes its k-th best
score along as a bound; then it goes to just those other blocks whose boxes the stopping test doesn't rule out.

Equal vectors are searched once, as a query and as a row: of their ids only the k + 1 smallest can be in a result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import sized, written

#: Projected dimensions (even), the probability of the stopping test, points of a kd-tree leaf.
PROJECTED, SURE, LEAF = 8, 0.97, 256
#: Rows of a block and queries of a chunk, on average.
BLOCK, CHUNK = 8192, 4096
#: Projected points, at most twice as many, that the upper levels' medians are taken from.
SAMPLE = 1 << 16
#: Largest norm of a range over its smallest, if a leaf's rows are that close.
RANGE = 1.1
#: Candidates kept beyond k until scores have been summed up in one fixed order.
SPARE = 8


def chi_square(x: np.ndarray, freedom: int) -> np.ndarray:
    """Distribution function for an even number of degrees of freedom."""
    half = np.minimum(x / 2, 700)
    term, total = np.ones_like(half), np.ones_like(half)
    for k in range(1, freedom // 2):
        term = term * half / k
        total = total + term
    return 1 - np.exp(-half) * total


class ProjectedTree:
    """kd-tree leaves over projected points: row numbers and bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.leaves: list[np.ndarray] = []
        stack = [np.arange(len(points))]
        while stack:
            rows = stack.pop()
            if len(rows) <= leaf:
                self.leaves.append(rows)
                continue
            axis = int(np.argmax(np.ptp(points[rows], axis=0)))
            order = rows[np.argsort(points[rows, axis], kind="stable")]
            stack += [order[len(order) // 2 :], order[: len(order) // 2]]  # left leaves come first, so equal points keep their order
        self.low = np.stack([points[r].min(0) for r in self.leaves])
        self.high = np.stack([points[r].max(0) for r in self.leaves])

    def reach(self, queries: np.ndarray) -> np.ndarray:
        """Squared projected distance from each query to each leaf's box."""
        out = np.zeros((len(queries), len(self.leaves)))
        for d in range(queries.shape[1]):
            q = queries[:, d : d + 1]
            gap = np.maximum(np.maximum(self.low[:, d] - q, q - self.high[:, d]), 0)
            out += gap * gap
        return out


class Upper:
    """The tree's upper levels: medians of a sample, as nested cuts; leaves are blocks."""

    def __init__(self, sample: np.ndarray, blocks: int):
        self.axis, self.cut, self.next = [], [], []
        self.blocks = 0
        self._grow(sample, blocks)

    def _grow(self, points: np.ndarray, blocks: int) -> int:
        """Number of the node made; leaves are -1 - block."""
        if blocks <= 1 or len(points) < 2:
            self.blocks += 1
            return -self.blocks
        node = len(self.axis)
        axis = int(np.argmax(np.ptp(points, axis=0)))
        left = blocks // 2
        cut = float(np.quantile(points[:, axis], left / blocks))
        self.axis.append(axis)
        self.cut.append(cut)
        self.next.append([0, 0])
        low = points[:, axis] < cut
        self.next[node] = [self._grow(points[low], left), self._grow(points[~low], blocks - left)]
        return node

    def block(self, points: np.ndarray) -> np.ndarray:
        """The block of each point."""
        if not self.axis:
            return np.zeros(len(points), np.int64)
        axis, cut, after = np.array(self.axis), np.array(self.cut), np.array(self.next)
        node, live = np.zeros(len(points), np.int64), np.arange(len(points))
        while len(live):
            at = node[live]
            node[live] = after[at, (points[live, axis[at]] >= cut[at]).astype(int)]
            live = live[node[live] >= 0]
        return -1 - node


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng([3, dim]).standard_normal((dim + 1, PROJECTED))


def projected(x: np.ndarray, most: float, query: bool) -> np.ndarray:
    """Projections of rows, or of queries, whose further coordinate is 0."""
    rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(most * most - np.einsum("ij,ij->i", x, x), 0))
    return np.c_[x, rest] @ directions(x.shape[1])


def ruled_out(reach: np.ndarray, norms: np.ndarray, most: float, worst: np.ndarray) -> np.ndarray:
    """The stopping test: whether nothing better than `worst` is likely from a squared projected distance `reach` on."""
    gap = np.maximum(norms + most * most - 2 * worst, 1e-300)  # squared distance of the k-th best
    return np.isfinite(worst) & (chi_square(reach / gap, PROJECTED) >= SURE)


def _ranges(norms: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """Row numbers of like norms, and the largest of their norms, from large to small."""
    order = np.argsort(-norms, kind="stable")
    start = 0
    while start < len(order):
        top = float(norms[order[start]])
        end = max(start + LEAF, int(np.searchsorted(-norms[order], -top / RANGE, "right")))
        end = len(order) if len(order) - end < LEAF else end
        yield np.sort(order[start:end]), top
        start = end


def searched(ids: np.ndarray, x: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers (-1: none) and inner products of each query's k best rows of x, in order, and how many rows were verified.

    Ties go to the smaller id. floor: scores that only better (or equal) rows count for.
    """
    by_id = np.argsort(ids, kind="stable")
    ids, x = ids[by_id], x[by_id]
    norms = np.einsum("ij,ij->i", q, q)
    keep = k + SPARE
    best, row = np.full((len(q), keep), -np.inf), np.full((len(q), keep), len(ids))
    floor = np.full(len(q), -np.inf) if floor is None else floor
    verified = np.zeros(len(q), np.int64)
    for mine, top in _ranges(np.sqrt(np.einsum("ij,ij->i", x, x))):
        worst = np.maximum(best[:, k - 1], floor)
        active = np.flatnonzero(np.sqrt(norms) * top * (1 + 1e-9) >= worst)
        tree = ProjectedTree(projected(x[mine], top, False))
        reach = np.full((len(q), len(tree.leaves)), np.inf)
        reach[active] = tree.reach(projected(q[active], top, True))
        order = np.argsort(reach, axis=1, kind="stable")
        for step in range(len(tree.leaves)):
            leaf = order[active, step]
            worst = np.maximum(best[active, k - 1], floor[active])
            done = ruled_out(reach[active, leaf], norms[active], top, worst)
            active, leaf = active[~done], leaf[~done]
            if not len(active):
                break
            by = np.argsort(leaf, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
                who, rows = active[part], np.sort(mine[tree.leaves[leaf[part[0]]]])
                score = q[who] @ x[rows].T
                verified[who] += len(rows)
                slack = 1e-9 * np.sqrt(norms[who]) * top
                some = (score.max(1) >= best[who, -1]) & (score.max(1) >= floor[who] - slack)
                who, score = who[some], score[some]
                all_score = np.c_[best[who], score]
                all_row = np.c_[row[who], np.broadcast_to(rows, score.shape)]
                by_row = np.argsort(all_row, axis=1, kind="stable")  # rows are numbered by id
                all_score, all_row = np.take_along_axis(all_score, by_row, 1), np.take_along_axis(all_row, by_row, 1)
                first = np.argsort(-all_score, axis=1, kind="stable")[:, :keep]
                best[who], row[who] = np.take_along_axis(all_score, first, 1), np.take_along_axis(all_row, first, 1)
    there = np.isfinite(best)
    who, at = np.nonzero(there)
    best[who, at] = np.einsum("ij,ij->i", q[who], x[row[who, at]])  # one order of summation, wherever a row lies
    by_row = np.argsort(row, axis=1, kind="stable")
    best, row = np.take_along_axis(best, by_row, 1), np.take_along_axis(row, by_row, 1)
    top = np.argsort(-best, axis=1, kind="stable")[:, :k]
    best, row = np.take_along_axis(best, top, 1), np.take_along_axis(row, top, 1)
    return np.where(np.isfinite(best), by_id[np.minimum(row, len(ids) - 1)] if len(ids) else -1, -1), best, verified


def usable(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v, dim) in double precision, without null ids, and null, empty, zero or non-finite vectors."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return rows.where("vec_id is not null and v is not null").where(good).withColumn("dim", F.size("v"))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score, verified): for ids divisible by `every`, the k largest inner products found.

    A query's own id is no candidate; vectors are compared with those of their own length only. Ties go to the smaller
    vec_id; a repeated vec_id counts once, with its best score. Fewer than k candidates give fewer rows. verified is the
    number of distinct vectors that the query was compared with. Other columns, whatever their names, take no part.
    """
    rows = written(usable(vectors).withColumn("key", F.md5(F.concat_ws(",", F.col("v").cast("array<string>")))))
    spare = k + 1
    first = F.row_number().over(Window.partitionBy("dim", "key").orderBy("vec_id"))
    few = rows.distinct().withColumn("_r", first).where(F.col("_r") <= spare)
    kinds = few.groupBy("dim", "key").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    kinds = written(kinds.withColumn("low", F.get("ids", F.lit(0))))
    queries = written(rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "dim", "key").distinct())
    wanted = queries.select("dim", "key").distinct().join(kinds, ["dim", "key"]).select("dim", "key", "v", "low")
    sizes = kinds.groupBy("dim").agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("most"))
    found = [_found(kinds.where(F.col("dim") == r["dim"]), written(wanted.where(F.col("dim") == r["dim"])), r["n"], r["most"], spare) for r in sizes.collect()]
    if not found:
        return queries.select("query_id", F.lit(0).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("verified")).where("false")
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    hits = written(hits)
    # ids of the vectors found; of each query vector the k + 1 best by score and id, whichever of its ids asks
    each = hits.select("key", "verified", F.explode("found").alias("e")).select("key", "verified", F.col("e.low").alias("low"), F.col("e.score").alias("score"))
    each = each.join(kinds.select("low", "dim", "ids"), "low").select("key", "dim", "verified", F.explode("ids").alias("vec_id"), "score")
    top = each.groupBy("key", "dim", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("dim", "key").orderBy(F.desc("score"), "vec_id"))
    top = top.withColumn("_r", place).where(F.col("_r") <= spare)
    best = F.sort_array(F.collect_list(F.struct("_r", "vec_id", "score")))
    lists = top.groupBy("key", "dim").agg(best.alias("best")).join(hits.groupBy("key").agg(F.sum("verified").alias("verified")), "key")
    lists = written(lists.select("key", "dim", "best", "verified"))
    told = queries.join(sized(lists, 32 * spare + 64), ["dim", "key"])
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    told = told.select("query_id", "verified", F.posexplode(others).alias("_at", "_e"))
    return told.select("query_id", (F.col("_at") + 1).alias("rank"), F.col("_e.vec_id").alias("vec_id"), F.col("_e.score").alias("score"), "verified")


_HITS = "key string, low long, found array<struct<low: long, score: double>>, worst double, verified long"


def _found(kinds: DataFrame, wanted: DataFrame, n: int, most: float, k: int) -> DataFrame:
    """Hits of each distinct query vector (key, low, v) among distinct vectors (low, v) of one length: those of its own block, then of others."""
    spark = kinds.sparkSession

    def points(query: bool):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                p = projected(np.stack(part["v"]), most, query) if len(part) else np.zeros((0, PROJECTED))
                yield part.drop(columns="v").assign(p=list(p))

        return run

    blocks = -(-n // BLOCK)
    sparse = kinds.where(F.pmod(F.xxhash64("low"), F.lit(max(1, n // SAMPLE))) == 0).select("low", "v")
    sample = sparse.mapInPandas(points(False), "low long, p array<double>").orderBy("low").limit(2 * SAMPLE).toPandas() if blocks > 1 else None
    upper = spark.sparkContext.broadcast(Upper(np.stack(sample["p"]) if sample is not None else np.zeros((0, PROJECTED)), blocks))

    def dealt(query: bool):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                p = projected(np.stack(part["v"]), most, query) if len(part) else np.zeros((0, PROJECTED))
                yield part.assign(p=list(p), block=upper.value.block(p))

        return run

    data = written(kinds.select("low", "v").mapInPandas(dealt(False), "low long, v array<double>, p array<double>, block long"))
    asked = written(wanted.select("key", "low", "v").mapInPandas(dealt(True), "key string, low long, v array<double>, p array<double>, block long"))
    home = _searched(data, asked.select("key", "low", "v", "block", F.lit(-math.inf).alias("worst")), k)
    if blocks == 1:
        return home
    home = written(home)
    edges = [f(F.get("p", F.lit(i))).alias(f"{f.__name__}{i}") for i in range(PROJECTED) for f in (F.min, F.max)]
    edges.append(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("norm"))
    boxes = data.groupBy("block").agg(*edges).toPandas().sort_values("block")  # one row a block
    told = spark.sparkContext.broadcast((boxes["block"].to_numpy(), *(boxes[[f"{f}{i}" for i in range(PROJECTED)]].to_numpy() for f in ("min", "max")), boxes["norm"].to_numpy()))

    def others(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, low, high, norm = told.value
        for part in parts:
            for a in range(0, len(part), 256):
                some = part.iloc[a : a + 256]
                q, p = np.stack(some["v"]), np.stack(some["p"])
                gap = np.maximum(np.maximum(low[None] - p[:, None], p[:, None] - high[None]), 0)
                worst, norms = some["worst"].fillna(-np.inf).to_numpy(float), np.einsum("ij,ij->i", q, q)
                go = ~ruled_out((gap * gap).sum(2), norms[:, None], most, worst[:, None]) & (names[None] != some["block"].to_numpy()[:, None])
                go &= np.sqrt(norms)[:, None] * norm[None] * (1 + 1e-9) >= worst[:, None]
                who, which = np.nonzero(go)
                yield pd.DataFrame({"key": some["key"].to_numpy()[who], "block": names[which], "worst": worst[who]})

    bounds = asked.join(home.select("key", "worst"), "key", "left").select("key", "v", "p", "block", "worst")
    pairs = written(bounds.mapInPandas(others, "key string, block long, worst double"))
    more = pairs.join(asked.select("key", "low", "v"), "key").select("key", "low", "v", "block", "worst")
    return home.unionByName(_searched(data, more, k))


def _searched(data: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Hits of queries (key, low, v, block, worst) in their blocks; a task holds a block and a chunk of its queries."""
    counts = written(asked.groupBy("block").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")))
    x = data.join(sized(counts, 16), "block").select("block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("low"), "v")
    q = asked.join(sized(counts, 16), "block").select("block", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int").alias("chunk"), "key", F.col("low").alias("self"), F.col("v").alias("q"), "worst")

    def run(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        names = ["key", "low", "found", "worst", "verified"]
        if not len(x) or not len(q):
            return pd.DataFrame(columns=names, dtype=object)
        ids, floor = x["low"].to_numpy(), q["worst"].to_numpy(float)
        near, score, verified = searched(ids, np.stack(x["v"]), np.stack(q["q"]), k, floor)
        found = [[{"low": int(ids[r]), "score": float(s)} for r, s in zip(rs, ss) if r >= 0] for rs, ss in zip(near, score)]
        return pd.DataFrame({"key": q["key"], "low": q["self"], "found": found, "worst": np.maximum(score[:, -1], floor), "verified": verified})

    return x.groupBy("block", "chunk").cogroup(q.groupBy("block", "chunk")).applyInPandas(run, _HITS)
