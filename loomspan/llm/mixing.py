"""Mixing sources to target weights by Pfair scheduling (operator 9).

A source's documents, in a hashed order, are cut into blocks of near-equal size. The ideal mix is a fluid one: each source
flows in proportion to its integer weight q until its n blocks have gone, then the others share its part. At level V (of
block i of a source: i / q to (i + 1) / q) it has passed t(V) = sum of min(q V, n) blocks. Block i is released at slot
floor(t(i / q)) and due by slot ceil(t((i + 1) / q)); each slot goes to the released block with the earliest deadline. So
after any slot every source has had within one block of its share, whatever the number of sources.
The driver walks the blocks once, in exact integers, holds two entries a source, and writes the slots out in batches.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import ranked, scratch, sized

#: Units that weights are counted in, unless a cycle is given; finer than one block in any number of blocks.
CYCLE = 1 << 60
#: Slots of a batch that the driver writes.
BATCH = 1 << 18
KINDS = pa.schema({"_s": pa.int32(), "block": pa.int64(), "phase": pa.int32(), "target": pa.float64(), "slot": pa.int64()})


def quotas(weights: dict[str, float], cycle: int = CYCLE) -> dict[str, int]:
    """Integers that sum to `cycle`, by largest remainders; ties by name. Each is within 1 of its share."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    total = sum(exact.values())
    share = {s: cycle * w / total if total else Fraction(cycle, len(exact)) for s, w in exact.items()}
    out = {s: int(x) for s, x in share.items()}
    rest = cycle - sum(out.values())
    for s in sorted(share, key=lambda s: (out[s] - share[s], s))[:rest]:
        out[s] += 1
    return out


def units(weights: dict[str, float], cycle: int = CYCLE) -> dict[str, int]:
    """The sources' integer weights: quotas of the cycle, or of CYCLE if the cycle leaves a source without a slot.

    A source of no weight gets one unit, so it comes when the others have ended.
    """
    out = quotas(weights, cycle)
    if any(not out[s] and w for s, w in weights.items()):
        out = quotas(weights)
    return {s: max(q, 1) for s, q in out.items()}


class Fluid:
    """The ideal flow of sources with integer weights q and block counts n."""

    def __init__(self, q: list[int], n: list[int]):
        self.q, self.n = q, n
        order = sorted(range(len(q)), key=lambda s: Fraction(n[s], q[s]))
        self.ends = [(n[s], q[s]) for s in order]
        self.about = [a / b for a, b in self.ends]
        self.gone, self.live = [0], [sum(q)]
        for blocks, weight in self.ends:
            self.gone.append(self.gone[-1] + blocks)
            self.live.append(self.live[-1] - weight)
        # sources that end together end one phase
        self.phase, last = [0], None
        for blocks, weight in self.ends:
            same = last is not None and blocks * last[1] == last[0] * weight
            self.phase.append(self.phase[-1] + (not same))
            last = (blocks, weight)

    def ended(self, i: int, q: int) -> int:
        """How many sources have ended at level i / q."""
        k = bisect_right(self.about, i / q)
        while k < len(self.ends) and self.ends[k][0] * q <= i * self.ends[k][1]:
            k += 1
        while k and self.ends[k - 1][0] * q > i * self.ends[k - 1][1]:
            k -= 1
        return k

    def window(self, s: int, i: int) -> tuple[int, int, int]:
        """Of block i of source s: the slot it is released at, the one it is due by, and the sources ended at its start."""
        q = self.q[s]
        k, j = self.ended(i, q), self.ended(i + 1, q)
        return self.gone[k] + i * self.live[k] // q, self.gone[j] - (-(i + 1) * self.live[j] // q), k


def scheduled(q: list[int], n: list[int]) -> Iterator[tuple[int, int, int]]:
    """(source, block, sources ended at its start) of each slot: earliest deadline first among released blocks."""
    fluid = Fluid(q, n)
    waiting = [(0, s, 0) for s in range(len(q)) if n[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    for slot in range(sum(n)):
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            _, due, k = fluid.window(s, i)
            heapq.heappush(ready, (due, s, i, k))
        _, s, i, k = heapq.heappop(ready)
        yield s, i, k
        if i + 1 < n[s]:
            heapq.heappush(waiting, (fluid.window(s, i + 1)[0], s, i + 1))


def pfair_cycle(quota: dict[str, int]) -> list[str]:
    """The source of each slot of one cycle; ties by name."""
    names = sorted(s for s in quota if quota[s])
    counts = [quota[s] for s in names]
    return [names[s] for s, _, _ in scheduled(counts, counts)]


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.7, block_bytes: int = 1 << 16, cycle: int = CYCLE) -> DataFrame:
    """(doc_id, source, block, phase, target, slot) of every row; sort by (slot, doc_id) for the mixed order.

    target is the source's weight over the weights of the sources left in the phase; a phase ends with a source. With a
    cycle, weights are first rounded to whole slots of it (if that leaves no source without one).
    weights: target share of each source; a source without one gets the smallest given. None: blocks ** alpha (tempered).
    A block holds the documents whose text starts in its block_bytes of the source. A null source counts as the source
    named '', a null text as empty; repeated rows keep separate places. An empty table gives an empty result.
    """
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("_size"),
    ).withColumn("_h", F.xxhash64("doc_id"))
    placed = ranked(rows, ["source", "_h", "doc_id"], "_rank", "_size", "_before")
    starts = placed.groupBy("source").agg(F.min("_before").alias("_start"), F.max("_before").alias("_last"))
    known = [(r["source"], r["_start"], (r["_last"] - r["_start"]) // block_bytes + 1) for r in starts.collect()]
    blocks = {s: n for s, _, n in known}
    least = min((weights or {}).values(), default=1.0)
    goal = {s: float(n) ** alpha if weights is None else weights.get(s, least) for s, n in blocks.items()}
    spark, names = docs.sparkSession, sorted(blocks)
    q, n = units(goal, cycle) if goal else {}, [blocks[s] for s in names]
    first = {s: b for s, b, _ in known}
    begun = spark.createDataFrame([(s, i, first[s]) for i, s in enumerate(names)], "source string, _s int, _start long")
    out = placed.join(sized(begun, 100), "source").withColumn("block", F.floor((F.col("_before") - F.col("_start")) / block_bytes))
    slots = _slots(spark, [q[s] for s in names], n)
    return out.join(sized(slots, 40), ["_s", "block"]).select("doc_id", "source", "block", "phase", "target", "slot")


def _slots(spark: SparkSession, q: list[int], n: list[int]) -> DataFrame:
    """(_s, block, phase, target, slot) of every block, as a Parquet table in the shared folder."""
    path, schema = scratch(spark), "_s int, block long, phase int, target double, slot long"
    fluid, walk, slot = Fluid(q, n), scheduled(q, n), 0
    while True:
        rows = [(s, i, fluid.phase[k], q[s] / fluid.live[k]) for s, i, k in islice(walk, BATCH)]
        if rows or not slot:
            columns = zip(*rows) if rows else [[]] * 4
            part = pa.table([*map(list, columns), range(slot, slot + len(rows))], schema=KINDS)
            spark.createDataFrame(part, schema).write.mode("append").parquet(path)
        slot += len(rows)
        if len(rows) < BATCH:
            return spark.read.schema(schema).parquet(path)
