"""Interval algebra per sequence. Every operator takes column names.

Coordinates are inclusive (length = end - begin + 1) where `closed` is true, else half-open (length = end - begin).
Rows whose sequence, begin or end is null take no part; reversed coordinates (begin > end) are put in order first.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.operators.scans import Dealt, Running, dealt
from loomspan.session import kept, shipped


def _ordered(df: DataFrame, seq: str, begin: str, end: str) -> DataFrame:
    rows = df.where(F.col(seq).isNotNull() & F.col(begin).isNotNull() & F.col(end).isNotNull())
    return rows.withColumns({begin: F.least(begin, end), end: F.greatest(begin, end)})


def _islands(df: DataFrame, seq: str, begin: str, end: str, island: str, slack: int) -> Dealt:
    """Dealt rows with the island and _fresh (the row begins one); a row goes on with an island if it begins before reach + slack."""
    rows = dealt(_ordered(df, seq, begin, end), key=[seq], order=[begin, end]).running(_reach=Running("max", F.col(end)))
    rows = rows.with_columns(_fresh=F.when(F.col("_reach").isNull() | (F.col(begin) >= F.col("_reach") + slack), 1).otherwise(0))
    return rows.running(**{island: Running("sum", F.col("_fresh"), own=True)})


def with_islands(df: DataFrame, *, seq: str, begin: str, end: str, island: str = "island", touching: bool = False, closed: bool = True) -> DataFrame:
    """df with the number of the island of overlapping intervals that a row is in.

    touching: intervals that only abut are one island (closed: end + 1 = begin counts as abutting). A sequence of any length
    is dealt to many tasks, which carry its furthest end and its islands' number over.
    """
    return _islands(df, seq, begin, end, island, int(touching) + int(closed)).rows.drop("_part", "_reach", "_fresh")


def union(df: DataFrame, *, seq: str, begin: str, end: str, touching: bool = False, closed: bool = True) -> DataFrame:
    """(seq, begin, end, members): merged intervals of each sequence."""
    rows = with_islands(df.select(seq, begin, end), seq=seq, begin=begin, end=end, island="_i", touching=touching, closed=closed)
    return rows.groupBy(seq, "_i").agg(F.min(begin).alias(begin), F.max(end).alias(end), F.count("*").alias("members")).drop("_i")


def _percent(part: Column, whole: Column) -> Column:
    """A part in percent to two places, the double's halves to even as numpy and the SQL's round_even take them (0.575 is 0.57)."""
    return F.rint(100 * part / whole * 100) / 100


def covered(df: DataFrame, *, seq: str, begin: str, end: str, length: str | None = None, closed: bool = True) -> DataFrame:
    """(seq, bp[, size, percent]): bases covered by at least one interval; percent of the sequence's length column."""
    merged = union(df, seq=seq, begin=begin, end=end, touching=True, closed=closed)
    out = merged.groupBy(seq).agg(F.sum(F.col(end) - F.col(begin) + int(closed)).alias("bp"))
    if length is None:
        return out
    sizes = df.where(F.col(seq).isNotNull()).groupBy(seq).agg(F.max(length).alias("size"))
    return sizes.join(out, seq, "left").select(seq, F.coalesce("bp", F.lit(0)).alias("bp"), "size", _percent(F.coalesce("bp", F.lit(0)), F.col("size")).alias("percent"))


def covered_whole(df: DataFrame, *, seq: str, begin: str, end: str, length: str, closed: bool = True) -> DataFrame:
    """One row (bp, size, percent) over all sequences."""
    per = covered(df, seq=seq, begin=begin, end=end, length=length, closed=closed)
    return per.agg(F.sum("bp").alias("bp"), F.sum("size").alias("size")).withColumn("percent", _percent(F.col("bp"), F.col("size")))


def _blocks(df: DataFrame, *, seq: str, begin: str, end: str, carry: list[str], apart: str | None = None) -> DataFrame:
    """(seq, begin, end, carry, _n, _lo, _hi, _came, _next): intervals at the blocks of their sequence that they touch.

    Rows are dealt to parts by ranges of (seq, begin); where a sequence goes on in another part there is a border, and blocks
    lie between borders. An interval that reaches over borders is in each of its blocks: _lo to _hi is what lies there; it
    came in over a border or not, and goes on over the border at _next (null if it ends before). So a block holds all that is
    open at its border, and blocks don't depend on each other. apart: a column in which all intervals that are open at a
    border must differ.
    """
    rows = _ordered(df.select(seq, begin, end, *carry), seq, begin, end)
    rows = kept(rows.repartitionByRange(seq, begin).withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy("_s").orderBy("_p")
    cuts = rows.groupBy(F.col(seq).alias("_s"), F.col("_part").alias("_p")).agg(F.min(begin).cast("long").alias("_cut"))
    cuts = cuts.withColumns({"_border": F.row_number().over(own) > 1, "_more": F.lead("_p").over(own).isNotNull()})
    cuts = kept(cuts.where("_border or _more").drop("_more"))

    def steps(cuts: DataFrame) -> DataFrame:
        """For parts of sequences that have several: the block, and where its next border is."""
        follows = own.rowsBetween(1, Window.unboundedFollowing)
        return cuts.select("_s", "_p", "_cut", "_border", F.count_if("_border").over(own).alias("_n"), F.min(F.when(F.col("_border"), F.col("_cut"))).over(follows).alias("_next"))

    def blocks(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pieces where intervals begin, and those that came in. Steps have two rows for each part at most."""
        mine = rows.join(F.broadcast(steps.select("_s", "_p", "_n", "_next")), (F.col(seq) == F.col("_s")) & (F.col("_part") == F.col("_p")), "left")
        mine = mine.select(seq, begin, end, *carry, F.coalesce("_n", F.lit(0)).alias("_n"), "_next")
        lists = steps.where("_border").groupBy("_s").agg(F.collect_list(F.struct("_n", "_cut", "_next")).alias("_borders"))
        over = mine.where(F.col(end) >= F.col("_next")).join(F.broadcast(lists), F.col(seq) == F.col("_s"))
        came = F.filter("_borders", lambda c: (c["_n"] > F.col("_n")) & (c["_cut"] <= F.col(end)))
        over = over.select(seq, begin, end, *carry, F.explode(came).alias("c")).select(seq, begin, end, *carry, "c._n", F.col("c._cut").alias("_lo"), "c._next")
        return mine.withColumn("_lo", F.col(begin).cast("long")), over

    first = steps(cuts)
    if apart:
        _, over = blocks(first)
        value = F.nanvl(F.coalesce(F.col(apart).cast("double"), F.lit(float("-inf"))), F.lit(float("-inf"))).alias("_v")
        tied = over.groupBy(F.col(seq).alias("_s"), F.col("_lo").alias("_cut"), value).count().where("count > 1").select("_s", "_cut").distinct()
        marked = cuts.join(tied.withColumn("_tied", F.lit(True)), ["_s", "_cut"], "left")
        first = steps(kept(marked.withColumn("_border", F.col("_border") & F.col("_tied").isNull()).drop("_tied")))
    both = [x.withColumn("_came", F.lit(came)) for x, came in zip(blocks(first), (False, True))]
    goes = F.when(F.col(end) >= F.col("_next"), F.col("_next"))
    return both[0].unionByName(both[1]).withColumns({"_hi": F.least(F.col(end).cast("long"), F.col("_next") - 1), "_next": goes})


#: Pieces that are laid out at once.
SWEPT = 100_000


def _won(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The ground that each piece wins, where the piece of highest rank over a place wins it; ranks are 0 to n - 1.

    A piece covers elementary stretches; it marks two ranges of a power of two that cover them, and marks go down by halves.
    """
    low, span = lo.min(), hi.max() - lo.min() + 2
    starts, ends = group * span + lo - low, group * span + hi + 1 - low
    points = np.unique(np.concatenate([starts, ends]))
    first, last = np.searchsorted(points, starts), np.searchsorted(points, ends)
    level = np.frexp((last - first).astype(float))[1] - 1
    marks = np.full(len(points), -1)
    for k in range(int(level.max()), -1, -1):
        half = 1 << k
        if 2 * half <= len(points):  # marks are of ranges twice as long
            finer = marks.copy()
            np.maximum(finer[half:], marks[:-half], out=finer[half:])
            marks = finer
        on = level == k
        np.maximum.at(marks, first[on], rank[on])
        np.maximum.at(marks, last[on] - half, rank[on])
    best = marks[:-1]
    got = np.zeros(len(rank), np.int64)
    np.add.at(got, best[best >= 0], np.diff(points)[best >= 0])
    return got[rank]


def _resolved(parts: Iterator[pd.DataFrame], names: list[str], bp: str, stretch: int) -> Iterator[pd.DataFrame]:
    """Pieces sorted by sequence, block and _lo, laid out a stretch at a time: what is open behind the stretch goes on to the next."""
    seq, begin, score, id = names
    held: list[pd.DataFrame] = []
    new = open = 0  # rows that came since the last layout, and those that it left

    def lay(rows: pd.DataFrame, key: tuple | None) -> tuple[pd.DataFrame, pd.DataFrame | None]:
        """Rows that are done; rows of key's block go on behind its place. All other blocks end here."""
        block = pd.factorize(rows[seq])[0].astype(np.int64) * (int(rows["_n"].max()) + 1) + rows["_n"].to_numpy()
        group = np.unique(block, return_inverse=True)[1]
        lo, hi = rows["_lo"].to_numpy(), rows["_hi"].to_numpy()
        stop = hi
        if key is not None:
            here = ((rows[seq] == key[0][0]) & (rows["_n"] == key[0][1])).to_numpy()
            stop = np.where(here, np.minimum(hi, key[1] - 1), hi)
        on = stop >= lo
        worth = rows[score].astype(float).fillna(float("-inf")).to_numpy()
        order = np.lexsort((pd.factorize(rows[id], sort=True)[0], rows[begin].to_numpy(), worth))
        rank = np.empty(len(rows), np.int64)
        rank[order[on[order]]] = np.arange(on.sum())
        got = rows["_got"].to_numpy().copy()
        if on.any():
            got[on] += _won(group[on], lo[on], stop[on], rank[on])
        rows = rows.assign(_got=got)
        ends = hi <= stop
        left = rows[~ends].assign(_lo=key[1]) if key is not None else None
        return rows[ends], left

    def out(rows: pd.DataFrame) -> pd.DataFrame:
        return rows[[seq, id]].assign(**{bp: rows["_got"].to_numpy()})

    for part in parts:
        held.append(part.assign(_got=np.int64(0)))
        new += len(part)
        if new >= max(stretch, open):  # however many are open, a row is laid out a few times
            rows = pd.concat(held, ignore_index=True)
            at = rows.iloc[-1]
            place = (at[seq], at["_n"])
            ready = (rows[seq] != place[0]) | (rows["_n"] != place[1]) | (rows["_lo"] < at["_lo"])
            done, left = lay(rows[ready].reset_index(drop=True), (place, at["_lo"])) if ready.any() else (rows[:0], None)
            held = [x for x in (left, rows[~ready]) if x is not None and len(x)]
            new, open = 0, sum(map(len, held))
            yield out(done)
    if held:
        yield out(lay(pd.concat(held, ignore_index=True), None)[0])


def resolve_overlap(df: DataFrame, *, seq: str, begin: str, end: str, score: str, id: str, bp: str = "bp_algor") -> DataFrame:
    """(seq, id, bp): each base goes to the best interval over it (highest score, then later begin, then larger id).

    Inclusive coordinates; `id` must be unique within a sequence; a null score is the least. A sequence is cut into blocks,
    which tasks resolve side by side, however long its islands; work grows as n log n, nested intervals or not.
    """
    pieces = _blocks(df, seq=seq, begin=begin, end=end, carry=[score, id])
    order = pieces.select(seq, "_n", "_lo", "_hi", begin, F.col(score).cast("double").alias(score), id).repartition(seq, "_n").sortWithinPartitions(seq, "_n", "_lo")
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in (seq, id)] + [T.StructField(bp, T.LongType())])
    shipped(df.sparkSession)
    names, stretch = [seq, begin, score, id], SWEPT
    return order.mapInPandas(lambda parts: _resolved(parts, names, bp, stretch), schema).groupBy(seq, id).agg(F.sum(bp).alias(bp))


class _InTurn:
    """Ground goes to one owner at a time. A newcomer takes over unless its score is less; whoever loses the ground waits."""

    def __init__(self) -> None:
        self.got: dict[object, int] = {}
        self.heap: list[tuple[float, int, object]] = []
        self.owner: tuple[object, float] | None = None
        self.since, self.waited = 0, 0

    def _wait(self, id: object, score: float) -> None:
        self.waited += 1
        heapq.heappush(self.heap, (-score, self.waited, id))

    def came(self, id: object, score: float, at: int) -> None:
        """An interval that was open at the block's border: the best of them owns, the others wait, and no two are equal."""
        self.got[id] = 0
        self._wait(id, score)
        if self.owner is None or self.owner[1] < score:
            self.owner, self.since = (id, score), at

    def open(self, id: object, score: float, at: int) -> None:
        self.got[id] = 0
        if self.owner and self.owner[1] > score:
            self._wait(id, score)
            return
        if self.owner:
            self.got[self.owner[0]] += at - self.since
            self._wait(*self.owner)
        self.owner, self.since = (id, score), at

    def close(self, id: object, at: int) -> int:
        if self.owner and self.owner[0] == id:
            self.got[id] += at - self.since + 1
            self.owner, self.since = None, at + 1
        got = self.got.pop(id)
        while self.owner is None and self.heap:
            score, _, first = heapq.heappop(self.heap)
            if first in self.got:  # those that closed while waiting are dropped here
                self.owner = (first, -score)
        return got

    def leave(self, id: object, at: int) -> int:
        """An interval that goes on over the block's border; so do all others that are open."""
        return self.got.pop(id) + (at - self.since if self.owner and self.owner[0] == id else 0)


#: Kinds of events, in their order at one place for an interval.
CAME, OPEN, CLOSE, LEAVE = -1, 0, 1, 2


def resolve_overlap_sequential(df: DataFrame, *, seq: str, begin: str, end: str, score: str, order: str, bp: str = "bp_algor") -> DataFrame:
    """(seq, order, bp): bases by the order-dependent rule; `order` is the unique row order.

    Points are visited by position, then row order, a row's begin before its end. A later opening takes over unless its
    score is less; when the owner ends, the best of those that wait goes on behind it, of equal ones the one that has waited
    longest. So an interval that begins where the owner before it ends counts that base again.

    A sequence is cut where the open intervals all differ in score: there the rule's state is known from them alone, the best
    one owning. Where many overlapping intervals share a score, as with whole-number qualities, blocks grow longer, and a
    task streams its block's events, holding only the intervals that are open at one place.
    """
    pieces = _blocks(df, seq=seq, begin=begin, end=end, carry=[score, order], apart=score)
    event = lambda kind, at: F.struct(at.cast("long").alias("_at"), F.lit(kind).alias("_kind"))
    first = F.when(F.col("_came"), event(CAME, F.col("_lo"))).otherwise(event(OPEN, F.col("_lo")))
    last = F.when(F.col("_next").isNull(), event(CLOSE, F.col(end))).otherwise(event(LEAVE, F.col("_next")))
    events = pieces.select(seq, "_n", order, F.col(score).cast("double").alias("_s"), F.explode(F.array(first, last)).alias("_e")).select(seq, "_n", order, "_s", "_e.*")
    events = events.repartition(seq, "_n").sortWithinPartitions(seq, "_n", "_at", F.col("_kind") != CAME, order, "_kind")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, block = _InTurn(), None
        for part in parts:
            seqs, ids, got = [], [], []
            for s, n, i, score, at, kind in zip(*(part[c].tolist() for c in (seq, "_n", order, "_s", "_at", "_kind"))):
                if (s, n) != block:
                    state, block = _InTurn(), (s, n)
                if kind <= OPEN:
                    (state.open if kind == OPEN else state.came)(i, float("-inf") if score is None or score != score else score, at)
                else:
                    got.append((state.close if kind == CLOSE else state.leave)(i, at))
                    seqs.append(s)
                    ids.append(i)
                    if not state.got:
                        state = _InTurn()
            yield pd.DataFrame({seq: pd.Series(seqs, dtype=object), order: pd.Series(ids, dtype=object), bp: pd.Series(got, dtype="int64")}, columns=[seq, order, bp])

    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in (seq, order)] + [T.StructField(bp, T.LongType())])
    shipped(df.sparkSession)
    return events.mapInPandas(run, schema).groupBy(seq, order).agg(F.sum(bp).alias(bp))


def estimators(df: DataFrame, *, group: list[str], naive: str, algor: str, overlapping: str, genome: str | None = None) -> DataFrame:
    """Long (group, algorithm, bp, percent_naive[, percent_genome]): naive, best (not overlapping) and resolved bases."""
    sums = df.groupBy(*group).agg(
        F.sum(naive).alias("naive"),
        F.coalesce(F.sum(F.when(~F.col(overlapping), F.col(naive))), F.lit(0)).alias("best"),
        F.sum(algor).alias("algor"),
        *([F.max(genome).alias("_genome")] if genome else []),
    )
    long = sums.select(*group, F.expr("stack(3, 'naive', naive, 'best', best, 'algor', algor) as (algorithm, bp)"), F.col("naive").alias("_naive"), *(["_genome"] if genome else []))
    out = long.withColumn("percent_naive", F.when(F.col("_naive") != 0, 100 * F.col("bp") / F.col("_naive")).otherwise(0.0))
    if genome:
        out = out.withColumn("percent_genome", 100 * F.col("bp") / F.col("_genome")).drop("_genome")
    return out.drop("_naive")


def gaps(df: DataFrame, *, seq: str, begin: str, end: str, length: str, keep_zero: bool = False) -> DataFrame:
    """(seq, region, begin, end, bp, position): mapped and unmapped stretches of each sequence, half-open from 0.

    Unmapped: before the first merged interval, between them and after the last. position is the stretch's centre in
    percent of the sequence, whole numbers. Zero gaps are dropped unless keep_zero.
    """
    sizes = df.where(F.col(seq).isNotNull()).groupBy(seq).agg(F.min(length).alias("_size"))
    merged = union(df, seq=seq, begin=begin, end=end, closed=False).select(seq, begin, end).join(sizes, seq)
    rows = dealt(merged, key=[seq], order=[begin, end]).running(_before=Running("last", F.col(end))).running(ahead=True, _after=Running("last", F.col(begin))).rows
    rows = rows.withColumns({"_prev": F.coalesce("_before", F.lit(0)), "_last": F.col("_after").isNull()})
    piece = lambda region, b, e: F.struct(F.lit(region).alias("region"), b.cast("long").alias("begin"), e.cast("long").alias("end"))
    parts = F.array(
        piece("mapped", F.col(begin), F.col(end)),
        piece("unmapped", F.col("_prev"), F.col(begin)),
        F.when(F.col("_last"), piece("unmapped", F.col(end), F.col("_size"))),
    )
    out = rows.select(seq, "_size", F.explode(parts).alias("p")).where("p is not null").select(seq, "_size", "p.*")
    out = out.withColumn("bp", F.col("end") - F.col("begin"))
    if not keep_zero:
        out = out.where("region = 'mapped' or bp != 0")
    return out.withColumn("position", F.floor((F.col("begin") + F.col("end")) / (0.02 * F.col("_size"))).cast("int")).drop("_size")


def consecutive_gaps(df: DataFrame, *, seq: str, begin: str, end: str) -> DataFrame:
    """(seq, begin, gap): positive distances from the end of the row before, by begin (nested rows included)."""
    rows = dealt(_ordered(df.select(seq, begin, end), seq, begin, end), key=[seq], order=[begin, end])
    return rows.running(_before=Running("last", F.col(end))).rows.withColumn("gap", F.col(begin) - F.col("_before")).where("gap > 0").select(seq, begin, "gap")


#: Pairs of a batch, and rows that are met at once.
PAIRS, MET = 100_000, 50_000


def _meetings(lo: np.ndarray, hi: np.ndarray, right: np.ndarray, new: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left, right) places of rows that overlap, a batch at a time; rows are sorted by lo, and one of the two is at `new` or later.

    The later of two rows begins within the earlier one. So each row's partners that come after it are a stretch of the
    other side's rows: from the row's own place to the last one that begins before it ends.
    """
    for side in (False, True):
        own, other = np.flatnonzero(right == side), np.flatnonzero(right != side)
        first = np.searchsorted(other, np.maximum(own, new - 1), "right")
        count = np.maximum(np.searchsorted(lo[other], hi[own], "right") - first, 0)
        upto = np.cumsum(count)
        for start in range(0, int(upto[-1]) if len(upto) else 0, PAIRS):
            k = np.arange(start, min(start + PAIRS, int(upto[-1])))
            row = np.searchsorted(upto, k, "right")
            mine, theirs = own[row], other[first[row] + k - (upto[row] - count[row])]
            yield (theirs, mine) if side else (mine, theirs)


def overlap_join(left: DataFrame, right: DataFrame, *, seq: str, begin: str, end: str, closed: bool = True) -> DataFrame:
    """Pairs of overlapping rows: left's columns, and right's with the suffix _r, of equal sequence.

    A sort-merge sweep. Both sides together are cut into blocks; a row that reaches over a border goes on in the next block,
    so a block's task needs nothing else. It streams its rows by begin and holds those that are still open. A pair is found
    where the later one begins, hence once, however many rows lie at one place. Rows with begin > end meet none.
    """
    names = [*left.columns, *[f"{c}_r" for c in right.columns]]
    if len(set(names)) < len(names):
        raise ValueError("a column of the left side is named like one of the right side with the suffix _r")
    sides = []
    for k, df in enumerate((left, right)):
        row = [F.struct(*x.columns) if i == k else F.lit(None).cast(x.schema) for i, x in enumerate((left, right))]
        whole = df.where(F.col(begin) <= F.col(end))
        sides.append(whole.select(F.col(seq).alias("_seq"), F.col(begin).cast("long").alias("_b"), F.col(end).cast("long").alias("_e"), F.lit(k).alias("_side"), row[0].alias("_l"), row[1].alias("_r")))
    pieces = _blocks(sides[0].union(sides[1]), seq="_seq", begin="_b", end="_e", carry=["_side", "_l", "_r"])
    pieces = pieces.select("_seq", "_n", "_came", "_lo", F.col("_e").alias("_hi"), "_b", "_side", "_l", "_r")
    pieces = pieces.repartition("_seq", "_n").sortWithinPartitions("_seq", "_n", F.desc("_came"), "_lo")
    width = MET

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: pa.Table | None = None
        done = 0  # rows that have met each other
        for part in parts:
            more = pa.Table.from_batches([part])
            rows = more if rows is None else pa.concat_tables([rows, more])
            if rows.num_rows - done >= width:
                yield from met(rows, done)
                rows = still_open(rows)
                done = rows.num_rows
        if rows is not None and rows.num_rows > done:
            yield from met(rows, done)

    def column(rows: pa.Table, name: str) -> np.ndarray:
        return rows.column(name).to_numpy()

    def block(rows: pa.Table) -> np.ndarray:
        """Numbers of the blocks, in order."""
        s, n = rows.column("_seq").combine_chunks().dictionary_encode().indices.to_numpy(), column(rows, "_n")
        return np.cumsum(np.r_[0, (np.diff(s) != 0) | (np.diff(n) != 0)])

    def still_open(rows: pa.Table) -> pa.Table:
        """What may meet rows that follow: of the last block, all that doesn't end before the last row begins."""
        b, hi, lo = block(rows), column(rows, "_hi"), column(rows, "_lo")
        return rows.take(np.flatnonzero((b == b[-1]) & (hi >= lo[-1])))

    def met(rows: pa.Table, done: int) -> Iterator[pa.RecordBatch]:
        b, lo, hi, came = block(rows), column(rows, "_lo"), column(rows, "_hi"), column(rows, "_came").astype(np.int64)
        begins, right = column(rows, "_b"), column(rows, "_side") == 1
        data = [rows.column(c).combine_chunks() for c in ("_l", "_r")]
        edges = np.r_[np.flatnonzero(np.r_[True, np.diff(b) != 0]), len(b)]
        came_in = np.add.reduceat(came, edges[:-1])
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            places = [pa.array(np.concatenate(k)) for k in zip(*held)]
            held.clear()
            return pa.RecordBatch.from_arrays([f for d, k in zip(data, places) for f in d.take(k).flatten()], names=names)

        for start, stop, some in zip(edges.tolist(), edges[1:].tolist(), came_in.tolist()):
            if stop <= done:
                continue
            new = max(done - start, some)  # those that came in have met in a block before
            for x, y in _meetings(lo[start:stop], hi[start:stop], right[start:stop], new):
                x, y = x + start, y + start
                if not closed:
                    on = (begins[x] < hi[y]) & (hi[x] > begins[y])
                    x, y = x[on], y[on]
                held.append((x, y))
                size += len(x)
                if size >= PAIRS:
                    yield out()
                    size = 0
        if held:
            yield out()

    shipped(left.sparkSession)
    types = [T.StructField(n, f.dataType) for n, f in zip(names, [*left.schema.fields, *right.schema.fields])]
    return pieces.mapInArrow(meet, T.StructType(types))


def overlapping_pairs(df: DataFrame, *, seq: str, begin: str, end: str, id: str, closed: bool = True) -> DataFrame:
    """(seq, id, id_r): all unordered pairs of overlapping intervals."""
    rows = df.select(seq, begin, end, id)
    return overlap_join(rows, rows, seq=seq, begin=begin, end=end, closed=closed).where(F.col(id) < F.col(f"{id}_r")).select(seq, id, f"{id}_r")


def overlapping_ids(df: DataFrame, *, seq: str, begin: str, end: str, id: str, closed: bool = True) -> DataFrame:
    """(seq, id) of intervals that overlap another one."""
    slack = int(closed)
    rows = dealt(_ordered(df.select(seq, begin, end, id), seq, begin, end), key=[seq], order=[begin, end, id])
    rows = rows.running(_reach=Running("max", F.col(end))).running(ahead=True, _after=Running("last", F.col(begin))).rows
    meets = lambda later, reach: F.coalesce(later < reach + slack, F.lit(False))
    return rows.where(meets(F.col(begin), F.col("_reach")) | meets(F.col("_after"), F.col(end))).select(seq, id)


def clipped(df: DataFrame, *, begin: str, end: str) -> DataFrame:
    """overlap_join's result with the common stretch (clip_begin, clip_end)."""
    return df.withColumns({"clip_begin": F.greatest(begin, f"{begin}_r"), "clip_end": F.least(end, f"{end}_r")})


def ends_inside(points: DataFrame, regions: DataFrame, *, seq: str, begin: str, end: str) -> DataFrame:
    """Rows of points whose begin or end lies inside a region (inclusive); a row that spans a region isn't in it."""
    both = overlap_join(points, regions, seq=seq, begin=begin, end=end)
    return both.where(F.col(begin).between(F.col(f"{begin}_r"), F.col(f"{end}_r")) | F.col(end).between(F.col(f"{begin}_r"), F.col(f"{end}_r")))


def reversed_coordinates(df: DataFrame, *, seq: str, begin: str, end: str, length: str, ids: list[str]) -> DataFrame:
    """df with the coordinates of some sequences counted from the other end."""
    turn = F.col(seq).isin(ids)
    return df.withColumns({begin: F.when(turn, F.col(length) - F.col(end)).otherwise(F.col(begin)), end: F.when(turn, F.col(length) - F.col(begin)).otherwise(F.col(end))})


def padded(df: DataFrame, *, begin: str, end: str, length: str, by: Column) -> DataFrame:
    """df with intervals widened on both sides by an expression, within [0, length]."""
    return df.withColumns({begin: F.greatest(F.col(begin) - by, F.lit(0)), end: F.least(F.col(end) + by, F.col(length))})


def distance(begin_a: str, end_a: str, begin_b: str, end_b: str) -> Column:
    """0 for overlapping intervals, else from the end of the first to the start of the second."""
    return F.greatest(F.greatest(begin_a, begin_b) - F.least(end_a, end_b), F.lit(0))


def alignment_overlap(df: DataFrame, *, id: str, sides: dict[str, tuple[str, str, str]], score: str) -> DataFrame:
    """df with <side>algorbp for each side (sequence, begin, end) of an alignment, resolved by score (half-open input)."""
    stack = F.explode(F.array(*[F.struct(F.lit(k).alias("_side"), F.col(s).alias("_seq"), F.col(b).alias("_b"), (F.col(e) - 1).alias("_e")) for k, (s, b, e) in sides.items()]))
    long = df.select(F.col(id), F.col(score).alias("_score"), stack.alias("p")).select(id, "_score", "p.*")
    keyed = long.where("_seq is not null").withColumn("_key", F.concat("_side", F.lit(":"), F.col("_seq").cast("string")))
    won = resolve_overlap(keyed, seq="_key", begin="_b", end="_e", score="_score", id=id)
    wide = won.groupBy(id).agg(*[F.max(F.when(F.col("_key").startswith(f"{k}:"), F.col("bp_algor"))).alias(f"{k}algorbp") for k in sides])
    return df.join(wide, id, "left")


def subset_lengths(df: DataFrame, *, group: list[str], seq: str, length: str) -> DataFrame:
    """(group, size): the summed lengths of a group's sequences, each counted once by its smallest stated length."""
    per = df.where(F.col(seq).isNotNull()).groupBy(*group, seq).agg(F.min(length).alias("_l"))
    return per.groupBy(*group).agg(F.sum("_l").alias("size"))


def overlap_report(df: DataFrame, *, group: list[str], seq: str, length: str, naive: str, algor: str) -> DataFrame:
    """(group, algorithm, bp, percent_naive, percent_subset): naive and resolved bases of each side and subset of alignments.

    df has a row for each side (and subset) of an alignment; percentages of naive bases are 0 where there are none.
    """
    sums = df.groupBy(*group).agg(F.coalesce(F.sum(naive), F.lit(0)).alias("naive"), F.coalesce(F.sum(algor), F.lit(0)).alias("algor"))
    both = sums.join(subset_lengths(df, group=group, seq=seq, length=length), group)
    long = both.select(*group, F.expr("stack(2, 'naive', naive, 'algor', algor) as (algorithm, bp)"), F.col("naive").alias("_n"), "size")
    share = F.when(F.col("_n") != 0, 100 * F.col("bp") / F.col("_n")).otherwise(0.0)
    return long.select(*group, "algorithm", "bp", share.alias("percent_naive"), (100 * F.col("bp") / F.col("size")).alias("percent_subset"))


def region_table(df: DataFrame, *, keys: list[str], seq: str, begin: str, end: str, length: str, values: list[str]) -> DataFrame:
    """(keys, seq, region, bp): mapped and unmapped stretches of each sequence, and each row's values as regions of their own.

    keys belong to the sequences (a side, a subset). values: alignment length, matches, mismatches and the like.
    """
    names = df.select(seq, *keys).distinct()
    stretches = gaps(df.dropDuplicates([seq, begin, end]), seq=seq, begin=begin, end=end, length=length).select(seq, "region", "bp").join(names, seq)
    own = df.select(*keys, seq, F.expr(f"stack({len(values)}, {', '.join(f'{v!r}, cast({v} as bigint)' for v in values)}) as (region, bp)"))
    return stretches.select(*keys, seq, "region", "bp").unionByName(own.where("bp is not null"))


def adjacent_pairs(df: DataFrame, *, seq: str, begin: str, end: str, id: str) -> DataFrame:
    """(seq, id, id_next): neighbours by begin (then end, id) that overlap, each row in one pair at most, from the left.

    Of a chain of overlapping neighbours the first and second pair up, then the third and fourth.
    """
    rows = dealt(_ordered(df.select(seq, begin, end, id), seq, begin, end), key=[seq], order=[begin, end, id])
    rows = rows.running(ahead=True, _next=Running("last", F.col(id)), _after=Running("last", F.col(begin)))
    rows = rows.with_columns(_over=F.coalesce(F.col("_after") <= F.col(end), F.lit(False)))
    rows = rows.running(_joined=Running("last", F.col("_over")), _n=Running("sum", F.lit(1), own=True)).kept()
    # a chain begins at a row that doesn't overlap the one before
    rows = rows.running(_first=Running("last", F.when(~F.coalesce("_joined", F.lit(False)), F.col("_n")), own=True)).rows
    return rows.where(F.col("_over") & ((F.col("_n") - F.col("_first")) % 2 == 0)).select(seq, id, F.col("_next").alias(f"{id}_next"))


def margins(df: DataFrame, *, sides: dict[str, tuple[str, str, str, str]], id: str, margin: int) -> DataFrame:
    """(id, side, seq, begin, end, tag): a window around each side (sequence, begin, end, length) of an alignment, within the sequence.

    tag: side, sequence and window as text, for regions that are cut out of sequences.
    """
    parts = [F.struct(F.lit(k).alias("side"), F.col(s).cast("string").alias("seq"), F.greatest(F.col(b) - margin, F.lit(0)).alias("begin"), F.least(F.col(e) + margin, F.col(n)).alias("end")) for k, (s, b, e, n) in sides.items()]
    rows = df.select(id, F.explode(F.array(*parts)).alias("p")).select(id, "p.*")
    return rows.withColumn("tag", F.concat_ws(":", "side", "seq", F.concat_ws("-", "begin", "end")))
