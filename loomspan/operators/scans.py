"""Prefix scans over rows in order, for keys of any size.

A window over a whole key runs in one task, and a genome has a handful of sequences. Here rows are dealt to parts of even size
by ranges of (key, order), so a long key spans many parts. A running value is worked out within each part, and what the
key's earlier parts add is carried in: one row for each part, from a table of one row for each part and key.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.session import kept


@dataclass(frozen=True)
class Running:
    """A value over the rows before (with `own`, also the row itself): max, min, sum, or last, the nearest one not null."""

    kind: str
    of: Column
    own: bool = False

    def over(self, rows) -> Column:
        take = {"max": F.max, "min": F.min, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}[self.kind]
        return take(self.of).over(rows.rowsBetween(Window.unboundedPreceding, 0 if self.own else -1))

    def total(self, order: Column, ahead: bool) -> Column:
        if self.kind == "last":
            pick = F.min_by if ahead else F.max_by
            return pick(self.of, F.when(self.of.isNotNull(), order))
        return {"max": F.max, "min": F.min, "sum": F.sum}[self.kind](self.of)

    def joined(self, carried: Column, within: Column) -> Column:
        if self.kind == "last":
            return F.coalesce(within, carried)
        if self.kind == "sum":
            return F.coalesce(carried + within, carried, within)
        return (F.greatest if self.kind == "max" else F.least)(carried, within)  # both pass over nulls


@dataclass(frozen=True)
class Dealt:
    """Rows in parts (column _part) by ranges of (key, order). Rows equal in all of these are in one part."""

    rows: DataFrame
    key: tuple[str, ...]
    order: tuple[str, ...]

    def with_columns(self, **columns: Column) -> Dealt:
        return replace(self, rows=self.rows.withColumns(columns))

    def running(self, ahead: bool = False, **values: Running) -> Dealt:
        """With a column for each running value; ahead: over the rows that follow instead."""
        turn = (lambda c: F.col(c).desc()) if ahead else (lambda c: F.col(c).asc())
        within = Window.partitionBy("_part", *self.key).orderBy(*[turn(c) for c in self.order])
        place = F.struct(*self.order)
        sums = self.rows.groupBy("_part", *self.key).agg(*[v.total(place, ahead).alias(n) for n, v in values.items()])
        parts = Window.partitionBy(*self.key).orderBy(turn("_part"))
        before = [replace(v, of=F.col(n), own=False).over(parts).alias(f"_c_{n}") for n, v in values.items()]
        keys = {k: f"_k{i}" for i, k in enumerate(self.key)}
        carried = sums.select(F.col("_part").alias("_p"), *[F.col(k).alias(c) for k, c in keys.items()], *before)
        carried = carried.where(reduce(or_, [F.col(f"_c_{n}").isNotNull() for n in values]))
        # a part has one key at most that began in a part before: no more rows than parts
        meet = reduce(and_, [F.col(k).eqNullSafe(F.col(c)) for k, c in keys.items()], F.col("_part") == F.col("_p"))
        rows = self.rows.withColumns({f"_w_{n}": v.over(within) for n, v in values.items()}).join(F.broadcast(carried), meet, "left")
        rows = rows.withColumns({n: v.joined(F.col(f"_c_{n}"), F.col(f"_w_{n}")) for n, v in values.items()})
        return replace(self, rows=rows.drop("_p", *keys.values(), *[f"_{x}_{n}" for n in values for x in "cw"]))

    def kept(self) -> Dealt:
        """With its rows written, so that further scans don't work out the ones before again."""
        return replace(self, rows=kept(self.rows).repartitionByRange("_part"))


def dealt(df: DataFrame, *, key: list[str], order: list[str]) -> Dealt:
    """df's rows (written once) dealt to parts. A null key is a key like any other."""
    rows = kept(df.repartitionByRange(*key, *order).withColumn("_part", F.spark_partition_id()))
    # read again in the same parts: ranges of part numbers, which windows by part need no other shuffle for
    return Dealt(rows.repartitionByRange("_part"), tuple(key), tuple(order))
