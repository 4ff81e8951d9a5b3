"""Sharding along a Hilbert curve (operator 10).

Metadata dimensions are quantised to a few bits each, a row gets the Hilbert index of its cell, rows are sorted by index
and the order is cut into runs. Neighbouring cells stay in few files, so that filters on any of the dimensions prune
files. Shards hold equally many rows (at most one apart).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import or_empty, ranked, unused

LEVELS = 5  # bits of a dimension


def hilbert(coords: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert indices of points (rows x dimensions) with coordinates of `bits` bits.

    The bits of all coordinates are Gray-decoded level by level: each level's reflection and exchange is undone in the
    lower bits, then the levels are interleaved.
    """
    x = coords.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for d in range(n):
            flip = (x[d] & bit) != 0
            swap = np.where(flip, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[d] ^= swap
    for d in range(1, n):
        x[d] ^= x[d - 1]
    carry = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        carry ^= np.where(x[n - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= carry
    out = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(n):
            out = (out << 1) | ((x[d] >> level) & 1)
    return out


def curve(df: DataFrame, dims: dict[str, Column], bits: int = LEVELS) -> DataFrame:
    """df with _curve. dims: numbers are cut at their 2**bits - 1 inner quantiles, anything else is hashed; null is cell 0."""
    if bits * len(dims) > 62:
        raise ValueError("too many bits for one index")
    cells, top = 1 << bits, (1 << bits) - 1
    df = df.withColumns({f"_d{i}": c for i, c in enumerate(dims.values())})
    kinds = dict(df.dtypes)
    numbers = [f"_d{i}" for i in range(len(dims)) if kinds[f"_d{i}"] in ("tinyint", "smallint", "int", "bigint", "float", "double")]
    cuts = dict(zip(numbers, df.select(*[F.col(c).cast("double") for c in numbers]).approxQuantile(numbers, [k / cells for k in range(1, cells)], 0.002))) if numbers else {}
    coords = []
    for i in range(len(dims)):
        c = F.col(f"_d{i}")
        if f"_d{i}" in cuts:
            edges = F.array(*[F.lit(float(x)) for x in sorted(set(cuts[f"_d{i}"]))]).cast("array<double>")
            cell = F.size(F.filter(edges, lambda e: e < c.cast("double")))  # noqa: B023
        else:
            cell = F.pmod(F.xxhash64(c), F.lit(cells)).cast("int")
        coords.append(F.coalesce(F.least(cell, F.lit(top)), F.lit(0)))

    @F.pandas_udf("long")
    def index(*parts: pd.Series) -> pd.Series:
        return pd.Series(hilbert(np.stack([p.to_numpy() for p in parts], axis=1), bits) if len(parts[0]) else [], dtype="int64")

    return df.withColumn("_curve", index(*coords)).drop(*[f"_d{i}" for i in range(len(dims))])


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    Dimensions: text bytes, language, source, doc_id. Ties on the curve are ordered by the text's checksum, so that equal
    texts of one cell lie side by side, then by doc_id. Row r of n goes to shard floor(r shards / n), at its place in the run. A null
    text counts as empty (size 1); repeated rows keep separate places.
    """
    rows = docs.select(
        "doc_id",
        (F.octet_length(or_empty(F.col("text"))) + 1).cast("long").alias("size"),
        F.crc32(or_empty(F.col("text"))).alias("text_crc32"),
        F.col("lang").alias("_lang"),
        F.col("source").alias("_source"),
    )
    rows = curve(rows, {"size": F.col("size"), "lang": F.col("_lang"), "source": F.col("_source"), "doc_id": F.col("doc_id")})
    placed = ranked(rows.drop("_lang", "_source"), ["_curve", "text_crc32", "doc_id"], "_rank")
    n = placed.agg(F.count("*")).first()[0]
    if not n:
        n = 1
    shard = F.expr(f"(_rank * {shards}L) div {n}L")
    start = F.expr(f"(({shards}L - 1) + ((_rank * {shards}L) div {n}L) * {n}L) div {shards}L")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        shard.cast("int").alias("shard"),
        (F.col("_rank") - start).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Writes docs, all columns, as folders shard=<n>, or shard_=<n> if there is a column shard; docs must have unique doc_ids."""
    key, slot, shard = unused(docs.columns, "id", "slot", "shard")
    place = sharded(docs, shards).select(F.col("doc_id").alias(key), F.col("shard").alias(shard), F.col("slot").alias(slot))
    rows = docs.join(place, docs["doc_id"].eqNullSafe(F.col(key))).drop(key)
    rows.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).drop(slot).write.partitionBy(shard).parquet(path)
