"""Merkle dataset manifest by nested-struct rollup (operator 12).

Every row is a leaf; a tree (one for each language) pairs consecutive nodes level by level. A row's rank in its tree is
written in digits. Blocks of FAN ** DEPTH leaves are dealt to tasks once, and within a block the digits are grouped away
from the last to the first: each grouping nests the structs of its children in a node and hashes them. So a block becomes
one row, whose struct holds all of its nodes. Blocks are leaves of the next layer, until each tree has one block.

Going down, explode takes a node's children apart again and hands each the hashes beside it, so the proofs inside a block
need no join. Only what lies above a block is joined to it, one row for each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import ranked, sized, unused, written

#: Nodes that become one, and digits of a block: of a tree's leaves, and of the trees, which are mostly few.
FAN, DEPTH, TOP_DEPTH = 2, 10, 4

_STEP = "struct<left:string,right:string>"


def hashed(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated texts."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """'-' for null, else UTF-8 byte count, ':' and the value, so that no two rows have equal inputs."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _rolled(nodes: DataFrame, fan: int, depth: int) -> DataFrame:
    """(tree, block, n, node): nodes (tree, r, n, h, item), n to a tree, rolled up in blocks.

    A level exists for a tree only while it has several nodes; at others the node is handed up as it is.
    """
    block = F.floor(F.col("r") / fan**depth).cast("long")
    rows = nodes.select("tree", "n", block.alias("block"), F.col("r").alias("place"), F.struct("h", "item").alias("node"))
    rows = rows.repartition("tree", "block")
    for level in range(depth):
        up = F.floor(F.col("place") / fan).cast("long")
        rows = rows.groupBy("tree", "block", up.alias("up")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("place", "node"))).alias("kids"))
        several = F.col("n") > fan**level
        joined = F.sha2(F.array_join(F.transform("kids", lambda k: k["node"]["h"]), ""), 256)
        h = F.when(several, joined).otherwise(F.col("kids")[0]["node"]["h"])
        kids = F.transform("kids", lambda k: k["node"])
        rows = rows.select("tree", "block", "n", F.col("up").alias("place"), F.struct(h.alias("h"), several.alias("several"), kids.alias("kids")).alias("node"))
    return rows.select("tree", "block", "n", "node")


def _proofs(nodes: DataFrame, fan: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """(tree, item, path, root): for each node what stands beside it on the way up, bottom first; and each tree's (tree, root)."""
    rolled = written(_rolled(nodes, fan, depth))
    rows = rolled.select("tree", "block", "n", "node", F.lit(None).cast(f"array<{_STEP}>").alias("path"), F.col("node")["h"].alias("root"))
    roots = rolled.select("tree", F.col("node")["h"].alias("root"))
    if not rolled.where(F.col("n") > fan**depth).isEmpty():
        tops = rolled.select("tree", F.col("block").alias("r"), F.ceil(F.col("n") / fan**depth).cast("long").alias("n"), F.col("node")["h"].alias("h"), F.col("block").alias("item"))
        above, roots = _proofs(tops, fan, depth)
        above = written(above)
        # 9 hashes of a path to a thousand blocks and two numbers: what a row may weigh
        rows = rolled.join(sized(above.select("tree", F.col("item").alias("block"), "path", "root"), 4096), ["tree", "block"])
    rows = rows.select("tree", "node", F.coalesce("path", F.array().cast(f"array<{_STEP}>")).alias("path"), "root")
    for _ in range(depth):

        def handed(kid: Column, i: Column) -> Column:
            around = lambda a, n: F.array_join(F.transform(F.slice("node.kids", a, n), lambda k: k["h"]), "")
            beside = F.struct(around(F.lit(1), i).alias("left"), around(i + 2, F.lit(fan)).alias("right"))
            here = F.when(F.col("node.several"), F.array(beside)).otherwise(F.array().cast(f"array<{_STEP}>"))
            return F.struct(kid.alias("node"), F.concat(here, "path").alias("path"))

        rows = rows.select("tree", "root", F.explode(F.transform("node.kids", handed)).alias("k")).select("tree", "root", "k.node", "k.path")
    return rows.select("tree", F.col("node.item").alias("item"), "path", "root"), roots


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def manifest(docs: DataFrame, fields: list[str], *, tree: str = "lang", order: str = "doc_id", extra: dict[str, Column] | None = None, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """(tree, order, leaf, subroot, root, path, and extra's columns) of every row; extra: expressions of docs' columns.

    A leaf hashes the fields. In a tree leaves ascend by `order`, nulls first, then by leaf: so repeated rows have equal
    leaves at places of their own, and the roots don't depend on how rows lie. Trees ascend by `tree`, null first and
    bytewise; the tree over them gives the root. path is the whole proof, bottom first: the hashes left and right of the
    row's node on each level, as one text each. No rows, no trees.
    """
    extra = extra or {}
    item = F.struct(F.col(tree).alias("tree"), F.col(order).alias("id"), hashed(*[field(F.col(c)) for c in fields]).alias("leaf"), *[e.alias(c) for c, e in extra.items()])
    rows = docs.select(item.alias("item")).select("item.tree", "item.id", "item.leaf", "item")
    placed = written(ranked(rows, ["tree", "id", "leaf"], "rank"))
    trees = placed.groupBy("tree").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    trees = written(ranked(trees, ["tree"], "number").withColumnRenamed("tree", "name"))
    numbered = placed.join(sized(trees, 64), F.col("tree").eqNullSafe(F.col("name")))
    leaves = numbered.select(F.col("number").alias("tree"), (F.col("rank") - F.col("first")).alias("r"), "n", F.col("leaf").alias("h"), "item")
    proofs, roots = _proofs(leaves, fan, depth)
    tops = roots.select(F.lit(0).alias("tree"), F.col("tree").alias("r"), F.lit(trees.count()).alias("n"), F.col("root").alias("h"), F.col("tree").alias("item"))
    above, _ = _proofs(tops, fan, min(depth, TOP_DEPTH))
    above = written(above.select(F.col("item").alias("tree"), F.col("path").alias("upper"), F.col("root").alias("whole")))
    out = proofs.join(sized(above, 4096), "tree")
    names = unused([tree, order, *extra], "leaf", "subroot", "root", "path")
    return out.select(
        F.col("item.tree").alias(tree),
        F.col("item.id").alias(order),
        F.col("item.leaf").alias(names[0]),
        F.col("root").alias(names[1]),
        F.col("whole").alias(names[2]),
        F.concat("path", "upper").alias(names[3]),
        *[F.col(f"item.{c}").alias(c) for c in extra],
    )


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def tampering(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, some of them tampered with.

    Where 7 divides the CRC-32 of the doc_id, one is added to n_chars before the proof is folded; rows without doc_id or
    n_chars stay as they are, and verify.
    """
    cut = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    changed = F.when(cut, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    bad = hashed(*[field(changed if c == "n_chars" else F.col(c)) for c in FIELDS])
    rows = manifest(docs, FIELDS, extra={"tampered": bad})
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    out = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.col("tampered"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
