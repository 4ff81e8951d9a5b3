"""The manifest against a tree that is built node by node."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomspan.llm import manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(nodes, fan):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + fan]) for i in range(0, len(out[-1]), fan)])
    return out


def proof(tree, i, fan):
    """(hashes to the left, hashes to the right) on each level."""
    for nodes in tree[:-1]:
        start = i - i % fan
        yield nodes[start:i], nodes[i + 1 : start + fan]
        i //= fan


def expected(rows, fan=2):
    def leaf(r, more=0):
        return digest(*[field(r[c] + more if c == "n_chars" and r[c] is not None else r[c]) for c in manifest.FIELDS])

    langs = {}
    for r in rows:
        langs.setdefault(r["lang"], []).append(r)
    names = sorted(langs, key=lambda k: (k is not None, (k or "").encode()))
    for group in langs.values():
        group.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = [levels([leaf(r) for r in langs[k]], fan) for k in names]
    top = levels([t[-1][0] for t in trees], fan) if trees else [[None]]
    root = top[-1][0]
    for n, k in enumerate(names):
        for i, r in enumerate(langs[k]):
            path = [*proof(trees[n], i, fan), *proof(top, n, fan)]
            h = leaf(r, int(r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0))
            for left, right in path:
                h = digest(*left, h, *right)
            yield r["doc_id"], leaf(r), trees[n][-1][0], root, digest(*[x for a, b in path for x in a + b]), h, h == root


@pytest.mark.parametrize("name", ["documents", "odd", "nothing"])
def test_manifest(request, name):
    docs = request.getfixturevalue(name)
    got = manifest.tampering(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == Counter(expected(docs.collect()))


@pytest.mark.parametrize(("fan", "depth"), [(2, 2), (5, 1)])
def test_many_layers_of_blocks(spark, fan, depth):
    """Blocks of a few leaves make several layers; a tree for nearly every row makes layers of trees."""
    for trees in (1, 7 * fan):
        docs = spark.range(61).select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), F.col("id") % trees).alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(7).alias("n_chars"), F.lit("é").alias("text"))
        rows = manifest.manifest(docs, manifest.FIELDS, fan=fan, depth=depth)
        want = {w[0]: w for w in expected(docs.collect(), fan)}
        got = rows.withColumn("up", manifest.folded(F.col("leaf"), F.col("path"))).collect()
        assert len(got) == 61
        for r in got:
            assert (r["leaf"], r["subroot"], r["root"]) == want[r["doc_id"]][1:4] and r["up"] == r["root"]
            assert digest(*[s["left"] + s["right"] for s in r["path"]]) == want[r["doc_id"]][4]


def test_any_change_shows(spark, documents):
    """A changed field, a swapped row and a lost row each change the root."""
    few = documents.limit(20)
    root = lambda df: manifest.manifest(df, manifest.FIELDS, depth=3).select("root").distinct().collect()
    first = root(few)
    assert len(first) == 1 and first == root(few.repartition(7))
    for other in (few.where("doc_id > 0"), few.withColumn("text", F.when(F.col("doc_id") == 3, "x").otherwise(F.col("text"))), few.withColumn("doc_id", F.col("doc_id") + 1)):
        assert root(other) != first
