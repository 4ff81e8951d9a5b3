"""The index of patterns against a loop over all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomspan.operators import patterns, recode
from loomspan.sources import readers

SHOWN = [
    ("^chr_?[0-9]+$", "chr"), ("Scaffold_12", "scaffold_12"), (r"chr\d", "chr"), ("scaff|ctg", ""), ("genome .*", "genome "), ("ab*cde", "cde"), ("ab?cd{0,2}efg", "efg"),
    ("abc+d", "abc"), (r"x\.yz", "yz"), (r"\x41bcd", ""), ("[a-z]bcd[^]x]e", "bcd"), ("a*?bcd", "bcd"), ("", ""), ("^$", ""), ("(abc)", ""), ("[a[bc]]def", ""), ("é+chr", "chr"),
]


def test_required_texts(spark):
    rows = spark.createDataFrame(SHOWN, "p string, want string").select("*", patterns.required(F.col("p")).alias("got")).collect()
    assert {r["p"]: r["got"] for r in rows} == {r["p"]: r["want"] for r in rows}


def made(rng, n):
    parts = ["chr", "Scaffold", "ctg", "_", "1", "22", "X", "contig", ".", "é", "random"]
    return ["".join(rng.choices(parts, k=rng.randrange(1, 6))) for _ in range(n)]


def test_many_patterns(spark):
    rng = random.Random(4)
    ids = sorted(set(made(rng, 400)))
    rules = [re.sub(r"[1X]", rng.choice([r"\\d", ".", "[0-9X]*", "1?"]), rng.choice(["^", ""]) + x.replace(".", r"\.") + rng.choice(["$", ""])) for x in made(rng, 300)] + ["chr|ctg", "1", None, "(Scaf)+", "nowhere"]
    df = spark.createDataFrame([(x,) for x in ids for _ in range(2)], "k string")
    table = spark.createDataFrame(list(enumerate(rules)), "n int, pattern string")
    assert table.count() > patterns.FEW
    got = sorted((r["k"], r["n"]) for r in recode.pattern_matches(df, table, id="k", pattern="pattern").collect())
    want = sorted((x, n) for n, p in enumerate(rules) if p is not None for x in ids if re.search(p.replace(r"\\d", r"\d"), x, re.I))
    loop = df.distinct().join(table, F.expr("rlike(k, concat('(?i)', pattern))"))
    assert got == sorted((r["k"], r["n"]) for r in loop.collect()) and len(got) > 1000 and abs(len(got) - len(want)) < 0.2 * len(want)


def test_many_regions_of_records(spark, tmp_path):
    path = str(tmp_path / "x.fa")
    with open(path, "w") as f:
        for k in range(90):
            f.write(f">Seq_{k} x\n" + "".join("ACGT"[(k + j) % 4] for j in range(70)) + "\n" + "A" * (k % 5) + "\n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    chunks = readers.fasta_chunks(spark, path, 16)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    whole = {r["header"]: r["sequence"] for r in readers.fasta(spark, path).collect()}
    built: dict[str, dict[int, str]] = {}
    for r in chunks.collect():
        built.setdefault(r["header"], {})[r["chunk"]] = r["bases"]
    assert {h: "".join(c[k] for k in sorted(c)) for h, c in built.items()} == whole
    regions = spark.createDataFrame([(f"sEQ_{k}", k % 30, k % 30 + 21, "t") for k in range(80)], "pattern string, begin long, end long, tag string")
    got = {(r["pattern"], r["header"]): r["sequence"] for r in readers.excerpts(chunks, regions, 16).collect()}
    assert got == {(f"sEQ_{k}", h): s[k % 30 : k % 30 + 21] for k in range(80) for h, s in whole.items() if f"seq_{k}" in h.lower()}


@pytest.mark.parametrize("few", [0, 64])
def test_pairs_and_subsets_by_index(spark, monkeypatch, few):
    monkeypatch.setattr(patterns, "FEW", few)
    df = spark.createDataFrame([("chr1", "scaffold_3"), ("chr2", "chr2"), ("CHR1", "x"), (None, "y")], "a string, b string")
    pairs = spark.createDataFrame([("chr1", "scaff"), ("^chr", "chr")], "pattern_a string, pattern_b string")
    assert sorted(map(tuple, recode.matches_any_pair(df, pairs, a="a", b="b").collect())) == [("chr1", "scaffold_3"), ("chr2", "chr2")]
    table = spark.createDataFrame([("one", "chr1"), ("all", ".")], "label string, pattern string")
    out = {r["label"]: (r["rows"], r["ids"]) for r in recode.subset_check(df, table, id="a", pattern="pattern", label="label").collect()}
    assert out == {"one": (2, 2), "all": (3, 3)}
