"""Factoring against brute force over all windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import factors


def expected(rows, length):
    """The definition, window by window; rows of equal id and text count once."""
    order = sorted({(i is None, i or 0, t or "") for i, t in rows})
    seen, gone = set(), {}
    for key in order:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", key[2]) if w]
        gone[key] = (words, [False] * len(words))
        for a in range(len(words) - length + 1):
            window = tuple(words[a : a + length])
            if window in seen:
                gone[key][1][a : a + length] = [True] * length
            seen.add(window)
    for i, t in rows:
        words, marks = gone[(i is None, i or 0, t or "")]
        kept = " ".join(w for w, g in zip(words, marks) if not g)
        yield i, len(words), sum(marks), hashlib.sha256(kept.encode()).hexdigest()


def check(docs, length=20):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = factors.digest(docs, length).collect()
    assert Counter(tuple(r)[:4] for r in got) == Counter(expected(rows, length))
    for r in got:
        assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"]
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]


@pytest.mark.parametrize("name", ["documents", "odd", "nothing"])
def test_duplicates(request, name):
    check(request.getfixturevalue(name))


@pytest.mark.parametrize("block", [factors.BLOCK, 2])
def test_few_words_repeat_often(spark, monkeypatch, block):
    """Texts over three words: matches start and end everywhere, and anchors are hot where blocks are small."""
    monkeypatch.setattr(factors, "BLOCK", block)
    monkeypatch.setattr(factors, "INDEX_WORDS", 300)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["a", "b", "c"], weights=[8, 2, 1], k=rng.randrange(0, 60)))) for i in range(300)]
    check(spark.createDataFrame(rows + rows[:9], "doc_id long, text string").repartition(5), 7)


def test_a_hot_anchor_is_in_no_single_task(spark, monkeypatch):
    """Rows of a hot anchor stay where they lie; the others are merged, however few, so that nothing changes with size."""
    monkeypatch.setattr(factors, "BLOCK", 50)
    rows = factors.written(spark.range(0, 900, 1, 6).select(F.when(F.col("id") % 3 == 0, 7).otherwise(1000 + F.col("id") % 201).alias("gram"), "id"))
    anchors = factors.written(rows.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"))
    got = factors._of_anchors(rows, anchors, "n")
    assert sorted(r["id"] for r in got.collect()) == list(range(900))
    assert {r["gram"]: r["n"] for r in got.collect()} == {r["gram"]: r["n"] for r in anchors.collect()}
    parts = got.where("gram = 7").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in parts) < 300
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") == 2


def test_ids_at_the_edge(spark):
    """Equal ids with other texts, negative and large ids, no ids."""
    text = [" ".join(f"w{k}" for k in range(a, a + 40)) for a in (0, 0, 10, 30, 5)]
    ids = [5, -(2**62), 5, None, 2**62]
    rows = list(zip(ids, text))
    got = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in factors.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[(-(2**62), 40)] == 0 and set(got) == {(i, 40) for i in ids}
    assert got[(None, 40)] == 20 and got[(2**62, 40)] == 40


def test_previous_factors():
    rng = np.random.default_rng(1)
    for n, kinds in ((1, 1), (40, 1), (200, 2), (300, 4)):
        x = rng.integers(0, kinds, n).tolist()
        want = [max([0, *[next((k for k in range(n - i) if x[i + k] != x[j + k]), n - i) for j in range(i)]]) for i in range(n)]
        assert factors.previous_factors(np.array(x)).tolist() == want
