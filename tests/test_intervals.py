from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspan.operators import intervals

KEYS = {"seq": "seq", "begin": "b", "end": "e"}
EDGES = [("s", 10, 20, 5), ("s", 20, 30, 5), ("s", 31, 40, 1), ("s", 10, 20, 5), ("s", 12, 15, 9), ("s", 13, 14, 9), ("t", 0, 7, 1)]


def table(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "seq string, b long, e long, score long, id long")


def by_base(rows):
    won = [0] * len(rows)
    for seq in {r[0] for r in rows}:
        mine = [(i, r) for i, r in enumerate(rows) if r[0] == seq]
        for at in range(min(r[1] for _, r in mine), max(r[2] for _, r in mine) + 1):
            over = [(r[3], r[1], i) for i, r in mine if r[1] <= at <= r[2]]
            if over:
                won[max(over)[2]] += 1
    return won


def resolved(spark, rows):
    out = intervals.resolve_overlap(table(spark, rows), **KEYS, score="score", id="id").collect()
    return [x["bp_algor"] for x in sorted(out, key=lambda x: x["id"])]


def test_edge_rows(spark):
    assert resolved(spark, EDGES) == by_base(EDGES)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("st"), st.integers(0, 30), st.integers(0, 12), st.integers(0, 3)), min_size=1, max_size=15))
def test_random_rows(spark, rows):
    rows = [(s, b, b + n, c) for s, b, n, c in rows]
    assert resolved(spark, rows) == by_base(rows)
    bases = {(s, x) for s, b, e, _ in rows for x in range(b, e + 1)}
    assert sum(resolved(spark, rows)) == len(bases)
    assert intervals.covered(table(spark, rows), **KEYS).agg(F.sum("bp")).first()[0] == len(bases)


def sequential(spark, rows):
    out = intervals.resolve_overlap_sequential(table(spark, rows), **KEYS, score="score", order="id").collect()
    return [x["bp_algor"] for x in sorted(out, key=lambda x: x["id"])]


def test_sequential_rule(spark):
    # an interval that starts where the best one before it in order ends counts that base again
    assert sequential(spark, [("s", 10, 20, 5), ("s", 20, 30, 5)]) == [11, 11]
    assert sequential(spark, [("s", 10, 20, 5), ("s", 15, 30, 5)]) == [5, 16]
    assert sequential(spark, [("s", 10, 30, 5), ("s", 15, 20, 9)]) == [15, 6]
    assert sequential(spark, [("s", 10, 30, 9), ("s", 15, 20, 5)]) == [21, 0]
    assert sequential(spark, [("s", 1, 5, 1), ("t", 1, 5, 1)]) == [5, 5]


def test_gaps_cover_the_sequence(spark):
    df = table(spark, EDGES).withColumn("size", F.lit(50))
    out = intervals.gaps(df, **KEYS, length="size")
    assert {r["seq"]: r["x"] for r in out.groupBy("seq").agg(F.sum("bp").alias("x")).collect()} == {"s": 50, "t": 50}
    merged = intervals.union(df, **KEYS, closed=False).where("seq = 's'").orderBy("b").collect()
    assert [(r["b"], r["e"]) for r in merged] == [(10, 20), (20, 30), (31, 40)]


def test_overlap_join_finds_each_pair_once(spark, monkeypatch):
    df = table(spark, [("s", 10, 20, 0), ("s", 15, 25, 0), ("s", 30, 35, 0), ("s", 40, 45, 0), ("s", 40, 50, 0)])
    for rows in (1, 7, 1000):
        monkeypatch.setattr(intervals, "MET", rows)
        got = intervals.overlapping_pairs(df, **KEYS, id="id").collect()
        assert sorted((r["id"], r["id_r"]) for r in got) == [(0, 1), (3, 4)]


def test_empty_and_null(spark):
    df = spark.createDataFrame([(None, 1, 2, 1, 0), ("s", None, 2, 1, 1)], "seq string, b long, e long, score long, id long")
    assert intervals.resolve_overlap(df, **KEYS, score="score", id="id").isEmpty()
    assert intervals.union(df, **KEYS).isEmpty()
    assert intervals.gaps(df.withColumn("size", F.lit(9)), **KEYS, length="size").isEmpty()


def test_nested_intervals_stay_linear(spark):
    """10,000 intervals within each other: each keeps its two ends, the last one its middle."""
    n = 10_000
    df = spark.range(n).selectExpr("'s' seq", "id b", f"{2 * n} - id e", "id score", "id")
    got = {r["id"]: r["bp_algor"] for r in intervals.resolve_overlap(df, **KEYS, score="score", id="id").collect()}
    assert got == {i: 2 if i < n - 1 else 3 for i in range(n)}


def test_sequential_rule_by_brute_force(spark):
    """Base by base: who comes, who goes, and in which turn each interval lost the ground, on random rows."""
    import itertools
    import random

    rng = random.Random(4)
    rows = [("s", b, b + rng.randint(0, 12), rng.randint(0, 3)) for b in sorted(rng.randint(0, 60) for _ in range(60))]
    won, turn, lost, holder = dict.fromkeys(range(60), 0), itertools.count(), {}, []

    def pay(until):
        for i, since in holder:
            won[i] += until - since

    for x in range(75):
        for i, (_, b, e, score) in enumerate(rows):
            if b == x:
                if holder and rows[holder[0][0]][3] > score:
                    lost[i] = next(turn)
                else:
                    pay(x)
                    lost.update({j: next(turn) for j, _ in holder})
                    holder = [(i, x)]
            if e == x:
                if lost.pop(i, None) is None:
                    pay(x + 1)
                    heirs = sorted(lost, key=lambda j: (-rows[j][3], lost[j]))[:1]
                    holder = [(j, x + 1) for j in heirs if lost.pop(j) is not None]
    assert sequential(spark, rows) == list(won.values())


def test_long_and_short_intervals_meet_once(spark, monkeypatch):
    import random

    rng = random.Random(5)
    rows = [("s", b, b + rng.choice([0, 1, 5, 40, 900, 20000]), 0) for b in (rng.randint(0, 20000) for _ in range(120))]
    df = table(spark, rows)
    want = sorted((i, j) for i, x in enumerate(rows) for j, y in enumerate(rows) if i < j and x[1] <= y[2] and y[1] <= x[2])
    for few in (10, 64, 5000):
        monkeypatch.setattr(intervals, "MET", few)
        got = intervals.overlapping_pairs(df, **KEYS, id="id").collect()
        assert sorted((r["id"], r["id_r"]) for r in got) == want


def test_a_stretch_may_end_with_a_whole_block():
    """Many short sequences: where all rows of a batch's last block begin at one place, the blocks before it end for good."""
    import pandas as pd

    parts = [[("a", 1, 9), ("a", 3, 20), ("b", 5, 8)], [("b", 5, 30), ("c", 2, 4)], [("d", 1, 2)]]
    frames, id = [], 0
    for part in parts:
        rows = [(s, 0, b, e, b, 7.0, id + k) for k, (s, b, e) in enumerate(part)]
        id += len(part)
        frames.append(pd.DataFrame(rows, columns=["seq", "_n", "_lo", "_hi", "b", "score", "id"]))
    for stretch in (1, 2, 3, 100):
        out = pd.concat(intervals._resolved(iter(frames), ["seq", "b", "score", "id"], "bp", stretch))
        assert out.groupby("id")["bp"].sum().to_dict() == {0: 2, 1: 18, 2: 0, 3: 26, 4: 3, 5: 2}
