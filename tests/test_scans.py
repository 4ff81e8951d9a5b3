"""One long sequence or group dealt to many tasks gives what one task gives."""

import random
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.operators import families, intervals, quantiles, summary, windows
from loomspan.operators.scans import Running, dealt
from loomspan.plans import jobs

KEYS = {"seq": "seq", "begin": "b", "end": "e"}


@pytest.fixture(scope="module", autouse=True)
def many_parts(spark):
    """Small tables stay in as many parts as large ones would have."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", old)


def intervals_of(seed, n=500, seqs="A", reach=3000, scores=50):
    rng = random.Random(seed)
    starts = [rng.randrange(1, reach) for _ in range(n)]
    return [(rng.choice(seqs), b, b + rng.choice([0, 1, 4, 40, 600]), float(rng.randrange(scores)), i) for i, b in enumerate(starts)]


def table(spark, rows):
    return spark.createDataFrame(rows, "seq string, b long, e long, score double, id long").repartition(5)


def tasks_rows(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]


@pytest.mark.parametrize("ahead", [False, True])
def test_running_values(spark, ahead):
    rng = random.Random(3)
    rows = [(rng.choice("ab") if k % 9 else None, k, rng.choice([None, *range(20)])) for k in range(200)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = dealt(df, key=["k"], order=["o"]).running(ahead=ahead, top=Running("max", F.col("v")), low=Running("min", F.col("v"), own=True), sum=Running("sum", F.col("v")), near=Running("last", F.col("v"))).rows
    assert len(tasks_rows(dealt(df, key=["k"], order=["o"]).rows)) > 1
    for r in got.collect():
        mine = [x for x in rows if x[0] == r["k"] and x[2] is not None and (x[1] > r["o"] if ahead else x[1] < r["o"])]
        values = [x[2] for x in sorted(mine, key=lambda x: x[1], reverse=ahead)]
        assert (r["top"], r["sum"], r["near"]) == (max(values, default=None), sum(values) if values else None, values[-1] if values else None)
        assert r["low"] == min([*values, *([r["v"]] if r["v"] is not None else [])], default=None)


@pytest.mark.parametrize(("closed", "touching"), [(True, False), (True, True), (False, False)])
def test_islands_of_one_sequence(spark, closed, touching):
    rows = sorted(intervals_of(1, 300, reach=20000), key=lambda r: (r[1], r[2]))
    want, reach, number = {}, None, 0
    for _, b, e, _, i in rows:
        if reach is None or b >= reach + closed + touching:
            number += 1
        reach = e if reach is None else max(e, reach)
        want[i] = number
    got = intervals.with_islands(table(spark, rows), **KEYS, closed=closed, touching=touching)
    assert got.columns == ["seq", "b", "e", "score", "id", "island"]
    # equal empty intervals may change places
    assert Counter((r["b"], r["e"], r["island"]) for r in got.collect()) == Counter((b, e, want[i]) for _, b, e, _, i in rows)
    if not touching:
        many = {i for i, n in Counter(want.values()).items() if n > 1}
        assert {r["id"] for r in intervals.overlapping_ids(table(spark, rows), **KEYS, id="id", closed=closed).collect()} == {i for i, n in want.items() if n in many}


def test_no_task_has_the_whole_sequence(spark):
    df = spark.range(70_000).select(F.lit("A").alias("seq"), (F.col("id") * 3).alias("b"), (F.col("id") * 3 + F.col("id") % 5).alias("e"))
    sizes = tasks_rows(intervals._islands(df, "seq", "b", "e", "i", 1).rows)
    assert len(sizes) >= 5 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_neighbours_across_parts(spark):
    rows = sorted(intervals_of(2, 200, "AB"), key=lambda r: (r[0], r[1], r[2], r[4]))
    df, size = table(spark, rows), 5000
    want, pairs = [], []
    for seq in "AB":
        mine = [r for r in rows if r[0] == seq]
        want += [(seq, y[1], y[1] - x[2]) for x, y in zip(mine, mine[1:]) if y[1] > x[2]]
        k = 0
        while k + 1 < len(mine):
            over = mine[k + 1][1] <= mine[k][2]
            pairs += [(seq, mine[k][4], mine[k + 1][4])] if over else []
            k += 2 if over else 1
    assert sorted(tuple(r) for r in intervals.consecutive_gaps(df, **KEYS).collect()) == sorted(want)
    assert sorted(tuple(r) for r in intervals.adjacent_pairs(df, **KEYS, id="id").collect()) == sorted(pairs)
    stretches = intervals.gaps(df.withColumn("size", F.lit(size)), **KEYS, length="size").collect()
    for seq in "AB":
        mine = sorted((r["begin"], r["end"], r["region"]) for r in stretches if r["seq"] == seq)
        assert mine[0][0] == 0 and mine[-1][1] == size and all(x[1] == y[0] for x, y in zip(mine, mine[1:]))
        bases = {x for r in rows if r[0] == seq for x in range(r[1], r[2])}
        assert sum(r[1] - r[0] for r in mine if r[2] == "mapped") == len(bases)


def won_by_base(rows):
    best = {}
    for seq, b, e, score, i in rows:
        for x in range(b, e + 1):
            best[seq, x] = max(best.get((seq, x), (-1, -1, -1)), (score, b, i))
    got = dict.fromkeys((r[4] for r in rows), 0)
    for _, _, i in best.values():
        got[i] += 1
    return got


@pytest.mark.parametrize("stretch", [intervals.SWEPT, 13])
def test_one_long_island_in_blocks(spark, monkeypatch, stretch):
    monkeypatch.setattr(intervals, "SWEPT", stretch)
    for seqs in ("A", "AAAB"):
        rows = intervals_of(4, 600, seqs)
        got = intervals.resolve_overlap(table(spark, rows), **KEYS, score="score", id="id").collect()
        assert {r["id"]: r["bp_algor"] for r in got} == won_by_base(rows) and len(got) == len(rows)
    blocks = intervals._blocks(table(spark, rows), **KEYS, carry=["id"]).where("seq = 'A'").groupBy("_n").count().collect()
    assert len(blocks) >= 5


def in_turn(rows):
    """The order-dependent rule, point by point, with a plain list of those that wait."""
    points = sorted(x for _, b, e, s, i in rows for x in ((b, i, 0, s), (e, i, 1, s)))
    got, out, wait, owner, since = {}, {}, [], None, 0
    for at, i, closes, score in points:
        if not closes:
            got[i] = 0
            if owner and owner[1] > score:
                wait.append((i, score))
                continue
            if owner:
                got[owner[0]] += at - since
                wait.append(owner)
            owner, since = (i, score), at
            continue
        if owner and owner[0] == i:
            got[i] += at - since + 1
            owner, since = None, at + 1
            if wait:
                owner = max(wait, key=lambda w: w[1])  # the first of equal ones
                wait.remove(owner)
        else:
            wait = [w for w in wait if w[0] != i]
        out[i] = got.pop(i)
    return out


@pytest.mark.parametrize("scores", [3, 60, 10**9])
def test_sequential_rule_across_borders(spark, scores):
    """Few scores leave few borders, many leave nearly all."""
    rows = intervals_of(6, 500, scores=scores)
    got = intervals.resolve_overlap_sequential(table(spark, rows), **KEYS, score="score", order="id").collect()
    assert {r["id"]: r["bp_algor"] for r in got} == in_turn(rows) and len(got) == len(rows)
    blocks = intervals._blocks(table(spark, rows), **KEYS, carry=["score", "id"], apart="score").select("_n").distinct().count()
    assert blocks >= 4 or scores < 10**9


@pytest.mark.parametrize("closed", [True, False])
def test_join_with_all_rows_at_one_place(spark, monkeypatch, closed):
    """A hot place, rows that reach over many borders, types that must come through as they are."""
    monkeypatch.setattr(intervals, "MET", 29)
    rng = random.Random(8)
    left = [("A", 100, 100 + k % 3, None if k % 4 else 2**60 + k, k) for k in range(90)] + [("A", 1, 9000, None, 90)]
    right = [("A", rng.randrange(90, 110), 110, None, 1000 + k) for k in range(60)] + [("A", b, b + 1, None, 2000 + b) for b in range(1, 9000, 100)]
    make = lambda rows: spark.createDataFrame(rows, "seq string, b int, e int, x long, id long").repartition(3)
    got = intervals.overlap_join(make(left), make(right), **KEYS, closed=closed)
    assert got.columns == ["seq", "b", "e", "x", "id", "seq_r", "b_r", "e_r", "x_r", "id_r"]
    meets = lambda p, q: p[1] <= q[2] and p[2] >= q[1] if closed else p[1] < q[2] and p[2] > q[1]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((*p, *q) for p in left for q in right if meets(p, q)), key=str)


def test_quantiles_of_one_group(spark):
    rng = random.Random(9)
    values = [rng.choice([rng.gauss(0, 9), rng.randrange(5), None]) for _ in range(700)]
    df = spark.createDataFrame([("g", None if v is None else float(v)) for v in values], "g string, v double")
    known = [float(v) for v in values if v is not None]
    got = quantiles.quantiles(df, group=["g"], value="v", named={f"q{p}": p for p in (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)}).first()
    for p in (0.0, 0.1, 0.25, 0.5, 0.9, 1.0):
        assert got[f"q{p}"] == pytest.approx(np.quantile(known, p), abs=1e-12)
    ranked = quantiles.ranked_values(df, group=["g"], value="v")
    assert max(tasks_rows(ranked)) < ranked.count() / 2
    box = summary.box_stats(df, group=["g"], value="v").first()
    q1, q3 = np.quantile(known, [0.25, 0.75])
    inside = [v for v in known if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
    assert (box["whisker_low"], box["whisker_high"], box["n"]) == (min(inside), max(inside), len(known))
    told = windows.outliers(df, group=[], value="v").groupBy("outlier").count().collect()
    assert {r["outlier"]: r["count"] for r in told}[None] == len(inside) + values.count(None)
    spread = summary.spread(df, group=["g"], value="v").first()
    assert spread["median"] == pytest.approx(statistics.median(known)) and spread["high"] - spread["median"] == int(1.96 * statistics.stdev(known))


def test_family_of_many_members(spark):
    """Pairs are counted by distance as if they had been made; a family of 100,000 is counted at once."""
    rng = random.Random(10)
    rows = [(rng.randrange(4), i, rng.choice("AAB"), b, b + rng.randrange(3000)) for i in range(250) for b in [rng.randrange(1, 3_000_000)]]
    want = Counter()
    for i, x in enumerate(rows):
        for y in rows[:i]:
            if x[0] == y[0]:
                key = tuple(sorted((x[2], y[2])))
                want[key, "pairs"] += 1
                if x[2] == y[2]:
                    d = max(0, max(x[3], y[3]) - min(x[4], y[4]))
                    want[key, next((c for c, t in zip(("near_4", "near_5", "near_6"), families.NEAR) if d < t), "far")] += 1
                    want[key, "total"] += d
    got = families.pair_distances(spark.createDataFrame(rows, "f int, id long, seq string, b long, e long"), family="f", id="id", **KEYS)
    for r in got.collect():
        assert all((r[c] or 0) == want[(r["seq"], r["seq_r"]), c] for c in ("pairs", "near_4", "near_5", "near_6", "far", "total"))
    large = spark.range(100_000).select(F.lit(1).alias("f"), "id", F.lit("A").alias("seq"), (F.col("id") * 30).alias("b"), (F.col("id") * 30 + 10).alias("e"))
    one = families.pair_distances(large, family="f", id="id", **KEYS).first()
    assert one["pairs"] == one["near_4"] + one["near_5"] + one["near_6"] + one["far"] == 100_000 * 99_999 // 2
    assert one["total"] == sum((100_000 - k) * (30 * k - 10) for k in range(1, 100_000))


def test_family_on_many_sequences(spark, monkeypatch):
    monkeypatch.setattr(families, "MEETING", 10)
    df = spark.range(300).select(F.lit(1).alias("f"), (F.col("id") % 90).alias("s"))
    got = {(r["seq_a"], r["seq_b"]): r["links"] for r in families.linkage(df, family="f", seq="s").collect()}
    n = Counter(k % 90 for k in range(300))
    want = {(a, b): n[a] * (n[a] - 1) // 2 if a == b else -(-n[a] * n[b] // 2) for a in n for b in n if a <= b}
    assert got == {k: v for k, v in want.items() if v}
    keys = families._pairs_of_sequences(df, "f", "s")
    assert keys.count() == 90 * 91 // 2


def test_coordinates_weigh_every_length(spark, tmp_path):
    """Three alignments of 10, 10 and 40 bases: equal lengths count each, and subsets don't double them."""
    line = lambda at, n: f"q\t1000\t{at}\t{at + n}\t+\tt\t2000\t{at}\t{at + n}\t{n}\t{n}\t60"
    path = str(tmp_path / "a.paf")
    with open(path, "w") as f:
        f.write("\n".join(line(at, n) for at, n in ((0, 10), (100, 10), (200, 40))))
    tables = jobs.alignment_stats(spark, path, [("all", "."), ("query", "q")])
    out = {r["sequid"]: r for r in tables["coordinates"].collect()}
    deviation = int(1.96 * statistics.stdev([10, 10, 40]))
    assert out["Q.q"]["ali_len"] == f"10.0 ± {deviation}"
    assert out["Q.q"]["unmapped"] == f"90.0 ± {int(1.96 * statistics.stdev([90, 90, 760]))}" and out["Q.q"]["Del"] == "NA"
    assert {(r["db"], r["subset"]): r["n"] for r in tables["regions"].where("region = 'ali_len'").collect()} == {("Q", "all"): 3, ("Q", "query"): 3, ("T", "all"): 3}


def test_lattice_against_grouping_sets(spark):
    rng = random.Random(11)
    rows = [("s", rng.choice("ab"), rng.choice(["x", "y", None]), float(rng.randrange(9)) / 2, rng.randrange(5)) for _ in range(300)]
    df = spark.createDataFrame(rows, "sp string, c string, d string, v double, n long")
    got = summary.lattice(df, by=["sp"], levels=["c", "d"], value="v", sums={"n": F.sum("n"), "k": F.count("*")})
    measures = {"n": F.sum("n"), "k": F.count("*"), "v_mean": F.avg("v"), "v_median": F.median("v"), "v_mode_floor": F.mode(F.floor("v"), True)}
    want = summary.rolled_up(df, by=["sp"], levels=["c", "d"], measures=measures)
    cells = lambda t: sorted(str(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in t.select("sp", "c", "d", "level", *measures).collect())
    assert cells(got) == cells(want)
