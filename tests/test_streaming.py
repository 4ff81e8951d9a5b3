"""Streams that are fed in several files, stopped and gone on with."""

import datetime as dt
import random
import statistics

import pytest

from loomspan.session import scratch
from loomspan.streaming import running


def feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_values_are_taken_back(spark):
    rng = random.Random(2)
    path, root, there = scratch(spark), scratch(spark), {}
    schema = "k string, v double, w int"
    for n in range(3):
        rows = []
        for _ in range(40):
            k = rng.choice("ab")
            mine = there.setdefault(k, [])
            if mine and rng.random() < 0.4:
                v = rng.choice([min(mine), max(mine), rng.choice(mine)])
                mine.remove(v)
                rows.append((k, v, -1))
            else:
                v = float(rng.randrange(12))
                mine.append(v)
                rows.append((k, v, 1))
        feed(spark, path, [*rows, ("a", None, 1)], schema)
        # each call goes on from the checkpoint and sees the new file only
        stream = running.kept_values(running.file_stream(spark, path, 1), group=["k"], value="v", sign="w")
        got = {r["k"]: r for r in running.drained(stream, "update", key=["k"], root=root).collect()}
        for k, mine in there.items():
            assert (got[k]["n"], got[k]["low"], got[k]["high"]) == (len(mine), min(mine, default=None), max(mine, default=None))
            if len(mine) > 1:
                assert got[k]["median"] == statistics.median(mine) and got[k]["mean"] == pytest.approx(statistics.fmean(mine))
                assert got[k]["variance"] == pytest.approx(statistics.variance(mine))


def test_nothing_is_left(spark):
    path = scratch(spark)
    feed(spark, path, [("a", 1.0, 1), ("a", 1.0, -1)], "k string, v double, w int")
    out = running.drained(running.kept_values(running.file_stream(spark, path, 1), group=["k"], value="v", sign="w"), "update", key=["k"]).collect()
    assert [tuple(r) for r in out] == [("a", 0, None, None, None, None, None)]


def test_windows_close_once_and_late_rows_are_counted(spark):
    path, root, start = scratch(spark), scratch(spark), dt.datetime(2024, 1, 1)
    at = lambda minutes: start + dt.timedelta(minutes=minutes)
    schema = "ts timestamp, g string, v double"
    batches = [[(at(m), "x", 1.0) for m in (1, 5, 11, 19)], [(at(m), "x", 1.0) for m in (21, 59)], [(at(2), "x", 1.0), (at(61), "x", 1.0)]]
    closed = []
    for rows in batches:
        feed(spark, path, rows, schema)
        stream = running.jumping_windows(running.file_stream(spark, path, 1), time="ts", width=600, jump=600, group=["g"], value="v", late="10 minutes")
        told = {}
        got = running.drained(stream, root=root, told=told).collect()
        closed.append(sorted((r["window_start"], r["n"]) for r in got))
    first = min(w for w, _ in closed[-1])
    assert [[((w - first) // 60, n) for w, n in c] for c in closed] == [[], [(0, 2), (20, 1)], [(0, 2), (20, 1)]]
    assert told["late"] == 1
