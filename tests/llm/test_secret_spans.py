"""Model spans that overlap base spans, in texts with very many of either."""

import random
import time

import pytest
from pyspark.sql import functions as F

from loomspan.llm import secret_scan

SPANS = "id int, base array<struct<start:int,kind:int,end:int>>, model array<struct<start:int,kind:int,end:int>>"


@pytest.mark.parametrize("most", [0, 1, 127, 128, 129, 700])
def test_spans_apart(spark, most):
    rng = random.Random(most)
    rows = []
    for i in range(6):
        base = sorted((s, k, s + rng.randrange(1, 30)) for k in range(3) for s in rng.sample(range(4000), rng.randrange(most + 1)))
        model = [(s, 3, s + rng.randrange(1, 12)) for s in range(0, 4000, 17)] if i else []
        rows.append((i, base, model))
    got = spark.createDataFrame(rows, SPANS).select("id", secret_scan._apart("model", "base").alias("free")).collect()
    for r in got:
        _, base, model = rows[r["id"]]
        assert [tuple(x) for x in r["free"]] == [x for x in model if not any(y[0] < x[2] and x[0] < y[2] for y in base)]


def test_many_spans_in_one_text(spark):
    n = 25_000

    def spans(first):
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct((k * 40 + first).alias("start"), F.lit(0).alias("kind"), (k * 40 + first + 18).alias("end")))

    one = spark.range(1).select(spans(0).alias("base"), spans(19).alias("model"))
    began = time.time()
    assert one.select(F.size(secret_scan._apart("model", "base"))).first()[0] == n
    assert time.time() - began < 60
