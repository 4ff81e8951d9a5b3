"""Every registered query of the library proper against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from loomspan.plans import files, whole  # noqa: F401  (they register queries)
from loomspan.plans.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def cell(x):
    if x is None or x is pd.NA or x != x:
        return (1, "")
    if isinstance(x, str):
        return (0, x)
    return (0, str(round(float(x), 4) + 0.0))


def rows(df):
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)
