"""Every core query that has SQL agrees with it on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from kilnwork.plans import catalogue

ROOT = "/root/testdata/sf0.001"


def fold(frame):
    def one(x):
        if x is None or pd.isna(x):
            return "NULL"
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return str(bool(x))
        if hasattr(x, "__float__"):
            return repr(round(float(x), 6) + 0.0)
        return str(x)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(one(x) for x in r) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(ROOT):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for f in glob.glob(f"{ROOT}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, ROOT).toPandas()
    want = duck.execute(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert fold(got) == fold(want)
