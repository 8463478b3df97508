"""Every query of the library against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from ledgerline.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{FOLDER}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return "null"
    if isinstance(x, float):
        return str(int(x)) if x == int(x) else f"{x:.9g}"
    return str(x)


def normal(df):
    df = df.reindex(sorted(df.columns), axis=1)
    return list(df.columns), sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name in ORACLES:
        assert normal(got) == normal(duck.sql(ORACLES[name]).df())
    else:
        assert len(got.columns)


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
