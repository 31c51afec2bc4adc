"""Every query with SQL gives the same rows as that SQL."""

import math

import duckdb
import pytest
from conftest import DATA, TABLES

from tidemark import catalog


def rows(df):
    def value(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "null"
        return f"{float(x):.5f}" if isinstance(x, (int, float)) else str(x)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(value(None if x is None or x != x else x) for x in r) for r in df.where(df.notna(), None).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
