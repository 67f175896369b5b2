"""Every query with SQL against DuckDB on the same tables."""

import os

import duckdb
import pytest

from threadlens import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda x: int(x) if isinstance(x, float) and x.is_integer() else x  # noqa: E731  columns of whole numbers with nulls come as floats from one engine
    return sorted(str(tuple(map(plain, r))) for r in df.astype(object).where(df.notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_like_sql(spark, duck, name):
    ours, theirs = queries.queries()[name](spark, SF).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_all_have_rows(spark):
    for name in set(queries.queries()) - set(queries.oracle_sql()) - {"thread_analysis", "turn_stages"}:
        assert queries.queries()[name](spark, SF).limit(1).count() == 1, name
