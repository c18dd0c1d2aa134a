"""Every core query against its SQL in DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quern.queries import registry

QUERIES, SQL = registry()


def canon(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]

    def value(x):
        if isinstance(x, float):
            return repr(round(x, 6))
        return str(x)

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    rows = df.collect()
    assert name in SQL
    got = duck.execute(SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert canon(rows, df.columns) == canon(got.fetchall(), columns)
