"""Every query of the core against its SQL on the smallest tables."""

import math
import os

import pytest

from quern import pipeline_queries, queries, store_queries

D = "/root/testdata/sf0.001"
ALL = {**pipeline_queries.QUERIES, **queries.QUERIES, **store_queries.QUERIES}
SQL = {**pipeline_queries.ORACLES, **queries.ORACLES, **store_queries.ORACLES}


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in sorted(os.listdir(D)):
        con.execute(f"create view {f.split('.')[0]} as select * from '{D}/{f}'")
    return con


def norm(rows, columns):
    def cell(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6)
        return tuple(map(cell, x)) if isinstance(x, (list, tuple)) else x

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, db, name):
    df = ALL[name](spark, D)
    rows = [tuple(r) for r in df.collect()]
    if name in SQL:
        cur = db.execute(SQL[name])
        columns = [c[0] for c in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert norm(rows, df.columns) == norm(cur.fetchall(), columns)
    assert rows  # two empty results would agree
