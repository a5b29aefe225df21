"""Every query against the SQL that states its outcome from typed columns."""

import os

import duckdb
import pytest

from lograft import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    return con


def test_every_query_has_sql():
    assert set(Q.QUERIES) == set(Q.ORACLES)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
    res = duck.execute(Q.ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in res.fetchall())
    assert got == want
