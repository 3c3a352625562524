"""Every query of the library against its SQL in DuckDB, over the smallest tables."""

import os

import duckdb
import pytest

from textlattice.plans import corpus, derived, fixtures, readings_of_tables, relations_of_tables

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = {}, {}
for part in (relations_of_tables, readings_of_tables, derived, corpus, fixtures):  # stated examples whose names are queries over tables too are tests of their own
    QUERIES |= {k if k not in QUERIES else f"stated {k}": q for k, q in part.QUERIES.items()}
    ORACLES |= {k if k not in ORACLES else f"stated {k}": q for k, q in part.ORACLES.items()}


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    at = [names.index(c) for c in sorted(names)]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
