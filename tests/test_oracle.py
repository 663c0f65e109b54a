"""Core queries against the SQL of another engine."""

import os

import pytest

from choralis.plans import queries as Q


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([float(r[i]) if isinstance(r[i], int) and not isinstance(r[i], bool) else r[i] for i in order]) for r in data)


@pytest.fixture(scope="module")
def db(sf):
    duckdb = pytest.importorskip("duckdb")
    d = duckdb.connect()
    for f in os.listdir(sf):
        d.execute(f"create view {f[:-8]} as from '{sf}/{f}'")
    return d


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_as_sql(spark, sf, db, name):
    df = Q.QUERIES[name](spark, sf)
    rel = db.execute(Q.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(cols, rel.fetchall())
