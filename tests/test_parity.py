"""Every market query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from tidemark.plans import queries as market

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def ordered(cols, data):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in at], sorted(tuple(repr(row[i]) for i in at) for row in data)


@pytest.mark.parametrize("name", sorted(market.QUERIES))
def test_parity(spark, name):
    got = market.QUERIES[name](spark, DATA)
    cols, data = got.columns, got.collect()
    if name not in market.SQL:
        assert data
        return
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    want = con.sql(market.SQL[name])
    a, b = ordered(cols, data), ordered(want.columns, want.fetchall())
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    assert [x for x, y in zip(a[1], b[1]) if x != y] == []
