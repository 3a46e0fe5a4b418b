"""Every query with SQL gives DuckDB's rows."""

import math

import duckdb
import pytest

from palimpsest.plans import catalogue

SF = "/root/testdata/sf0.01"


def _plain(x):
    return "nan" if isinstance(x, float) and math.isnan(x) else str(x)


#: Queries whose order counts, and their columns in this order.
ORDERED = {"history_export": ["history", "commit_seq", "k"], "store_topology": ["depth", "name", "kind"], "store_listings": ["place"]}


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_rows(spark, name):
    df = catalogue.queries()[name](spark, SF)
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{SF}/events.parquet')")
    found = con.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(map(_plain, r)) for r in found.fetchall())
    rows = df.collect()
    assert sorted(tuple(_plain(r[c]) for c in columns) for r in rows) == want
    assert rows
    if name in ORDERED:
        keys = [tuple(r[c] for c in ORDERED[name]) for r in rows]
        assert keys == sorted(keys)
