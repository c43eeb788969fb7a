"""Every registered query with SQL against DuckDB on the same tables; the others must give rows."""

import math
from pathlib import Path

import duckdb
import pytest

from pulsegrid.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def shape(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: f"{v:.5f}" if isinstance(v, float) and math.isfinite(v) else str(v)
    return sorted(columns), sorted(tuple(cell(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    if name not in catalog.SQL:
        assert df.count() > 0
        return
    con = duck.execute(catalog.SQL[name])
    want = shape([c[0] for c in con.description], con.fetchall())
    got = shape(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    assert not bad, bad[:3]
