"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from packetloom.plans import catalogue


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    return repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    ours = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
    r = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert ours == sorted(tuple(cell(x[i]) for i in at) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, sf, name):
    assert entry.queries()[name](spark, sf).columns


def test_entry(spark):
    assert entry.entry(spark).count() > 0
