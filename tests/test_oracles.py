"""Every registered query with SQL gives what DuckDB gives on the same tables; the others run."""

from __future__ import annotations

import functools
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from wakeline.plans import catalog_formed
from tests.conftest import SF

NAMES = sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module", autouse=True)
def shared_frames():
    """Queries over formed episodes share what they write, so that formation does not run again for each of them."""
    plain, children = catalog_formed.FormedFrames, catalog_formed.ChildFrames
    catalog_formed.FormedFrames = functools.cache(plain)
    made = {}
    catalog_formed.ChildFrames = lambda spark, sf_dir, cells: made.setdefault((sf_dir, len(cells)), children(spark, sf_dir, cells))
    yield
    catalog_formed.FormedFrames, catalog_formed.ChildFrames = plain, children


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    v = v.item() if hasattr(v, "item") else v
    return round(float(v), 7) if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) else v


def rows(columns, data):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in at) for r in data), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in entry.oracle_sql():
        out = db.execute(entry.oracle_sql()[name])
        assert got == rows([c[0] for c in out.description], out.fetchall())
    else:
        assert got[1]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
