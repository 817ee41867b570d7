"""Each registered query of the reference's own operators against its SQL, over the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from viewforge.plans.queries import ORACLES, QUERIES

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    session = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        session.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return session


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, TABLES).toPandas()
    columns = sorted(got.columns)
    if name not in ORACLES:
        assert len(got)
        return
    want = duck.execute(ORACLES[name]).df()
    assert columns == sorted(want.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
