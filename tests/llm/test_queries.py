"""Registered queries: SQL where there is some, else that they run and give rows."""

import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from quarry.llm import queries as q

SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not SF.is_dir(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want, got = con.sql(q.SQL[name]), q.QUERIES[name](spark, str(SF))
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert Counter(str(tuple(r)) for r in got.select(order).collect()) == Counter(str(r) for r in want.select(*order).fetchall())


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.SQL)))
def test_runs(spark, name):
    assert q.QUERIES[name](spark, str(SF)).count() > 0
