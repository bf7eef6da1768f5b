"""Every query with SQL against DuckDB at sf0.001; the others must run and give rows."""

import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.queries import clustering, dense, mining, nested, text

SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
QUERIES = {k: f for m in (mining, text, clustering, dense, nested) for k, f in m.QUERIES.items()}
SQL = {k: q for m in (mining, text, clustering, dense, nested) for k, q in m.SQL.items()}
pytestmark = pytest.mark.skipif(not SF.is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(names, got):
    return Counter(str(tuple(r[names.index(c)] for c in sorted(names))) for r in got)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    want = duck.sql(SQL[name])
    got = QUERIES[name](spark, str(SF))
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())


def _fits(df):
    """Every document assigned once, to one of at most 20 clusters."""
    assert df.count() == df.select("doc_id").distinct().count() > 0
    assert 1 < df.select("cluster").distinct().count() <= 20 and df.where("cluster IS NULL OR cluster < 0 OR cluster >= 20").count() == 0


def _weights(df):
    got = df.agg(F.count("*").alias("n"), F.countDistinct("dim").alias("d"), F.countDistinct("label").alias("l"), F.sum(F.abs("w")).alias("s")).first()
    assert got["n"] == got["d"] * got["l"] and got["d"] == 49 and got["s"] > 0


def _predicted(df):
    """Labels of the data, and better than always guessing the same one."""
    rows = df.collect()
    assert {r["pred"] for r in rows} <= {r["label"] for r in rows} | {r["pred"] for r in rows} and len(rows) == len({r["id"] for r in rows}) > 0
    most = Counter(r["label"] for r in rows).most_common(1)[0][1]
    assert sum(r["label"] == r["pred"] for r in rows) >= 0.5 * most


def _shares(df):
    rows = df.collect()
    assert len(rows) == 7 and all(0 <= r["accuracy"] <= 1 for r in rows)


def _descending(df):
    v = [r["value"] for r in df.orderBy("k").collect()]
    assert len(v) == 20 and v == sorted(v, reverse=True) and v[-1] >= 0


def _linked(df):
    """Every child names a parent of its own record and one depth less."""
    rows = df.collect()
    at = {(r["file_key"], r["record_no"], r["node_no"]): r for r in rows}
    assert len(at) == len(rows) > 0
    assert all(r["parent_no"] is None or at[r["file_key"], r["record_no"], r["parent_no"]]["depth"] == r["depth"] - 1 for r in rows)


INVARIANTS = {
    **dict.fromkeys(["kmeans_fit", "kmeans_fit_e1", "kmeans_best_trial", "kmeans_sequential"], _fits),
    **dict.fromkeys(["ridge_weights", "nn_ridge_weights"], _weights),
    **dict.fromkeys(["ridge_classify", "nn_ridge_classify", "ridge_predict_trained"], _predicted),
    **dict.fromkeys(["ridge_validate_lambda_trained", "nn_ridge_validate_lambda_trained"], _shares),
    "ridge_objective_trained": lambda df: [r["objective"] > 0 or pytest.fail() for r in df.collect()],
    "svd_singular_values": _descending,
    "svd_project": lambda df: df.where("size(features) <> 10").count() == 0 or pytest.fail(),
    "nn_match_counts_svd": lambda df: (df.count() == 24 and df.where("matched > n OR n = 0").count() == 0) or pytest.fail(),
    "p2_nodes": _linked,
    "p2_entries": lambda df: df.where("entry = '' OR seq_no < 1 OR tag IS NULL").count() == 0 < df.count() or pytest.fail(),
    "p2_elements": lambda df: df.where("entry = '' OR seq_no < 1 OR tag IS NULL").count() == 0 < df.count() or pytest.fail(),
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_invariants(spark, name):
    INVARIANTS[name](QUERIES[name](spark, str(SF)))


def test_trained_objective_is_below_untrained(spark):
    at = lambda name: {r["label"]: r["objective"] for r in QUERIES[name](spark, str(SF)).collect()}
    trained, early = at("ridge_objective_trained"), at("ridge_objective")
    assert set(trained) == set(early) and all(trained[k] <= early[k] + 1e-6 for k in early)


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
