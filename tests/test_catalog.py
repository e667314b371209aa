"""A few registered queries against DuckDB on the smallest tables; tools/check_oracle.py runs all of them."""

import os

import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["dt_summary", "resample_linear", "nearest_match", "dmdc_per_case", "rollout", "kalman_filter",
                                  "trust_timeline", "window_summary", "live_row_checks"])
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    cursor = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    assert got == rows(cursor.fetchall(), names) and got


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_views_read_by_several_passes_are_made_once(spark):
    """The plans of these views begin at stored rows: a pass over them groups or matches nothing again."""
    from trajmill import catalog

    folder = "/root/testdata/sf0.001"
    for view in (catalog.supply, catalog.split_supply, catalog.bias_chain):
        plan = view(spark, folder)._jdf.queryExecution().analyzed().toString()
        assert not any(step in plan for step in ("Aggregate", "Join", "Window", "MapIn")), view.__name__
