"""Every query of the engine against its SQL on the smallest tables."""

import os

import pytest

from mergeview.plans import catalog
from tests.conftest import SF

TABLES = "customer orders events pages".split()


@pytest.fixture(scope="module")
def db():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    want = db.sql(catalog.ORACLES[name])
    key = lambda row: repr(sorted(row.items()))
    rows = sorted(key(r.asDict()) for r in got.collect())
    assert rows == sorted(key(dict(zip(want.columns, r))) for r in want.fetchall())


def test_picked_run_is_one_that_the_sql_may_give(spark):
    """ORDER BY overlap_bytes, min_key LIMIT 1 leaves runs with equal ones open here; the smallest id among them is picked."""
    import duckdb

    folder = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet')")
    whole = catalog.ORACLES["lcs_pick_run"].replace("SELECT run_id, overlap_bytes FROM (", "SELECT overlap_bytes, min_key, run_id FROM (").replace(" LIMIT 1)", ")")
    rows = c.sql(whole).fetchall()
    tied = sorted((r, b) for b, key, r in rows if (b, key) == min(x[:2] for x in rows))
    assert len(tied) > 1 and [tuple(r) for r in catalog.QUERIES["lcs_pick_run"](spark, folder).collect()] == tied[:1]


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.ORACLES.keys()))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
