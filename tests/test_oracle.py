"""Every catalogue query against its DuckDB oracle, over whole tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check import compare

from loreweave.plans import registry
from loreweave.plans.tables import BASE, Tables, for_duckdb

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CATALOGUE = registry.load()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in BASE:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n, q in CATALOGUE.items() if q.oracle])
def test_query_matches_oracle(spark, con, name):
    q = CATALOGUE[name]
    df = q.build(Tables(spark, SF_DIR))
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(for_duckdb(q.oracle))
    columns = [d[0] for d in cur.description]
    assert compare(df.columns, got, columns, cur.fetchall()) is None


def test_inventory_ids_are_known():
    ids = {i for q in CATALOGUE.values() for i in q.covers.split(",")}
    assert all(i[0].isalpha() and i[1:].isdigit() for i in ids)
    assert len(ids) > 150
