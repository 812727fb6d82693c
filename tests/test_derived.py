"""The derived tables with vectors: equi joins, the rows of their SQL, no vectors at all."""

import os

import duckdb
import pytest

from loreweave.plans.tables import BASE, Tables, for_duckdb

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WITH_VECTORS = {"chunks": "doc_id", "fact_vectors": "event_id", "asks": "query_id", "incoming_vectors": "event_id"}


@pytest.mark.parametrize("name", WITH_VECTORS)
def test_vectors_meet_rows_in_an_equi_join(spark, name):
    plan = getattr(Tables(spark, SF_DIR), name)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", WITH_VECTORS)
def test_rows_are_those_of_the_sql(spark, name):
    key = WITH_VECTORS[name]
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    want = con.execute(for_duckdb(f"SELECT {key}, embedding FROM {name}")).fetchall()
    got = getattr(Tables(spark, SF_DIR), name).select(key, "embedding").collect()
    assert sorted((r[0], list(r[1])) for r in got) == sorted((k, list(v)) for k, v in want)


def test_no_vectors_no_rows(spark, tmp_path):
    for t in ("documents", "embeddings"):
        df = spark.read.parquet(f"{SF_DIR}/{t}.parquet")
        (df.limit(0) if t == "embeddings" else df).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert Tables(spark, str(tmp_path)).chunks.count() == 0
