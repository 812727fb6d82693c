"""Scores in context blocks are rounded as C's ``%.3f``; consolidation takes idle vaults only."""

import os
import re
import sys

import duckdb

from loreweave.operators import retrieval as rt
from loreweave.plans import registry
from loreweave.plans.tables import Tables, for_duckdb

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check import compare

SCORES = [0.3465, 0.0625, 0.1875, 0.0005, 0.9995, 0.9996, -0.0004, 0.0, 1.0, 1234.5675, -0.3465, -0.0, 1e-9] + [k / 10**6 for k in range(500, 10**6, 1000)]


def test_scores_are_rounded_from_the_binary_value(spark):
    rows = [(1, i, s, "a.md", 0, "t") for i, s in enumerate(SCORES)]
    results = spark.createDataFrame(rows, "query_id long, rank int, score double, source_file string, chunk_index int, text string")
    for context in (rt.build_context(results), rt.cited_context(results, "rank")):
        assert re.findall(r"Score: (\S+)\]", context.first()["context"]) == [f"{s:.3f}" for s in SCORES]


def test_a_vault_that_talks_is_not_consolidated(spark, tmp_path):
    # Even conversations are vault alpha, silent since January; 1001 (beta) is after AS_OF.
    path = str(tmp_path / "conversations.parquet")
    rows = [(c, t, r, f"{r} {c}") for c in (0, 2, 1, 1001) for t, r in enumerate(("user", "assistant"))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(path)
    query = registry.load()["consolidate"]
    df = query.build(Tables(spark, str(tmp_path)))
    got = [tuple(r) for r in df.collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    cur = con.execute(for_duckdb(query.oracle))
    assert {r[df.columns.index("vault")] for r in got} == {"alpha"} and len(got) == 2
    assert compare(df.columns, got, [d[0] for d in cur.description], cur.fetchall()) is None
