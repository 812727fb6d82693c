"""Rewritten queries of odd texts are those of the query's SQL."""

import duckdb

from loreweave.plans import registry

TEXTS = ["", " \n\t", None, "one.", " two words \n", "how\nto en", "x" * 5000 + "\n"]


def test_empty_and_missing_texts_match_the_sql(spark, tmp_path):
    rows = [(i, text, "en", "src1") for i, text in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT query_id, mode, part, text FROM ({registry.oracle_sql()['apply_rewrite']})").fetchall()
    got = registry.queries()["apply_rewrite"](spark, str(tmp_path)).select("query_id", "mode", "part", "text").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and len(want) == 7 * len(TEXTS)
