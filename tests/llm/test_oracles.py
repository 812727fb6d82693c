"""Training-data queries against their DuckDB oracles, and on tables that are odd or empty."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from check import compare
from pyspark.sql import functions as F

from loreweave.llm import queries as llm

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")
QUERIES, ORACLES = llm.queries(), llm.oracle_sql()


def answers(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{sf_dir}/{t}.parquet') else ''}'")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def test_every_operator_has_a_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in QUERIES


@pytest.mark.parametrize("name", ORACLES)
def test_query_matches_oracle(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    assert compare(df.columns, [tuple(r) for r in df.collect()], *answers(SF_DIR, ORACLES[name])) is None


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with nulls everywhere, empty and long texts, ties, repeated rows and columns
    whose names clash with results."""
    base = str(tmp_path_factory.mktemp("odd"))
    run = "one two three four five six seven eight nine ten " * 6
    long_text = "\n".join(f"word{i % 977} of line {i}" for i in range(60_000))
    rows = [
        (1, run + "\nshort tail", "en", "a", 5), (2, run + "\nshort tail", "en", "a", None), (2, run + "\nshort tail", "en", "a", None),
        (3, None, None, None, None), (4, "", "en", None, 0), (5, "   \n\t ", "de", "b", 6), (6, "ONE Two three", "en", "b", 13),
        (None, "a text without an id, token = abcdefgh1234", "en", "b", 3), (None, None, None, None, None), (7, long_text, "fr", "c", 1),
        (8, "\n" + run + "\nshort tail", "en", "d", 1), (9, "benchmark words " * 10, "en", "d", 2), (10, "x", "en", "é", 1), (10, "y", "en", "z", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for clash in ("score", "stats", "size", "copies", "target", "n_lines", "deleted", "fp", "component_id", "n_words", "words", "secrets", "copy"):
        docs = docs.withColumn(clash, F.lit("clash"))
    docs.write.parquet(f"{base}/documents.parquet")
    labels = [(1, 1, 0), (2, 0, 1), (3, None, None), (4, 1, 0), (None, 1, 1), (5, 0, 0), (6, 1, 1), (6, 1, 1), (99, 0, 0), (8, 0, 1), (9, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash")).write.parquet(f"{base}/labels.parquet")
    items = [("i1", "benchmark words " * 9), ("i2", None), ("i3", ""), (None, "x"), ("i1", "Two THREE"), ("i4", "one two three four five six seven eight nine ten one two three four")]
    spark.createDataFrame(items, "item_id string, text string").withColumn("words", F.lit(1)).write.parquet(f"{base}/benchmark.parquet")
    nan, inf = float("nan"), float("inf")
    vectors = [
        (0, [1.0, 0.0, 0.5, 0.2], 1), (20, [1.0, 0.0, 0.5, 0.2], 1), (1, [0.5, 0.5, 0.1, 0.0], None), (2, None, 0), (3, [0.0, 0.0, 0.0, 0.0], 0),
        (4, [nan, 1.0, 1.0, 1.0], 0), (5, [inf, 1.0, 1.0, 1.0], 0), (6, [1.0, None, 1.0, 1.0], 0), (7, [1.0, 1.0], 0), (8, [], 0),
        (None, [1.0, 1.0, 1.0, 1.0], 0), (40, [-1.0, -0.5, 0.3, 0.9], 2), (40, [-1.0, -0.5, 0.3, 0.9], 2), (9, [1.0, 0.0, 0.5, 0.2], 1),
    ]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit(1)).write.parquet(f"{base}/embeddings.parquet")
    pages = [(1, "http://a/\r\nb", "<p>é</p>"), (2, None, "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c", None), (4, "http://d", ""), (None, "http://e", "<p>é</p>"), (None, None, "lone"), (5, "http://f", "x" * 2_000_000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).write.parquet(f"{base}/pages.parquet")
    return base


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("empty"))
    for t in TABLES:
        spark.read.parquet(f"{odd}/{t}.parquet").limit(0).write.parquet(f"{base}/{t}.parquet")
    return base


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables_give_empty_results(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("pipeline", "op4_nearest_neighbours", "op8_warc_bundles", "op12_html_extraction", "op13_filter_interactions")])
def test_odd_documents_give_a_row_each(spark, odd, name):
    rows = QUERIES[name](spark, odd).collect()
    ids = sorted((r["doc_id"] for r in rows), key=lambda x: (x is None, x))
    assert ids == [1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10, 10, None, None]


@pytest.mark.parametrize("name", ["op3_mix_sources", "op8_warc_bundles", "op13_filter_interactions"])
def test_odd_rows_match_oracle(spark, odd, name):
    df = QUERIES[name](spark, odd)
    assert compare(df.columns, [tuple(r) for r in df.collect()], *answers(odd, ORACLES[name])) is None


def test_odd_benchmark(spark, odd):
    rows = {(r["doc_id"], r["n_words"]): r for r in QUERIES["op7_decontaminate"](spark, odd).collect()}
    assert rows[9, 20]["contaminated"] and rows[9, 20]["n_hit"] == 20
    assert rows[6, 3]["n_hit"] == 2 and rows[6, 3]["contaminated"]
    assert rows[10, 1]["n_items"] in (0, 1) and not rows[3, 0]["contaminated"]
    assert rows[1, 62]["n_hit"] == 54


def test_odd_lines(spark, odd):
    rows = {r["doc_id"]: r for r in QUERIES["op2_line_dedup"](spark, odd).collect() if r["doc_id"] not in (None, 10)}
    assert (rows[1]["deleted"], rows[2]["deleted"], rows[8]["deleted"]) == ("", "0,1", "0,1")
    assert rows[3]["n_lines"] == rows[5]["n_lines"] == 0 and rows[7]["n_deleted"] == 0


def test_odd_vectors(spark, odd):
    rows = QUERIES["op4_nearest_neighbours"](spark, odd).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in rows} == {0, 20, 40}
    assert [(r["vec_id"], r["rank"]) for r in rows if r["query_id"] == 0] == [(9, 1), (20, 2), (1, 3), (40, 4), (40, 5)]


def test_odd_pipeline(spark, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{odd}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, odd)
        assert docs.columns[: len(columns)] == columns, name
        assert docs.filter("score <> 'clash' or size <> 'clash' or n_lines <> 'clash' or copies <> 'clash'").count() == 0


def test_odd_pages(spark, odd):
    rows = sorted(((r["page_id"] is None, r["page_id"] or 0, r["n_chars"]) for r in QUERIES["op12_html_extraction"](spark, odd).collect()))
    assert rows == [(False, 1, 1), (False, 2, 1), (False, 2, 1), (False, 3, 0), (False, 4, 0), (False, 5, 2_000_000), (True, 0, 1), (True, 0, 4)]
