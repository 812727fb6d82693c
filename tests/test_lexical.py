"""Lexical search: scores in tasks and by a join give the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from loreweave.operators import lexical as lx


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(["common", *rnd.choices(words, k=rnd.randint(1, 30))]) for _ in range(300)]
    rows = [(f"k{i}", t) for i, t in enumerate(texts + texts[:5] * 40 + ["", None, "the of"])]
    return spark.createDataFrame([*rows, ("k3", "w1 w1 w2"), (None, "w1 w2 common")], "key string, text string").repartition(5)


@pytest.mark.parametrize("variant", ["reference", "okapi"])
@pytest.mark.parametrize("scores", [lx.SCORES, 50])
def test_scores_in_tasks_equal_those_of_a_join(spark, docs, variant, scores, monkeypatch):
    monkeypatch.setattr(lx, "SCORES", scores)
    asks = spark.createDataFrame([(i, f"w{i} w{i} w{i + 1} common absent") for i in range(30)] + [(99, "absent"), (98, "the"), (None, "w1")], "query_id int, text string")
    index, stats = lx.postings(docs, "key"), lx.collection_stats(docs)
    got, want = ([tuple(r) for r in lx.bm25(asks, index, stats, "key", 7, variant=variant, broadcast_terms=n).collect()] for n in (10_000, 0))
    by_rank = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(got, key=by_rank) == sorted(want, key=by_rank)
    assert len(got) > 200


def test_tasks_hand_on_few_rows(docs):
    parts = lx.postings(docs, "key").select("key", "term", F.lit(1.0).alias("part"))
    weighted = parts.sparkSession.createDataFrame([(1, "common", 1.0), (2, "w1", 2.0)], "query_id int, term string, weight double")
    out = lx._best_in_tasks(parts, weighted, "key", 3)
    assert out.count() <= 3 * 2 * 8


def test_words_are_taken_once_a_text(docs):
    plan = lx.postings(docs, "key")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_queries_without_terms_give_no_rows(spark, docs):
    asks = spark.createDataFrame([(1, "the of")], "query_id int, text string")
    assert lx.bm25(asks, lx.postings(docs, "key"), lx.collection_stats(docs), "key", 7).count() == 0
    assert lx.bm25(asks.limit(0), lx.postings(docs, "key"), lx.collection_stats(docs), "key", 7).count() == 0


def test_sparse_encode_counts_postings_once(docs):
    out = lx.sparse_encode(docs, lx.postings(docs, "key"), "key")
    assert "split(" not in out._jdf.queryExecution().optimizedPlan().toString()
    norms = out.groupBy("key").agg(F.sum(F.col("weight") * F.col("weight")).alias("n"))
    assert norms.filter("abs(n - 1) > 1e-9").count() == 0 and norms.count() > 300
