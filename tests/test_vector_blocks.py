"""The block kernel of vector search against sorting all scores, and how it cuts both sides."""

import numpy as np
import pytest

from loreweave.operators import vector


@pytest.mark.parametrize("k", [1, 10, 500])
@pytest.mark.parametrize("threshold", [None, -1.0, 0.3, 0.95])
def test_best_are_those_of_a_full_sort(monkeypatch, k, threshold):
    monkeypatch.setattr(vector, "SCORES", 900)  # some queries at a time
    rng = np.random.default_rng(3)
    rows = vector._unit(list(rng.normal(size=(300, 6)).round(1)) + [np.zeros(6)] * 2)
    rows[100:140] = rows[60]  # ties
    queries = vector._unit(list(rng.normal(size=(23, 6)).round(1)))
    queries[5] = rows[60]
    i, j, score = vector._best(rows, queries, k, threshold)
    want = []
    for q in range(len(queries)):
        all_scores = np.round(queries[q] @ rows.T, 6) + 0.0
        order = sorted(range(len(rows)), key=lambda r: (-all_scores[r], r))[:k]
        want += [(q, r) for r in order if threshold is None or all_scores[r] >= threshold]
    assert list(zip(j.tolist(), i.tolist())) == want


def test_blocks_copy_each_side_few_times(spark):
    """40,000 rows and 20,000 queries: three blocks of either, nine cells (before: five and ten, fifty)."""
    made = lambda n, name: spark.range(n).selectExpr(f"id AS {name}", "array(cast(id % 7 AS float), cast(id % 11 AS float), 1f) AS embedding")
    found = vector.knn_batch(made(20_000, "query_id"), made(40_000, "doc_id"), "doc_id", 2)
    assert -(-20_000 // vector.QUERY_BLOCK) * -(-40_000 // vector.ROW_BLOCK) <= 9
    got = {(r["query_id"], r["rank"]): r["doc_id"] for r in found.filter("query_id < 3").collect()}
    assert got == {(q, rank): q + 77 * (rank - 1) for q in range(3) for rank in (1, 2)}
