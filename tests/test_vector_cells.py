"""Searches of many queries: what a cell finds, and how often each side is copied."""

import numpy as np
import pytest

from loreweave.operators import vector


@pytest.mark.parametrize("k", [1, 10, 500])
@pytest.mark.parametrize("threshold", [None, -1.0, 0.3, 0.95])
def test_tiles_give_the_best_of_all_rows(monkeypatch, k, threshold):
    monkeypatch.setattr(vector, "TILE_SCORES", 900)  # some queries at a time
    rng = np.random.default_rng(3)
    rows = np.array(list(rng.normal(size=(300, 6)).round(1)) + [np.zeros(6)] * 2)
    rows[100:140] = rows[60]  # ties
    queries = vector._normal(rng.normal(size=(23, 6)).round(1))
    i, j, score = vector._nearest(queries, [rows[:90], rows[90:95], rows[95:]], k, threshold)
    i2, j2, score2 = vector._best(vector._normal(rows), queries, k, threshold)
    assert list(zip(j, i, score)) == list(zip(j2, i2, score2))


def _copies(queries, rows, cells=48):
    """Of queries and rows together; ``rows`` and ``queries`` per bucket."""
    sizes = dict(enumerate(zip(queries, rows)))
    plan, n = vector._grid(sizes, vector.ROW_VALUES // 65, cells)
    taken = [c for _, first, qs, rs in plan for c in range(first, first + qs * rs)]
    assert set(taken) == set(range(n)) and len(plan) == len(sizes)
    return sum(q * dict((p[0], p[3]) for p in plan)[b] + r * dict((p[0], p[2]) for p in plan)[b] for b, (q, r) in sizes.items()), n


def test_copies_grow_with_the_tables_not_their_product():
    """615,000 queries and 3,080,000 rows were 76 and 188 blocks: 350 million copies."""
    one, _ = _copies([102_500], [513_000])
    six, _ = _copies([615_000], [3_080_000])
    assert six < 25_000_000 and six < 7 * one
    assert _copies([7_200_000] * 2, [1_540_000] * 2)[0] < 150_000_000  # before: four thousand million


def test_small_buckets_share_cells():
    copies, cells = _copies([20] * 1000, [50] * 1000)
    assert copies == 70_000 and cells <= 60


def test_cells_keep_keys_dimensions_and_missing_vaults_apart(spark, monkeypatch):
    monkeypatch.setattr(vector, "ROW_BLOCK", 7)
    big = 2**60
    asked = spark.createDataFrame(
        [(big + i, "ab"[i % 2] if i % 5 else None, [float(i % 3), 1.0, 0.5][: 2 + i % 2]) for i in range(40)], "query_id long, vault string, embedding array<float>"
    )
    held = spark.createDataFrame(
        [(big + i, "ab"[i % 2] if i % 7 else None, [float(i % 4), 1.0, 0.25][: 2 + i % 3 % 2]) for i in range(60)], "id long, vault string, embedding array<float>"
    )
    for options in ({}, {"within": "vault"}, {"per": "vault"}, {"threshold": 0.9}):
        some, all_ = (sorted(map(tuple, vector.knn_batch(asked, held, "id", 3, broadcast_queries=n, **options).collect())) for n in (5, 100))
        assert some == all_ and some
