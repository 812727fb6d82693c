"""Approximate nearest neighbours by an inverted multi-index, for the largest inner product.

A vector is cut in two halves and each half is quantised by its own centroids, so a cell is
a pair of centroids and few centroids make many cells. A query scores the centroids
of each half, walks the pairs from the best sum downwards with a heap, and stops once
the cells it has seen hold enough rows; the rows of those cells are then ranked by the
exact inner product. Equal vectors are one entry with its smallest ids, which is all that
a list of the nearest can show of them, so one very common vector fills no cell.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.llm.common import table
from loreweave.session import durable

#: Centroids of a half, rows they are learned from, and rounds of learning.
CENTROIDS, SAMPLE, ROUNDS = 64, 20_000, 12
#: Rows a query's cells hold before it stops: this share of all, and at least so many.
#: Near-random vectors need this much for nine neighbours in ten; clustered ones far less.
SHARE, LEAST = 0.5, 2_000
#: Nearest rows asked for, entries of one first centroid and queries that a group of a task
#: takes, and queries it multiplies at a time.
NEAREST, BLOCK, QUERIES, AT_ONCE = 20, 16_384, 8_192, 256


@dataclass(frozen=True)
class Quantiser:
    first: np.ndarray
    second: np.ndarray

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        return x[:, :cut] @ self.first.T, x[:, cut:] @ self.second.T

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each half."""
        a, b = self.scores(x)
        return (a - 0.5 * (self.first**2).sum(1)).argmax(1), (b - 0.5 * (self.second**2).sum(1)).argmax(1)


def _centroids(x: np.ndarray, k: int) -> np.ndarray:
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = (x @ c.T - 0.5 * (c**2).sum(1)).argmax(1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def valid(vectors: DataFrame) -> DataFrame:
    """``(vec_id, embedding)`` as doubles, without vectors that are null, empty, zero, or
    hold a null or non-finite component, and of the most frequent length only (the
    longer on a tie), as no inner product joins different lengths."""
    v = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    good = vectors.select("vec_id", v.alias("embedding")).filter(
        (F.size("embedding") > 0) & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)
    )
    lengths = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return good.filter(F.size("embedding") == (lengths[0] if lengths else 0))


def entries(rows: DataFrame, nearest: int) -> DataFrame:
    """Distinct vectors of ``valid`` rows: ``(uid, ids, embedding)``, ``ids`` the smallest
    ``nearest + 1`` (a query's own may be among them), ascending. Rows with a null id
    can not be told apart and take no part."""
    by = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.filter(F.col("vec_id").isNotNull()).withColumn("k", F.row_number().over(by)).filter(F.col("k") <= nearest + 1)
    made = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return durable(made.withColumn("uid", F.monotonically_increasing_id()))


def learn(known: DataFrame, n: int) -> Quantiser:
    """Centroids from a sample of at most about ``SAMPLE`` entries, by hash."""
    keep = F.pmod(F.xxhash64("embedding"), F.lit(1 << 24)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 24)) + 1
    x = np.array([r[0] for r in known.filter(keep).select("embedding").toLocalIterator()], dtype=np.float64)
    if not len(x):
        return Quantiser(np.zeros((1, 1)), np.zeros((1, 1)))
    cut = max(1, x.shape[1] // 2)
    return Quantiser(_centroids(x[:, :cut], CENTROIDS), _centroids(x[:, cut:], CENTROIDS))


def traverse(a: np.ndarray, b: np.ndarray, held: np.ndarray, enough: float) -> list[list[int]]:
    """Second centroids visited per first one: pairs by descending sum of the scores ``a``
    and ``b``, until the cells (``held`` rows each) hold ``enough`` rows."""
    one, two = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    x, y = a[one].tolist(), b[two].tolist()
    counts = held[np.ix_(one, two)].tolist()
    seen: list[list[int]] = [[] for _ in range(len(a))]
    heap, total = [(-(x[0] + y[0]), 0, 0)], 0
    while heap and total < enough:
        _, i, j = heapq.heappop(heap)
        if counts[i][j]:
            total += counts[i][j]
            seen[one[i]].append(int(two[j]))
        if j + 1 < len(y):
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (-(x[i + 1] + y[0]), i + 1, 0))
    return seen


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def search(vectors: DataFrame, is_query: Column, nearest: int = NEAREST) -> DataFrame:
    """For each row of ``vectors(vec_id, embedding)`` for which ``is_query`` holds, its
    ``nearest`` neighbours found: ``(query_id, rank, vec_id, score)``.

    Candidates are all rows but those with the query's id; fewer give fewer. Ties go to
    the smaller id. The score is the inner product in double precision. Which rows are
    valid says ``valid``. Repeated rows of one id show it as often as it is repeated,
    queries repeated so are answered once. No valid row, no result.
    """
    rows = durable(valid(vectors))
    known = entries(rows, nearest)
    n = known.count()
    q = learn(known, n)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                one, two = q.cells(_matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(one.astype(np.int32)), pa.array(two.astype(np.int32))], ["uid", "embedding", "one", "two"])

    placed = durable(known.select("uid", "embedding").mapInArrow(place, "uid bigint, embedding array<double>, one int, two int"))
    held = np.zeros((len(q.first), len(q.second)), dtype=np.int64)
    for r in placed.groupBy("one", "two").count().toLocalIterator():
        held[r["one"], r["two"]] = r["count"]
    enough = max(SHARE * n, LEAST)
    blocks = np.maximum(1, -(-held.sum(1) // BLOCK))

    asked = durable(
        rows.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_e")).distinct()
        .join(known.select("embedding", "uid"), F.col("_e") == F.col("embedding")).select("query_id", "uid")
    )
    wanted = durable(known.join(asked.select("uid").distinct(), "uid", "left_semi").select("uid", "embedding"))
    parts = max(1, -(-wanted.count() // QUERIES))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.slice(at, 512)
                a, c = q.scores(_matrix(part.column(1)))
                at_, one, block, two = [], [], [], []
                for i in range(len(part)):
                    for first, seconds in enumerate(traverse(a[i], c[i], held, enough)):
                        for k in range(blocks[first] if seconds else 0):
                            at_.append(i), one.append(first), block.append(k), two.append(seconds)
                part = part.take(pa.array(at_, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(one, pa.int32()), pa.array(block, pa.int32()), pa.array(two, pa.list_(pa.int32()))],
                    ["quid", "query", "one", "block", "twos"],
                )

    routes = wanted.mapInArrow(walk, "quid bigint, query array<double>, one int, block int, twos array<int>")
    routes = routes.withColumn("part", F.pmod(F.xxhash64("quid"), F.lit(parts)).cast("int"))
    split = F.array(*[F.lit(int(x)) for x in blocks])
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("uid"), split[F.col("one")].cast("long")).cast("int"))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def rank(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            x, two, uid = _matrix(right.column("embedding")), right.column("two").to_numpy(), right.column("uid").to_numpy()
            quid = left.column("quid").to_numpy()
            for at in range(0, len(left), AT_ONCE):
                y = _matrix(left.column("query").slice(at, AT_ONCE))
                s = y @ x.T
                for i, twos in enumerate(left.column("twos").slice(at, AT_ONCE).to_pylist()):
                    inside = np.flatnonzero(np.isin(two, twos))
                    if len(inside) > nearest + 1:
                        least = np.partition(s[i, inside], -(nearest + 1))[-(nearest + 1)]
                        inside = inside[s[i, inside] >= least - 1e-9 * (1 + abs(least))]
                    exact = (x[inside] * y[i]).sum(axis=1)
                    out.append((np.full(len(inside), quid[at + i]), uid[inside], exact))
        names = ["quid", "uid", "score"]
        if not out:
            return pa.table({"quid": pa.array([], pa.int64()), "uid": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return pa.table(dict(zip(names, (np.concatenate(c) for c in zip(*out)))))

    found = routes.groupBy("one", "block", "part").cogroup(dealt.groupBy("one", "block", "part")).applyInArrow(rank, "quid bigint, uid bigint, score double")
    named = found.join(known.select("uid", "ids"), "uid").withColumn("first", F.col("ids")[0])
    best = Window.partitionBy("quid").orderBy(F.desc("score"), "first")
    few = named.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= nearest + 1).select("quid", "ids", "score")
    lists = few.select("quid", F.explode("ids").alias("vec_id"), "score")
    top = Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id")
    lists = lists.withColumn("k", F.row_number().over(top)).filter(F.col("k") <= nearest + 1).groupBy("quid").agg(
        F.sort_array(F.collect_list(F.struct("k", "vec_id", "score"))).alias("list")
    )
    mine = asked.join(lists, asked["uid"] == lists["quid"]).withColumn("list", F.filter("list", lambda x: x["vec_id"] != F.col("query_id")))
    return mine.select("query_id", F.posexplode(F.slice("list", 1, nearest)).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score"
    )


def op4(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
