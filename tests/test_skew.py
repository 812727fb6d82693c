"""Skew-safe helpers and block search against brute force, with one hot key."""

import datetime as dt
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loreweave import skew
from loreweave.operators import graph as gr
from loreweave.operators import links as lk
from loreweave.operators import procedures as pr
from loreweave.operators import vector as vx
from loreweave.plans import registry


@pytest.fixture(scope="module")
def rows(spark):
    # Key 0 holds more than a third of the rows; positions have gaps.
    return spark.range(600).select(
        F.when(F.col("id") % 5 < 2, 0).otherwise(F.col("id") % 7).alias("k"), (F.col("id") * 3 + F.col("id") % 2).alias("t"), (F.col("id") * 37 % 11).alias("x")
    )


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_running_sum_and_position(rows):
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    seg = F.floor(F.col("t") / 50)
    got = skew.position(skew.running_sum(rows, ["k"], seg, [F.col("t")], F.col("x"), "s"), ["k"], seg, [F.col("t")])
    want = rows.withColumn("s", F.sum("x").over(w)).withColumn("pos", F.count(F.lit(1)).over(w))
    same(got.select("k", "t", "s", "pos"), want.select("k", "t", "s", "pos"))


@pytest.mark.parametrize("ahead", [True, False])
def test_neighbour(rows, ahead):
    w = Window.partitionBy("k").orderBy("t")
    got = skew.neighbour(rows, ["k"], F.floor(F.col("t") / 40), [F.col("t")], F.struct("x"), "n", ahead).select("k", "t", F.col("n.x"))
    want = rows.select("k", "t", (F.lead("x") if ahead else F.lag("x")).over(w))
    same(got, want)


def test_halo_frames(rows):
    w = Window.partitionBy("k").orderBy("t")
    placed = rows.withColumn("pos", F.row_number().over(w))
    inner = Window.partitionBy("k", "_block").orderBy("pos").rowsBetween(-3, 2)
    got = skew.with_halo(placed, "pos", 16, before=3, after=2).withColumn("s", F.sum("x").over(inner)).filter("_own")
    same(got.select("k", "t", "s"), rows.select("k", "t", F.sum("x").over(w.rowsBetween(-3, 2))))


def test_order_statistics_with_copies(spark):
    values = [0.0] * 400 + [float(i) / 3 for i in range(300)] + [5.0] * 100
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = skew.order_statistics(df, "v", {"a": 0.5, "b": 0.9, "c": 0.999}).first()
    s = sorted(values)
    assert tuple(got) == tuple(s[int(len(s) * p)] for p in (0.5, 0.9, 0.999))


@pytest.mark.parametrize("limit", [1000, 3])
@pytest.mark.parametrize("within", [None, "vault"])
def test_search_equals_brute_force(spark, limit, within, monkeypatch):
    monkeypatch.setattr(vx, "ROW_BLOCK", 40)
    monkeypatch.setattr(vx, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(150, 8)).astype("float32")
    base[50:110] = base[0]  # a third are copies
    base[149] = 0
    rows = [(i, "a" if i % 3 else "b", [float(x) for x in base[i]]) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, vault string, embedding array<float>")
    asks = df.filter("id % 15 = 0").withColumnRenamed("id", "query_id")
    got = vx.knn_batch(asks, df, "id", 7, within=within, broadcast_queries=limit)
    d = base.astype("float64")
    norm = np.linalg.norm(d, axis=1, keepdims=True)
    unit = np.divide(d, norm, out=np.zeros_like(d), where=norm > 0)
    want = []
    for q in range(0, 150, 15):
        score = np.round(unit @ unit[q], 6) + 0.0
        ids = [i for i in range(150) if within is None or rows[i][1] == rows[q][1]]
        for r, i in enumerate(sorted(ids, key=lambda i: (-score[i], i))[:7]):
            want.append((q, i, float(score[i]), r + 1))
    assert sorted(map(tuple, got.select("query_id", "id", "score", "rank").collect())) == sorted(want)


def test_rows_of_other_dimensions_are_passed_over(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [])], "id long, embedding array<double>")
    out = vx.knn_batch(df.withColumnRenamed("id", "query_id"), df, "id", 5).collect()
    assert sorted((r["query_id"], r["id"]) for r in out) == [(1, 1), (2, 2)]


def test_path_references_with_spaces_and_brackets(spark):
    paths = ["a b/c d.md", "x.md", "notes/x.md", "y(1).md"]
    bodies = {"p1": "see a b/c d.md, ok", "p2": "(x.md) and zx.md", "p3": "zx.md then x.md", "x.md": "x.md here", "p4": 'say "notes/x.md" y(1).md'}
    docs = spark.createDataFrame(list(bodies.items()), "path string, text string")
    known = spark.createDataFrame([(p,) for p in paths], "path string")
    before, after = " \t\n\"'(`", " \t\n\"').,`}>"
    want = set()
    for src, body in bodies.items():
        for p in paths:
            i = body.find(p)
            if p != src and i >= 0 and (i == 0 or body[i - 1] in before) and (i + len(p) >= len(body) or body[i + len(p)] in after):
                want.add((src, p))
    got = {(r["source_path"], r["target_path"]) for r in lk.path_references(docs, known).collect()}
    assert got == want and ("p1", "a b/c d.md") in got


def test_path_references_shuffle_only_pieces_that_look_like_paths(spark):
    docs = spark.createDataFrame([(f"p{i}", f"plain words here {i} doc/{i}.md, " * 5) for i in range(200)] + [("none", None), ("empty", "")], "path string, text string").repartition(4)
    known = spark.createDataFrame([("doc/7.md",), ("doc/9.md",)], "path string")
    out = lk.path_references(docs, known)
    assert {(r["source_path"], r["target_path"]) for r in out.collect()} == {("p7", "doc/7.md"), ("p9", "doc/9.md")}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_look" in plan and plan.count("split(text") == 1


@pytest.mark.parametrize("threshold", [0.6, 0.75, 0.85])
def test_name_dedup_misses_no_pair(spark, threshold):
    rng = np.random.default_rng(7)
    words = ["run", "check", "the", "nginx", "config", "of", "db", "test"]
    names = sorted({" ".join(rng.choice(words, size=rng.integers(1, 6))) for _ in range(60)})
    new = spark.createDataFrame([(n,) for n in names[::2]], "name string")
    old = spark.createDataFrame([(f"k{i}", n) for i, n in enumerate(names[1::2])], "key string, name string")
    sim = F.round(pr.name_similarity(F.col("name"), F.col("b")), 6)
    pairs = new.crossJoin(old.select(F.col("name").alias("b"))).withColumn("s", sim).filter(F.col("s") >= threshold)
    want = {r["name"]: r["m"] for r in pairs.groupBy("name").agg(F.max("s").alias("m")).collect()}
    got = {r["name"]: r["similarity"] for r in pr.dedup_procedures(new, old, threshold).collect() if r["similarity"] is not None}
    assert got == want


def _moments(spread, n):
    """Instants spread evenly, or most of them within one second of a long time."""
    start = dt.datetime(2023, 1, 1)
    if spread == "even":
        return [start + dt.timedelta(days=12 * i) for i in range(n)]
    return [start + dt.timedelta(microseconds=i * i) for i in range(n)] + [start + dt.timedelta(days=4000)]


@pytest.mark.parametrize("spread,n", [("even", 0), ("even", 1), ("even", 30), ("dense", 200)])
def test_as_of_join_matches_brute_force(spark, spread, n):
    """Open, empty, reversed and repeated intervals; repeated and null instants."""
    at = _moments(spread, n)
    rng = np.random.default_rng(7)
    edge = at + [t + dt.timedelta(microseconds=d) for t in at for d in (-1, 1)] + [dt.datetime(1990, 1, 1), dt.datetime(2060, 1, 1), None]
    pick = lambda: edge[rng.integers(len(edge))]
    rows = [(i, pick(), pick()) for i in range(150)] + [(150, None, None), (150, None, None)]
    held = spark.createDataFrame(rows, "id long, valid_from timestamp_ntz, valid_until timestamp_ntz")
    asked = spark.createDataFrame([(t,) for t in [*at, *at[:5], None]], "at timestamp_ntz")
    got = sorted((r["id"], r["at"]) for r in gr.as_of_join(held, asked).collect())
    assert got == sorted((i, t) for i, a, b in rows for t in at if (a is None or a <= t) and (b is None or t < b))


def test_as_of_cover_is_exact_and_small(spark):
    """Every interval of 32 cells: the nodes hold its cells once, at most two a level."""
    pairs = spark.createDataFrame([(a, b) for a in range(32) for b in range(a, 32)], "a long, b long")
    for a, b, nodes in pairs.select("a", "b", gr._cover(F.col("a"), F.col("b"), F.lit(5))).collect():
        cells = []
        for x in nodes:
            width = 1 << (6 - x.bit_length())
            cells += range(x * width - 32, (x + 1) * width - 32)
        assert sorted(cells) == list(range(a, b + 1)) and len(nodes) <= 10


def test_as_of_queries_join_open_ended_edges(spark):
    """Both queries over a fixture, against brute force; no end is the latest end."""
    at = lambda d: dt.datetime(2023, 1, 1) + dt.timedelta(days=d)
    edges = [(f"e{i}", at(9 * i), None if i % 3 else at(9 * i + 70)) for i in range(40)]
    orders = [(at(12 * i),) for i in range(30)]
    tables = SimpleNamespace(
        edges_in=spark.createDataFrame(edges, "id string, valid_from timestamp_ntz, valid_until timestamp_ntz"),
        orders=spark.createDataFrame(orders, "o_orderdate timestamp_ntz"),
    )
    months = {d.replace(day=1) for (d,) in orders}
    want = sorted((m, i) for i, a, b in edges for m in months if a <= m and (b is None or m < b))
    for name in ("edges_as_of_join", "edges_as_of_join_months"):
        assert sorted(map(tuple, registry.load()[name].build(tables).collect())) == want
