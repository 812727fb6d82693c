"""Hand-sized cases with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loreweave.functions import clock, text
from loreweave.functions import facts as ff
from loreweave.operators import chunking as ck
from loreweave.operators import communities as cm
from loreweave.operators import evaluation as ev
from loreweave.operators import gates
from loreweave.operators import graph as gr
from loreweave.operators import lexical as lx
from loreweave.operators import lifecycle as lc
from loreweave.operators import links as lk
from loreweave.operators import parsing as ps
from loreweave.operators import procedures as pr
from loreweave.operators import reports as rp
from loreweave.operators import retrieval as rt
from loreweave.operators import review as rv
from loreweave.operators import sessions as ss
from loreweave.operators import vector as vx
from loreweave.plans.tables import Tables

NOW = "2024-02-01 00:00:00"
T0 = dt.datetime(2024, 1, 1)


def ntz(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def rankings(spark, lists):
    rows = [(1, f"l{i}", x, r + 1) for i, items in enumerate(lists) for r, x in enumerate(items)]
    return spark.createDataFrame(rows, "query_id int, source string, id string, rank int")


def test_rrf_shared_item_first(spark):
    out = rt.rrf(rankings(spark, [["solo", "shared"], ["shared", "other"]]), "id", 10).orderBy("rank").collect()
    assert out[0]["id"] == "shared"
    out = rt.rrf(rankings(spark, [["d1", "d2", "common"], ["common", "l1"]]), "id", 10).orderBy("rank").collect()
    assert out[0]["id"] == "common" and len(out) == 4


def test_bm25_finds_the_only_match_and_ignores_stopwords(spark):
    docs = spark.createDataFrame(
        [("1", "the quick brown fox"), ("2", "a lazy dog sleeps"), ("3", "idempotent database migrations are safe")], "id string, text string"
    )
    asks = spark.createDataFrame([(1, "database migrations idempotent"), (2, "the and of")], "query_id int, text string")
    hits = lx.bm25(asks, lx.postings(docs, "id"), lx.collection_stats(docs), "id", 10).collect()
    assert [(r["query_id"], r["id"]) for r in hits] == [(1, "3")]


@pytest.mark.parametrize("ids,answer,want", [("abc", "3,1,2", "cab"), ("abc", "2,1", "bac"), ("ab", "9, 2, 2, 0, 1", "ba")])
def test_rerank(spark, ids, answer, want):
    results = spark.createDataFrame([(1, i + 1, c) for i, c in enumerate(ids)], "query_id int, rank int, id string")
    answers = spark.createDataFrame([(1, answer)], "query_id int, answer string")
    out = rt.rerank(results, answers, "id").orderBy("rank").collect()
    assert "".join(r["id"] for r in out) == want


def test_multiquery_lines_then_original(spark):
    asks = spark.createDataFrame([(1, "cooking rice")], "query_id int, text string")
    answers = spark.createDataFrame([(1, "1. how to cook rice\n2. rice cooking method\n- how to cook rice")], "query_id int, answer string")
    out = rt.apply_rewrite(asks, answers, "multiquery").orderBy("part").collect()
    assert [r["text"] for r in out] == ["how to cook rice", "rice cooking method", "cooking rice"]
    assert rt.apply_rewrite(asks, None, "hyde").first()["text"] == "cooking rice"


def test_token_limit_keeps_header_and_words(spark):
    body = "# Title\n\n" + "\n\n".join(" ".join(f"w{i}x{j}" for j in range(50)) for i in range(10))
    docs = spark.createDataFrame([("a.md", body)], "path string, text string")
    out = ck.chunk_documents(docs, max_tokens=400).orderBy("chunk_index").collect()
    assert len(out) >= 2
    assert all(int(len(r["text"].split()) * 1.3) <= 400 and r["header"] == "# Title" for r in out)
    assert " ".join(r["text"] for r in out).split() == body.split()
    assert [r["chunk_index"] for r in out] == list(range(len(out)))


def test_key_versions(spark):
    keys = ["org/v1/decision", "api/v2/models/v3/config", "plain/key", "x/v0/y", "v2/z", "a/version/b"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    out = {r[0]: (r[1], r[2]) for r in df.select("k", text.version_of_key(F.col("k")), text.key_prefix(F.col("k"))).collect()}
    assert out["api/v2/models/v3/config"] == (3, "api/v2/models")
    assert out["org/v1/decision"] == (1, "org")
    assert out["plain/key"] == (0, "") and out["x/v0/y"] == (0, "") and out["v2/z"] == (2, "") and out["a/version/b"] == (0, "")


def fact(spark, **columns):
    df = spark.range(1).select(F.lit("v").alias("vault"), F.lit("k").alias("fact_key"))
    typed = {c: F.lit(v).cast(ff.FACT_COLUMNS[c]) for c, v in columns.items()}
    return ff.with_fact_columns(df.withColumns(typed))


def test_decay_half_life_and_cap(spark):
    def kept(**c):
        return fact(spark, **c).select(ff.accessibility(NOW)).first()[0]

    assert kept(created_at="2024-01-02 00:00:00") == pytest.approx(0.5)
    days = [kept(created_at=str(dt.datetime(2024, 2, 1) - dt.timedelta(days=d))) for d in (1, 7, 30, 90, 365)]
    assert all(0 < b < a <= 1 for a, b in zip(days, days[1:]))
    assert kept() == 1.0
    big = fact(spark, access_count=10**9, confirmation_count=10**9, confidence=1.0, ttl_days=10**6)
    assert big.select(ff.stability()).first()[0] == 12.0


def test_importance_of_a_perfect_fact(spark):
    f = fact(spark, access_count=100, last_accessed_at=NOW, confirmation_count=10, confidence=1.0)
    assert f.select(ff.importance(NOW)).first()[0] == pytest.approx(1.0)


def test_new_edge_ends_the_old_one(spark):
    rows = [("e1", "A", "C1", "2020-01-01", "2030-01-01", "2020-01-01", 1), ("e2", "A", "C2", "2022-01-01", None, "2022-01-01", 2)]
    edges = spark.createDataFrame(rows, "id string, source_id string, target_id string, valid_from string, valid_until string, created_at string, seq int")
    edges = ntz(edges, "valid_from", "valid_until", "created_at").withColumns(
        {"vault": F.lit("v"), "type": F.lit("works_at"), "invalidated_at": F.lit(None).cast("timestamp_ntz")}
    )
    closed = gr.close_intervals(edges)
    assert [r["target_id"] for r in gr.edges_as_of(closed, "2023-01-01 00:00:00").collect()] == ["C2"]
    assert [r["target_id"] for r in gr.edges_as_of(closed, "2021-01-01 00:00:00").collect()] == ["C1"]
    assert [r["id"] for r in gr.current_edges(closed).collect()] == ["e2"]


def test_two_triangles_are_two_communities(spark):
    pairs = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", 1.0) for a, b in pairs], "u string, v string, w double")
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(7)], "node string")
    groups = {}
    for r in cm.detect(edges, nodes).collect():
        groups.setdefault(r["label"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [["n0", "n1", "n2"], ["n3", "n4", "n5"], ["n6"]]


def test_communities_never_lower_modularity_and_conserve_weight(spark):
    edges = spark.createDataFrame([(f"a{i % 9}", f"b{(i * 7) % 11}", 1.0 + i % 3) for i in range(60)], "u string, v string, w double")
    edges = edges.groupBy("u", "v").agg(F.sum("w").alias("w"))
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    labels = cm.detect(edges, nodes)
    alone = nodes.withColumn("label", F.col("node"))
    assert labels.count() == nodes.count()
    assert cm.modularity(edges, labels).first()[0] >= cm.modularity(edges, alone).first()[0]
    total = edges.agg(F.sum("w")).first()[0]
    assert cm.aggregate_graph(edges, labels).agg(F.sum("w")).first()[0] == pytest.approx(total)


def facts_table(spark, rows):
    df = spark.createDataFrame(rows, "fact_key string, status string, supersedes string, supports array<string>, ttl_days int, expires_at string, confidence double")
    return ntz(df, "expires_at").withColumns({"vault": F.lit("v"), "refines": F.lit(None).cast("string"), "contradicts": F.array().cast("array<string>")})


def test_scans(spark):
    facts = facts_table(spark, [
        ("newer", "active", "older", [], 0, None, 0.9), ("older", "active", None, [], 0, None, 0.9),
        ("org/v1/d", "active", None, [], 0, None, 0.9), ("org/v2/d", "active", None, [], 0, None, 0.9),
        ("stale", "active", None, [], 5, "2024-01-01 00:00:00", 0.9), ("kept", "active", None, [], 5, "2024-01-01 00:00:00", 0.9),
        ("ref", "active", None, ["kept"], 0, None, 0.4),
    ])
    assert [r["fact_key"] for r in lc.supersede_by_reference(facts).collect()] == ["older"]
    assert [(r["fact_key"], r["superseded_by"]) for r in lc.supersede_by_version(facts).collect()] == [("org/v1/d", 2)]
    assert [r["fact_key"] for r in lc.ttl_stale(facts, NOW).collect()] == ["stale"]
    assert [r["fact_key"] for r in lc.low_confidence(facts).collect()] == ["ref"]
    a = lc.change_set(lc.ttl_stale(facts, NOW), lc.low_confidence(facts), lc.supersede_by_version(facts))
    b = lc.change_set(lc.supersede_by_version(facts), lc.low_confidence(facts), lc.ttl_stale(facts, NOW))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_conflict_marks_the_newer_fact_once(spark):
    rows = [(1, "k1", "2024-01-01", [1.0, 0.0]), (2, "k2", "2024-01-02", [0.95, 0.3]), (3, "k3", "2024-01-03", [0.0, 1.0])]
    df = ntz(spark.createDataFrame(rows, "id int, fact_key string, created_at string, embedding array<double>"), "created_at").withColumns(
        {"vault": F.lit("v"), "status": F.lit("active"), "conflict_resolved": F.lit(False), "fact_value": F.lit("x"), "confidence": F.lit(1.0),
         "contradicts": F.array().cast("array<string>")}
    )
    pairs = vx.conflict_pairs(df, "id", 0.85)
    assert [(r["fact_key"], r["other_key"]) for r in pairs.collect()] == [("k2", "k1")]
    once = lc.flag_conflicts(df, pairs)
    twice = lc.flag_conflicts(once, pairs)
    assert [r["status"] for r in twice.orderBy("id").collect()] == ["active", "needs_review", "active"]
    assert twice.filter("id = 2").first()["contradicts"] == ["k1"]


def test_replay_schedule(spark):
    rows = [("v", f"s{i}", i, T0 - dt.timedelta(days=i)) for i in range(10)]
    df = ntz(spark.createDataFrame(rows, "vault string, session_id string, turn_count int, updated_at timestamp"), "updated_at")
    out = ss.replay_schedule(df, NOW, 5, 0.4).orderBy("slot").collect()
    assert [r["session_id"] for r in out] == ["s0", "s1", "s2", "s9", "s8"]


def test_name_similarity(spark):
    df = spark.createDataFrame([("fix nginx config", "install postgres database"), ("run a", "run a")], "a string, b string")
    out = [r[0] for r in df.select(pr.name_similarity(F.col("a"), F.col("b"))).collect()]
    assert out[0] <= 0.3 and out[1] == 1.0


def test_cooldown_passes_from_the_last_passed_turn(spark):
    rows = [("s", i, T0 + dt.timedelta(seconds=x)) for i, x in enumerate([0, 10, 31, 40, 62])]
    df = ntz(spark.createDataFrame(rows, "session_id string, turn_id int, created_at timestamp"), "created_at")
    assert sorted(r["turn_id"] for r in gates.cooldown_gate(df, 30).collect()) == [0, 2, 4]


def test_latency_by_index(spark):
    df = spark.range(1, 101).select(F.col("id").cast("double").alias("latency_ms"), F.lit("").alias("error"))
    r = ev.latency_summary(df).first()
    assert (r["p50"], r["p95"], r["p99"]) == (51.0, 96.0, 100.0)


def test_parse_instant(spark):
    df = spark.createDataFrame([("2024-01-15T14:00:00+02:00",), ("2024-01-15T12:00:00Z",), ("2024-01-15",), ("soon",)], "t string")
    out = [r[0] for r in df.select(clock.parse_instant(F.col("t"))).collect()]
    assert out == [dt.datetime(2024, 1, 15, 12)] * 2 + [dt.datetime(2024, 1, 15), None]


def test_links_of_a_text(spark):
    body = "see [[a/b|shown]] and [[a/b#part]], [t](c.md#x), [w](https://x.y), [[http://z]]"
    df = spark.createDataFrame([(body,)], "t string")
    assert df.select(text.extract_links(F.col("t"))).first()[0] == ["a/b", "c.md"]


def test_malformed_answers_fall_back(spark):
    df = spark.createDataFrame([(1, "no json"), (2, '```json\n[{"key":"k","value":"v","confidence":7}]\n```')], "id int, answer string")
    out = {r["id"]: (r["key"], r["confidence"]) for r in ps.json_facts(df).collect()}
    assert out[1][0].startswith("conversation-summary-") and out[1][1] == 5.0
    assert out[2] == ("k", 7.0)
    assert ps.json_facts(df, fallback=False).count() == 1


def test_threshold_rules(spark):
    rows = [("conflict", "reject")] * 4 + [("conflict", "confirm")] * 2 + [("low_confidence", "confirm")] * 9 + [("stale", "confirm")] * 2
    df = spark.createDataFrame(rows, "reason_type string, action string")
    out = {r["reason_type"]: (r["recommended"], r["auto_apply"]) for r in rv.threshold_recommendations(df).collect()}
    assert out == {"conflict": (0.9, True), "low_confidence": (0.6, True)}


def test_vaults_share_paths_but_not_links(spark):
    docs = spark.createDataFrame([("a", "x.md", "see [[y]] at z.md"), ("b", "x.md", "see [[y]] at z.md")], "vault string, path string, text string")
    paths = spark.createDataFrame([("a", "y.md"), ("a", "x.md"), ("b", "z.md")], "vault string, path string")
    links = lk.build_links(docs, paths)
    assert sorted((r["vault"], r["source_path"], r["target_path"]) for r in links.collect()) == [("a", "x.md", "y.md"), ("b", "x.md", "z.md")]
    chunks = spark.createDataFrame([("a", "x.md", "hit", ["y.md"]), ("b", "y.md", "no", ["z.md"])], "vault string, source_file string, text string, links_to array<string>")
    nodes, edges = lk.entity_graph(chunks, "hit", 3)
    assert sorted((r["vault"], r["id"]) for r in nodes.collect()) == [("a", "entity:hit"), ("a", "file:x.md"), ("a", "file:y.md")]
    assert edges.count() == 2


def test_vaults_share_names_but_not_entities(spark):
    entities = spark.createDataFrame([("a", "e1", "Ann"), ("b", "e2", "Ann"), ("a", "e3", "Bob")], "vault string, id string, name string")
    relations = spark.createDataFrame([("a", "ann", "bob", "knows"), ("b", "ann", "bob", "knows")], "vault string, source string, target string, type string")
    got = gr.resolve_relations(relations, entities).select("vault", "source_id", "target_id").collect()
    assert [tuple(r) for r in got] == [("a", "e1", "e3")]
    files = spark.createDataFrame([("a", "p/n.md"), ("b", "q/n.md"), ("a", "r/n.md")], "vault string, path string")
    assert [tuple(r) for r in rp.duplicate_names(files).collect()] == [("a", "n.md", "p/n.md", "r/n.md")]


def test_contradictions_show_every_value(spark):
    facts = spark.createDataFrame([("A", "k", "1"), ("B", "k", "2"), ("C", "k", "3"), ("A", "s", "1"), ("B", "s", "1")], "vault string, fact_key string, fact_value string")
    got = sorted((r["value"], r["vaults"], r["n_values"]) for r in rp.cross_vault_contradictions(facts).collect())
    assert got == [("1", 1, 3), ("2", 1, 3), ("3", 1, 3)]


def test_vault_tables_hold_every_row_and_share_paths(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    assert t.vault_links.count() == t.lineitem.select(F.col("l_orderkey") % 5, "l_partkey", "l_suppkey").distinct().count()
    assert t.vault_paths.select("vault", "path").distinct().count() == t.documents.count()
    for rows, path in ((t.vault_links, "source_path"), (t.vault_links, "target_path"), (t.vault_paths, "path")):
        assert rows.groupBy(path).agg(F.countDistinct("vault").alias("n")).agg(F.max("n")).first()[0] == 5
