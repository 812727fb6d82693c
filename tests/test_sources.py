"""Readers and writers over small files, and streams over growing folders."""

import datetime as dt
import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loreweave import models, schemas
from loreweave.operators import chunking as ck
from loreweave.operators import evaluation as ev
from loreweave.operators import retrieval
from loreweave.plans import registry
from loreweave.sources import datasets as ds
from loreweave.sources import events as se
from loreweave.sources import vault as vt
from loreweave.streaming import jobs, state


def put(root, files):
    for name, body in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(body)


VAULT = {"a.md": "# A\ntext", "sub dir/b.txt": "plain\n\ntwo", "noext": "n", "skip.png": "x", ".git/c.md": "x", "sub dir/.h.md": "x"}


def test_read_vault(spark, tmp_path):
    put(tmp_path, VAULT)
    out = {r["path"]: r for r in vt.read_vault(spark, str(tmp_path), "v").collect()}
    assert set(out) == {"a.md", "sub dir/b.txt", "noext"}
    assert out["a.md"]["text"] == "# A\ntext" and out["a.md"]["mtime"] is not None


def test_inbox(spark, tmp_path):
    put(tmp_path, {
        "n1.md": '---\ntitle: "Hello"\nsource: web\ntags: [a, "b"]\ncreated_at: 2024-01-01\nprocessed: yes\n---\nbody\n',
        "n2.md": "no front matter", "n3.md": "---\ntitle: x\ncreated_at: 2024-02-01\n---\nlater",
    })
    out = vt.read_inbox(spark, str(tmp_path)).collect()
    assert [r["id"] for r in out] == ["n3", "n1", "n2"]
    assert (out[1]["title"], out[1]["source"], out[1]["tags"], out[1]["processed"], out[1]["content"]) == ("Hello", "web", ["a", "b"], True, "body\n")
    assert out[2]["content"] == "no front matter" and out[2]["tags"] == []
    assert spark.range(1).select(vt.inbox_id(F.lit(" My  Note: Über-test! "))).first()[0] == "my-note-ber-test"


def test_export_and_import(spark, tmp_path):
    docs = spark.createDataFrame([("alpha", "a.md", "# H\nx [[b]]\n## I\ny")], "vault string, path string, text string")
    chunks = ck.chunk_documents(docs)
    vt.export_chunks(chunks, str(tmp_path / "out"))
    back = vt.import_chunks(spark, str(tmp_path / "out"), "beta")
    assert {(r["vault"], r["chunk_id"], r["text"]) for r in back.collect()} == {("beta", r["chunk_id"], r["text"]) for r in chunks.collect()}


def test_snapshot_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    vt.write_snapshot(spark.createDataFrame([("a", 1), ("b", 2)], "vault string, x int"), path)
    vt.write_snapshot(spark.createDataFrame([("a", 9)], "vault string, x int"), path)
    assert sorted((r["vault"], r["x"]) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 2)]


def test_append_logs_rejects_bad_rows(spark, tmp_path):
    rows = [(1, "a", "t", "b", ["x"]), (2, "a" * 257, "t", "b", []), (3, "a", "t", "b" * 70000, []), (4, "a", "t", "b", [""]), (5, "a", "t", "b", ["t"] * 51)]
    logs = spark.createDataFrame(rows, "id long, agent string, type string, body string, tags array<string>")
    logs = logs.withColumn("created_at", F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz"))
    errors = [r["error"] for r in se.validate_logs(logs).orderBy("id").collect()]
    assert errors == [None, "AGENT_TOO_LONG", "BODY_TOO_LARGE", "EMPTY_TAG", "TOO_MANY_TAGS"]
    se.append_logs(logs, str(tmp_path / "log"))
    logs.write.parquet(str(tmp_path / "in"))
    stream = jobs.file_stream(spark, str(tmp_path / "in"), logs.schema)
    se.append_log_stream(stream, str(tmp_path / "log2"), str(tmp_path / "cp")).awaitTermination()
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "log")).collect()] == [1]
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "log2")).collect()] == [1]


def test_locomo(spark, tmp_path):
    talk = {"session_1": [{"speaker": "user", "text": "hi"}, {"speaker": "Ann", "text": ""}], "session_2": [{"speaker": "Ann", "text": "yo"}], "session_4": [{"text": "lost"}]}
    data = [{"sample_id": "c1", "conversation": talk, "qa": [{"question": "q?", "answer": "a", "category": 2}, {"question": "", "answer": "x"}, {"question": "z?", "answer": "b", "category": 9}]},
            {"sample_id": "c2", "conversation": {}, "qa": [{"question": "q", "answer": "a"}]}]
    put(tmp_path, {"d.json": json.dumps(data)})
    messages, questions = ds.load_locomo(spark, str(tmp_path / "d.json"))
    assert [(r["session"], r["role"], r["content"]) for r in messages.orderBy("session", "pos").collect()] == [(1, "user", "hi"), (2, "assistant", "yo")]
    assert sorted((r["question_id"], r["question_type"]) for r in questions.collect()) == [("locomo-c1-0", "temporal-reasoning"), ("locomo-c1-2", "category-9")]


def test_longmemeval(spark, tmp_path):
    put(tmp_path, {
        "S/s1/conversation.json": json.dumps([{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]),
        "S/s2/conversation.json": json.dumps({"turns": [{"role": "user", "content": "c"}]}),
        "S/s3/conversation.json": json.dumps({"role": "user", "content": "d"}),
        "S/s1/questions.json": json.dumps([{"question_id": "1", "question": "When was it?", "answer": 5}, {"question_id": "1", "question": "again"}]),
        "S/s2/questions.json": json.dumps({"question_id": "2", "text": "Who is it?", "ground_truth": "x"}),
        "S/s3/questions.json": json.dumps([{"question_id": "3", "question": "So?", "type": "Multi Hop"}, {"question_id": "1", "question": "dup"}]),
    })
    messages, questions = ds.load_longmemeval(spark, str(tmp_path))
    assert sorted((r["conversation_id"], r["pos"], r["content"]) for r in messages.collect()) == [("s1", 0, "a"), ("s1", 1, "b"), ("s2", 0, "c"), ("s3", 0, "d")]
    assert {r["question_id"]: (r["question_type"], r["ground_truth"], r["conversation_id"]) for r in questions.collect()} == {
        "lme-1": ("temporal-reasoning", "5", "s1"), "lme-2": ("fact-retrieval", "x", "s2"), "lme-3": ("multi-hop", "", "s3"),
    }


def test_split_by_conversation(spark, tmp_path):
    path = str(tmp_path / "out")
    first = spark.createDataFrame([("c1", "a"), ("c2", "b")], "conv_id string, body string")
    assert ds.split_by_conversation(first, path) == 2
    assert ds.split_by_conversation(first.union(spark.createDataFrame([("c3", "c")], first.schema)), path) == 1
    assert sorted(r["body"] for r in spark.read.json(path).collect()) == ["a", "b", "c"]


def test_narrativeqa(spark):
    schema = "document struct<id:string,kind:string,word_count:int,text:string>, question struct<text:string>, answers array<struct<text:string>>"
    rows = [(("d1", "gutenberg", 10, " Once "), ("Who came?",), [("A",), ("B",)]), (("d1", "gutenberg", 10, " Once "), ("Why?",), [("",)]),
            (("d2", "movie", 10, "x"), ("How?",), []), (("d3", "gutenberg", 999, "x"), ("How?",), []), (("d4", "gutenberg", 1, " "), ("How?",), [])]
    stories, questions = ds.load_narrativeqa(spark.createDataFrame(rows, schema), kinds=["gutenberg"], max_words=100)
    assert [(r["conversation_id"], r["content"], r["vault"], r["source"]) for r in stories.collect()] == [("d1", "Once", "nqa-gutenberg-d1", "narrativeqa/gutenberg/d1")]
    assert sorted((r["question_type"], r["ground_truth"]) for r in questions.collect()) == [("cause", ""), ("character", "A | B")]


def test_traces_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("q1", None, "a", True, 3.5)], "question_id string, question_type string, answer string, correct boolean, latency_ms double")
    ds.write_traces(rows, str(tmp_path / "t"))
    r = ds.read_traces(spark, str(tmp_path / "t")).first()
    assert (r["question_id"], r["question_type"], r["retries"], r["latency_ms"]) == ("q1", "unknown", 0, 3.5)


def test_models_batch_and_check_counts(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(45)], "id int, text string")
    assert models.embed(df, models.hashing_embedder(16), batch=7).filter(F.size("embedding") == 16).count() == 45
    answers = models.complete(df.withColumnRenamed("text", "prompt"), lambda ps: [p.upper() for p in ps])
    assert answers.filter("answer = upper(prompt)").count() == 45
    results = spark.createDataFrame([("q", "yes", "no")], "question string, ground_truth string, answer string")
    assert ev.score_answers(results, lambda ps: ["0.7"] * len(ps)).first()["correct"] is True
    assert ev.score_answers(results, lambda ps: ["?"] * len(ps)).first()["correct"] is False
    try:
        models.embed(df, lambda ts: [[0.0]]).collect()
    except Exception as e:
        assert "model returned" in str(e)
    else:
        raise AssertionError("a short answer must fail")


def test_stream_vault_rechunks_changed_files(spark, tmp_path):
    root, base = str(tmp_path / "vault"), str(tmp_path / "state")
    put(root, {"a.md": "# A\none\n## B\ntwo", "b.txt": "x"})
    schema = StructType([f for f in StructType.fromDDL(schemas.CHUNKS) if f.name not in ("embedding", "meta", "tags")])
    table = jobs.VersionedTable(spark, f"{base}/table", schema)
    step = jobs.index_files_batch(table, "2024-02-01 00:00:00")
    jobs.run_batches(jobs.stream_vault(spark, root, "v"), step, f"{base}/cp").awaitTermination()
    assert sorted((r["source_file"], r["chunk_index"]) for r in table.read(0).collect()) == [("a.md", 0), ("a.md", 1), ("b.txt", 0)]
    put(root, {"c.md": "new", "b.txt": "x"})
    jobs.run_batches(jobs.stream_vault(spark, root, "v"), step, f"{base}/cp").awaitTermination()
    assert {r["source_file"] for r in table.read(1).collect()} == {"a.md", "b.txt", "c.md"}


def test_cooldown_state_survives_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    t0 = pd.Timestamp("2024-01-01")
    for i, offsets in enumerate([[0, 10], [31, 40], [62]]):
        rows = [("s", t0 + pd.Timedelta(seconds=x)) for x in offsets]
        spark.createDataFrame(pd.DataFrame(rows, columns=["session_id", "created_at"])).coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    stream = jobs.file_stream(spark, src, schema, files_per_trigger=1)
    out = jobs.drain(state.cooldown_gate(stream, 30)).collect()
    assert sorted((r["created_at"] - t0.to_pydatetime()).total_seconds() for r in out) == [0, 31, 62]


def test_replayed_batch_changes_nothing(spark, tmp_path):
    schema = StructType.fromDDL("vault string, chunk_id string, source_file string, chunk_index int, header string, text string, first_paragraph string, file_last_updated timestamp_ntz, links_to array<string>")
    table = jobs.VersionedTable(spark, str(tmp_path / "t"), schema)
    step = jobs.index_files_batch(table, "2024-02-01 00:00:00")
    batch = spark.createDataFrame([("v", "a.txt", "one\n\ntwo")], "vault string, path string, text string")
    step(batch, 0)
    before = sorted(map(tuple, table.read(0).drop("links_to").collect()))
    step(batch, 0)
    assert sorted(map(tuple, table.read(0).drop("links_to").collect())) == before and len(before) == 2


STREAMS = [n for n in registry.queries() if n.endswith("_stream")]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The given tables as folders of part files."""
    base = str(tmp_path_factory.mktemp("folders"))
    for name in ("events", "conversations", "documents"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartition(3).write.parquet(f"{base}/{name}.parquet")
    return base


@pytest.mark.parametrize("name", STREAMS)
def test_streams_read_folders_as_files(spark, folders, name):
    run = registry.queries()[name]
    one, many = (sorted(map(str, run(spark, d).collect())) for d in ("/root/testdata/sf0.001", folders))
    assert one and one == many


def test_table_stream_takes_part_files_one_by_one(spark, folders):
    schema = spark.read.parquet(f"{folders}/conversations.parquet").schema
    out = jobs.drain(jobs.table_stream(spark, folders, "conversations", schema, files_per_trigger=1))
    assert out.select("batch").distinct().count() == 3
    assert sorted(map(str, out.drop("batch").collect())) == sorted(map(str, spark.read.parquet(f"{folders}/conversations.parquet").collect()))


def test_drain_without_a_batch_is_empty(spark, tmp_path):
    (tmp_path / "none").mkdir()
    out = jobs.drain(jobs.file_stream(spark, str(tmp_path / "none"), StructType.fromDDL("id long, at timestamp_ntz")))
    assert out.columns == ["id", "at", "batch"] and out.count() == 0


def test_stream_vault_decodes_names(spark, tmp_path):
    root = str(tmp_path / "vault")
    put(root, {"a b.md": "x", "c+d%.md": "y"})
    assert {r["path"] for r in jobs.drain(jobs.stream_vault(spark, root, "v")).collect()} == {"a b.md", "c+d%.md"}


def test_full_context_keeps_vaults_apart(spark):
    rows = [(1, "alpha", "a.md", 0, "mine", [1.0, 0.0]), (2, "beta", "a.md", 0, "theirs", [0.0, 1.0]), (3, "alpha", "a.md", 1, "mine too", [0.0, 1.0])]
    chunks = spark.createDataFrame(rows, "id long, vault string, source_file string, chunk_index int, text string, embedding array<float>")
    asks = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<float>")
    (row,) = retrieval.full_context(asks, chunks, "id", hits=1).collect()
    assert row["context"] == "[Source: a.md | Chunk 0]\nmine\n\n[Source: a.md | Chunk 1]\nmine too\n\n"
