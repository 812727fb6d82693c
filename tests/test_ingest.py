"""Fresh documents are cut to the token limit before they replace their old rows."""

import duckdb

from loreweave.plans import registry

LONG = {
    1: "short text.",
    2: ". ".join(" ".join(f"s{i}w{j}" for j in range(40)) for i in range(100)) + ".",  # sentences
    3: "\n\n".join(" ".join(f"p{i}w{j}" for j in range(700)) for i in range(5)),  # paragraphs
    4: " ".join(f"w{j}" for j in range(3200)),  # one sentence of words
    5: "\n \n\n ".join("x. " * 900 for _ in range(3)),
    6: " ".join(f"w{j}" for j in range(3200)),  # keeps its old row
}


def test_long_documents_become_several_chunks(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")

    write("documents", [(i, text, "en", "src1") for i, text in LONG.items()], "doc_id long, text string, lang string, source string")
    write("labels", [(i, 1) for i in range(1, 6)], "doc_id long, quality int")
    write("embeddings", [(0, [1.0, 0.5]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["ingest_documents"]).fetchall()
    got = [tuple(r) for r in registry.queries()["ingest_documents"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    chunks = {i: sorted(r[2] for r in got if r[1] == f"doc/{i}.md") for i in LONG}
    assert chunks == {1: [0], 2: [0, 1, 2], 3: [0, 1, 2], 4: [0, 1, 2], 5: [0, 1, 2], 6: [0]}
    assert all(int(len(r[3].split()) * 1.3) <= 2000 for r in got if r[1] != "doc/6.md")
