"""The engine's tables, derived from the given parquet tables.

Each derivation is one SQL text that Spark and DuckDB both run, so a checked query
and its oracle start from the same rows.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

AS_OF = "2024-02-01 00:00:00"

DERIVED = {
    "facts_in": """
        SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS vault,
          concat('u', user_id, '/v', event_id % 3 + 1, '/', event_type) AS fact_key, props AS fact_value,
          concat('doc/', event_id % 1300, '.md') AS source,
          CASE event_id % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'extraction' ELSE 'conversation' END AS source_type,
          CAST(event_id % 101 AS DOUBLE) / 100 AS confidence,
          CASE event_id % 5 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'superseded' ELSE 'active' END AS status,
          CAST(event_id % 3 + 1 AS INT) AS version,
          CASE WHEN event_id % 7 = 0 THEN concat('u', user_id, '/v1/', event_type) END AS supersedes,
          CASE WHEN event_id % 9 = 0 THEN concat('u', user_id, '/v3/view') END AS refines,
          CASE WHEN event_id % 11 = 0 THEN concat('u', user_id, '/v2/', event_type) ELSE '' END AS contradicts_csv,
          CASE WHEN event_id % 17 = 0 THEN concat('u', user_id, '/v1/click,u', user_id, '/v2/view') ELSE '' END AS supports_csv,
          CASE WHEN event_id % 4 = 0 THEN concat(event_type, ',hot') ELSE event_type END AS tags_csv,
          event_id % 13 = 0 AS conflict_resolved,
          CAST(event_id % 12 AS INT) AS confirmation_count, CAST(event_id % 130 AS INT) AS access_count,
          CAST(event_id % 40 AS INT) AS ttl_days, ts AS created_at,
          CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL '1' HOUR * CAST(event_id % 50 AS INT) END AS updated_at,
          CASE WHEN event_id % 4 = 1 THEN ts + INTERVAL '1' HOUR * CAST(event_id % 30 AS INT) END AS last_accessed_at,
          CASE WHEN event_id % 6 = 2 THEN ts + INTERVAL '1' HOUR * CAST(event_id % 20 AS INT) END AS last_confirmed_at,
          CASE WHEN event_id % 8 = 3 THEN ts + INTERVAL '1' MINUTE * CAST(event_id % 60 AS INT) END AS last_recalled_at,
          CASE WHEN event_id % 40 > 0 THEN ts + INTERVAL '1' DAY * CAST(event_id % 40 AS INT) END AS expires_at,
          ts AS valid_from, CASE WHEN event_id % 6 = 0 THEN ts + INTERVAL '1' DAY * 10 END AS valid_until
        FROM {events}""",
    "facts": """
        SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY vault, fact_key ORDER BY created_at DESC, event_id DESC) AS rn
          FROM {facts_in}) t WHERE rn = 1""",
    "turns": """
        SELECT concat('s', conv_id) AS session_id, turn AS turn_id, role, text AS content,
          TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(conv_id AS INT)
            + INTERVAL '1' MINUTE * CAST(turn AS INT) AS created_at
        FROM {conversations}""",
    "sessions": """
        SELECT concat('s', conv_id) AS session_id, CASE WHEN conv_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS vault,
          concat('agent', conv_id % 5) AS agent_id, count(*) AS turn_count,
          TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(conv_id AS INT) AS created_at,
          TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(conv_id AS INT)
            + INTERVAL '1' MINUTE * CAST(max(turn) AS INT) AS updated_at,
          conv_id % 10 = 9 AS archived
        FROM {conversations} GROUP BY conv_id""",
    "log_entries": """
        SELECT event_id AS id, concat('u', user_id) AS agent, event_type AS type, props AS body,
          CASE WHEN event_id % 4 = 0 THEN concat(event_type, ',hot') ELSE event_type END AS tags_csv, ts AS created_at
        FROM {events}""",
    "resolutions": """
        SELECT event_id, concat('u', user_id, '/v', event_id % 3 + 1, '/', event_type) AS fact_key,
          CASE event_type WHEN 'error' THEN 'conflict' WHEN 'view' THEN 'low_confidence' ELSE event_type END AS reason_type,
          CASE event_id % 4 WHEN 0 THEN 'reject' WHEN 1 THEN 'reclassify' WHEN 2 THEN 'supersede' ELSE 'confirm' END AS action,
          ts AS created_at FROM {events}""",
    "edges_in": """
        SELECT concat('e', o_orderkey) AS id, CASE WHEN o_custkey % 2 = 0 THEN 'alpha' ELSE 'beta' END AS vault,
          concat('c', o_custkey) AS source_id, o_orderpriority AS type,
          concat('n', o_orderkey % 50) AS target_id, concat('order ', o_orderkey) AS fact,
          o_orderdate AS valid_from,
          CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL '1' DAY * 400 END AS valid_until,
          o_orderdate + INTERVAL '1' HOUR AS created_at,
          CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate + INTERVAL '1' DAY * 30 END AS invalidated_at,
          o_orderkey AS seq FROM {orders}""",
    "entities": """
        SELECT concat('c', c_custkey) AS id, CASE WHEN c_custkey % 2 = 0 THEN 'alpha' ELSE 'beta' END AS vault,
          c_name AS name, 'person' AS kind, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE '' END AS summary
        FROM {customer}
        UNION ALL
        SELECT DISTINCT concat('n', o_orderkey % 50) AS id, 'alpha' AS vault, concat('node ', o_orderkey % 50) AS name,
          'concept' AS kind, '' AS summary FROM {orders}""",
    "links": """
        SELECT DISTINCT concat('p', l_partkey) AS source_path, concat('p', (l_partkey * 7 + l_suppkey) % 200) AS target_path,
          'wikilink' AS link_type FROM {lineitem}""",
    "vault_links": """
        SELECT DISTINCT concat('v', l_orderkey % 5) AS vault, concat('p', l_partkey) AS source_path,
          concat('p', l_suppkey) AS target_path, 'wikilink' AS link_type FROM {lineitem}""",
    "results": """
        SELECT event_id AS question_id, event_type AS question_type, substr('ABCD', CAST(event_id % 4 + 1 AS INT), 1) AS config,
          value > 50 AS correct, value AS latency_ms,
          CASE WHEN event_id % 9 = 0 THEN concat('POST /ask: ', event_id % 7) WHEN event_id % 31 = 0 THEN 'Timeout: x' ELSE '' END AS error,
          CASE WHEN event_id % 6 = 0 THEN 'I cannot answer that' ELSE props END AS answer
        FROM {events}""",
    "files": """
        SELECT CASE WHEN doc_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS vault, concat('doc/', doc_id, '.md') AS path,
          TIMESTAMP '2023-10-01 00:00:00' + INTERVAL '1' HOUR * CAST(doc_id AS INT) AS mtime FROM {documents}""",
    "facts_seven": """
        SELECT concat('v', event_id % 7) AS vault, concat(event_type, '/', user_id % 20) AS fact_key,
          concat('x', event_id % 3) AS fact_value FROM {events}""",
    "vault_paths": """
        SELECT concat('v', doc_id % 5) AS vault, concat('doc/', CAST((doc_id - doc_id % 5) / 5 AS BIGINT), '.md') AS path, CAST(doc_id AS INT) AS hours,
          TIMESTAMP '2023-10-01 00:00:00' + INTERVAL '1' HOUR * CAST(doc_id AS INT) AS mtime FROM {documents}""",
    "vectors": """
        SELECT vec_id, embedding, n FROM {embeddings} CROSS JOIN (SELECT count(*) AS n FROM {embeddings}) AS size""",
    "chunks": """
        SELECT CASE WHEN doc_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS vault, concat('doc/', doc_id, '.md') AS source_file,
          0 AS chunk_index, text,
          TIMESTAMP '2023-10-01 00:00:00' + INTERVAL '1' HOUR * CAST(doc_id AS INT) AS file_last_updated,
          d.doc_id, array_append(e.embedding, CAST((d.doc_id % 1024) / 8192 AS FLOAT)) AS embedding, lang, source AS origin
        FROM {documents} d JOIN {vectors} e ON e.vec_id = d.doc_id % e.n""",
    "fact_vectors": """
        SELECT f.*, array_append(e.embedding, CAST((f.event_id % 1024) / 8192 AS FLOAT)) AS embedding
        FROM {facts} f JOIN {vectors} e ON e.vec_id = f.event_id % e.n""",
    "asks": """
        SELECT item_id AS query_id, text, array_append(e.embedding, CAST(1 AS FLOAT)) AS embedding
        FROM {benchmark} b JOIN {vectors} e ON e.vec_id = b.item_id % e.n""",
    "incoming_vectors": """
        SELECT i.event_id, array_append(e.embedding, CAST((i.event_id % 1024) / 8192 AS FLOAT)) AS embedding
        FROM {facts_in} i JOIN {vectors} e ON e.vec_id = (i.event_id * 3) % e.n""",
    "dialogue": """
        SELECT session_id, turn_id, role, created_at, concat(content, CASE
          WHEN role = 'assistant' THEN CASE turn_id % 4 WHEN 1 THEN concat(chr(10), 'Now run the build of ', session_id) ELSE ' Then check the config; we will use the new plan.' END
          WHEN length(content) % 3 = 0 THEN ' That works, the design is fine.' WHEN length(content) % 3 = 1 THEN ' It failed with a bug.' ELSE '' END) AS content
        FROM {turns}""",
    "peer_facts": """
        SELECT vault, CASE WHEN version = 1 AND fact_key LIKE '%/click' THEN concat('peer/', split_part(fact_key, '/', 1), '/card/profile') ELSE fact_key END AS fact_key,
          fact_value, tags_csv, status, conflict_resolved, created_at, updated_at, valid_from, valid_until FROM {facts}""",
    "linked_docs": """
        SELECT doc_id, concat('doc/', doc_id, '.md') AS path, concat(text, chr(10), chr(10), 'see [[doc/', (doc_id * 7) % 1000, '.md|x#y]] and [t](doc/',
          (doc_id * 3) % 1000, '.md#a) or [w](http://x.y/z) and [[', (doc_id + 5) % 1000, ']] at doc/', (doc_id * 11) % 1000, '.md.') AS text
        FROM {documents}""",
}

_NAME = re.compile(r"\{(\w+)\}")


class Tables:
    """Attribute access to base and derived tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._seen: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._seen:
            if name in BASE:
                self._seen[name] = self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))
            elif name == "vectors":
                # The same rows as the SQL text; a constant ``n`` lets the joins on
                # ``key % n`` be equi joins, where a column of this side makes them loops.
                n = max(self.embeddings.count(), 1)
                self._seen[name] = self.embeddings.select("vec_id", "embedding", F.lit(n).cast("long").alias("n"))
            elif name in DERIVED:
                sql = DERIVED[name]
                self._seen[name] = self.sql(sql)
            else:
                raise AttributeError(name)
        return self._seen[name]

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: getattr(self, n) for n in set(_NAME.findall(text))})

    @property
    def fact_table(self) -> DataFrame:
        """``facts`` with list columns in place of the comma-separated twins."""
        return with_lists(self.facts)

    @property
    def incoming_facts(self) -> DataFrame:
        return with_lists(self.facts_in)


def as_list(csv):
    return F.filter(F.split(csv, ","), lambda x: x != "")


def with_lists(df: DataFrame) -> DataFrame:
    out = df
    for name in ("contradicts", "supports", "tags"):
        if f"{name}_csv" in df.columns:
            out = out.withColumn(name, as_list(F.col(f"{name}_csv"))).drop(f"{name}_csv")
    return out.drop("rn")


def for_duckdb(body: str) -> str:
    """Prefix an oracle with the derivations of the tables it names."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in DERIVED:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(DERIVED[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    body = _NAME.sub(r"\1", body)
    if not needed:
        return body
    ctes = ",\n".join(f"{n} AS ({_NAME.sub(r'{}'.format(chr(92) + '1'), DERIVED[n])})" for n in needed)
    return f"WITH {ctes}\nSELECT * FROM ({body}) AS answer"
