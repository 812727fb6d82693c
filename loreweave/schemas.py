"""Declared schemas of the engine's tables, as DDL; readers never infer."""

from __future__ import annotations

from loreweave.functions.facts import FACT_COLUMNS

FACTS = ", ".join(f"{n} {t}" for n, t in FACT_COLUMNS.items()) + ", embedding array<float>"
CHUNKS = (
    "vault string, chunk_id string, source_file string, chunk_index int, header string, text string, "
    "first_paragraph string, file_last_updated timestamp_ntz, links_to array<string>, tags array<string>, "
    "meta map<string,string>, embedding array<float>"
)
LOGS = ("id bigint, agent string, type string, body string, tags array<string>, created_at timestamp_ntz")
SESSIONS = (
    "session_id string, vault string, agent_id string, source string, turn_count bigint, created_at timestamp_ntz, "
    "updated_at timestamp_ntz, finalized_at timestamp_ntz, archived boolean"
)
TURNS = ("session_id string, turn_id bigint, role string, content string, created_at timestamp_ntz")
LINKS = (
    "vault string, source_path string, target_path string, link_type string, context string, created_at timestamp_ntz"
)
ENTITIES = ("id string, vault string, name string, kind string, summary string, seq bigint")
EDGES = (
    "id string, vault string, source_id string, target_id string, type string, fact string, valid_from timestamp_ntz, "
    "valid_until timestamp_ntz, created_at timestamp_ntz, invalidated_at timestamp_ntz, seq bigint"
)
RESOLUTIONS = ("fact_key string, action string, reason_type string, similarity double, created_at timestamp_ntz")
TRACES = (
    "question_id string, benchmark string, config string, question_type string, question string, ground_truth string, "
    "answer string, correct boolean, latency_ms double, retries int, error string, sources array<map<string,string>>, vault string"
)
