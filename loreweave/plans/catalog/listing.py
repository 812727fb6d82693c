"""Filters, pages, lookups and listings."""

from pyspark.sql import functions as F

from loreweave.functions import text
from loreweave.operators import facts as fx
from loreweave.operators import filters as fl
from loreweave.plans.registry import query
from loreweave.plans.tables import AS_OF, with_lists

NOW = f"TIMESTAMP '{AS_OF}'"


@query("scroll_facts", "B1", "SELECT event_id, fact_key, row_number() OVER (ORDER BY event_id) > 100 AS is_next "
       "FROM (SELECT event_id, fact_key FROM facts WHERE event_id > 50 ORDER BY event_id LIMIT 101)")
def _(t):
    return fl.scroll(t.facts.select("event_id", "fact_key"), "event_id", 100, after=50)


@query("scroll_filtered", "B2", "SELECT event_id, fact_key, row_number() OVER (ORDER BY event_id) > 100 AS is_next "
       "FROM (SELECT event_id, fact_key FROM facts WHERE status = 'active' ORDER BY event_id LIMIT 101)")
def _(t):
    facts = t.facts.select("event_id", "fact_key", "status")
    return fl.scroll(facts, "event_id", 100, where=fl.keyword("status", "active")).drop("status")


@query("get_by_ids", "B3,B13", "SELECT vault, fact_key, fact_value FROM facts "
       "WHERE fact_key IN (SELECT supersedes FROM facts WHERE supersedes IS NOT NULL)")
def _(t):
    ids = t.facts.filter("supersedes is not null").select(F.col("supersedes").alias("fact_key"))
    return fl.get_by_ids(t.facts, ids, "fact_key").select("vault", "fact_key", "fact_value")


@query("get_fact", "B13", "SELECT vault, fact_key, fact_value, status FROM facts WHERE fact_key = 'u7/v1/click'")
def _(t):
    return fl.lookup(t.facts, "fact_key", "u7/v1/click").select("vault", "fact_key", "fact_value", "status")


@query("get_chunk", "B13", "SELECT vault, source_file, chunk_index, text FROM chunks WHERE source_file = 'doc/42.md'")
def _(t):
    return fl.lookup(t.chunks, "source_file", "doc/42.md").select("vault", "source_file", "chunk_index", "text")


@query("build_filter", "B4,B5", """
    SELECT vault, fact_key FROM facts
    WHERE status = 'active' AND confidence >= 0.2 AND confidence < 0.9
      AND (contradicts_csv <> '' OR starts_with(fact_key, 'u1') OR valid_until IS NULL)
      AND NOT conflict_resolved AND NOT (created_at >= TIMESTAMP '2024-01-20 00:00:00' AND created_at <= TIMESTAMP '2024-01-25 00:00:00')
      AND NOT coalesce(list_contains(string_split(supports_csv, ','), concat(split_part(fact_key, '/', 1), '/v1/click')), false)""")
def _(t):
    own = F.concat(F.split_part("fact_key", F.lit("/"), F.lit(1)), F.lit("/v1/click"))
    cond = fl.build_filter(
        must=[fl.keyword("status", "active"), fl.number_range("confidence", gte=0.2, lt=0.9)],
        should=[F.size("contradicts") > 0, fl.prefix("fact_key", "u1"), fl.missing("valid_until")],
        must_not=[
            fl.keyword("conflict_resolved", True),
            fl.time_range("created_at", "2024-01-20 00:00:00", "2024-01-25 00:00:00"),
            F.array_contains("supports", own),
        ],
    )
    return t.fact_table.filter(cond).select("vault", "fact_key")


@query("recall_filter", "B6", """
    SELECT source_file, vault FROM chunks WHERE starts_with(source_file, 'doc/1') AND lang = 'en'
      AND file_last_updated >= TIMESTAMP '2023-10-02 00:00:00' AND file_last_updated <= TIMESTAMP '2023-11-15 00:00:00'""")
def _(t):
    tagged = t.chunks.withColumn("tags", F.array("lang", "origin"))
    cond = fl.recall_filter("doc/1", ["en"], "2023-10-02 00:00:00", "2023-11-15 00:00:00")
    return tagged.filter(cond).select("source_file", "vault")


@query("active_at", "B7", f"""
    SELECT 'active' AS mode, count(*) AS n FROM facts
      WHERE valid_from <= {NOW} AND (valid_until IS NULL OR {NOW} < valid_until)
    UNION ALL SELECT 'active_at', count(*) FROM facts WHERE valid_from <= TIMESTAMP '2024-01-15 12:00:00'
      AND (valid_until IS NULL OR TIMESTAMP '2024-01-15 12:00:00' < valid_until)
    UNION ALL SELECT 'all', count(*) FROM facts""")
def _(t):
    modes = {"active": "active", "active_at": "active_at:2024-01-15T14:00:00+02:00", "all": "all"}
    counts = [F.count_if(fl.active_at(m, AS_OF)).alias(k) for k, m in modes.items()]
    return t.facts.agg(*counts).unpivot([], list(modes), "mode", "n")


@query("detail_levels", "B8", """
    SELECT source_file, '' AS text, '' AS first_paragraph, 'l0' AS level FROM chunks
    UNION ALL SELECT source_file, '', left(text, 200), 'l1' FROM chunks
    UNION ALL SELECT source_file, text, left(text, 200), 'l2' FROM chunks""")
def _(t):
    base = t.chunks.select("source_file", "text", text.first_paragraph(F.col("text")).alias("first_paragraph"))
    parts = [fl.detail(base, level).withColumn("level", F.lit(level)) for level in ("l0", "l1", "l2")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("list_facts", "B9", f"""
    SELECT vault, fact_key, fact_value FROM facts WHERE list_contains(string_split(tags_csv, ','), 'hot') AND status = 'active'
      AND NOT conflict_resolved AND valid_from <= {NOW} AND (valid_until IS NULL OR {NOW} < valid_until)
      AND starts_with(fact_key, 'u') AND contains(fact_key, '/v')""")
def _(t):
    rows = fl.list_facts(t.fact_table, AS_OF, tag="hot", status="active", conflict_resolved=False,
                         key_prefix="u", key_contains="/v")
    return rows.select("vault", "fact_key", "fact_value")


@query("list_chunks", "B10", "SELECT vault, source_file, chunk_index, file_last_updated FROM chunks")
def _(t):
    return fl.list_chunks(t.chunks)


@query("list_logs", "B11", """
    SELECT id, agent, type, body, lpad(lower(hex(id)), 16, '0') AS cursor FROM log_entries
    WHERE list_contains(string_split(tags_csv, ','), 'hot') AND type = 'view'
      AND created_at >= TIMESTAMP '2024-01-05 00:00:00' AND created_at <= TIMESTAMP '2024-01-25 00:00:00'
    ORDER BY id DESC LIMIT 100""")
def _(t):
    rows = fl.list_logs(with_lists(t.log_entries), 100, type_="view", tag="hot",
                        since="2024-01-05 00:00:00", until="2024-01-25 00:00:00")
    return rows.select("id", "agent", "type", "body", "cursor")


@query("list_sessions", "B12", """
    SELECT session_id, vault, turn_count, updated_at FROM sessions WHERE NOT archived AND vault = 'alpha'
    ORDER BY updated_at DESC, session_id LIMIT 20 OFFSET 5""")
def _(t):
    rows = fl.list_sessions(t.sessions, 20, 5, "alpha")
    return rows.select("session_id", "vault", "turn_count", "updated_at")


DAYS = "(epoch_us({now}) - epoch_us({at})) / CAST(86400000000 AS DOUBLE)"
ANCHOR = "greatest(last_confirmed_at, last_accessed_at, created_at)"
STABILITY = ("least(greatest(1 + ln(1 + access_count) + ln(1 + confirmation_count) * 1.5 + 2 * confidence + "
             "CASE WHEN ttl_days > 0 THEN least(CAST(ttl_days AS DOUBLE) / 30, 3) ELSE 0 END, 1), 12)")
ACCESS = (f"CASE WHEN {ANCHOR} >= {NOW} THEN 1.0::DOUBLE ELSE exp(-({DAYS.format(now=NOW, at=ANCHOR)}) * ln(2::DOUBLE) "
          f"/ ({STABILITY} * 30)) END")
IMPORTANCE = ("0.3::DOUBLE * least(CAST(access_count AS DOUBLE) / 100, 1) + 0.3::DOUBLE * greatest(1 - "
              f"({DAYS.format(now=NOW, at='coalesce(last_accessed_at, created_at)')}) / 365, 0) "
              "+ 0.2::DOUBLE * least(CAST(confirmation_count AS DOUBLE) / 10, 1) + 0.2::DOUBLE * confidence")


@query("present_facts", "B14,L10", f"""
    SELECT vault, fact_key, status, round({ACCESS}, 6) AS accessibility, round(confidence * ({ACCESS}), 6) AS effective_confidence
    FROM facts""")
def _(t):
    rows = fx.present_facts(t.facts, AS_OF)
    return rows.select("vault", "fact_key", "status", F.round("accessibility", 6).alias("accessibility"),
                       F.round("effective_confidence", 6).alias("effective_confidence"))


@query("backfill_defaults", "B15", f"""
    SELECT vault, fact_key, 'active' AS status, 1.0::DOUBLE AS confidence, 'manual' AS source_type, true AS conflict_resolved,
      1 AS confirmation_count, coalesce(updated_at, {NOW}) AS created_at, coalesce(last_confirmed_at, updated_at, {NOW}) AS last_confirmed_at,
      coalesce(supersedes, '') AS supersedes, regexp_extract(fact_key, '^(.*)/v[0-9]+/', 1) AS key_prefix,
      CAST(regexp_extract(fact_key, '/v([0-9]+)/', 1) AS INT) AS version, ttl_days, 0 AS superseded_by FROM facts""")
def _(t):
    bare = t.fact_table.drop("status", "confidence", "source_type", "conflict_resolved", "confirmation_count",
                             "created_at", "version")
    return fx.backfill_defaults(bare, AS_OF).select(
        "vault", "fact_key", "status", "confidence", "source_type", "conflict_resolved", "confirmation_count",
        "created_at", "last_confirmed_at", "supersedes", "key_prefix", "version", "ttl_days", "superseded_by")


@query("list_files", "B16", "SELECT DISTINCT source_path AS path FROM links")
def _(t):
    return fl.distinct_paths(t.links)


@query("is_indexable", "A2", """
    WITH p AS (SELECT DISTINCT url AS path FROM pages UNION SELECT DISTINCT concat('a/', lang, '/.', source, '/x.md') FROM documents
      UNION SELECT concat('d/', doc_id, '.', ['md','txt','org','rst','json','py','HTML','log'][doc_id % 8 + 1]) FROM documents
      UNION SELECT concat('n/', doc_id) FROM documents)
    SELECT path, NOT contains(path, '/.') AND NOT starts_with(path, '.')
        AND (regexp_extract(path, '[^/]*$') NOT LIKE '%.%' OR lower(regexp_extract(regexp_extract(path, '[^/]*$'), '\\.([^.]*)$', 1)) IN ('md','txt','org','rst')) AS in_vault,
      NOT starts_with(regexp_extract(path, '[^/]*$'), '.') AND lower(regexp_extract(regexp_extract(path, '[^/]*$'), '\\.([^.]*)$', 1))
        IN ('txt','md','json','csv','xml','yaml','yml','html','htm','rst','adoc','log') AS in_documents FROM p""")
def _(t):
    ends = F.array(*[F.lit(e) for e in ("md", "txt", "org", "rst", "json", "py", "HTML", "log")])
    d = t.documents
    paths = (
        t.pages.select(F.col("url").alias("path"))
        .union(d.select(F.concat(F.lit("a/"), "lang", F.lit("/."), "source", F.lit("/x.md"))))
        .union(d.select(F.concat(F.lit("d/"), "doc_id", F.lit("."), F.get(ends, (F.col("doc_id") % 8).cast("int")))))
        .union(d.select(F.concat(F.lit("n/"), "doc_id")))
        .distinct()
    )
    return fl.is_indexable(paths)
