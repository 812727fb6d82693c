"""Statistics, audits, set operations, listings, evaluation and events."""

from pyspark.sql import functions as F

from loreweave.operators import evaluation as ev
from loreweave.operators import reports as rp
from loreweave.plans.catalog.lifecycle import REASON_ROWS
from loreweave.plans.catalog.listing import DAYS, NOW
from loreweave.plans.registry import query
from loreweave.plans.tables import AS_OF
from loreweave.sources import events as se


@query("vault_stats", "G1", "SELECT vault, count(*) AS chunks, count(DISTINCT source_file) AS files, max(file_last_updated) AS last_updated FROM chunks GROUP BY vault")
def _(t):
    return rp.vault_stats(t.chunks)


@query("coverage_gaps", "G6", "SELECT vault, count(*) AS chunks, count(DISTINCT source_file) AS files, 'low_coverage' AS severity FROM (SELECT lang || '/' || origin AS vault, source_file FROM chunks) GROUP BY vault HAVING count(DISTINCT source_file) < 40")
def _(t):
    chunks = t.chunks.withColumn("vault", F.concat("lang", F.lit("/"), "origin"))
    return rp.coverage_gaps(chunks, 40).drop("last_updated")


@query("agent_stats", "G3", """SELECT source AS agent, count(*) AS facts_written, round(avg(confidence), 6) AS avg_confidence, count_if(status = 'needs_review') AS flag_count,
    round(count_if(status = 'needs_review') * 100::DOUBLE / count(*), 6) AS flag_rate_pct FROM facts GROUP BY source""")
def _(t):
    rows = rp.agent_stats(t.facts)
    return rows.withColumn("avg_confidence", F.round("avg_confidence", 6)).withColumn("flag_rate_pct", F.round("flag_rate_pct", 6))


@query("debt_report", "G4", f"""
    SELECT 'review_queue_size' AS metric, count(*) AS value, min(created_at) AS at FROM facts WHERE status = 'needs_review'
    UNION ALL SELECT 'review_' || reason, count(*), NULL FROM ({REASON_ROWS}) WHERE reason <> 'unread' GROUP BY reason
    UNION ALL SELECT 'vault_count', count(DISTINCT vault), NULL FROM chunks UNION ALL SELECT 'total_files', count(DISTINCT source_file), NULL FROM chunks UNION ALL SELECT 'total_chunks', count(*), NULL FROM chunks""")
def _(t):
    return rp.debt_report(t.fact_table, t.chunks, AS_OF)


TYPED_LOGS = "(SELECT *, CASE type WHEN 'click' THEN 'created' WHEN 'signup' THEN 'ingest' WHEN 'view' THEN 'fact_updated' WHEN 'error' THEN 'deleted' ELSE type END AS kind FROM log_entries)"


def typed_logs(t):
    kind = F.expr("CASE type WHEN 'click' THEN 'created' WHEN 'signup' THEN 'ingest' WHEN 'view' THEN 'fact_updated' WHEN 'error' THEN 'deleted' ELSE type END")
    return t.log_entries.withColumn("type", kind)


@query("digest", "G5", f"""SELECT agent, count_if(kind IN ('created', 'ingest')) AS created, count_if(kind = 'fact_updated') AS updated, count_if(kind = 'deleted') AS deleted, count(*) AS events
    FROM {TYPED_LOGS} WHERE created_at >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY agent""")
def _(t):
    return rp.digest(typed_logs(t), "2024-01-20 00:00:00", hours=240)


@query("briefing", "G7", f"""
    SELECT 'events' AS section, type AS label, count(*) AS n FROM log_entries WHERE created_at >= {NOW} - INTERVAL '720' HOUR GROUP BY type
    UNION ALL SELECT 'vault_files', vault, count(DISTINCT source_file) FROM chunks GROUP BY vault UNION ALL SELECT 'review', vault, count(*) FROM facts WHERE status = 'needs_review' GROUP BY vault
    UNION ALL SELECT 'last_session', vault || '/' || session_id, turn_count FROM (SELECT * FROM sessions WHERE NOT archived QUALIFY row_number() OVER (PARTITION BY vault ORDER BY updated_at DESC, session_id) = 1)""")
def _(t):
    return rp.briefing(t.log_entries, t.chunks, t.facts, t.sessions, AS_OF, hours=720)


@query("extraction_stats", "G10", "SELECT count(*) AS total_attempted, count_if(event_id % 3 = 0) AS facts_created, count_if(event_id % 3 = 1) AS facts_skipped, count_if(event_id % 3 = 2) AS facts_rejected, round(avg(value), 6) AS avg_confidence, max(ts) AS last_extraction FROM events")
def _(t):
    def one(r):
        return F.when(F.col("event_id") % 3 == r, 1).otherwise(0)

    runs = t.events.select(F.lit(1).alias("attempted"), one(0).alias("created"), one(1).alias("skipped"), one(2).alias("rejected"), F.col("value").alias("confidence"), F.col("ts").alias("at"))
    return rp.extraction_stats(runs).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("request_counts", "G19", "SELECT event_type AS endpoint, event_id % 4 AS status, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    return rp.request_counts(t.events.select(F.col("event_type").alias("endpoint"), (F.col("event_id") % 4).alias("status")))


@query("scan_health", "G20", "SELECT event_type AS scan, count(*) AS runs, max(ts) AS last_run, sum(user_id) AS flagged, sum(event_id % 5) AS resolved FROM events GROUP BY 1")
def _(t):
    return rp.scan_health(t.events.select(F.col("event_type").alias("scan"), F.col("ts").alias("at"), F.col("user_id").alias("flagged"), (F.col("event_id") % 5).alias("resolved")))


@query("freshness", "G22", f"""SELECT fact_key, w AS last_write, round(({DAYS.format(now=NOW, at='w')}) * 24, 6) AS hours_since, ({DAYS.format(now=NOW, at='w')}) * 24 >= 24 AS alert
    FROM (SELECT fact_key, coalesce(updated_at, created_at) AS w FROM facts ORDER BY w DESC, fact_key DESC LIMIT 1)""")
def _(t):
    return rp.freshness(t.facts, AS_OF).withColumn("hours_since", F.round("hours_since", 6))


@query("prune_to_newest", "X3", "SELECT id, agent FROM log_entries ORDER BY id DESC LIMIT 5000")
def _(t):
    return rp.prune_to_newest(t.log_entries, 5000).select("id", "agent")


@query("stale_files", "G16", f"SELECT path, CAST(trunc({DAYS.format(now=NOW, at='mtime')}) AS INT) AS days_stale FROM files WHERE {DAYS.format(now=NOW, at='mtime')} > 90")
def _(t):
    return rp.stale_files(t.files, AS_OF).select("path", "days_stale")


@query("duplicate_names", "G15", """SELECT filename, a AS path_a, path AS path_b FROM (SELECT filename, path, min(path) OVER (PARTITION BY filename) AS a FROM (
    SELECT 'f' || doc_id % 300 || '.md' AS filename, lang || '/' || source || '/' || doc_id || '/f' || doc_id % 300 || '.md' AS path FROM documents)) WHERE path > a""")
def _(t):
    paths = t.documents.select(F.concat("lang", F.lit("/"), "source", F.lit("/"), "doc_id", F.lit("/f"), F.col("doc_id") % 300, F.lit(".md")).alias("path"))
    return rp.duplicate_names(paths)


LISTING_SQL = """SELECT concat('v/', lang, '/', source, CASE WHEN source = 'src3' THEN '/img/f' ELSE '/f' END, doc_id, CASE WHEN source = 'src3' THEN '.png' WHEN doc_id % 5 = 0 THEN '' ELSE '.md' END) AS path, false AS is_dir FROM {documents}
    UNION ALL SELECT DISTINCT concat('v/', lang, '/', source), true FROM {documents} UNION ALL SELECT DISTINCT concat('v/', lang), true FROM {documents} UNION ALL SELECT DISTINCT 'v', true FROM {documents}
    UNION ALL SELECT DISTINCT concat('v/', lang, '/empty'), true FROM {documents} UNION ALL SELECT DISTINCT concat('v/', lang, '/src3/img'), true FROM {documents} WHERE source = 'src3'"""


def listing(t):
    return t.sql(LISTING_SQL)


LISTING = "(" + LISTING_SQL.replace("{documents}", "documents") + ")"
GAPS = f"""SELECT d.path AS dir, CASE WHEN count(x.path) = 0 THEN 'empty' ELSE 'no_indexable' END AS reason FROM {LISTING} d LEFT JOIN {LISTING} x ON starts_with(x.path, d.path || '/')
    WHERE d.is_dir GROUP BY d.path HAVING count(*) FILTER (WHERE NOT x.is_dir AND NOT contains(substr(x.path, length(d.path) + 2), '/')) = 0
      AND count(*) FILTER (WHERE NOT x.is_dir AND (x.path LIKE '%.md' OR NOT contains(regexp_extract(x.path, '[^/]*$'), '.'))) = 0"""


@query("empty_dirs", "G17", GAPS)
def _(t):
    return rp.empty_dirs(listing(t))


ON_DISK = "(SELECT * FROM files WHERE mtime < TIMESTAMP '2023-11-05 00:00:00' OR vault = 'beta')"
CONSISTENCY = f"""SELECT vault, i AS indexed_files, d AS disk_files, round((i - d)::DOUBLE / i, 6) AS delta, d = 0 OR (i - d)::DOUBLE / i > 0.1 AS affected
    FROM (SELECT vault, count(DISTINCT source_file) AS i FROM chunks GROUP BY vault) JOIN (SELECT vault, count(*) AS d FROM {ON_DISK} GROUP BY vault) USING (vault)"""


def on_disk(t):
    return t.files.filter("mtime < TIMESTAMP_NTZ '2023-11-05 00:00:00' OR vault = 'beta'")


@query("index_consistency", "G18", CONSISTENCY)
def _(t):
    return rp.index_consistency(on_disk(t), t.chunks).withColumn("delta", F.round("delta", 6))


@query("diff_listings", "A3", """SELECT vault, path, CASE WHEN n.path IS NULL THEN 'deleted' WHEN o.path IS NULL THEN 'added' ELSE 'modified' END AS action FROM (SELECT * FROM vault_paths WHERE vault < 'v3' OR hours % 3 = 0) o
    FULL JOIN (SELECT vault, path, mtime + INTERVAL '1' HOUR * CASE WHEN hours % 2 = 0 THEN 5 ELSE 0 END AS mtime FROM vault_paths WHERE vault > 'v0' OR hours % 5 > 0) n USING (vault, path)
    WHERE o.mtime IS NULL OR n.mtime IS NULL OR n.mtime > o.mtime""")
def _(t):
    old = t.vault_paths.filter("vault < 'v3' OR hours % 3 = 0")
    new = t.vault_paths.filter("vault > 'v0' OR hours % 5 > 0").select(
        "vault", "path", F.expr("mtime + make_dt_interval(0, CASE WHEN hours % 2 = 0 THEN 5 ELSE 0 END)").alias("mtime"))
    return rp.diff_listings(old, new)


@query("deleted_files", "S4", "SELECT path FROM files EXCEPT SELECT concat('doc/', doc_id, '.md') FROM labels")
def _(t):
    return t.files.select("path").subtract(t.labels.select(F.concat(F.lit("doc/"), "doc_id", F.lit(".md"))))


@query("changed_files", "S2", "SELECT concat('doc/', doc_id, '.md') AS path FROM labels UNION SELECT source FROM facts")
def _(t):
    return t.labels.select(F.concat(F.lit("doc/"), "doc_id", F.lit(".md")).alias("path")).union(t.facts.select("source")).distinct()


@query("shared_keys", "S3", "SELECT fact_key FROM facts WHERE vault = 'alpha' INTERSECT SELECT fact_key FROM facts WHERE vault = 'beta'")
def _(t):
    return rp.shared_keys(t.facts, "alpha", "beta")


@query("tag_sets", "S5", """SELECT event_id, len(list_intersect(a, b)) AS both_n, len(list_distinct(list_concat(a, b))) AS any_n, list_has_all(a, b) AS all_tags FROM (
    SELECT event_id, string_split(tags_csv, ',') AS a, [split_part(fact_key, '/', 3), CASE WHEN version = 1 THEN 'hot' ELSE 'view' END] AS b FROM facts)""")
def _(t):
    b = F.array(F.split_part("fact_key", F.lit("/"), F.lit(3)), F.when(F.col("version") == 1, "hot").otherwise("view"))
    a = F.col("tags")
    rows = t.fact_table.withColumn("b", b)
    shared = F.array_intersect(a, F.col("b"))
    return rows.select("event_id", F.size(shared).cast("long").alias("both_n"), F.size(F.array_union(a, F.col("b"))).cast("long").alias("any_n"),
                       (F.size(F.array_except("b", a)) == 0).alias("all_tags"))


CONTRA = """SELECT a.fact_key, a.fact_value AS value, count(DISTINCT a.vault) AS vaults, min(a.vault) AS first_vault, any_value(k.n) AS n_values
    FROM {0} a JOIN (SELECT fact_key, count(DISTINCT fact_value) AS n FROM {0} GROUP BY 1) k ON k.fact_key = a.fact_key
    WHERE EXISTS (SELECT 1 FROM {0} b WHERE b.fact_key = a.fact_key AND b.vault <> a.vault AND b.fact_value <> a.fact_value) GROUP BY 1, 2"""


@query("cross_vault_contradictions", "F4", CONTRA.format("facts_seven"))
def _(t):
    return rp.cross_vault_contradictions(t.facts_seven)


@query("zip_facts_chunks", "F12,L23", """SELECT a.r AS place, fact_key, fact_value, doc_id, text FROM (SELECT *, row_number() OVER (ORDER BY vault, fact_key) AS r FROM facts WHERE status = 'active') a
    JOIN (SELECT *, row_number() OVER (ORDER BY doc_id) AS r FROM chunks) b ON b.r = a.r WHERE a.r <= 50""")
def _(t):
    return rp.zip_facts_chunks(t.facts, t.chunks, "doc_id", 50)


@query("cross_source_pairs", "F13,L23", """WITH s AS (SELECT doc_id, source_file, (row_number() OVER (ORDER BY md5(concat(doc_id, ':3')), doc_id) - 1) AS n FROM (SELECT * FROM chunks ORDER BY md5(concat(doc_id, ':3')), doc_id LIMIT 100))
    SELECT a.n // 2 AS pair, a.doc_id AS id_a, b.doc_id AS id_b FROM s a JOIN s b ON b.n = a.n + 1 WHERE a.n % 2 = 0 AND a.source_file <> b.source_file""")
def _(t):
    return rp.cross_source_pairs(t.chunks, "doc_id", 50, 3).select("pair", "id_a", "id_b")


@query("audit", "G21", f"""
    SELECT 'staleness' AS "check", path AS subject, CAST(CAST(trunc({DAYS.format(now=NOW, at='mtime')}) AS INT) AS VARCHAR) AS detail FROM files WHERE {DAYS.format(now=NOW, at='mtime')} > 90
    UNION ALL SELECT 'gaps', dir, reason FROM ({GAPS}) UNION ALL SELECT 'consistency', vault, CAST(disk_files AS VARCHAR) FROM ({CONSISTENCY.replace(ON_DISK, 'files')}) WHERE affected
    UNION ALL SELECT 'conflicts', vault || '/' || fact_key, contradicts_csv FROM facts WHERE contradicts_csv <> '' AND NOT conflict_resolved
    UNION ALL SELECT 'contradictions', first_vault || '/' || fact_key, value FROM ({CONTRA.format('facts')}) UNION ALL SELECT 'expired', vault || '/' || fact_key, 'expired' FROM facts WHERE status = 'active' AND valid_until < {NOW}""")
def _(t):
    return rp.audit(t.files, t.fact_table, t.chunks, listing(t), AS_OF)


# ── evaluation ────────────────────────────────────────────────────────────────
@query("score_answers", "G0,O6", """SELECT doc_id, CASE WHEN lower(trim(lang)) = lower(trim(CASE WHEN doc_id % 2 = 0 THEN ' ' || upper(lang) ELSE source END)) THEN 1 ELSE 0 END::DOUBLE AS score,
    lower(trim(lang)) = lower(trim(CASE WHEN doc_id % 2 = 0 THEN ' ' || upper(lang) ELSE source END)) AS correct FROM documents""")
def _(t):
    rows = t.documents.select("doc_id", F.col("lang").alias("ground_truth"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), F.upper("lang"))).otherwise(F.col("source")).alias("answer"))
    return ev.score_answers(rows).select("doc_id", "score", "correct")


BATCH = "(SELECT question_type, config, count(*) AS total, count_if(correct) AS correct, round(count_if(correct) / count(*)::DOUBLE, 4) AS accuracy FROM {0} GROUP BY GROUPING SETS ((), (question_type), (config)))"


@query("score_batch", "G11", BATCH.format("results"))
def _(t):
    return ev.score_batch(t.results)


HALVES = ["(SELECT * FROM results WHERE latency_ms >= 20)", "(SELECT * FROM results WHERE latency_ms < 20)"]


@query("compare_to_baseline", "G12", f"""SELECT question_type, "current", baseline, delta, CASE WHEN delta < -0.01 THEN 'regression' WHEN delta > 0.01 THEN 'improvement' ELSE 'stable' END AS verdict FROM (
    SELECT question_type, c.accuracy AS "current", b.accuracy AS baseline, round(coalesce(c.accuracy, 0) - coalesce(b.accuracy, 0), 4) AS delta
    FROM (SELECT coalesce(question_type, '(all)') AS question_type, accuracy FROM {BATCH.format(HALVES[0])} WHERE config IS NULL) c FULL JOIN (SELECT coalesce(question_type, '(all)') AS question_type, accuracy
      FROM {BATCH.format(HALVES[1])} WHERE config IS NULL) b USING (question_type))""")
def _(t):
    new, old = t.results.filter("latency_ms >= 20"), t.results.filter("latency_ms < 20")
    return ev.compare_to_baseline(ev.score_batch(new), ev.score_batch(old))


@query("latency_summary", "G13", """SELECT count(*) AS total, count_if(error <> '') AS errors, l[CAST(floor(count(*) * 0.5::DOUBLE) AS BIGINT) + 1] AS p50, l[CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT) + 1] AS p95,
    l[CAST(floor(count(*) * 0.99::DOUBLE) AS BIGINT) + 1] AS p99 FROM results, (SELECT list_sort(list(latency_ms)) AS l FROM results) GROUP BY l""")
def _(t):
    return ev.latency_summary(t.results).drop("throughput_rps")


@query("classify_failures", "G14", """
    SELECT 'ingest_failures' AS pattern, '' AS label, 30 AS n, (SELECT count(*) FROM results) AS total
    UNION ALL SELECT 'error_cluster', question_type, count(*), (SELECT count(*) FROM results) FROM results WHERE error <> '' GROUP BY question_type HAVING count(*) > 3
    UNION ALL SELECT 'timeouts', '', count_if(latency_ms * 1000 >= 30000), count(*) FROM results HAVING count_if(latency_ms * 1000 >= 30000) / count(*)::DOUBLE > 0.05
    UNION ALL SELECT 'synthesis_failure', '', count(*), (SELECT count(*) FROM results) FROM results WHERE error = '' AND contains(lower(answer), 'cannot answer') HAVING count(*) > 3
    UNION ALL SELECT 'new_error_mode', split_part(error, ':', 1), count(*), (SELECT count(*) FROM results) FROM results WHERE error <> '' AND split_part(error, ':', 1) NOT IN ('POST /ask', 'POST /vault', 'ConnectionError') GROUP BY ALL HAVING count(*) > 1""")
def _(t):
    rows = t.results.withColumn("latency_ms", F.col("latency_ms") * 1000)
    return ev.classify_failures(rows, conversations_total=1000, conversations_ingested=970)


# ── events ────────────────────────────────────────────────────────────────────
PUSH = """concat('{"ref":"refs/heads/main","before":"b', event_id, '","after":"a', event_id, '","commits":[{"added":["docs/x ', user_id, '.md","r.md"],"removed":["gone.md"],"modified":[]},{"added":["r.md"],"modified":["k/', event_type, '.md"]}],',
    '"repository":{"full_name":"o/r', user_id, '","clone_url":"https://h.example/o/r', user_id, '.git","html_url":"https://h.example/o/r', user_id, '"},"project":{"git_http_url":"https://l.example/g/r', user_id, '.git","path_with_namespace":"g/r"}}')"""
PROVIDER = "CASE event_id % 3 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' ELSE 'gitea' END"


@query("read_push_events", "A10", f"""SELECT event_id, provider, repo_url, path, CASE provider WHEN 'github' THEN 'https://raw.githubusercontent.com/o/r' || user_id || '/a' || event_id || '/' WHEN 'gitlab' THEN repo_url || '/-/raw/a' || event_id || '/'
      ELSE repo_url || '/raw/a' || event_id || '/' END || replace(replace(path, '/', '%2F'), ' ', '%20') AS raw_url
    FROM (SELECT *, CASE provider WHEN 'gitlab' THEN 'https://l.example/g/r' || user_id ELSE 'https://h.example/o/r' || user_id END AS repo_url FROM (
      SELECT event_id, user_id, {PROVIDER} AS provider, unnest(['docs/x ' || user_id || '.md', 'r.md', 'k/' || event_type || '.md']) AS path FROM events))""")
def _(t):
    rows = t.events.select("event_id", F.expr(PROVIDER).alias("provider"), F.expr(PUSH).alias("body"))
    return se.read_push_events(rows).select("event_id", "provider", "repo_url", "path", "raw_url")


@query("to_event_stream", "A16", """SELECT '1.0' AS specversion, 'loreweave' AS source, event_type AS type, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS time, '{"event_id":' || event_id || ',"user_id":' || user_id || '}' AS data
    FROM events WHERE event_type IN ('view', 'error')""")
def _(t):
    out = se.to_event_stream(t.events, F.col("event_type"), "loreweave", "ts", ["event_id", "user_id"], ["view", "error"])
    return out.drop("id")


@query("validate_logs", "A7", """SELECT doc_id, CASE WHEN strlen(text) > 65536 THEN 'BODY_TOO_LARGE' WHEN lang = 'de' THEN 'EMPTY_TAG' END AS error FROM documents""")
def _(t):
    rows = t.documents.select("doc_id", F.col("source").alias("agent"), F.col("lang").alias("type"), F.col("text").alias("body"), F.array(F.when(F.col("lang") == "de", "").otherwise("t")).alias("tags"))
    return se.validate_logs(rows).select("doc_id", "error")
