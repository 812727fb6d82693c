"""Fact writes, maintenance scans, review and tuning."""

from pyspark.sql import functions as F

from loreweave.operators import facts as fx
from loreweave.operators import lifecycle as lc
from loreweave.operators import review as rv
from loreweave.plans.catalog.listing import ACCESS, DAYS, IMPORTANCE, NOW
from loreweave.plans.registry import query
from loreweave.plans.tables import AS_OF

LATER = "2024-03-05 00:00:00"
SPLIT = "2024-01-16 00:00:00"
KEY = ["vault", "fact_key"]

# One row per fact before and after the split instant; every event is on one side.
OLD_SQL = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vault, fact_key ORDER BY created_at DESC, event_id DESC) AS r
  FROM facts_in WHERE created_at < TIMESTAMP '{SPLIT}') WHERE r = 1)"""
NEW_SQL = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vault, fact_key ORDER BY created_at DESC, event_id DESC) AS r
  FROM facts_in WHERE created_at >= TIMESTAMP '{SPLIT}') WHERE r = 1)"""


def before_split(t):
    from loreweave import skew

    early = t.incoming_facts.filter(F.col("created_at") < F.lit(SPLIT).cast("timestamp_ntz"))
    return skew.first_per_key(early, KEY, [F.desc("created_at"), F.desc("event_id")])


def after_split(t):
    return t.incoming_facts.filter(F.col("created_at") >= F.lit(SPLIT).cast("timestamp_ntz"))


@query("validate_facts", "L1", """
    SELECT event_id, CASE WHEN fact_value = '' THEN 'INVALID_INPUT' WHEN strlen(fact_value) > 65536 THEN 'VALUE_TOO_LARGE' END AS error
    FROM (SELECT doc_id AS event_id, CASE WHEN source = 'src1' THEN '' ELSE text END AS fact_value FROM documents)""")
def _(t):
    rows = t.documents.select(F.col("doc_id").alias("event_id"), F.concat(F.lit("d/"), "doc_id").alias("fact_key"),
                              F.when(F.col("source") == "src1", "").otherwise(F.col("text")).alias("fact_value"))
    return fx.validate(rows).select("event_id", "error")


@query("upsert_facts", "L1", f"""
    SELECT coalesce(n.vault, o.vault) AS vault, coalesce(n.fact_key, o.fact_key) AS fact_key,
      CASE WHEN n.fact_key IS NULL THEN o.fact_value ELSE n.fact_value END AS fact_value,
      coalesce(o.status, 'active') AS status,
      CASE WHEN n.fact_key IS NULL THEN o.confidence ELSE least(greatest(n.confidence, 0), 1) END AS confidence,
      coalesce(o.created_at, {NOW}) AS created_at,
      CASE WHEN n.fact_key IS NULL THEN o.updated_at ELSE {NOW} END AS updated_at,
      CASE WHEN n.fact_key IS NULL THEN o.expires_at WHEN n.ttl_days > 0 THEN {NOW} + INTERVAL '1' DAY * n.ttl_days END AS expires_at,
      CASE WHEN n.fact_key IS NULL THEN o.confirmation_count WHEN o.confirmation_count > 0 THEN o.confirmation_count ELSE 1 END AS confirmation_count,
      coalesce(o.access_count, 0) AS access_count, coalesce(n.version, o.version) AS version,
      CASE WHEN n.fact_key IS NULL THEN o.valid_from ELSE coalesce(n.valid_from, o.created_at, {NOW}) END AS valid_from,
      o.supersedes AS supersedes, coalesce(o.conflict_resolved, false) AS conflict_resolved
    FROM {OLD_SQL} o FULL JOIN {NEW_SQL} n ON o.vault = n.vault AND o.fact_key = n.fact_key""")
def _(t):
    out = fx.upsert(before_split(t), after_split(t), AS_OF, ["created_at", "event_id"])
    return out.select("vault", "fact_key", "fact_value", "status", "confidence", "created_at", "updated_at", "expires_at",
                      "confirmation_count", "access_count", "version", "valid_from", "supersedes", "conflict_resolved")


@query("update_facts", "L2,L13", f"""
    SELECT f.vault, f.fact_key, coalesce(p.fact_value, f.fact_value) AS fact_value, coalesce(p.confidence, f.confidence) AS confidence,
      coalesce(p.ttl_days, f.ttl_days) AS ttl_days,
      CASE WHEN p.ttl_days > 0 THEN {NOW} + INTERVAL '1' DAY * p.ttl_days WHEN p.ttl_days IS NULL THEN f.expires_at END AS expires_at,
      CASE WHEN p.fact_key IS NOT NULL THEN {NOW} ELSE f.updated_at END AS updated_at
    FROM facts f LEFT JOIN (SELECT * FROM (SELECT vault, fact_key, fact_value, CASE WHEN confidence > 0.5 THEN confidence END AS confidence,
        CASE WHEN ttl_days < 30 THEN ttl_days END AS ttl_days,
        row_number() OVER (PARTITION BY vault, fact_key ORDER BY event_id DESC) AS r FROM facts_in WHERE created_at >= TIMESTAMP '{SPLIT}') WHERE r = 1) p
      ON p.vault = f.vault AND p.fact_key = f.fact_key""")
def _(t):
    patches = after_split(t).select(
        *KEY, "event_id", "fact_value", F.when(F.col("confidence") > 0.5, F.col("confidence")).alias("confidence"),
        F.when(F.col("ttl_days") < 30, F.col("ttl_days")).alias("ttl_days"))
    out = fx.update(t.fact_table, patches, AS_OF, ["event_id"], window_minutes=30)
    return out.select(*KEY, "fact_value", "confidence", "ttl_days", "expires_at", "updated_at")


PATCH_KEYS = "(SELECT DISTINCT vault, supersedes AS fact_key FROM facts WHERE supersedes IS NOT NULL)"


def patch_keys(t):
    return t.facts.filter("supersedes is not null").select("vault", F.col("supersedes").alias("fact_key"))


@query("bulk_patch", "L3", f"""
    SELECT f.vault, f.fact_key, CASE WHEN k.fact_key IS NULL THEN status ELSE 'active' END AS status,
      CASE WHEN k.fact_key IS NULL THEN confidence ELSE 0.9::DOUBLE END AS confidence,
      CASE WHEN k.fact_key IS NULL THEN expires_at ELSE {NOW} + INTERVAL '10' DAY END AS expires_at
    FROM facts f LEFT JOIN {PATCH_KEYS} k ON k.vault = f.vault AND k.fact_key = f.fact_key""")
def _(t):
    snapshot, _ = fx.bulk_patch(t.fact_table, patch_keys(t), {"status": "active", "confidence": 0.9, "ttl_days": 10}, AS_OF)
    return snapshot.select(*KEY, "status", "confidence", "expires_at")


@query("bulk_patch_outcome", "L3", f"""
    SELECT k.vault, k.fact_key, f.fact_key IS NOT NULL AS ok, CASE WHEN f.fact_key IS NULL THEN 'NOT_FOUND' END AS error
    FROM {PATCH_KEYS} k LEFT JOIN facts f ON k.vault = f.vault AND k.fact_key = f.fact_key""")
def _(t):
    return fx.bulk_patch(t.fact_table, patch_keys(t), {"status": "active"}, AS_OF)[1]


@query("delete_facts", "L4", f"SELECT vault, fact_key FROM facts EXCEPT SELECT vault, fact_key FROM {PATCH_KEYS}")
def _(t):
    return fx.delete(t.facts, patch_keys(t)).select(*KEY)


@query("reconsolidate", "L13", """
    SELECT f.vault, f.fact_key, CASE WHEN u.at >= f.last_recalled_at AND u.at <= f.last_recalled_at + INTERVAL '30' MINUTE THEN u.at END AS reconsolidated_at,
      CASE WHEN u.at >= f.last_recalled_at AND u.at <= f.last_recalled_at + INTERVAL '30' MINUTE THEN 1 ELSE 0 END AS chain_length
    FROM facts f LEFT JOIN (SELECT vault, fact_key, max(created_at) + INTERVAL '40' MINUTE AS at FROM facts_in GROUP BY ALL) u
      ON f.vault = u.vault AND f.fact_key = u.fact_key""")
def _(t):
    updates = t.facts_in.select(*KEY, (F.col("created_at") + F.expr("INTERVAL '40' MINUTE")).alias("updated_at"))
    out = fx.reconsolidate(t.fact_table, updates)
    return out.select(*KEY, "reconsolidated_at", F.coalesce(F.size("reconsolidation_chain"), F.lit(0)).alias("chain_length"))


@query("fact_history", "L15", """
    SELECT fact_key, 0 AS stage, 'created' AS event, created_at AS at FROM facts
    UNION ALL SELECT fact_key, 1, 'updated', updated_at FROM facts WHERE updated_at IS NOT NULL
    UNION ALL SELECT fact_key, 2, action, created_at FROM resolutions WHERE fact_key IN (SELECT fact_key FROM facts)""")
def _(t):
    return fx.history(t.facts, t.resolutions)


@query("fact_provenance", "F14", "SELECT vault, fact_key, fact_value, source_type, source AS target, source <> '' AS resolved FROM facts")
def _(t):
    links = fx.provenance_links(t.facts)
    return fx.provenance(t.facts, links).select("vault", "fact_key", "fact_value", "source_type", "target", "resolved")


# ── scans ─────────────────────────────────────────────────────────────────────
REFS = """(SELECT DISTINCT vault, k AS fact_key FROM (
    SELECT vault, supersedes AS k FROM facts WHERE status = 'active' UNION ALL SELECT vault, refines FROM facts WHERE status = 'active'
    UNION ALL SELECT vault, unnest(string_split(contradicts_csv, ',')) FROM facts WHERE status = 'active'
    UNION ALL SELECT vault, unnest(string_split(supports_csv, ',')) FROM facts WHERE status = 'active') WHERE k IS NOT NULL AND k <> '')"""
STALE = f"""SELECT vault, fact_key FROM facts f WHERE status = 'active' AND ttl_days > 0 AND expires_at < {NOW} AND {IMPORTANCE} < 0.6
    AND NOT EXISTS (SELECT 1 FROM {REFS} r WHERE r.vault = f.vault AND r.fact_key = f.fact_key)"""
EXPIRED = f"SELECT vault, fact_key FROM facts WHERE status = 'active' AND valid_until < {NOW}"
LOW = "SELECT vault, fact_key FROM facts WHERE status = 'active' AND confidence <= 0.5"
DELETED = """SELECT vault, fact_key FROM facts f WHERE status = 'active' AND source <> ''
    AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.vault = f.vault AND c.source_file = f.source)"""
BY_REF = """SELECT vault, fact_key FROM facts f WHERE status = 'active'
    AND EXISTS (SELECT 1 FROM facts s WHERE s.vault = f.vault AND s.supersedes = f.fact_key)"""
VERSIONS = """(SELECT vault, fact_key, v, max(v) OVER (PARTITION BY vault, p) AS top FROM (SELECT vault, fact_key,
    regexp_extract(fact_key, '^(.*)/v[0-9]+/', 1) AS p, CAST(regexp_extract(fact_key, '/v([0-9]+)/', 1) AS INT) AS v FROM facts WHERE status = 'active'))"""
BY_VERSION = f"SELECT vault, fact_key FROM {VERSIONS} WHERE v < top"


@query("importance", "L9", f"SELECT vault, fact_key, round({IMPORTANCE}, 6) AS importance FROM facts")
def _(t):
    from loreweave.functions import facts as ff

    return t.facts.select(*KEY, F.round(ff.importance(AS_OF), 6).alias("importance"))


@query("stale_unreferenced", "F3", f"""SELECT vault, fact_key FROM facts f WHERE status = 'active'
    AND NOT EXISTS (SELECT 1 FROM {REFS} r WHERE r.vault = f.vault AND r.fact_key = f.fact_key)""")
def _(t):
    return lc.unreferenced(t.fact_table).select(*KEY)


@query("ttl_stale", "L5", STALE)
def _(t):
    return lc.ttl_stale(t.fact_table, AS_OF, 0.6).select(*KEY)


@query("expired", "L6", EXPIRED)
def _(t):
    return lc.expired(t.fact_table, AS_OF).select(*KEY)


@query("low_confidence", "L7", LOW)
def _(t):
    return lc.low_confidence(t.fact_table).select(*KEY)


@query("source_deleted", "F2", DELETED)
def _(t):
    return lc.source_deleted(t.fact_table, t.chunks).select(*KEY)


@query("supersede_by_reference", "F1", BY_REF)
def _(t):
    return lc.supersede_by_reference(t.fact_table).select(*KEY)


@query("supersede_by_version", "W3", f"SELECT vault, fact_key, top AS superseded_by FROM {VERSIONS} WHERE v < top")
def _(t):
    return lc.supersede_by_version(t.fact_table).select(*KEY, "superseded_by")


@query("supersede_on_write", "W3", f"""
    SELECT f.vault, f.fact_key, CASE WHEN f.status = 'active' AND f.version < n.top THEN 'superseded' ELSE f.status END AS status,
      CASE WHEN f.status = 'active' AND f.version < n.top THEN n.top END AS superseded_by
    FROM facts f LEFT JOIN (SELECT vault, regexp_extract(fact_key, '^(.*)/v[0-9]+/', 1) AS p, max(version) AS top FROM facts_in
        WHERE created_at >= TIMESTAMP '{SPLIT}' GROUP BY ALL) n ON n.vault = f.vault AND n.p = regexp_extract(f.fact_key, '^(.*)/v[0-9]+/', 1)""")
def _(t):
    out = lc.supersede_on_write(t.fact_table, after_split(t), AS_OF)
    return out.select(*KEY, "status", "superseded_by")


@query("unresolved_conflicts", "L22", """SELECT vault, fact_key, fact_value, contradicts_csv AS contradicts, status FROM facts
    WHERE contradicts_csv <> '' AND NOT conflict_resolved""")
def _(t):
    rows = lc.unresolved_conflicts(t.fact_table)
    return rows.select(*KEY, "fact_value", F.array_join("contradicts", ",").alias("contradicts"), "status")


@query("maintain_facts", "P9", f"""
    SELECT f.vault, f.fact_key, CASE WHEN s.fact_key IS NOT NULL THEN 'superseded' WHEN r.fact_key IS NOT NULL THEN 'needs_review' ELSE f.status END AS status,
      CASE WHEN s.fact_key IS NOT NULL OR r.fact_key IS NOT NULL THEN {NOW} ELSE f.updated_at END AS updated_at
    FROM facts f LEFT JOIN ({BY_REF} UNION {BY_VERSION}) s ON s.vault = f.vault AND s.fact_key = f.fact_key
    LEFT JOIN ({STALE} UNION {EXPIRED} UNION {LOW} UNION {DELETED}) r ON r.vault = f.vault AND r.fact_key = f.fact_key""")
def _(t):
    return lc.maintain(t.fact_table, t.chunks, AS_OF, importance_threshold=0.6).select(*KEY, "status", "updated_at")


# ── review ────────────────────────────────────────────────────────────────────
UNREAD = (f"CASE WHEN access_count = 0 THEN {DAYS.format(now=NOW, at='created_at')} > 30 "
          f"ELSE coalesce({DAYS.format(now=NOW, at='last_accessed_at')} > 30, false) END")
REASON_ROWS = f"""
    SELECT *, unnest(list_filter([CASE WHEN expires_at < {NOW} THEN 'stale' END, CASE WHEN contradicts_csv <> '' AND NOT conflict_resolved THEN 'contradiction' END,
      CASE WHEN confidence < 0.5 THEN 'low_confidence' END, CASE WHEN supersedes <> '' THEN 'supersession' END, CASE WHEN {UNREAD} THEN 'unread' END],
      lambda x: x IS NOT NULL)) AS reason FROM facts WHERE status = 'needs_review'"""


@query("review_queue", "L11", f"""
    SELECT vault, fact_key, reason FROM ({REASON_ROWS}) WHERE list_contains(string_split(tags_csv, ','), 'hot') AND confidence < 0.9""")
def _(t):
    return rv.queue_reasons(rv.queue(t.fact_table, AS_OF, tag="hot", max_confidence=0.9))


@query("review_queue_unread", "L11", f"SELECT vault, fact_key FROM ({REASON_ROWS.replace(AS_OF, LATER)}) WHERE reason = 'unread' AND source_type = 'manual'")
def _(t):
    return rv.queue_reasons(rv.queue(t.fact_table, LATER, reason="unread", source_type="manual")).select(*KEY)


STATS = ", count(*) AS n, min(created_at) AS oldest, round(avg({d}), 6) AS avg_pending_days, round(avg({a}), 6) AS avg_accessibility".format(
    d=DAYS.format(now=NOW, at="created_at"), a=ACCESS)


@query("review_stats", "G2", f"""
    SELECT 'total' AS grouping, '' AS label {STATS} FROM facts WHERE status = 'needs_review'
    UNION ALL SELECT 'source_type', source_type {STATS} FROM facts WHERE status = 'needs_review' GROUP BY source_type
    UNION ALL SELECT 'reason', reason {STATS} FROM ({REASON_ROWS}) WHERE reason <> 'unread' GROUP BY reason""")
def _(t):
    rows = rv.stats(t.fact_table, AS_OF)
    return rows.select("grouping", "label", "n", "oldest", F.round("avg_pending_days", 6).alias("avg_pending_days"),
                       F.round("avg_accessibility", 6).alias("avg_accessibility"))


DECISIONS = """(SELECT * FROM (SELECT fact_key, action, event_id, CASE WHEN event_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS vault,
    row_number() OVER (PARTITION BY fact_key, event_id % 2 ORDER BY event_id DESC) AS r FROM resolutions) WHERE r = 1)"""


def decisions(t):
    return t.sql("""SELECT * FROM (SELECT fact_key, action, event_id, CASE WHEN event_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS vault,
        row_number() OVER (PARTITION BY fact_key, event_id % 2 ORDER BY event_id DESC) AS r FROM {resolutions}) x WHERE r = 1""").select(
        *KEY, "action", F.concat("fact_key", F.lit("/next")).alias("new_key"), F.concat(F.lit("value "), "event_id").alias("new_value"),
        F.lit(0.75).alias("confidence"), F.lit(20).alias("ttl_days"))


@query("resolve_reviews", "L12", f"""
    SELECT f.vault, f.fact_key, f.fact_value, CASE d.action WHEN 'confirm' THEN 'active' WHEN 'reclassify' THEN 'active' WHEN 'supersede' THEN 'superseded'
        WHEN 'reject' THEN 'rejected' ELSE f.status END AS status,
      CASE WHEN d.action IN ('confirm', 'reclassify') THEN 0.75::DOUBLE ELSE f.confidence END AS confidence,
      f.confirmation_count + CASE WHEN d.action = 'confirm' THEN 1 ELSE 0 END AS confirmation_count,
      CASE WHEN d.action = 'supersede' THEN concat(f.fact_key, '/next') ELSE f.supersedes END AS supersedes,
      CASE WHEN d.action = 'reclassify' THEN {NOW} + INTERVAL '20' DAY ELSE f.expires_at END AS expires_at
    FROM facts f LEFT JOIN {DECISIONS} d ON d.vault = f.vault AND d.fact_key = f.fact_key
    UNION ALL
    SELECT f.vault, concat(f.fact_key, '/next'), concat('value ', d.event_id), 'active', f.confidence, 1, '', NULL
    FROM facts f JOIN {DECISIONS} d ON d.vault = f.vault AND d.fact_key = f.fact_key AND d.action = 'supersede'""")
def _(t):
    out = rv.resolve(t.fact_table, decisions(t), AS_OF)
    return out.select(*KEY, "fact_value", "status", "confidence", "confirmation_count", "supersedes", "expires_at")


@query("threshold_recommendations", "G8", """
    SELECT reason_type, total AS sample_size, round(acc / total, 6) AS accept_rate, cur AS "current",
      CASE reason_type WHEN 'conflict' THEN CASE WHEN rej / total > 0.3 THEN 0.9 WHEN acc / total > 0.85 THEN 0.8 ELSE 0.85 END
        WHEN 'low_confidence' THEN CASE WHEN rej / total > 0.3 THEN 0.4 WHEN acc / total > 0.85 THEN 0.6 ELSE 0.5 END ELSE 0 END::DOUBLE AS recommended
    FROM (SELECT reason_type, count(*) AS total, count_if(action IN ('confirm', 'reclassify'))::DOUBLE AS acc, count_if(action = 'reject')::DOUBLE AS rej,
      CASE reason_type WHEN 'conflict' THEN 0.85 WHEN 'low_confidence' THEN 0.5 ELSE 0 END::DOUBLE AS cur FROM resolutions GROUP BY reason_type HAVING count(*) >= 3)""")
def _(t):
    rows = rv.threshold_recommendations(t.resolutions)
    return rows.select("reason_type", "sample_size", F.round("accept_rate", 6).alias("accept_rate"), "current", "recommended")
