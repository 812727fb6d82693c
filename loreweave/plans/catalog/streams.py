"""Structured Streaming jobs, run over the given files until they are drained."""

from pyspark.sql import functions as F

from loreweave.functions.facts import FACT_COLUMNS
from loreweave.plans.catalog.listing import NOW
from loreweave.plans.registry import query
from loreweave.plans.tables import AS_OF, DERIVED, with_lists
from loreweave.session import shared_dir
from loreweave.streaming import jobs, state


def event_stream(t):
    return jobs.table_stream(t.spark, t.sf_dir, "events", t.events.schema)


def derived_stream(t, name):
    """A derived table whose only input is one base table, as a stream."""
    base = {"log_entries": "events", "turns": "conversations", "facts_in": "events"}[name]
    source = jobs.table_stream(t.spark, t.sf_dir, base, getattr(t, base).schema)
    return t.spark.sql(DERIVED[name], **{base: source})


COUNTS = "SELECT w AS start, w + INTERVAL '1' HOUR AS \"end\", type, agent, count(*) AS n FROM (SELECT date_trunc('hour', created_at) AS w, type, agent FROM log_entries) GROUP BY ALL"


@query("live_counts", "P5", COUNTS)
def _(t):
    logs = t.log_entries.withColumn("created_at", F.col("created_at").cast("timestamp"))
    return naive(jobs.live_counts(logs), "start", "end")


def naive(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("live_counts_stream", "P5", COUNTS + " HAVING w + INTERVAL '1' HOUR <= (SELECT max(created_at) FROM log_entries) - INTERVAL '10' MINUTE")
def _(t):
    logs = jobs.with_event_time(derived_stream(t, "log_entries"), "created_at")
    return naive(jobs.drain(jobs.live_counts(logs)), "start", "end").drop("batch")


@query("sliding_counts_stream", "P5", """SELECT start, start + INTERVAL '2' HOUR AS "end", type, agent, count(*) AS n FROM (SELECT date_trunc('hour', created_at) - INTERVAL '1' HOUR * k AS start, type, agent FROM log_entries, (SELECT unnest([0, 1]) AS k))
    GROUP BY ALL HAVING start + INTERVAL '2' HOUR <= (SELECT max(created_at) FROM log_entries) - INTERVAL '10' MINUTE""")
def _(t):
    logs = jobs.with_event_time(derived_stream(t, "log_entries"), "created_at")
    return naive(jobs.drain(jobs.live_counts(logs, "2 hours", "1 hour")), "start", "end").drop("batch")


@query("session_activity_stream", "P4", """SELECT session_id, min(created_at) AS start, max(created_at) + INTERVAL '30' MINUTE AS idle_at, count(*) AS turns FROM turns GROUP BY session_id
    HAVING max(created_at) + INTERVAL '30' MINUTE <= (SELECT max(created_at) FROM turns) - INTERVAL '10' MINUTE""")
def _(t):
    turns = jobs.with_event_time(derived_stream(t, "turns"), "created_at")
    return naive(jobs.drain(jobs.session_activity(turns)), "start", "idle_at").drop("batch")


@query("session_counters_stream", "P7", "SELECT session_id, count(*) AS turn_count, max(created_at) AS updated_at FROM turns GROUP BY session_id")
def _(t):
    out = jobs.drain(jobs.session_counters(derived_stream(t, "turns")), "update")
    return out.groupBy("session_id").agg(F.max_by("turn_count", "batch").alias("turn_count"), F.max_by("updated_at", "batch").alias("updated_at"))


@query("dedup_events_stream", "P6", "SELECT event_id, user_id FROM events")
def _(t):
    twice = jobs.with_event_time(event_stream(t), "ts").withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")
    return jobs.drain(jobs.dedup_events(twice, "event_id")).select("event_id", "user_id")


@query("cooldown_gate_stream", "P2", """
    WITH RECURSIVE g AS (SELECT agent, min(created_at) AS at FROM log_entries GROUP BY agent
      UNION ALL SELECT g.agent, (SELECT min(created_at) FROM log_entries l WHERE l.agent = g.agent AND l.created_at >= g.at + INTERVAL '12' HOUR) FROM g WHERE g.at IS NOT NULL)
    SELECT l.agent, l.id FROM log_entries l JOIN g ON g.agent = l.agent AND g.at = l.created_at QUALIFY row_number() OVER (PARTITION BY l.agent, l.created_at ORDER BY l.id) = 1""")
def _(t):
    logs = derived_stream(t, "log_entries").select("id", "agent", F.col("created_at").cast("timestamp").alias("created_at"))
    return jobs.drain(state.cooldown_gate(logs, 12 * 3600, "agent", "created_at")).select("agent", "id")


@query("access_debounce_stream", "P3", """
    WITH RECURSIVE r AS (SELECT agent, created_at, row_number() OVER (PARTITION BY agent ORDER BY created_at) AS n FROM log_entries),
    f AS (SELECT agent, 1 AS n, 1 AS c, created_at AS l FROM r WHERE n = 1
      UNION ALL SELECT f.agent, f.n + 1, CASE WHEN r.created_at >= f.l + INTERVAL '6' HOUR OR (f.c + 1) % 5 = 0 THEN f.c + 1 ELSE f.c END,
        CASE WHEN r.created_at >= f.l + INTERVAL '6' HOUR OR (f.c + 1) % 5 = 0 THEN r.created_at ELSE f.l END FROM f JOIN r ON r.agent = f.agent AND r.n = f.n + 1)
    SELECT agent, c AS access_count, l AS last_accessed_at FROM f QUALIFY row_number() OVER (PARTITION BY agent ORDER BY n DESC) = 1""")
def _(t):
    reads = derived_stream(t, "log_entries").select("agent", F.col("created_at").cast("timestamp").alias("read_at"))
    out = jobs.drain(state.access_debounce(reads, "agent", "read_at", 6 * 3600), "update")
    last = out.groupBy("agent").agg(F.max_by("access_count", "batch").alias("access_count"), F.max_by("last_accessed_at", "batch").alias("last_accessed_at"))
    return naive(last, "last_accessed_at")


@query("upsert_facts_stream", "P8", f"""
    SELECT vault, fact_key, fact_value, CASE WHEN version < max(version) OVER (PARTITION BY vault, regexp_extract(fact_key, '^(.*)/v[0-9]+/', 1)) THEN 'superseded' ELSE 'active' END AS status,
      {NOW} AS created_at FROM facts""")
def _(t):
    schema = ", ".join(f"{n} {k}" for n, k in FACT_COLUMNS.items())
    base = f"{shared_dir(t.spark).rstrip('/')}/facts-{jobs.uuid.uuid4().hex}"
    table = jobs.VersionedTable(t.spark, f"{base}/table", schema)
    incoming = with_lists(derived_stream(t, "facts_in"))
    batches = jobs.run_batches(incoming, jobs.upsert_facts_batch(table, AS_OF, ["created_at", "event_id"]), f"{base}/checkpoint")
    batches.awaitTermination()
    return table.read(table.last()).select("vault", "fact_key", "fact_value", "status", "created_at")
