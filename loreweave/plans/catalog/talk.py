"""Sessions, turns, gates, procedures and consolidation."""

from pyspark.sql import functions as F

from loreweave.operators import gates
from loreweave.operators import parsing as ps
from loreweave.operators import procedures as pr
from loreweave.operators import sessions as ss
from loreweave.plans.catalog.recall import cos
from loreweave.plans.catalog.listing import NOW
from loreweave.plans.catalog.texts import TRIM, WORDS
from loreweave.plans.registry import query
from loreweave.plans.tables import AS_OF


@query("last_n_turns", "W1", "SELECT session_id, turn_id, content FROM turns QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn_id DESC) <= 3")
def _(t):
    return ss.last_n_turns(t.turns, 3).select("session_id", "turn_id", "content")


LINE = f"(CASE WHEN role = 'assistant' THEN 'Assistant' ELSE 'User' END) || ': ' || {TRIM.format('content')} || chr(10)"


@query("context_window", "W2", f"""
    SELECT session_id, turn_id, coalesce(string_agg(line, '') OVER (PARTITION BY session_id ORDER BY turn_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '')
      || 'Current turn:' || chr(10) || content AS context
    FROM (SELECT *, CASE WHEN role <> 'system' AND NOT (role = 'assistant' AND strlen({TRIM.format('content')}) < 200) THEN {LINE} ELSE '' END AS line FROM turns)""")
def _(t):
    return ss.context_windows(t.turns, 3, min_assistant=200).select("session_id", "turn_id", "context")


@query("valid_turns", "F11", "SELECT session_id, turn_id, session_id IN (SELECT session_id FROM sessions WHERE NOT archived) AS known FROM turns")
def _(t):
    good, bad = ss.known_turns(t.turns, t.sessions.filter("not archived"))
    return good.withColumn("known", F.lit(True)).unionByName(bad.withColumn("known", F.lit(False))).select("session_id", "turn_id", "known")


@query("session_counters", "P7", "SELECT session_id, count(*) AS turn_count, max(created_at) AS updated_at FROM turns GROUP BY session_id")
def _(t):
    return ss.session_counters(t.turns)


@query("idle_sessions", "P4", "SELECT vault, max(updated_at) AS newest, max(updated_at) <= TIMESTAMP '2024-01-05 04:00:00' - INTERVAL '30' MINUTE AS idle FROM sessions GROUP BY vault")
def _(t):
    return ss.idle_vaults(t.sessions, "2024-01-05 04:00:00")


@query("newest_update", "W9", """SELECT vault, max(created_at) AS newest, arg_max(fact_key, (created_at, fact_key)) AS newest_key, min(created_at) AS oldest,
    arg_min(fact_key, (created_at, fact_key)) AS oldest_key FROM facts GROUP BY vault""")
def _(t):
    return ss.newest_update(t.facts, "vault", "fact_key", "created_at")


@query("first_per_key", "W8", "SELECT agent, type, min(id) AS id FROM log_entries GROUP BY agent, type")
def _(t):
    from loreweave import skew

    return skew.first_per_key(t.log_entries, ["agent", "type"], [F.col("id")]).select("agent", "type", "id")


IMP = f"turn_count + 1 / (1 + greatest((epoch_us({NOW}) - epoch_us(updated_at)) / CAST(86400000000 AS DOUBLE), 0))"
REPLAY = f"""(WITH pool AS (SELECT *, row_number() OVER (PARTITION BY vault ORDER BY updated_at DESC, session_id) AS recency, {IMP} AS importance FROM sessions QUALIFY recency <= 80)
    SELECT vault, session_id, recency AS slot FROM pool WHERE recency <= 14
    UNION ALL SELECT vault, session_id, 14 + row_number() OVER (PARTITION BY vault ORDER BY importance DESC, recency) FROM pool WHERE recency > 14
      QUALIFY row_number() OVER (PARTITION BY vault ORDER BY importance DESC, recency) <= 6)"""


@query("replay_schedule", "W4", REPLAY)
def _(t):
    return ss.replay_schedule(t.sessions, AS_OF).select("vault", "session_id", "slot")


# Only vaults silent for half an hour are consolidated.
IDLE = f"(SELECT vault FROM sessions GROUP BY vault HAVING epoch_us({NOW}) - epoch_us(max(updated_at)) >= 30 * 60000000)"


@query("consolidate", "L21", f"""
    SELECT r.vault, r.session_id, r.slot, x.transcript FROM (SELECT * FROM {REPLAY} WHERE vault IN {IDLE}) r JOIN (
      SELECT session_id, string_agg(role || ': ' || {TRIM.format('content')} || chr(10), '' ORDER BY turn_id) AS transcript FROM (
        SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_id DESC) AS back FROM turns) WHERE back <= 50 GROUP BY session_id) x ON x.session_id = r.session_id""")
def _(t):
    return ss.consolidation_batch(t.sessions, t.turns, AS_OF)


@query("gist_facts", "L21", f"""SELECT vault, 'gist:' || session_id AS fact_key, 'agent ' || agent_id AS fact_value, 365 AS ttl_days, {NOW} + INTERVAL '365' DAY AS expires_at, 0.7::DOUBLE AS confidence, 'gist' AS category, session_id FROM sessions""")
def _(t):
    gists = t.sessions.select("vault", "session_id", F.concat(F.lit(" agent "), "agent_id", F.lit("\n")).alias("gist"))
    return ss.gist_facts(gists, AS_OF).select("vault", "fact_key", "fact_value", "ttl_days", "expires_at", "confidence", "category", "session_id")


def _topics(user):
    cases = ", ".join(f"CASE WHEN t{i} IS NOT NULL AND (r{i} = 'user') = {user} THEN {{'t': t{i}, 'i': {i}, 'w': '{w}'}} END" for i, w in enumerate(ss.TOPIC_WORDS))
    return f"array_to_string(list_transform(list_sort(list_filter([{cases}], lambda h: h IS NOT NULL)), lambda h: h.w), ', ')"


SEEN = ", ".join(f"min(turn_id) FILTER (contains(lower(content), '{w}')) AS t{i}, arg_min(role, turn_id) FILTER (contains(lower(content), '{w}')) AS r{i}" for i, w in enumerate(ss.TOPIC_WORDS))
DECIDED = "(" + " OR ".join(f"contains(lower(content), '{p}')" for p in ss.DECISION_PHRASES) + ")"


@query("finalize_sessions", "L18", f"""
    SELECT vault, 'session/' || session_id || '/summary' AS fact_key, 'Session Summary' || chr(10) || 'Session: ' || session_id || chr(10) || 'Agent: ' || agent_id || chr(10) || 'Turns: ' || n || chr(10)
      || CASE WHEN u <> '' THEN 'User topics: ' || u || chr(10) ELSE '' END || CASE WHEN k <> '' THEN 'Key aspects: ' || k || chr(10) ELSE '' END || 'First topic: ' || left(first, 200) || chr(10) AS fact_value, 0.7::DOUBLE AS confidence
    FROM (SELECT s.*, {_topics('true')} AS u, {_topics('false')} AS k, p.n, p.first FROM sessions s JOIN (SELECT session_id, count(*) AS n, arg_min(content, turn_id) AS first, {SEEN} FROM dialogue GROUP BY session_id) p ON p.session_id = s.session_id)
    UNION ALL SELECT DISTINCT vault, 'house/decision/' || regexp_replace(replace(lower(left(content, 48)), ' ', '-'), '[.,:''"]', '', 'g') || '-' || substr(sha256(content), 1, 8), content, 0.6
    FROM (SELECT vault, CASE WHEN length(content) > 500 THEN left(content, 497) || '...' ELSE content END AS content FROM dialogue d JOIN sessions s ON s.session_id = d.session_id WHERE role = 'assistant' AND {DECIDED})""")
def _(t):
    return ss.finalize(t.sessions, t.dialogue).select("vault", "fact_key", "fact_value", "confidence")


@query("finalized_sessions", "L18", f"SELECT session_id, CASE WHEN session_id IN (SELECT session_id FROM turns WHERE turn_id % 2 = 1) THEN {NOW} END AS finalized_at FROM sessions")
def _(t):
    return ss.mark_finalized(t.sessions, t.turns.filter("turn_id % 2 = 1"), AS_OF).select("session_id", "finalized_at")


@query("cooldown_gate", "P2", """
    WITH RECURSIVE g AS (SELECT agent, min(created_at) AS at FROM log_entries GROUP BY agent
      UNION ALL SELECT g.agent, (SELECT min(created_at) FROM log_entries l WHERE l.agent = g.agent AND l.created_at >= g.at + INTERVAL '12' HOUR) FROM g WHERE g.at IS NOT NULL)
    SELECT l.agent, l.id FROM log_entries l JOIN g ON g.agent = l.agent AND g.at = l.created_at
    QUALIFY row_number() OVER (PARTITION BY l.agent, l.created_at ORDER BY l.id) = 1""")
def _(t):
    return gates.cooldown_gate(t.log_entries, 12 * 3600, "agent", "created_at", ("id",)).select("agent", "id")


READS = "(SELECT vault || '|' || fact_key AS fact_id, event_id AS read_id, created_at + INTERVAL '1' HOUR * 18 AS read_at FROM facts_in)"
BASE = "(SELECT vault || '|' || fact_key AS fact_id, access_count, last_accessed_at, last_recalled_at FROM facts)"


@query("apply_access", "L14,P3", f"""
    WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY read_at, read_id) AS n FROM {READS}),
    f AS (SELECT fact_id, 0 AS n, access_count AS c, last_accessed_at AS l FROM {BASE}
      UNION ALL SELECT f.fact_id, f.n + 1,
        CASE WHEN f.l IS NULL OR r.read_at >= f.l + INTERVAL '60' HOUR OR (f.c + 1) % 5 = 0 THEN f.c + 1 ELSE f.c END,
        CASE WHEN f.l IS NULL OR r.read_at >= f.l + INTERVAL '60' HOUR OR (f.c + 1) % 5 = 0 THEN r.read_at ELSE f.l END FROM f JOIN r ON r.fact_id = f.fact_id AND r.n = f.n + 1)
    SELECT f.fact_id, c AS access_count, l AS last_accessed_at, CASE WHEN c > b.access_count THEN l ELSE b.last_recalled_at END AS last_recalled_at
    FROM f JOIN {BASE} b ON b.fact_id = f.fact_id QUALIFY row_number() OVER (PARTITION BY f.fact_id ORDER BY n DESC) = 1""")
def _(t):
    fact_id = F.concat("vault", F.lit("|"), "fact_key").alias("fact_id")
    facts = t.facts.select(fact_id, "access_count", "last_accessed_at", "last_recalled_at")
    reads = t.facts_in.select(fact_id, F.col("event_id").alias("read_id"), (F.col("created_at") + F.expr("INTERVAL '18' HOUR")).alias("read_at"))
    return gates.apply_access(facts, reads, 60 * 3600, 5, "fact_id", reconsolidation=True)


# ── procedures ────────────────────────────────────────────────────────────────
def pattern(words):
    return "|".join(w.replace(".", "\\.") for w in words)


ACTIONS = f"""(SELECT *, sum(CASE WHEN gap IS NULL OR gap > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY pos) AS run FROM (
    SELECT *, pos - lag(pos) OVER (PARTITION BY session_id ORDER BY pos) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_id) AS pos FROM dialogue)
    WHERE role = 'assistant' AND regexp_matches(lower(content), '{pattern(pr.STEP_MARKS + pr.ACTION_WORDS)}')))"""
RUNS = f"(SELECT session_id, run, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n_actions FROM {ACTIONS} GROUP BY session_id, run)"
OUTCOME = f"""(SELECT r.*, coalesce(bool_or(good) AND NOT bool_or(bad), false) AS success FROM {RUNS} r LEFT JOIN (
    SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY turn_id) AS pos, role, regexp_matches(lower(content), '{pattern(pr.POSITIVE)}') AS good,
      regexp_matches(lower(content), '{pattern(pr.NEGATIVE)}') AS bad FROM dialogue) d
    ON d.session_id = r.session_id AND d.pos BETWEEN last_pos + 1 AND last_pos + 2 AND role IN ('user', 'system') GROUP BY ALL)"""


@query("action_runs", "W5", RUNS)
def _(t):
    return pr.action_runs(pr.action_turns(pr.marked_turns(t.dialogue)))


@query("positive_outcome", "W6", f"SELECT session_id, run, success FROM {OUTCOME}")
def _(t):
    marked = pr.marked_turns(t.dialogue)
    return pr.with_outcome(pr.action_runs(pr.action_turns(marked)), marked).select("session_id", "run", "success")


STEP = f"""coalesce(list_filter(L, lambda x: NOT starts_with(x, '#') AND NOT starts_with(x, '//') AND length(x) > 5 AND length(x) < 200)[1],
    list_filter(L, lambda x: length(x) > 5)[1], CASE WHEN length(content) > 200 THEN left(content, 200) || '...' ELSE content END)"""
STEPS = f"(SELECT session_id, run, pos, {STEP} AS step FROM (SELECT *, list_transform(string_split(content, chr(10)), lambda x: {TRIM.format('x')}) AS L FROM {ACTIONS}))"


@query("procedure_steps", "L19", f"SELECT session_id, run, pos, step FROM {STEPS} WHERE step <> ''")
def _(t):
    return pr.procedure_steps(pr.marked_turns(t.dialogue))


def _summary(step):
    words = f"list_filter(regexp_split_to_array(regexp_replace({step}, '^`+|`+$', '', 'g'), '\\s+'), lambda w: w <> '')"
    return f"""(SELECT CASE WHEN length(s) > 60 THEN left(s, 60) || '...' ELSE s END FROM (SELECT CASE WHEN h IS NULL THEN array_to_string(W[1:5], ' ') ELSE array_to_string(W[h:h+3], ' ') END AS s
      FROM (SELECT W, list_filter(range(1, len(W)), lambda i: regexp_matches(lower(W[i]), '{pattern(pr.ACTION_WORDS)}'))[1] AS h FROM (SELECT {words} AS W))))"""


@query("procedures", "L19", f"""
    SELECT 'procedure-' || substr(sha256(name || chr(0) || trig), 1, 12) AS key, name, trig AS trigger, session_id, run, n_steps FROM (
      SELECT session_id, run, n_steps, one || CASE WHEN two <> one THEN ' and ' || lower(left(two, 30)) ELSE '' END AS name,
        CASE WHEN coalesce(trig, '') = '' THEN 'Agent initiated action sequence' ELSE trig END AS trig FROM (
        SELECT r.session_id, r.run, s.n_steps, {_summary('s.one')} AS one, {_summary('s.two')} AS two, b.trig
        FROM {OUTCOME} r JOIN (SELECT session_id, run, count(*) AS n_steps, arg_min(step, pos) AS one, min(struct_pack(pos := pos, step := step)) FILTER (no = 2) ['step'] AS two
            FROM (SELECT *, row_number() OVER (PARTITION BY session_id, run ORDER BY pos) AS no FROM {STEPS} WHERE step <> '') GROUP BY session_id, run) s
          ON s.session_id = r.session_id AND s.run = r.run
        LEFT JOIN (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY turn_id) + 1 AS first_pos,
            coalesce(list_filter(list_transform(string_split(content, chr(10)), lambda x: {TRIM.format('x')}), lambda x: length(x) > 10 AND length(x) < 200)[1],
              CASE WHEN length(content) > 200 THEN left(content, 200) || '...' ELSE content END) AS trig FROM dialogue) b
          ON b.session_id = r.session_id AND b.first_pos = r.first_pos
        WHERE r.success AND r.n_actions >= 3 AND s.n_steps >= 3))""")
def _(t):
    return pr.procedures(t.dialogue).select("key", "name", "trigger", "session_id", "run", "n_steps")


def names(t):
    """Step texts as procedure names: the first words of each turn with an action word."""
    rows = t.dialogue.filter("role = 'assistant'").select(
        "session_id", "turn_id", F.concat(F.lit("Check "), F.array_join(F.slice(F.split("content", r"\s+"), 1, 4), " ")).alias("name"))
    return rows.withColumn("key", F.concat("session_id", F.lit("/"), "turn_id")).withColumn("trigger", F.lit("t"))


NAMES = "(SELECT session_id || '/' || turn_id AS key, 'Check ' || array_to_string(regexp_split_to_array(content, '\\s+')[1:4], ' ') AS name, turn_id FROM dialogue WHERE role = 'assistant')"
SIM = """(CASE WHEN a = b THEN 1::DOUBLE ELSE least(1, 0.6::DOUBLE * i / (len(wa) + len(wb) - i) + 0.4::DOUBLE * 2 * g / (len(ga) + len(gb)) + CASE WHEN va = vb THEN 0.15::DOUBLE ELSE 0 END) END)"""


def _verb(w):
    kw = "[" + ",".join(f"'{k}'" for k in pr.ACTION_WORDS) + "]"
    return f"list_filter({w}, lambda x: list_contains({kw}, x))[1]"


@query("dedup_procedures", "L20", f"""
    WITH n AS (SELECT DISTINCT lower({TRIM.format('name')}) AS a FROM {NAMES} WHERE turn_id >= 3), o AS (SELECT lower({TRIM.format('name')}) AS b, min(key) AS k FROM {NAMES} WHERE turn_id < 3 GROUP BY 1),
    x AS (SELECT a, b, k, regexp_split_to_array(a, '\\s+') AS wa, regexp_split_to_array(b, '\\s+') AS wb, list_transform(range(1, length(a)), lambda i: substr(a, i, 2)) AS ga,
        list_transform(range(1, length(b)), lambda i: substr(b, i, 2)) AS gb FROM n, o),
    y AS (SELECT *, len(list_filter(wb, lambda w: list_contains(wa, w))) AS i, coalesce(list_sum(list_transform(list_distinct(list_intersect(ga, gb)),
        lambda q: least(len(list_filter(ga, lambda z: z = q)), len(list_filter(gb, lambda z: z = q))))), 0) AS g, {_verb('wa')} AS va, {_verb('wb')} AS vb FROM x),
    s AS (SELECT a, k, round({SIM}, 6) AS similarity FROM y)
    SELECT m.key, best.similarity, best.k AS existing_key, CASE WHEN best.k IS NULL THEN 'create' ELSE 'update' END AS decision
    FROM (SELECT key, lower({TRIM.format('name')}) AS a FROM {NAMES} WHERE turn_id >= 3) m
    LEFT JOIN (SELECT a, max(similarity) AS similarity, arg_max(k, (similarity, k)) AS k FROM s WHERE similarity >= 0.7 GROUP BY a) best ON best.a = m.a""")
def _(t):
    all_ = names(t)
    out = pr.dedup_procedures(all_.filter("turn_id >= 3"), all_.filter("turn_id < 3"), 0.7)
    return out.select("key", "similarity", "existing_key", "decision")


# ── facts from sessions ───────────────────────────────────────────────────────
@query("extract_facts", "L16", f"""
    SELECT event_id, 'session:s' || user_id AS source, least(confidence, 0.85) AS confidence, CASE WHEN decision = 'supersede' THEN fact_key ELSE '' END AS supersedes,
      CASE WHEN ttl_days > 0 THEN {NOW} + INTERVAL '1' DAY * ttl_days END AS expires_at FROM (
      SELECT n.event_id, n.fact_key, n.confidence, n.ttl_days, n.user_id, CASE WHEN {cos('n.embedding', 'o.embedding')} >= 0.2 THEN 'skip'
        WHEN o.fact_key IS NOT NULL AND o.status = 'active' THEN 'supersede' ELSE 'write' END AS decision
      FROM (SELECT i.*, v.user_id, e.embedding FROM facts_in i JOIN events v ON v.event_id = i.event_id JOIN incoming_vectors e ON e.event_id = i.event_id) n
      LEFT JOIN fact_vectors o ON o.vault = n.vault AND o.fact_key = n.fact_key) WHERE decision <> 'skip'""")
def _(t):
    users = t.events.select("event_id", F.concat(F.lit("s"), "user_id").alias("session_id"))
    parsed = t.facts_in.join(users, "event_id").join(t.incoming_vectors, "event_id").select(
        "vault", "event_id", "session_id", "fact_key", F.concat("fact_value", F.lit("#"), "event_id").alias("value"), "confidence",
        F.lit("event").alias("category"), "ttl_days", "embedding")
    out = ss.extracted_facts(parsed, t.fact_vectors, AS_OF, threshold=0.2)
    return out.select(F.split_part("fact_value", F.lit("#"), F.lit(-1)).cast("long").alias("event_id"), "source", "confidence", "supersedes", "expires_at")


@query("conversation_facts", "L17", f"""
    SELECT event_id AS conversation_id, CASE WHEN event_id % 3 = 0 THEN 'conv-' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 8) || '-0' ELSE 'k' || event_id END AS fact_key, event_type AS fact_value,
      least(CAST(event_id % 11 AS DOUBLE) / 10, 0.85) AS confidence, 'needs_review' AS status, CASE WHEN event_id % 90 > 0 THEN {NOW} + INTERVAL '1' DAY * CAST(event_id % 90 AS INT) END AS expires_at FROM events""")
def _(t):
    answer = F.expr("""concat('[{"key":"', CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('k', event_id) END, '","value":"', event_type, '","confidence":', event_id % 11,
        ',"category":"event","ttl_days":', event_id % 90, '}]')""")
    parsed = ps.json_facts(t.events.select(F.col("event_id").alias("conversation_id"), answer.alias("answer")))
    return ss.conversation_facts(parsed, AS_OF).select("conversation_id", "fact_key", "fact_value", "confidence", "status", "expires_at")
