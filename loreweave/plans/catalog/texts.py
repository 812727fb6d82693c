"""Chunking, tokenising, parsing and vault content."""

from pyspark.sql import functions as F

from loreweave.functions import text
from loreweave.operators import chunking as ck
from loreweave.operators import lexical as lx
from loreweave.operators import parsing as ps
from loreweave.plans.registry import query
from loreweave.plans.tables import AS_OF

TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
WORDS = "len(regexp_extract_all({0}, '\\S+'))"
EST = f"CAST(trunc({WORDS} * 1.3::DOUBLE) AS INT)"
STOP = "[" + ",".join(f"'{w}'" for w in text.STOPWORDS) + "]"
TOKENS = ("list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), "
          f"lambda w: strlen(w) >= 2 AND NOT list_contains({STOP}, w))")
CHUNK_ID = ("(SELECT concat(substr(h,1,8),'-',substr(h,9,4),'-4',substr(h,14,3),'-',"
            "translate(substr(h,17,1),'0123456789abcdef','89ab89ab89ab89ab'),substr(h,18,3),'-',substr(h,21,12)) FROM (SELECT sha256(concat({0}, ':', {1})) AS h))")


def headed(t):
    """Documents whose lines are headings of level two or four."""
    return t.documents.select("doc_id", F.concat(F.lit("d/"), "doc_id", F.lit(".md")).alias("path"),
                              F.regexp_replace(F.regexp_replace("text", "\n([A-M])", "\n## $1"), "\n([N-Z])", "\n#### $1").alias("text"))


HEADED = "(SELECT doc_id, regexp_replace(regexp_replace(text, '\\n([A-M])', chr(10) || '## \\1', 'g'), '\\n([N-Z])', chr(10) || '#### \\1', 'g') AS text FROM documents)"


@query("chunk_markdown", "C1", f"""
    SELECT doc_id, header, text, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index FROM (
      SELECT doc_id, i, {TRIM.format('part')} AS text, CASE WHEN starts_with(part, '## ') THEN {TRIM.format("string_split(part, chr(10))[1]")} ELSE '' END AS header
      FROM (SELECT doc_id, unnest(string_split(replace(text, chr(10) || '## ', chr(10) || chr(1) || '## '), chr(1))) AS part,
        generate_subscripts(string_split(replace(text, chr(10) || '## ', chr(10) || chr(1) || '## '), chr(1)), 1) AS i FROM {HEADED})) WHERE text <> ''""")
def _(t):
    return ck.chunk_documents(headed(t), max_tokens=0).select("doc_id", "header", "text", "chunk_index")


@query("chunk_plain", "C2,C8,C5", f"""
    SELECT doc_id, chunk_index, text, {CHUNK_ID.format("concat('doc/', doc_id)", "chunk_index")} AS chunk_id, left(text, 200) AS first_paragraph FROM (
      SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index FROM (
        SELECT doc_id, {TRIM.format('part')} AS text, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS part,
          generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) WHERE text <> '')""")
def _(t):
    docs = t.documents.select("doc_id", F.concat(F.lit("doc/"), "doc_id").alias("path"), "text")
    out = ck.chunk_documents(docs, max_tokens=0, mode="plain", separator="\n")
    return out.select("doc_id", "chunk_index", "text", "chunk_id", "first_paragraph")


@query("enforce_max_tokens", "C3", f"""
    WITH RECURSIVE d AS (SELECT doc_id, {TRIM.format('text')} AS text FROM documents),
    p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\\.[ \\n]', '.' || chr(1), 'g'), chr(1)), lambda x: {TRIM.format('x')}),
        lambda x: x <> '') AS parts, len(list_filter(string_split(regexp_replace(text, '\\.[ \\n]', '.' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS n, text FROM d),
    pack AS (
      SELECT doc_id, 1 AS i, parts[1] AS part, {WORDS.format('parts[1]')} AS words, 0 AS chunk, parts FROM p WHERE {EST.format('text')} > 60 AND n > 1
      UNION ALL
      SELECT doc_id, i + 1, parts[i + 1],
        CASE WHEN trunc(words * 1.3::DOUBLE) + trunc({WORDS.format('parts[i + 1]')} * 1.3::DOUBLE) > 60 THEN {WORDS.format('parts[i + 1]')} ELSE words + {WORDS.format('parts[i + 1]')} END,
        CASE WHEN trunc(words * 1.3::DOUBLE) + trunc({WORDS.format('parts[i + 1]')} * 1.3::DOUBLE) > 60 THEN chunk + 1 ELSE chunk END, parts
      FROM pack WHERE i < len(parts))
    SELECT doc_id, chunk AS chunk_index, string_agg(part, ' ' ORDER BY i) AS text FROM pack GROUP BY doc_id, chunk
    UNION ALL SELECT doc_id, 0, text FROM d WHERE {EST.format('text')} <= 60 AND text <> ''
    UNION ALL SELECT doc_id, CAST(i AS INT), array_to_string(w[i * 46 + 1 : i * 46 + 46], ' ') FROM (
      SELECT doc_id, w, unnest(range(0, (len(w) + 45) // 46)) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w
        FROM p WHERE {EST.format('text')} > 60 AND n <= 1))""")
def _(t):
    docs = t.documents.select("doc_id", F.concat(F.lit("doc/"), "doc_id").alias("path"), "text")
    out = ck.chunk_documents(docs, max_tokens=60, mode="plain")
    return out.select("doc_id", "chunk_index", "text")


@query("split_sentences", "C4", """
    SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '\\.[ \\n]', '.' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS n,
      array_to_string(string_split(regexp_replace(text, '\\.[ \\n]', '.' || chr(1), 'g'), chr(1)), chr(1)) AS sentences FROM documents""")
def _(t):
    s = text.sentences(F.col("text"))
    return t.documents.select("doc_id", F.size(F.filter(s, lambda x: x != "")).cast("long").alias("n"), F.array_join(s, "\x01").alias("sentences"))


@query("est_tokens", "C6", f"SELECT doc_id, {EST.format('text')} AS tokens FROM documents")
def _(t):
    return t.documents.select("doc_id", text.est_tokens(F.col("text")).alias("tokens"))


@query("extract_links", "C7", """
    SELECT doc_id, concat('doc/', (doc_id * 7) % 1000, '.md') AS link, 0 AS pos FROM documents
    UNION ALL SELECT doc_id, concat((doc_id + 5) % 1000), 1 FROM documents
    UNION ALL SELECT doc_id, concat('doc/', (doc_id * 3) % 1000, '.md'), 2 FROM documents WHERE (doc_id * 7) % 1000 <> (doc_id * 3) % 1000""")
def _(t):
    return t.linked_docs.select("doc_id", F.posexplode(text.extract_links(F.col("text"))).alias("pos", "link"))


@query("tokenize", "C9", f"SELECT doc_id, array_to_string({TOKENS.format('text')}, ' ') AS tokens FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(text.tokens(F.col("text")), " ").alias("tokens"))


POSTINGS = f"(SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY ALL)"


@query("postings", "C11", f"SELECT doc_id, term, tf FROM {POSTINGS}")
def _(t):
    return lx.postings(t.documents, "doc_id").select("doc_id", "term", "tf")


@query("term_stats", "C11", f"SELECT term, count(*) AS df FROM {POSTINGS} GROUP BY term")
def _(t):
    return lx.term_stats(lx.postings(t.documents, "doc_id"))


@query("collection_stats", "C11", f"SELECT count(*) AS n_docs, round(avg(len({TOKENS.format('text')})), 6) AS avg_len FROM documents")
def _(t):
    return lx.collection_stats(t.documents).select("n_docs", F.round("avg_len", 6).alias("avg_len"))


@query("sparse_encode", "C10", f"""
    WITH p AS {POSTINGS}, w AS (SELECT doc_id, p.term, tf * (1 + ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (df + 1))) AS w
      FROM p JOIN (SELECT term, count(*) AS df FROM p GROUP BY term) d ON d.term = p.term)
    SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def _(t):
    out = lx.sparse_encode(t.documents, lx.postings(t.documents, "doc_id"), "doc_id")
    return out.select("doc_id", "term", F.round("weight", 6).alias("weight"))


def numbered(t):
    """Each document as a bulleted, quoted, numbered list answer."""
    return t.documents.select("doc_id", F.concat(F.lit("1. "), F.regexp_replace("text", "\n", "\n- \""), F.lit("\"\n2) "), F.replace("text", F.lit("e"), F.lit("E"))).alias("answer"))


@query("parse_list_lines", "C12", """
    SELECT doc_id, arg_min(line, i) AS line FROM (
      SELECT doc_id, i, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '^[0-9]{1,3}[.)]\\s*', ''),
        '^[-*•\\s]+', ''), '^["'']+|["'']+$', '', 'g'), '^\\s+|\\s+$', '', 'g') AS line
      FROM (SELECT doc_id, unnest(string_split(a, chr(10))) AS line, generate_subscripts(string_split(a, chr(10)), 1) AS i
        FROM (SELECT doc_id, concat('1. ', replace(text, chr(10), chr(10) || '- "'), '"' || chr(10) || '2) ', replace(text, 'e', 'E')) AS a FROM documents)))
    WHERE line <> '' GROUP BY doc_id, lower(line)""")
def _(t):
    return numbered(t).select("doc_id", F.explode(ps.list_lines(F.col("answer"))).alias("line"))


@query("parse_json_facts", "C13", """
    SELECT event_id, 'k' || event_id AS key, event_type AS value, CAST(event_id % 11 AS DOUBLE) AS confidence, 'event' AS category, CAST(event_id % 90 AS INT) AS ttl_days
    FROM events WHERE event_id % 10 <> 0
    UNION ALL SELECT event_id, 'conversation-summary-' || substr(sha256(props || ' {'), 1, 8), props || ' {', 5, NULL, NULL FROM events WHERE event_id % 10 = 0""")
def _(t):
    answer = F.expr("""CASE WHEN event_id % 10 = 0 THEN concat(props, ' {') ELSE concat('```json\n[{"key":"k', event_id, '","value":"', event_type,
        '","confidence":', event_id % 11, ',"category":"event","ttl_days":', event_id % 90, '}]\n```') END""")
    return ps.json_facts(t.events.select("event_id", answer.alias("answer"))).drop("n")


@query("parse_graph_json", "C14", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN 'c' || o_custkey || '|person;n' || o_orderkey % 50 || '|org' END AS entities,
      CASE WHEN o_orderkey % 7 <> 0 THEN 'c' || o_custkey || '|n' || o_orderkey % 50 || '|uses|f' END AS relations FROM orders""")
def _(t):
    answer = F.expr("""CASE WHEN o_orderkey % 7 = 0 THEN '{"entities":[' ELSE concat('```\n{"entities":[{"name":"c', o_custkey, '","kind":"person"},{"name":"n', o_orderkey % 50,
        '","kind":"org"}],"relations":[{"source":"c', o_custkey, '","target":"n', o_orderkey % 50, '","type":"uses","fact":"f"}]}\n```') END""")
    out = ps.graph_json(t.orders.select("o_orderkey", answer.alias("answer")))
    listed = lambda name, *keys: F.array_join(F.transform(name, lambda x: F.concat_ws("|", *[x[k] for k in keys])), ";").alias(name)
    return out.select("o_orderkey", listed("entities", "name", "kind"), listed("relations", "source", "target", "type", "fact"))


@query("parse_citations", "C15", """
    SELECT answer_id, chunk_id, min(pos) AS pos FROM (SELECT doc_id AS answer_id, concat('c', doc_id % 7) AS chunk_id, 0 AS pos FROM documents
      UNION ALL SELECT doc_id, concat('c', doc_id % 5), 1 FROM documents UNION ALL SELECT doc_id, concat('c', doc_id % 3), 4 FROM documents) GROUP BY ALL""")
def _(t):
    d = t.documents
    body = F.concat("text", F.lit(" [cite: c"), F.col("doc_id") % 7, F.lit(", c"), F.col("doc_id") % 5, F.lit("] and [cite:none, zz, c"), F.col("doc_id") % 3, F.lit("]"))
    context = d.select(F.col("doc_id").alias("answer_id"), F.explode(F.expr("transform(sequence(0, 9), i -> concat('c', i))")).alias("chunk_id"))
    return ps.citations(d.select(F.col("doc_id").alias("answer_id"), body.alias("text")), context)


@query("parse_rank_order", "C16", """
    SELECT event_id, array_to_string(list_filter([a, b, c], lambda x: x >= 1 AND x <= 20), ',') AS positions FROM (
      SELECT event_id, user_id % 25 AS a, CASE WHEN event_id % 25 <> user_id % 25 THEN event_id % 25 END AS b,
        CASE WHEN CAST(floor(value) AS BIGINT) % 25 NOT IN (user_id % 25, event_id % 25) THEN CAST(floor(value) AS BIGINT) % 25 END AS c FROM events)""")
def _(t):
    answer = F.concat(F.lit("["), F.col("user_id") % 25, F.lit("], "), F.col("event_id") % 25, F.lit(".\n x "), F.floor("value") % 25)
    return t.events.select("event_id", F.array_join(ps.rank_order(answer, F.lit(20)), ",").alias("positions"))


CASES = " ".join(f"WHEN regexp_matches(low, '{p}') THEN '{d}'" for p, d in ps.FACT_TRIGGERS)
SAID = """(SELECT session_id, turn_id, content || CASE turn_id % 6 WHEN 0 THEN ' We decided to use store ' || session_id || '. Should we?'
    WHEN 1 THEN ' The plan is to set the limit to ' || turn_id || '!' WHEN 2 THEN chr(10) || 'Please always use tabs here' WHEN 3 THEN ' I prefer it.' ELSE '' END AS content FROM turns)"""


def said(t):
    return t.sql("""SELECT session_id, turn_id, concat(content, CASE turn_id % 6 WHEN 0 THEN concat(' We decided to use store ', session_id, '. Should we?')
        WHEN 1 THEN concat(' The plan is to set the limit to ', turn_id, '!') WHEN 2 THEN concat(chr(10), 'Please always use tabs here') WHEN 3 THEN ' I prefer it.' ELSE '' END) AS content FROM {turns}""")


@query("session_sentence_facts", "C17", f"""
    SELECT fact_key, any_value(value) AS value, any_value(domain) AS domain FROM (
      SELECT value, domain, concat('session-facts/', domain, '/', CASE WHEN slug = '' THEN 'item' ELSE slug END, '-', substr(sha256(value), 1, 8)) AS fact_key FROM (
        SELECT value, domain, left(regexp_replace(regexp_replace(lower(value), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 48) AS slug FROM (
          SELECT CASE WHEN length(value) > 500 THEN left(value, 497) || '...' ELSE value END AS value, CASE {CASES} END AS domain FROM (
            SELECT value, lower(value) AS low FROM (SELECT {TRIM.format("unnest(regexp_split_to_array(regexp_replace(content, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'))")} AS value
              FROM {SAID}) WHERE value <> '' AND NOT contains(value, '?') AND {WORDS.format('value')} >= 4)))
      WHERE domain IS NOT NULL) GROUP BY fact_key""")
def _(t):
    return ps.sentence_facts(said(t)).select("fact_key", "value", "domain")


# ── vault content ─────────────────────────────────────────────────────────────
def chunk_rows(t):
    return t.chunks.select("vault", "source_file", "chunk_index", "text")


@query("ingest_documents", "A4", f"""
    WITH RECURSIVE fresh AS (SELECT doc_id, {TRIM.format("concat('new ', text)")} AS text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND {TRIM.format('text')} <> ''),
    cut AS (SELECT doc_id, text, blank, list_filter(list_transform(parts, lambda x: {TRIM.format('x')}), lambda x: x <> '') AS parts FROM (
      SELECT *, contains(text, chr(10) || chr(10)) AS blank, CASE WHEN contains(text, chr(10) || chr(10))
        THEN string_split(text, chr(10) || chr(10)) ELSE string_split(regexp_replace(text, '\\.[ \\n]', '.' || chr(1), 'g'), chr(1)) END AS parts FROM fresh WHERE {EST.format('text')} > 2000)),
    pack AS (
      SELECT doc_id, 1 AS i, w[1] AS words, 0 AS chunk, w FROM (SELECT doc_id, list_transform(parts, lambda x: {WORDS.format('x')}) AS w FROM cut WHERE len(parts) > 1)
      UNION ALL
      SELECT doc_id, i + 1, CASE WHEN trunc(words * 1.3::DOUBLE) + trunc(w[i + 1] * 1.3::DOUBLE) > 2000 THEN w[i + 1] ELSE words + w[i + 1] END,
        CASE WHEN trunc(words * 1.3::DOUBLE) + trunc(w[i + 1] * 1.3::DOUBLE) > 2000 THEN chunk + 1 ELSE chunk END, w FROM pack WHERE i < len(w)),
    pieces AS (
      SELECT doc_id, 0 AS chunk, text FROM fresh WHERE {EST.format('text')} <= 2000
      UNION ALL SELECT doc_id, chunk, CASE WHEN blank THEN string_agg(part, chr(10) || chr(10) ORDER BY i) ELSE string_agg(part, ' ' ORDER BY i) END
        FROM (SELECT doc_id, blank, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM cut)
        JOIN (SELECT doc_id, i, chunk FROM pack) USING (doc_id, i) GROUP BY doc_id, chunk, blank
      UNION ALL SELECT doc_id, CAST(i AS INT), array_to_string(w[i * 1538 + 1 : i * 1538 + 1538], ' ') FROM (
        SELECT doc_id, w, unnest(range(0, (len(w) + 1537) // 1538)) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM cut WHERE len(parts) <= 1)))
    SELECT vault, source_file, chunk_index, text FROM chunks WHERE source_file NOT IN (SELECT concat('doc/', doc_id, '.md') FROM labels)
    UNION ALL SELECT CASE WHEN doc_id % 2 = 0 THEN 'alpha' ELSE 'beta' END, concat('doc/', doc_id, '.md'), chunk, text FROM pieces""")
def _(t):
    fresh = t.documents.join(t.labels.select("doc_id").distinct(), "doc_id", "left_semi").select(
        F.when(F.col("doc_id") % 2 == 0, "alpha").otherwise("beta").alias("vault"),
        F.concat(F.lit("doc/"), "doc_id", F.lit(".md")).alias("path"), F.concat(F.lit("new "), "text").alias("text"))
    return ck.ingest_documents(chunk_rows(t), fresh, AS_OF).select("vault", "source_file", "chunk_index", "text")


LINES = "(SELECT session_id, turn_id, role || ': ' || content AS line FROM turns WHERE content <> '')"


@query("ingest_sessions", "A5", f"""
    SELECT CASE WHEN part = 0 THEN 'sessions/batch/' || session_id ELSE 'sessions/batch/' || session_id || '/' || part END AS source_file, 0 AS chunk_index,
      {TRIM.format("string_agg(line, chr(10) ORDER BY turn_id)")} AS text
    FROM (SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY turn_id) - 1) // 4 AS part FROM {LINES}) GROUP BY session_id, part""")
def _(t):
    return ck.ingest_sessions(t.turns, "alpha", max_tokens=0, segment_turns=4).select("source_file", "chunk_index", "text")


@query("index_turns", "A6", f"""
    SELECT 'session:' || session_id || '/turn:' || turn_id AS source_file, 0 AS chunk_index, {TRIM.format("role || ': ' || content")} AS text,
      CAST(turn_id AS VARCHAR) AS turn_index, 'session' AS tag FROM turns""")
def _(t):
    out = ck.index_turns(t.turns, "alpha", max_tokens=0)
    return out.select("source_file", "chunk_index", "text", F.col("meta")["turn_index"].alias("turn_index"), F.col("tags")[0].alias("tag"))


@query("delete_chunks", "A20", """SELECT vault, source_file, chunk_index FROM chunks c
    WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.vault = c.vault AND f.source = c.source_file)""")
def _(t):
    sources = t.facts.select("vault", F.col("source").alias("source_file"))
    return ck.delete_chunks(t.chunks, sources).select("vault", "source_file", "chunk_index")


@query("merge_vaults", "A18", """
    SELECT 'beta' AS vault, concat('id', doc_id // 3) AS chunk_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id // 3 ORDER BY vault = 'alpha' DESC, doc_id) AS r FROM chunks) WHERE r = 1""")
def _(t):
    rows = t.chunks.select("vault", F.concat(F.lit("id"), F.floor(F.col("doc_id") / 3)).alias("chunk_id"), "doc_id")
    lowest = rows.groupBy("vault", "chunk_id").agg(F.min("doc_id").alias("doc_id"))
    return ck.merge_vaults(lowest, "alpha", "beta")


@query("clear_vault", "A19", """SELECT 'chunks' AS "table", count(*) AS removed FROM chunks WHERE vault = 'alpha'
    UNION ALL SELECT 'facts', count(*) FROM facts WHERE vault = 'alpha' UNION ALL SELECT 'sessions', count(*) FROM sessions WHERE vault = 'alpha'""")
def _(t):
    return ck.clear_report("alpha", chunks=t.chunks, facts=t.facts, sessions=t.sessions)


@query("clear_vault_rows", "A19", "SELECT vault, fact_key FROM facts WHERE vault <> 'alpha'")
def _(t):
    return ck.clear_vault(t.facts, "alpha").select("vault", "fact_key")


@query("archive_vault", "A19", "SELECT vault, count(*) AS n, vault = 'beta' AS archived FROM facts GROUP BY vault")
def _(t):
    vaults = t.facts.groupBy("vault").agg(F.count(F.lit(1)).alias("n"))
    return ck.archive_vault(vaults, "beta")
