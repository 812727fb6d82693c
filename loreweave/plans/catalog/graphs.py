"""Links, traversal, the temporal graph, as-of joins, routing, communities."""

from pyspark.sql import functions as F

from loreweave.functions import text
from loreweave.operators import communities as cm
from loreweave.operators import graph as gr
from loreweave.operators import links as lk
from loreweave.plans.catalog.listing import NOW
from loreweave.plans.catalog.texts import TRIM
from loreweave.plans.registry import query
from loreweave.plans.tables import AS_OF

PATHS = "(SELECT path FROM files UNION SELECT 'notes/' || p_partkey || '_' || lower(replace(split_part(p_name, ' ', 1), ' ', '-')) || '.txt' AS path FROM part)"


def paths(t):
    return t.sql("""SELECT path FROM {files} UNION SELECT concat('notes/', p_partkey, '_', lower(split_part(p_name, ' ', 1)), '.txt') AS path FROM {part}""")


TARGETS = """(SELECT DISTINCT target FROM (SELECT 'doc/' || doc_id || '.md' AS target FROM documents UNION SELECT 'doc/' || doc_id FROM documents UNION SELECT concat(doc_id) FROM documents
    UNION SELECT 'x/' || doc_id || '-' || source || '.md' FROM documents UNION SELECT lower(split_part(p_name, ' ', 1)) || '.txt' FROM part UNION SELECT p_partkey || ' ' || lower(split_part(p_name, ' ', 1)) FROM part))"""
STEM = "regexp_replace(regexp_extract({0}, '[^/]*$'), '\\.[^.]*$', '')"
SPACED = "lower(translate({0}, '-_', '  '))"


@query("resolve_wikilinks", "F5", f"""
    SELECT target, path, rule FROM (SELECT target, rule, path, row_number() OVER (PARTITION BY target ORDER BY rule, path) AS r FROM (
      SELECT t.target, p.path, CASE WHEN p.path = t.target THEN 1 WHEN p.path = t.target || '.md' AND NOT ends_with(t.target, '.md') THEN 2
        WHEN lower(ps) IN (lower(ts), lower(replace(ts, '-', ' ')), lower(replace(ts, '_', ' '))) THEN 3 WHEN ends_with(p.path, t.target) THEN 4 WHEN {SPACED.format('ps')} = {SPACED.format('ts')} THEN 5 END AS rule
      FROM (SELECT target, {STEM.format('target')} AS ts FROM {TARGETS}) t, (SELECT path, {STEM.format('path')} AS ps FROM {PATHS}) p) WHERE rule IS NOT NULL) WHERE r = 1""")
def _(t):
    d, p = t.documents, t.part
    word = F.lower(F.split_part("p_name", F.lit(" "), F.lit(1)))
    targets = (
        d.select(F.concat(F.lit("doc/"), "doc_id", F.lit(".md")).alias("target")).union(d.select(F.concat(F.lit("doc/"), "doc_id"))).union(d.select(F.col("doc_id").cast("string")))
        .union(d.select(F.concat(F.lit("x/"), "doc_id", F.lit("-"), "source", F.lit(".md")))).union(p.select(F.concat(word, F.lit(".txt"))))
        .union(p.select(F.concat("p_partkey", F.lit(" "), word)))
    )
    return lk.resolve_targets(targets, paths(t))


REFS = """(SELECT d.path AS source_path, p.path AS target_path, i FROM (SELECT d.path, p.path AS p, strpos(d.text, p.path) - 1 AS i, d.text FROM linked_docs d, files p
    WHERE p.path <> d.path AND contains(d.text, p.path)) x JOIN linked_docs d ON d.path = x.path JOIN files p ON p.path = x.p
    WHERE (i = 0 OR contains(' \t\n"''(`', substr(d.text, i, 1))) AND (i + length(p.path) >= length(d.text) OR contains(' \t\n"'').,`}>', substr(d.text, i + length(p.path) + 1, 1))))"""
WIKI = """(SELECT path AS source_path, target_path, min(raw) AS raw FROM (SELECT path, raw, CASE WHEN starts_with(target, 'doc/') THEN target ELSE 'doc/' || target || '.md' END AS target_path
    FROM (SELECT path, unnest(regexp_extract_all(text, '\\[\\[[^\\]|]+(?:\\|[^\\]]+)?\\]\\]')) AS raw, unnest(regexp_extract_all(text, '\\[\\[([^\\]|]+)(?:\\|[^\\]]+)?\\]\\]', 1)) AS target FROM linked_docs))
    WHERE target_path IN (SELECT path FROM files) GROUP BY ALL)"""


@query("path_references", "F6", f"SELECT source_path, target_path FROM {REFS}")
def _(t):
    return lk.path_references(t.linked_docs, t.files).select("source_path", "target_path")


WHOLE = TRIM.format("string_split(substr(text, 1, i), chr(10) || chr(10))[-1] || raw || string_split(substr(text, i + length(raw) + 1), chr(10) || chr(10))[1]")


@query("build_links", "N1", f"""
    SELECT source_path, target_path, link_type, CASE WHEN length(w) <= 200 THEN w WHEN length(s) > 101 THEN s ELSE left(w, 200) END AS context FROM (
      SELECT *, regexp_extract(left(w, 200), '^((?s).*\\.)', 1) AS s FROM (SELECT source_path, target_path, link_type, {WHOLE} AS w FROM (
        SELECT l.*, d.text, strpos(d.text, raw) - 1 AS i FROM (SELECT source_path, target_path, raw, 'wikilink' AS link_type FROM {WIKI}
          UNION ALL SELECT source_path, target_path, target_path, 'path_ref' FROM {REFS}) l JOIN linked_docs d ON d.path = l.source_path)))""")
def _(t):
    return lk.build_links(t.linked_docs, t.files)


@query("replace_links", "N1", """SELECT source_path, target_path FROM links WHERE source_path NOT IN (SELECT concat('p', s_suppkey) FROM supplier)
    UNION ALL SELECT concat('p', s_suppkey), concat('p', s_nationkey) FROM supplier""")
def _(t):
    fresh = t.supplier.select(F.concat(F.lit("p"), "s_suppkey").alias("source_path"), F.concat(F.lit("p"), "s_nationkey").alias("target_path"))
    return lk.replace_links(t.links, fresh, fresh).select("source_path", "target_path")


def vault_files(t):
    return t.supplier.select(F.concat(F.lit("v"), F.col("s_nationkey") % 5).alias("vault"), F.concat(F.lit("p"), "s_suppkey").alias("path"))


@query("outbound_links", "N2", "SELECT vault, source_path, target_path FROM vault_links WHERE (vault, source_path) IN (SELECT (concat('v', s_nationkey % 5), concat('p', s_suppkey)) FROM supplier)")
def _(t):
    return lk.outbound(t.vault_links, vault_files(t)).select("vault", "source_path", "target_path")


@query("backlinks", "N2", "SELECT vault, source_path, target_path FROM vault_links WHERE (vault, target_path) IN (SELECT (concat('v', s_nationkey % 5), concat('p', s_suppkey)) FROM supplier)")
def _(t):
    return lk.backlinks(t.vault_links, vault_files(t)).select("vault", "source_path", "target_path")


WALK = """(WITH RECURSIVE w AS (SELECT DISTINCT concat('v', s_suppkey % 5) AS vault, concat('p', s_nationkey) AS seed, concat('p', s_nationkey) AS node, 0 AS hop FROM supplier
    UNION SELECT w.vault, w.seed, l.target_path, w.hop + 1 FROM w JOIN vault_links l ON l.vault = w.vault AND l.source_path = w.node WHERE w.hop < 6)
    SELECT vault, seed, node, min(hop) AS hop FROM w GROUP BY ALL)"""


def seeds(t):
    return t.supplier.select(F.concat(F.lit("v"), F.col("s_suppkey") % 5).alias("vault"), F.concat(F.lit("p"), "s_nationkey").alias("path")).distinct()


@query("link_graph_nodes", "N3", f"SELECT vault, seed, node, hop FROM {WALK}")
def _(t):
    return lk.link_graph(t.vault_links, seeds(t), 6)[0].select("vault", "seed", "node", "hop")


@query("link_graph_edges", "N3", f"SELECT DISTINCT w.vault, seed, source_path AS source, target_path AS target FROM {WALK} w JOIN vault_links l ON l.vault = w.vault AND l.source_path = w.node WHERE hop < 6")
def _(t):
    return lk.link_graph(t.vault_links, seeds(t), 6)[1].select("vault", "seed", "source", "target")


def linked_chunks(t):
    return t.linked_docs.select(F.col("path").alias("source_file"), "text", text.extract_links(F.col("text")).alias("links_to"))


LINKS_TO = """(SELECT DISTINCT path AS source, 'doc/' || (doc_id * 7) % 1000 || '.md' AS target FROM linked_docs UNION SELECT path, concat((doc_id + 5) % 1000) FROM linked_docs
    UNION SELECT path, 'doc/' || (doc_id * 3) % 1000 || '.md' FROM linked_docs)"""


@query("vault_graph_nodes", "N4", "SELECT 'file:' || path AS id, 'doc / ' || doc_id AS label FROM linked_docs")
def _(t):
    return lk.vault_graph(linked_chunks(t))[0].select("id", "label")


@query("vault_graph_edges", "N4", f"SELECT 'file:' || source AS source, 'file:' || target AS target FROM {LINKS_TO}")
def _(t):
    return lk.vault_graph(linked_chunks(t))[1].select("source", "target")


ENTITY_WALK = f"""(WITH RECURSIVE w AS (SELECT path AS node, 0 AS hop FROM linked_docs WHERE contains(text, 'qui que') UNION SELECT l.target, w.hop + 1 FROM w JOIN {LINKS_TO} l ON l.source = w.node WHERE w.hop < 2)
    SELECT node, min(hop) AS hop FROM w GROUP BY node)"""


@query("entity_graph_nodes", "N5", f"SELECT 'entity:qui que' AS id, 'entity' AS type UNION ALL SELECT 'file:' || node, 'file' FROM {ENTITY_WALK}")
def _(t):
    return lk.entity_graph(linked_chunks(t), "qui que", 2)[0].select("id", "type")


@query("entity_graph_edges", "N5", f"""
    SELECT 'file:' || node AS source, 'entity:qui que' AS target, 'contains' AS relationship FROM {ENTITY_WALK} WHERE hop = 0
    UNION ALL SELECT 'file:' || min(l.source), 'file:' || l.target, 'links_to' FROM {LINKS_TO} l JOIN {ENTITY_WALK} a ON a.node = l.source JOIN {ENTITY_WALK} b ON b.node = l.target AND b.hop = a.hop + 1 GROUP BY l.target""")
def _(t):
    return lk.entity_graph(linked_chunks(t), "qui que", 2)[1]


FORWARD = """(SELECT DISTINCT vault, source, target, link_type FROM (SELECT vault, fact_key AS source, supersedes AS target, 'supersedes' AS link_type FROM facts UNION ALL SELECT vault, fact_key, refines, 'refines' FROM facts
    UNION ALL SELECT vault, fact_key, unnest(string_split(contradicts_csv, ',')), 'contradicts' FROM facts UNION ALL SELECT vault, fact_key, unnest(string_split(supports_csv, ',')), 'supports' FROM facts) WHERE target <> '')"""
BOTH = f"""(SELECT vault, source AS node, source, target, link_type, target AS "to" FROM {FORWARD} UNION ALL SELECT vault, target, source, target, CASE link_type WHEN 'supersedes' THEN 'superseded_by'
    WHEN 'refines' THEN 'refined_by' WHEN 'contradicts' THEN 'contradicted_by' ELSE 'supported_by' END, source FROM {FORWARD})"""
FACT_WALK = f"""(WITH RECURSIVE b AS {BOTH}, w AS (SELECT DISTINCT vault, supersedes AS seed, supersedes AS node, 0 AS hop FROM facts f WHERE EXISTS (SELECT 1 FROM facts k WHERE k.vault = f.vault AND k.fact_key = f.supersedes)
    UNION SELECT w.vault, w.seed, b.to, w.hop + 1 FROM w JOIN b ON b.vault = w.vault AND b.node = w.node WHERE w.hop < 2 AND EXISTS (SELECT 1 FROM facts k WHERE k.vault = w.vault AND k.fact_key = b.to)) SELECT vault, seed, node, min(hop) AS hop FROM w GROUP BY ALL)"""


def fact_walk(t):
    return lk.fact_graph(t.fact_table, t.fact_table.filter("supersedes is not null").select("vault", F.col("supersedes").alias("fact_key")), 2)


@query("fact_graph_nodes", "N6", f"SELECT vault, seed, node, hop FROM {FACT_WALK}")
def _(t):
    return fact_walk(t)[0].select("vault", "seed", "node", "hop")


@query("fact_graph_edges", "N6", f"SELECT DISTINCT w.vault, w.seed, b.source, b.target, b.link_type FROM {FACT_WALK} w JOIN {BOTH} b ON b.vault = w.vault AND b.node = w.node WHERE w.hop < 2")
def _(t):
    return fact_walk(t)[1]


# ── temporal graph ────────────────────────────────────────────────────────────
@query("upsert_entities", "N7", """SELECT vault, kind, arg_min(id, seq) AS id, arg_min(name, seq) AS name, coalesce(arg_max(summary, seq) FILTER (summary <> ''), '') AS summary FROM (
    SELECT 'alpha' AS vault, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE lower(o_orderpriority) END AS name, o_orderstatus AS kind, concat('e', o_orderkey) AS id,
      CASE WHEN o_orderkey % 3 = 0 THEN concat('s', o_custkey) ELSE '' END AS summary, o_orderkey AS seq FROM orders) GROUP BY vault, lower(name), kind""")
def _(t):
    rows = t.sql("""SELECT 'alpha' AS vault, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE lower(o_orderpriority) END AS name, o_orderstatus AS kind, concat('e', o_orderkey) AS id,
      CASE WHEN o_orderkey % 3 = 0 THEN concat('s', o_custkey) ELSE '' END AS summary, o_orderkey AS seq FROM {orders}""")
    return gr.upsert_entities(rows).select("vault", "kind", "id", "name", "summary")


@query("normalize_kinds", "N7", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'org' WHEN 2 THEN 'project' ELSE 'concept' END AS kind,
    CASE WHEN p_partkey % 2 = 0 THEN 'works_on_' || p_partkey ELSE 'is_a' END AS rel FROM part""")
def _(t):
    kind = F.expr("CASE p_partkey % 4 WHEN 0 THEN ' People' WHEN 1 THEN 'Organisation' WHEN 2 THEN 'repo ' ELSE 'Thing' END")
    rel = F.expr("CASE WHEN p_partkey % 2 = 0 THEN concat(' Works-on ', p_partkey, '!') ELSE '_is a_' END")
    return t.part.select("p_partkey", text.normalize_kind(kind).alias("kind"), text.normalize_rel_type(rel).alias("rel"))


CLOSED = """(SELECT id, CASE WHEN nf IS NOT NULL AND invalidated_at IS NULL AND (valid_until IS NULL OR valid_until > nf) THEN nf ELSE valid_until END AS valid_until,
    CASE WHEN nf IS NOT NULL AND invalidated_at IS NULL THEN nc ELSE invalidated_at END AS invalidated_at
    FROM (SELECT *, lead(valid_from) OVER w AS nf, lead(created_at) OVER w AS nc FROM edges_in WINDOW w AS (PARTITION BY vault, source_id, type ORDER BY created_at, seq)))"""


@query("close_intervals", "W7", CLOSED)
def _(t):
    return gr.close_intervals(t.edges_in).select("id", "valid_until", "invalidated_at")


@query("add_edges", "N8", f"""SELECT e.id, CASE WHEN e.type IN ('1-URGENT', '2-HIGH') THEN c.valid_until ELSE e.valid_until END AS valid_until,
    CASE WHEN e.type IN ('1-URGENT', '2-HIGH') THEN c.invalidated_at ELSE e.invalidated_at END AS invalidated_at FROM edges_in e JOIN {CLOSED} c ON c.id = e.id""")
def _(t):
    old, new = t.edges_in.filter("valid_from < '1995-01-01'"), t.edges_in.filter("valid_from >= '1995-01-01'")
    return gr.add_edges(old, new, F.col("type").isin("1-URGENT", "2-HIGH")).select("id", "valid_until", "invalidated_at")


@query("invalidate_edges", "N9", f"SELECT id, CASE WHEN invalidated_at IS NULL AND target_id IN (SELECT concat('n', n_nationkey) FROM nation) THEN {NOW} ELSE invalidated_at END AS invalidated_at FROM edges_in")
def _(t):
    ids = t.edges_in.join(t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("target_id")), "target_id", "left_semi")
    return gr.invalidate_edges(t.edges_in, ids, AS_OF).select("id", "invalidated_at")


@query("current_edges", "N10", "SELECT id, source_id, target_id FROM edges_in WHERE invalidated_at IS NULL AND type = '1-URGENT'")
def _(t):
    return gr.current_edges(t.edges_in, "1-URGENT").select("id", "source_id", "target_id")


@query("edges_as_of", "N10,F9", "SELECT id, source_id, target_id FROM edges_in WHERE valid_from <= TIMESTAMP '1996-06-01' AND (valid_until IS NULL OR TIMESTAMP '1996-06-01' < valid_until) AND (source_id = 'n7' OR target_id = 'n7')")
def _(t):
    return gr.edges_as_of(t.edges_in, "1996-06-01 00:00:00", entity="n7").select("id", "source_id", "target_id")


INSTANTS = "(SELECT DISTINCT date_trunc('month', o_orderdate) AS at FROM orders)"
AS_OF_EDGES = f"SELECT a.at, e.id FROM edges_in e JOIN {INSTANTS} a ON valid_from <= a.at AND (valid_until IS NULL OR a.at < valid_until)"


def months(t):
    return t.orders.select(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("at")).distinct()


@query("edges_as_of_join", "F9", AS_OF_EDGES)
def _(t):
    return gr.as_of_join(t.edges_in, months(t)).select("at", "id")


@query("edges_as_of_join_months", "F9", AS_OF_EDGES)
def _(t):
    return gr.as_of_join(t.edges_in, months(t)).select("at", "id")


@query("facts_as_of", "F10", """SELECT a.at, vault, fact_key, arg_max(event_id, (created_at, event_id)) AS event_id FROM facts_in f
    JOIN (SELECT DISTINCT date_trunc('day', created_at) AS at FROM log_entries) a ON valid_from <= a.at AND (valid_until IS NULL OR a.at < valid_until) GROUP BY ALL""")
def _(t):
    days = t.log_entries.select(F.date_trunc("day", "created_at").cast("timestamp_ntz").alias("at")).distinct()
    return gr.facts_as_of(t.facts_in, days, ["created_at", "event_id"]).select("at", "vault", "fact_key", "event_id")


LIVE = "(SELECT * FROM edges_in WHERE valid_from <= TIMESTAMP '1996-06-01' AND (valid_until IS NULL OR TIMESTAMP '1996-06-01' < valid_until))"


@query("entity_as_of", "N11", f"""SELECT n.vault, n.id, n.name, e.edge_id, e.direction FROM entities n LEFT JOIN (SELECT vault, source_id AS id, id AS edge_id, 'out' AS direction FROM {LIVE}
    UNION ALL SELECT vault, target_id, id, 'in' FROM {LIVE}) e ON e.vault = n.vault AND e.id = n.id""")
def _(t):
    return gr.entity_as_of(t.entities, t.edges_in, "1996-06-01 00:00:00").select("vault", "id", "name", "edge_id", "direction")


@query("resolve_relations", "F8", """SELECT o_orderkey, s.id AS source_id, d.id AS target_id, 'ordered_' || o_orderkey % 3 AS type FROM orders
    JOIN (SELECT lower(c_name) AS n, min('c' || c_custkey) AS id FROM customer GROUP BY 1) s ON s.n = lower('Customer#' || lpad(CAST(o_custkey % 2000 AS VARCHAR), 9, '0'))
    JOIN (SELECT lower(n_name) AS n, min('x' || n_nationkey) AS id FROM nation GROUP BY 1) d ON d.n = lower((SELECT arg_min(n_name, abs(n_nationkey - o_orderkey % 25)) FROM nation))""")
def _(t):
    nation = t.nation.select(F.col("n_nationkey").alias("_k"), "n_name")
    relations = t.orders.join(nation, F.col("_k") == F.col("o_orderkey") % 25).select(
        "o_orderkey", F.concat(F.lit(" CUSTOMER#"), F.lpad((F.col("o_custkey") % 2000).cast("string"), 9, "0")).alias("source"), F.upper("n_name").alias("target"),
        F.concat(F.lit("Ordered "), F.col("o_orderkey") % 3, F.lit("!")).alias("type"))
    entities = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name")).union(
        t.nation.select(F.concat(F.lit("x"), "n_nationkey"), "n_name"))
    return gr.resolve_relations(relations, entities).select("o_orderkey", "source_id", "target_id", "type")


@query("route_to_vault", "F7", """SELECT page_id, CASE WHEN host LIKE '%.example.com' THEN 'com' WHEN host LIKE '%.org' THEN 'org' END AS vault
    FROM (SELECT page_id, regexp_extract(url, '^https?://([^/]*)', 1) AS host FROM pages)""")
def _(t):
    rules = t.spark.createDataFrame([("example.com", "com"), ("org", "org")], "pattern string, vault string")
    events = t.pages.select("page_id", F.regexp_extract("url", "^https?://([^/]*)", 1).alias("repo_url"))
    return gr.route_to_vault(events, rules).select("page_id", "vault")


@query("graph_stats", "G9", "SELECT (SELECT count(*) FROM entities) AS entities, count(*) AS edges, count(invalidated_at) AS invalidated FROM edges_in")
def _(t):
    return gr.stats(t.entities, t.edges_in)


# ── communities ───────────────────────────────────────────────────────────────
PAIRS = "(SELECT least(source_id, target_id) AS u, greatest(source_id, target_id) AS v, CAST(count(*) AS DOUBLE) AS w FROM edges_in WHERE invalidated_at IS NULL GROUP BY ALL)"
BY_HASH = "(SELECT DISTINCT node, ascii(right(node, 1)) % 7 AS label FROM (SELECT u AS node FROM {p} UNION SELECT v FROM {p}))".format(p=PAIRS)


def pairs(t):
    return cm.undirected(t.edges_in.filter("invalidated_at is null"))


def by_hash(t):
    return pairs(t).select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("label", F.ascii(F.right("node", F.lit(1))) % 7)


@query("modularity", "N13", f"""SELECT round(inside / m - squares / (4 * m * m), 6) AS q FROM (SELECT sum(CASE WHEN a.label = b.label THEN w ELSE 0 END) AS inside, sum(w) AS m
    FROM {PAIRS} p JOIN {BY_HASH} a ON a.node = u JOIN {BY_HASH} b ON b.node = v), (SELECT sum(k * k) AS squares FROM (SELECT label, sum(w) AS k FROM (SELECT u AS node, w FROM {PAIRS} UNION ALL SELECT v, w FROM {PAIRS}) d
      JOIN {BY_HASH} h ON h.node = d.node GROUP BY label))""")
def _(t):
    return cm.modularity(pairs(t), by_hash(t)).select(F.round("q", 6).alias("q"))


@query("aggregate_graph", "N14", f"SELECT least(a.label, b.label) AS u, greatest(a.label, b.label) AS v, sum(w) AS w FROM {PAIRS} p JOIN {BY_HASH} a ON a.node = u JOIN {BY_HASH} b ON b.node = v GROUP BY ALL")
def _(t):
    return cm.aggregate_graph(pairs(t), by_hash(t))


def detected(t):
    nodes = t.entities.select(F.col("id").alias("node"))
    return cm.detect(pairs(t), nodes)


@query("communities", "N12")
def _(t):
    return detected(t)


@query("communities_by_size", "X5", f"SELECT label, count(*) AS size FROM {BY_HASH} GROUP BY label ORDER BY size DESC, label")
def _(t):
    return cm.by_size(by_hash(t))


@query("community_context", "N15", f"""SELECT label, 'entity' AS kind, name AS line FROM {BY_HASH} h JOIN (SELECT DISTINCT id, name FROM entities) e ON e.id = h.node
    UNION ALL SELECT a.label, 'fact', fact FROM edges_in e JOIN {BY_HASH} a ON a.node = source_id JOIN {BY_HASH} b ON b.node = target_id AND b.label = a.label WHERE e.invalidated_at IS NULL""")
def _(t):
    return cm.community_context(by_hash(t), t.entities, t.edges_in.filter("invalidated_at is null"))
