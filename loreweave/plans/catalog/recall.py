"""Vector search, BM25, fusion, recall pipelines and context building."""

from pyspark.sql import functions as F

from loreweave import models, skew
from loreweave.operators import lexical as lx
from loreweave.operators import retrieval as rt
from loreweave.operators import vector as vx
from loreweave.plans.catalog.listing import NOW
from loreweave.plans.catalog.texts import TOKENS
from loreweave.plans.registry import query
from loreweave.plans.tables import AS_OF, with_lists


def cos(a, b):
    return f"round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 6)"


def ranked(pairs, group="query_id", key="doc_id"):
    return f"(SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY score DESC, {key}) AS rank FROM ({pairs}))"


DENSE = ranked(f"SELECT query_id, doc_id, {cos('a.embedding', 'c.embedding')} AS score FROM asks a, chunks c")


def bm25_sql(norm, idf):
    return ranked(f"""
      WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM chunks) GROUP BY ALL),
      l AS (SELECT doc_id, len({TOKENS.format('text')}) AS dl FROM chunks), s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS mean FROM l),
      q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({TOKENS.format('text')}) AS term FROM asks) GROUP BY ALL),
      d AS (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY term)
      SELECT query_id, p.doc_id, round(sum(times * {idf} * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * ({norm}))), 6) AS score
      FROM q JOIN p ON p.term = q.term JOIN d ON d.term = q.term JOIN l ON l.doc_id = p.doc_id, s GROUP BY query_id, p.doc_id""")


LEXICAL = bm25_sql("0.75::DOUBLE * (dl / mean)", "greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 0)")
FUSED = f"""(SELECT query_id, doc_id, round(sum(1::DOUBLE / (60 + rank)), 6) AS score, string_agg(source, ',' ORDER BY source) AS sources FROM (
    SELECT query_id, doc_id, rank, 'dense' AS source FROM {DENSE} WHERE rank <= 20
    UNION ALL SELECT query_id, doc_id, rank, 'lexical' FROM {LEXICAL} WHERE rank <= 20) GROUP BY query_id, doc_id)"""
HYBRID = ranked(f"SELECT * FROM {FUSED}")


def dense(t, k=10):
    return vx.knn_batch(t.asks, t.chunks, "doc_id", k)


def sparse(t, k=20, variant="reference"):
    return lx.bm25(t.asks, lx.postings(t.chunks, "doc_id"), lx.collection_stats(t.chunks), "doc_id", k, variant=variant)


@query("cosine", "D1", f"SELECT a.vec_id, {cos('a.embedding', 'b.embedding')} AS score FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id * 7 + 3) % (SELECT count(*) FROM embeddings)")
def _(t):
    b = t.embeddings.select(F.col("vec_id").alias("other"), F.col("embedding").alias("b"))
    pairs = t.vectors.join(b, F.col("other") == (F.col("vec_id") * 7 + 3) % F.col("n"))
    return pairs.select("vec_id", F.round(vx.cosine(F.col("embedding"), F.col("b")), 6).alias("score"))


CENTROIDS = """(SELECT label AS query_id, list(v ORDER BY i) AS embedding FROM (SELECT label, i, avg(v) AS v FROM (
    SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"""


def centroids(t):
    flat = t.embeddings.select("label", F.posexplode("embedding").alias("i", "v"))
    means = flat.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    listed = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("_p"))
    return listed.select(F.col("label").alias("query_id"), F.transform("_p", lambda x: x["v"]).alias("embedding"))


@query("knn", "D2,X2", f"SELECT query_id, vec_id, score, rank FROM {ranked(f'SELECT q.query_id, e.vec_id, ' + cos('q.embedding', 'e.embedding') + f' AS score FROM {CENTROIDS} q, embeddings e', key='vec_id')} WHERE rank <= 10 AND score >= 0.2")
def _(t):
    return vx.knn(centroids(t), t.embeddings, "vec_id", 10, threshold=0.2)


# Derived vectors have one component more than the given ones.
LONGER = "(SELECT vec_id, array_append(embedding, CAST(1 AS FLOAT)) AS embedding FROM embeddings)"


def longer(t):
    return t.embeddings.withColumn("embedding", F.array_append("embedding", F.lit(1.0).cast("float")))


@query("knn_batch", "D3", f"SELECT query_id, doc_id, score, rank FROM {ranked('SELECT q.vec_id AS query_id, c.doc_id, ' + cos('q.embedding', 'c.embedding') + ' AS score FROM ' + LONGER + ' q, chunks c')} WHERE rank <= 10")
def _(t):
    return vx.knn_batch(longer(t).withColumnRenamed("vec_id", "query_id"), t.chunks, "doc_id", 10)


@query("knn_batch_blocks", "D3", f"SELECT query_id, doc_id, score, rank FROM {ranked('SELECT q.vec_id AS query_id, c.doc_id, ' + cos('q.embedding', 'c.embedding') + ' AS score FROM ' + LONGER + ' q, chunks c')} WHERE rank <= 10")
def _(t):
    return vx.knn_batch(longer(t).withColumnRenamed("vec_id", "query_id"), t.chunks, "doc_id", 10, broadcast_queries=100)


@query("knn_batch_outcome", "D3", f"SELECT query_id, CASE WHEN query_id % 10 = 0 THEN 0 ELSE 10 END AS n, CASE WHEN query_id % 10 = 0 THEN 0 ELSE max(score) END AS top_score, CASE WHEN query_id % 10 = 0 THEN 'no embedding' END AS error FROM {DENSE} GROUP BY query_id")
def _(t):
    asks = t.asks.withColumn("embedding", F.when(F.col("query_id") % 10 != 0, F.col("embedding")))
    return vx.batch_outcome(asks, vx.knn_batch(asks, t.chunks, "doc_id", 10))


@query("knn_cross_vault", "D4", f"SELECT query_id, vault, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {ranked('SELECT query_id, doc_id, vault, ' + cos('a.embedding', 'c.embedding') + ' AS score FROM asks a, chunks c', 'query_id, vault')} WHERE rank <= 10 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10")
def _(t):
    return vx.knn_cross_vault(t.asks, t.chunks, "doc_id", 10)


@query("knn_expand", "D5", f"""SELECT query_id, kind, id, score, rank FROM {ranked('SELECT query_id, kind, CAST(id AS VARCHAR) AS id, score FROM ('
    + "SELECT query_id, 'chunk' AS kind, doc_id AS id, score, rank FROM " + DENSE + " UNION ALL SELECT query_id, 'fact', event_id, score, rank FROM "
    + ranked('SELECT query_id, event_id, ' + cos('a.embedding', 'f.embedding') + ' AS score FROM asks a, fact_vectors f', key='event_id') + ') WHERE rank <= 10', key='kind, id')} WHERE rank <= 10""")
def _(t):
    return vx.knn_expand(t.asks, t.chunks, t.fact_vectors, "doc_id", "event_id", 10)


FEW = """(SELECT * FROM fact_vectors WHERE status = 'active' AND NOT conflict_resolved ORDER BY md5(concat(event_id, ':0')), event_id LIMIT 50)"""
PAIRS = f"""(SELECT m.vault, m.fact_key, m.event_id AS id, o.fact_key AS other_key, o.event_id AS other_id, {cos('m.embedding', 'o.embedding')} AS score
    FROM {FEW} m JOIN {FEW} o ON (m.created_at, -m.confidence, m.fact_key, m.event_id) > (o.created_at, -o.confidence, o.fact_key, o.event_id))"""


@query("conflict_pairs", "D6,X4", f"SELECT * FROM {PAIRS} WHERE score >= 0.2")
def _(t):
    return vx.conflict_pairs(t.fact_vectors, "event_id", threshold=0.2)


@query("sample_active", "X4", "SELECT event_id, fact_key FROM facts WHERE status = 'active' ORDER BY md5(concat(event_id, ':7')), event_id LIMIT 100")
def _(t):
    return vx.sample(t.facts.filter("status = 'active'"), "event_id", 100, 7).select("event_id", "fact_key")


@query("flag_conflicts", "L8", f"""
    SELECT f.vault, f.fact_key, CASE WHEN n > 0 THEN 'needs_review' ELSE status END AS status, CASE WHEN n > 0 THEN false ELSE conflict_resolved END AS conflict_resolved,
      CASE WHEN contradicts_csv <> '' THEN 1 ELSE 0 END + coalesce(n, 0) AS n_contradicts
    FROM facts f LEFT JOIN (SELECT p.vault, p.fact_key, count(DISTINCT other_key) AS n FROM {PAIRS} p JOIN facts g ON g.vault = p.vault AND g.fact_key = p.fact_key
      WHERE score >= 0.2 AND other_key <> g.contradicts_csv GROUP BY ALL) c ON c.vault = f.vault AND c.fact_key = f.fact_key""")
def _(t):
    from loreweave.operators import lifecycle as lc

    out = lc.flag_conflicts(t.fact_table, vx.conflict_pairs(t.fact_vectors, "event_id", threshold=0.2))
    return out.select("vault", "fact_key", "status", "conflict_resolved", F.size("contradicts").cast("long").alias("n_contradicts"))


@query("link_facts_to_chunks", "D7", f"""SELECT query_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS related_chunks FROM {ranked('SELECT f.event_id AS query_id, c.doc_id, '
    + cos('f.embedding', 'c.embedding') + ' AS score FROM fact_vectors f JOIN chunks c ON c.vault = f.vault')} WHERE rank <= 10 AND score >= 0.7 GROUP BY query_id""")
def _(t):
    out = vx.link_facts_to_chunks(t.fact_vectors.withColumnRenamed("event_id", "query_id"), t.chunks, "doc_id")
    return out.select("query_id", F.array_join("related_chunks", ",").alias("related_chunks"))


def zeroed(t):
    return t.fact_vectors.withColumn("embedding", F.when(F.col("event_id") % 9 == 0, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("embedding")))


@query("embed_documents", "D8,O1")
def _(t):
    out = models.embed(t.documents.select("doc_id", "text"), models.hashing_embedder())
    return out.select("doc_id", "embedding")


@query("find_zero_vectors", "D9", "SELECT event_id FROM facts WHERE event_id % 9 = 0")
def _(t):
    return vx.zero_vectors(zeroed(t)).select("event_id")


@query("reembed_facts", "D9", "SELECT event_id, 65 AS dim, false AS zero FROM facts")
def _(t):
    out = models.reembed_zero_vectors(zeroed(t), models.hashing_embedder(65))
    return out.select("event_id", F.size("embedding").alias("dim"), vx.is_zero_vector(F.col("embedding")).alias("zero"))


@query("vector_dim_report", "D10", "SELECT len(embedding) AS dim, count(*) AS n FROM fact_vectors GROUP BY 1")
def _(t):
    return vx.dimension_report(t.fact_vectors).select(F.col("dim").cast("long").alias("dim"), "n")


@query("project_2d", "D11")
def _(t):
    return vx.project_2d(t.chunks, "doc_id", label="lang", source="source_file")


@query("dedup_against_existing", "D12", f"""
    SELECT n.event_id, {cos('n.embedding', 'o.embedding')} AS similarity, CASE WHEN {cos('n.embedding', 'o.embedding')} >= 0.2 THEN 'skip'
      WHEN o.fact_key IS NOT NULL AND o.status = 'active' THEN 'supersede' ELSE 'write' END AS decision
    FROM (SELECT i.*, e.embedding FROM facts_in i JOIN incoming_vectors e USING (event_id)) n LEFT JOIN fact_vectors o ON o.vault = n.vault AND o.fact_key = n.fact_key""")
def _(t):
    incoming = t.facts_in.select("vault", "fact_key", "event_id").join(t.incoming_vectors, "event_id")
    return vx.dedup_against_existing(incoming, t.fact_vectors, 0.2).select("event_id", F.round("similarity", 6).alias("similarity"), "decision")


# ── lexical, fusion, recall ───────────────────────────────────────────────────
@query("bm25", "E1", f"SELECT query_id, doc_id, score, rank FROM {LEXICAL} WHERE rank <= 20")
def _(t):
    return sparse(t)


@query("bm25_okapi", "E1", f"""SELECT query_id, doc_id, score, rank FROM {bm25_sql('1 - 0.75::DOUBLE + 0.75::DOUBLE * (dl / mean)', 'ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))')} WHERE rank <= 20""")
def _(t):
    return sparse(t, variant="okapi")


@query("bm25_from_index", "E1", f"SELECT query_id, doc_id, score, rank FROM {LEXICAL} WHERE rank <= 20")
def _(t):
    return lx.bm25(t.asks, lx.postings(t.chunks, "doc_id"), lx.collection_stats(t.chunks), "doc_id", 20)


@query("rrf", "E2,S1", f"SELECT query_id, doc_id, score, sources FROM {FUSED}")
def _(t):
    lists = rt.named(dense(t, 20), "dense", "doc_id").unionByName(rt.named(sparse(t), "lexical", "doc_id"))
    return rt.rrf(lists, "doc_id")


@query("recall_dense", "E3", f"SELECT d.query_id, d.rank, d.score, c.source_file, '' AS text FROM {DENSE} d JOIN chunks c ON c.doc_id = d.doc_id WHERE d.rank <= 10")
def _(t):
    return rt.recall_dense(t.asks, t.chunks, "doc_id", 10, detail="l1").select("query_id", "rank", "score", "source_file", "text")


@query("recall_sparse", "E4", f"SELECT d.query_id, d.rank, d.score, c.source_file, c.text FROM {LEXICAL} d JOIN chunks c ON c.doc_id = d.doc_id WHERE d.rank <= 20")
def _(t):
    return rt.recall_sparse(t.asks, t.chunks, "doc_id", 10).select("query_id", "rank", "score", "source_file", "text")


@query("recall_hybrid", "E5,E6", f"SELECT d.query_id, d.rank, d.score, d.sources, c.source_file, c.text FROM {HYBRID} d JOIN chunks c ON c.doc_id = d.doc_id WHERE d.rank <= 10")
def _(t):
    return rt.recall_hybrid(t.asks, t.chunks, "doc_id", 10).select("query_id", "rank", "score", "sources", "source_file", "text")


REWRITES = """(SELECT query_id, 0 AS part, embedding FROM asks UNION ALL SELECT b.item_id, 1, array_append(e.embedding, CAST(1 AS FLOAT)) FROM benchmark b JOIN vectors e ON e.vec_id = (b.item_id * 7 + 1) % e.n)"""


@query("recall_multiquery", "E7", f"""SELECT query_id, doc_id, score, rank FROM {ranked('SELECT query_id, doc_id, round(sum(1::DOUBLE / (60 + rank)), 6) AS score FROM '
    + ranked('SELECT query_id, part, doc_id, ' + cos('a.embedding', 'c.embedding') + f' AS score FROM {REWRITES} a, chunks c', 'query_id, part') + ' WHERE rank <= 20 GROUP BY query_id, doc_id')} WHERE rank <= 10""")
def _(t):
    rewrites = t.sql("""SELECT query_id, 0 AS part, embedding FROM {asks} UNION ALL
        SELECT b.item_id, 1, array_append(e.embedding, CAST(1 AS FLOAT)) FROM {benchmark} b JOIN {vectors} e ON e.vec_id = (b.item_id * 7 + 1) % e.n""")
    return rt.recall_multiquery(rewrites, t.chunks, "doc_id", 10).drop("sources")


@query("apply_rewrite", "E8", """
    SELECT doc_id AS query_id, 'multiquery' AS mode, 0 AS part, 'how to ' || lang AS text FROM documents
    UNION ALL SELECT doc_id, 'multiquery', 1, 'About ' || source FROM documents
    UNION ALL SELECT doc_id, 'multiquery', 2, regexp_replace(text, '^\\s+|\\s+$', '', 'g') FROM documents
    UNION ALL SELECT doc_id, 'stepback', 0, 'how to ' || lang FROM documents
    UNION ALL SELECT doc_id, 'stepback', 1, regexp_replace(text, '^\\s+|\\s+$', '', 'g') FROM documents
    UNION ALL SELECT doc_id, 'hyde', 0, '1. how to ' || lang || chr(10) || '- "About ' || source || '"' || chr(10) || '* HOW to ' || lang FROM documents
    UNION ALL SELECT doc_id, 'off', 0, regexp_replace(text, '^\\s+|\\s+$', '', 'g') FROM documents""")
def _(t):
    d = t.documents
    answer = F.concat(F.lit("1. how to "), "lang", F.lit('\n- "About '), "source", F.lit('"\n* HOW to '), "lang")
    asked = d.select(F.col("doc_id").alias("query_id"), "text")
    answers = d.select(F.col("doc_id").alias("query_id"), answer.alias("answer"))
    out = None
    for mode in ("multiquery", "stepback", "hyde", "off"):
        part = rt.apply_rewrite(asked, answers, mode).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


@query("rerank", "E9", f"""SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank = 3 THEN 1 WHEN rank = 1 THEN 2 WHEN rank = 7 THEN 3 ELSE 99 END, rank) AS rank
    FROM {DENSE} WHERE rank <= 60""")
def _(t):
    answers = t.asks.select("query_id", F.lit("[3], 1, 55, 3, 0, 99\n7").alias("answer"))
    return rt.rerank(dense(t, 60), answers, "doc_id").select("query_id", "doc_id", "rank")


@query("rerank_prompts", "E9", f"""SELECT query_id, string_agg('[' || rank || '] ' || left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 500), chr(10) ORDER BY rank) AS prompt
    FROM {DENSE} d JOIN (SELECT doc_id AS id, text FROM chunks) c ON c.id = d.doc_id WHERE rank <= 50 GROUP BY query_id""")
def _(t):
    return rt.rerank_prompts(rt.fetch_ranked(dense(t, 60), t.chunks.select("doc_id", "text"), "doc_id"))


TYPED = """(SELECT * FROM (SELECT fact_key, fact_value, priority, CASE priority WHEN 0 THEN 'key' WHEN 1 THEN 'prefix' ELSE 'tag' END AS "match",
    row_number() OVER (PARTITION BY fact_key ORDER BY priority, vault) AS r FROM (SELECT *, CASE WHEN fact_key = 'u7/v1/click' THEN 0 WHEN starts_with(fact_key, 'u7/') THEN 1
      WHEN list_contains(string_split(tags_csv, ','), 'hot') THEN 2 END AS priority FROM facts) WHERE priority IS NOT NULL) WHERE r = 1 ORDER BY priority, fact_key LIMIT 40)"""


@query("hybrid_typed", "E10,S1", f"""
    SELECT 'chunk' AS kind, source_file AS key, text AS content, NULL AS "match", score FROM {DENSE} d JOIN (SELECT doc_id AS id, source_file, text FROM chunks) c ON c.id = d.doc_id WHERE rank <= 5
    UNION ALL SELECT 'fact', fact_key, fact_value, 'vector', score FROM {ranked('SELECT query_id, event_id, fact_key, fact_value, ' + cos('a.embedding', 'f.embedding') + ' AS score FROM asks a, fact_vectors f', key='event_id')} WHERE rank <= 5
    UNION ALL SELECT 'fact', fact_key, fact_value, "match", 0 FROM {TYPED}""")
def _(t):
    chunks = rt.recall_dense(t.asks, t.chunks, "doc_id", 5)
    facts = vx.knn_batch(t.asks, t.fact_vectors, "event_id", 5).join(t.facts.select("event_id", "fact_key", "fact_value"), "event_id")
    return rt.hybrid_typed(chunks, facts, rt.typed_facts(t.fact_table, "u7/v1/click", "u7/", "hot", 40))


@query("select_mode", "E11", f"SELECT query_id, max(score) AS top_score, CASE WHEN max(score) >= 0.75 THEN 'rag' ELSE 'full' END AS mode FROM {DENSE} GROUP BY query_id")
def _(t):
    return rt.select_mode(dense(t))


BLOCK = "'[Source: ' || source_file || ' | Chunk ' || chunk_index || ' | Score: ' || printf('%.3f', score) || ']' || chr(10) || text || chr(10) || chr(10)"
TOP = f"(SELECT d.*, c.source_file, c.chunk_index, c.text FROM {DENSE} d JOIN chunks c ON c.doc_id = d.doc_id WHERE rank <= 10)"


def top(t, k=10):
    return rt.recall_dense(t.asks, t.chunks, "doc_id", k)


@query("build_context", "E12", f"SELECT query_id, string_agg({BLOCK}, '' ORDER BY rank) AS context FROM {TOP} GROUP BY query_id")
def _(t):
    return rt.build_context(top(t))


@query("context_sources", "E12", f"SELECT query_id, source_file, min(rank) AS rank FROM {TOP} GROUP BY ALL")
def _(t):
    return rt.context_sources(top(t))


@query("full_context", "E12", f"""
    SELECT query_id, string_agg(block, '' ORDER BY rank) AS context FROM (
      SELECT *, coalesce(sum(w) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM (
        SELECT query_id, rank, block, len(regexp_extract_all(block, '\\S+')) AS w FROM (
          SELECT d.query_id, d.rank, '[Source: ' || source_file || ' | Chunk ' || chunk_index || ']' || chr(10) || text || chr(10) || chr(10) AS block
          FROM {DENSE} d JOIN chunks c ON c.doc_id = d.doc_id WHERE rank <= 50)))
    WHERE trunc(used * 1.3::DOUBLE) <= 8000 GROUP BY query_id""")
def _(t):
    return rt.full_context(t.asks, t.chunks, "doc_id")


FACT_TOP = ranked('SELECT query_id, f.* EXCLUDE (embedding), ' + cos('a.embedding', 'f.embedding') + ' AS score FROM asks a, fact_vectors f', key='event_id')
TS = "strftime({0}, '%Y-%m-%dT%H:%M:%SZ')"


def fact_top(t, k=5):
    hits = vx.knn_batch(t.asks, t.fact_vectors, "event_id", k)
    return hits.join(t.facts, "event_id")


@query("fact_context", "E13", f"""
    SELECT query_id, string_agg('[Fact: ' || fact_key || ' | Created: ' || {TS.format('created_at')} || ' | Valid from: ' || {TS.format('valid_from')}
      || CASE WHEN valid_until IS NOT NULL THEN ' | Valid until: ' || {TS.format('valid_until')} ELSE '' END || ' | Score: ' || printf('%.3f', score) || ']' || chr(10)
      || fact_value || chr(10) || chr(10), '' ORDER BY rank) AS facts FROM {FACT_TOP} WHERE rank <= 5 GROUP BY query_id""")
def _(t):
    return rt.fact_context(fact_top(t))


@query("cited_context", "E14", f"""SELECT query_id, string_agg('[chunk_id: ' || doc_id || ' | Source: ' || source_file || ' | Chunk ' || chunk_index || ' | Score: ' || printf('%.3f', score)
    || ']' || chr(10) || text || chr(10) || chr(10), '' ORDER BY rank) AS context FROM {TOP} GROUP BY query_id""")
def _(t):
    return rt.cited_context(top(t), "doc_id")


@query("explain", "E15", f"SELECT query_id, source_file, chunk_index, text, score, score >= 0.5 AS included FROM {TOP}")
def _(t):
    return rt.explain(top(t)).select("query_id", "source_file", "chunk_index", "text", "score", "included")


@query("verify", "E16", f"""SELECT query_id, s AS supporting, 10 - s AS below_threshold, s / 10::DOUBLE AS confidence,
    CASE WHEN s > 10 - s THEN 'confirmed' WHEN s < 10 THEN 'conflicts' ELSE 'insufficient_data' END AS status
    FROM (SELECT query_id, count_if(score >= 0.65) AS s FROM {DENSE} WHERE rank <= 10 GROUP BY query_id)""")
def _(t):
    return rt.verify(t.asks, t.chunks, "doc_id", 10)


@query("enrich_links", "E17", f"""SELECT t.query_id, t.rank, t.source_file, l.target AS link_target FROM {TOP} t
    LEFT JOIN (SELECT DISTINCT concat('doc/', event_id % 1300, '.md') AS source, fact_key AS target FROM facts) l ON l.source = t.source_file""")
def _(t):
    links = t.facts.select(F.col("source").alias("source_path"), F.col("fact_key").alias("target_path"), F.lit("provenance").alias("link_type")).distinct()
    return rt.enrich_links(top(t), links).select("query_id", "rank", "source_file", "link_target")


LIVE = f"valid_from <= {NOW} AND (valid_until IS NULL OR {NOW} < valid_until)"


@query("context_bundle", "E18", f"""
    SELECT 'peer_card' AS section, fact_key AS key, fact_value AS content, 1 AS rank FROM peer_facts WHERE {LIVE} AND starts_with(fact_key, 'peer/u7/card/profile')
    UNION ALL SELECT 'recent_facts', fact_key, fact_value, row_number() OVER (ORDER BY changed DESC, vault, fact_key) FROM (
      SELECT *, coalesce(updated_at, created_at) AS changed FROM peer_facts WHERE {LIVE} ORDER BY changed DESC, vault, fact_key LIMIT 10)
    UNION ALL SELECT 'recall', source_file, text, rank FROM {TOP}""")
def _(t):
    return rt.context_bundle("u7", with_lists(t.peer_facts), top(t), AS_OF)


@query("peer_list", "E19", f"SELECT vault, fact_key, fact_value FROM peer_facts WHERE {LIVE} AND starts_with(fact_key, 'peer/')")
def _(t):
    return rt.peer_list(with_lists(t.peer_facts), AS_OF).select("vault", "fact_key", "fact_value")


@query("recent_changes", "E20", f"""
    SELECT 'event' AS kind, created_at, type AS name, body AS content FROM (SELECT * FROM log_entries WHERE created_at >= TIMESTAMP '2024-01-20 00:00:00' ORDER BY id DESC LIMIT 20)
    UNION ALL SELECT 'fact', changed, fact_key, fact_value FROM (SELECT *, coalesce(updated_at, created_at) AS changed FROM facts WHERE {LIVE} AND coalesce(updated_at, created_at) >= TIMESTAMP '2024-01-20 00:00:00'
      ORDER BY changed DESC, vault, fact_key LIMIT 20)""")
def _(t):
    return rt.recent_changes(with_lists(t.log_entries), t.fact_table, "2024-01-20 00:00:00", AS_OF)


@query("search_facts", "E21", f"""SELECT query_id, fact_key, score, rank FROM {ranked('SELECT query_id, event_id, fact_key, ' + cos('a.embedding', 'f.embedding')
    + f" AS score FROM asks a, fact_vectors f WHERE status = 'active' AND {LIVE} AND list_contains(string_split(tags_csv, ','), 'hot')", key='event_id')} WHERE rank <= 100""")
def _(t):
    facts = with_lists(t.fact_vectors)
    return rt.search_facts(t.asks, facts, "event_id", AS_OF, tag="hot", status="active").select("query_id", "fact_key", "score", "rank")


@query("agent_context", "E22", f"""
    SELECT 'peer_card' AS section, fact_key AS key, fact_value AS content, 1 AS rank FROM peer_facts WHERE fact_key = 'peer/u7/card/profile'
    UNION ALL SELECT 'fact_chain', 'supersedes', b.fact_value, 1 FROM facts a JOIN facts b ON b.vault = a.vault AND b.fact_key = a.supersedes
    UNION ALL SELECT * FROM (SELECT 'session_summary', fact_key, fact_value, 1 FROM facts WHERE starts_with(fact_key, 'u7/') ORDER BY created_at DESC, fact_key DESC LIMIT 1)
    UNION ALL SELECT 'cross_agent', vault, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END, rank FROM (SELECT vault, text, row_number() OVER (PARTITION BY vault ORDER BY file_last_updated DESC, doc_id) AS rank FROM chunks) WHERE rank <= 3""")
def _(t):
    card = t.peer_facts.filter(F.col("fact_key") == "peer/u7/card/profile")
    old = t.facts.select("vault", F.col("fact_key").alias("supersedes"), F.col("fact_value").alias("old_value"))
    chain = t.facts.filter("supersedes is not null").select("vault", "supersedes").join(old, ["vault", "supersedes"]).select(
        F.lit("supersedes").alias("relationship"), F.col("old_value").alias("fact_value"))
    cross = skew.top_per_group(t.chunks.drop("embedding"), ["vault"], [F.desc("file_last_updated"), F.col("doc_id")], 3)
    return rt.agent_context(card, chain, t.facts.filter(F.startswith("fact_key", F.lit("u7/"))), cross)


@query("last_user_text", "E23", "SELECT session_id, arg_max(content, turn_id) AS content FROM turns WHERE role = 'user' AND content <> '' GROUP BY session_id")
def _(t):
    return rt.last_user_text(t.turns)


@query("top_k", "X1", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 50")
def _(t):
    return t.events.select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(50)


@query("top_k_per_group", "X2", "SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank <= 5")
def _(t):
    rows = t.events.select("event_type", "event_id", "value")
    return skew.top_per_group(rows, ["event_type"], [F.desc("value"), F.col("event_id")], 5)
