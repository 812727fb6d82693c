"""Links between files: resolution, references, traversal, graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.functions import text
from loreweave.session import durable

# Fixed value: a wiki link with an optional display text.
WIKI_LINK = r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"
MAX_DEPTH = 5
CONTEXT = 200


def scope_of(*frames: DataFrame) -> list[str]:
    """The columns of ``vault`` and ``extraction_id`` that all tables have: paths, names
    and keys then mean those of their vault and of their extraction."""
    return [c for c in ("vault", "extraction_id") if all(c in f.columns for f in frames)]


# ── resolution ────────────────────────────────────────────────────────────────
def resolve_targets(targets: DataFrame, paths: DataFrame) -> DataFrame:
    """``(target, path, rule)`` for every target some known path (of its vault) answers to.

    Rules in order: exact, with ``.md`` added, same base name, path suffix, same
    display name; the smallest path wins inside a rule. Each rule becomes keys on both
    sides, so all of them are one equi join against a table that is unique per key.
    """
    scope = scope_of(targets, paths)
    asked = targets.select(*scope, "target").filter(F.col("target") != "").distinct()
    # Suffixes of a path are only cut at lengths some target has.
    lengths = asked.agg(F.collect_set(F.length("target"))).scalar()
    known = paths.select(*scope, "path").distinct().withColumn("_lengths", lengths)
    target, path = F.col("target"), F.col("path")
    base = text.stem(target)

    def spaced(c: Column) -> Column:
        return F.lower(F.translate(c, "-_", "  "))

    suffixes = F.transform(F.filter("_lengths", lambda n: n <= F.length(path)), lambda n: F.right(path, n))

    def keyed(rule: int, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(rule).alias("rule"), k.alias("key")))

    wanted = F.concat(
        keyed(1, F.array(target)),
        keyed(2, F.array(F.when(target.endswith(".md"), target).otherwise(F.concat(target, F.lit(".md"))))),
        keyed(3, F.array(F.lower(base), F.lower(F.replace(base, F.lit("-"), F.lit(" "))), F.lower(F.replace(base, F.lit("_"), F.lit(" "))))),
        keyed(4, F.array(target)),
        keyed(5, F.array(spaced(base))),
    )
    offered = F.concat(
        keyed(1, F.array(path)), keyed(2, F.array(path)), keyed(3, F.array(F.lower(text.stem(path)))), keyed(4, suffixes),
        keyed(5, F.array(spaced(text.stem(path)))),
    )
    lookup = known.select(*scope, "path", F.explode(offered).alias("k")).groupBy(*scope, "k.rule", "k.key").agg(F.min("path").alias("path"))
    return (
        asked.select(*scope, "target", F.explode(wanted).alias("k"))
        .select(*scope, "target", "k.rule", "k.key")
        .distinct()
        .join(lookup, [*scope, "rule", "key"])
        .groupBy(*scope, "target")
        .agg(F.min(F.struct("rule", "path")).alias("_best"))
        .select(*scope, "target", "_best.path", "_best.rule")
    )


def _context(body: Column, at: Column, length: Column) -> Column:
    """The paragraph around a match (``at`` counts from 0), at most 200 characters."""
    before = F.substring_index(F.substr(body, F.lit(1), at), "\n\n", -1)
    middle = F.substr(body, at + 1, length)
    after = F.substring_index(F.substr(body, at + length + 1), "\n\n", 1)
    whole = text.squeeze(F.concat(before, middle, after))
    cut = F.left(whole, F.lit(CONTEXT))
    sentence = F.regexp_extract(cut, r"(?s)^(.*\.)", 1)
    return F.when(F.length(whole) <= CONTEXT, whole).when(F.length(sentence) > CONTEXT // 2 + 1, sentence).otherwise(cut)


def wiki_links(docs: DataFrame, paths: DataFrame) -> DataFrame:
    """Resolved wiki links of ``docs(path, text)``, each (source, target) once."""
    scope = scope_of(docs, paths)
    found = docs.select(
        *scope,
        "path",
        F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WIKI_LINK), F.lit(0)))).alias("raw"),
    ).withColumn("target", F.regexp_extract("raw", WIKI_LINK, 1))
    resolved = resolve_targets(found, paths).withColumnRenamed("path", "target_path")
    return (
        found.join(resolved.select(*scope, "target", "target_path"), [*scope, "target"])
        .groupBy(*scope, "path", "target_path")
        .agg(F.min("raw").alias("raw"))
        .select(*scope, F.col("path").alias("source_path"), "target_path", "raw", F.lit("wikilink").alias("link_type"))
    )


#: Classes of beginnings and ends that paths are told apart by before a shuffle.
LOOKS = 4096
BEFORE, AFTER = " \t\n\"'(`", " \t\n\"').,`}>"


def path_references(docs: DataFrame, paths: DataFrame) -> DataFrame:
    """Known paths written out in a text, other than the text's own path.

    Only text pieces that could be a clean reference are looked up by an equi join:
    they start at the text start or after one of the opening characters and end before
    a closing one. The first occurrence of the path then has to be a clean one. A path
    with spaces spans several words; the most words of any known path is looked up.
    Pieces that begin and end like no known path drop out where they are read, so few
    rows are shuffled. (A plain ``explode`` has its list made again to test that it is
    not empty; the nulls of ``explode_outer`` fall to the filters.)
    """
    scope = scope_of(docs, paths)
    known = paths.select(*scope, F.col("path").alias("target_path")).distinct()
    most_words = known.agg(F.coalesce(F.max(F.regexp_count("target_path", F.lit(" "))), F.lit(0)) + 1).scalar()

    def grams(words: Column, most: Column) -> Column:
        """Runs of up to ``most`` words of one segment."""
        return F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.size(words) - 1),
                lambda i: F.transform(
                    F.sequence(F.lit(1), F.least(most, F.size(words) - i)), lambda n: F.array_join(F.slice(words, i + 1, n), " ")
                ),
            )
        )

    def places(c: Column, chars: str) -> Column:
        return F.filter(F.sequence(F.lit(1), F.length(c)), lambda i: F.substr(c, i, F.lit(1)).isin(*chars))

    segments = docs.select(*scope, "path", F.explode_outer(F.split("text", "[\t\n\"'`]")).alias("_s")).filter(F.col("_s") != "").withColumn("_most", most_words)
    words = segments.select(*scope, "path", F.explode_outer(text.let(F.split("_s", " "), lambda w: F.when(F.col("_most") == 1, w).otherwise(grams(w, F.col("_most"))))).alias("_g")).filter(F.col("_g") != "")
    # Most words hold no bracket and no closing character, so they stay as they are.
    whole = F.array("_g")
    starts = F.when(F.col("_g").contains("("), F.concat(whole, F.transform(places(F.col("_g"), "("), lambda i: F.substr(F.col("_g"), i + 1)))).otherwise(whole)
    opened = words.select(*scope, "path", F.explode_outer(starts).alias("_c")).filter(F.col("_c") != "")
    alone = F.array("_c")
    ends = F.when(
        F.col("_c").rlike(r"[).,}>]"), F.concat(alone, F.transform(places(F.col("_c"), ").,}>"), lambda i: F.substr(F.col("_c"), F.lit(1), i - 1)))
    ).otherwise(alone)
    candidates = opened.select(*scope, "path", F.explode_outer(ends).alias("target_path")).filter(
        (F.col("target_path") != F.col("path")) & (F.col("target_path") != "")
    )
    looks = F.pmod(F.xxhash64(F.left("target_path", F.lit(3)), F.right("target_path", F.lit(3))), F.lit(LOOKS)).alias("_look")
    like = durable(known.select(looks).distinct())
    candidates = candidates.withColumn("_look", looks).join(like, "_look", "left_semi").drop("_look")
    pairs = candidates.join(known, [*scope, "target_path"]).distinct().join(docs.select(*scope, "path", "text"), [*scope, "path"])
    idx = F.expr("locate(target_path, text)") - 1
    previous = F.substr("text", idx, F.lit(1))
    following = F.substr("text", idx + F.length("target_path") + 1, F.lit(1))
    clean = ((idx == 0) | previous.isin(*BEFORE)) & ((idx + F.length("target_path") >= F.length("text")) | following.isin(*AFTER))
    return pairs.filter((idx >= 0) & clean).select(
        *scope, F.col("path").alias("source_path"), "target_path", F.col("target_path").alias("raw"), F.lit("path_ref").alias("link_type")
    )


def build_links(docs: DataFrame, paths: DataFrame) -> DataFrame:
    """All links of the documents with the paragraph around their first mention."""
    found = wiki_links(docs, paths).unionByName(path_references(docs, paths))
    scope = scope_of(docs, paths)
    bodies = docs.select(*scope, F.col("path").alias("source_path"), "text")
    at = F.expr("locate(raw, text)") - 1
    return found.join(bodies, [*scope, "source_path"]).select(
        *scope, "source_path", "target_path", "link_type", _context(F.col("text"), at, F.length("raw")).alias("context")
    )


def replace_links(links: DataFrame, fresh: DataFrame, sources: DataFrame) -> DataFrame:
    """Next link table: re-read sources lose their old links."""
    keys = [*scope_of(links, sources), "source_path"]
    return links.join(sources.select(*keys).distinct(), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def outbound(links: DataFrame, paths: DataFrame) -> DataFrame:
    scope = scope_of(links, paths)
    return links.join(paths.select(*scope, F.col("path").alias("source_path")).distinct(), [*scope, "source_path"], "left_semi")


def backlinks(links: DataFrame, paths: DataFrame) -> DataFrame:
    scope = scope_of(links, paths)
    return links.join(paths.select(*scope, F.col("path").alias("target_path")).distinct(), [*scope, "target_path"], "left_semi")


# ── traversal ─────────────────────────────────────────────────────────────────
def traverse(seeds: DataFrame, depth: int, expand: Callable[[DataFrame], DataFrame], exists: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Breadth-first walk from ``seeds(seed, node)``.

    ``expand`` turns a frontier ``(seed, node)`` into edges ``(seed, node, source,
    target, link_type, to)``; ``exists(node)`` limits which nodes are entered. Returns
    nodes ``(seed, node, hop, link_type)`` and edges ``(seed, source, target, link_type)``.
    Each hop is an equi join; the frontier is unique per (seed, node), so a node with
    very many edges is only ever split on the edge side. A ``vault`` column of the seeds
    goes along and is part of every key.
    """
    scope = scope_of(seeds)
    walk = [*scope, "seed", "node"]
    nodes = seeds.select(*walk, F.lit(0).alias("hop"), F.lit("source").alias("link_type"))
    frontier, all_edges = seeds.select(*walk), None
    for hop in range(1, depth + 1):
        edges = expand(frontier)
        all_edges = edges if all_edges is None else all_edges.unionByName(edges)
        reached = edges.groupBy(*scope, "seed", F.col("to").alias("node")).agg(F.min("link_type").alias("link_type"))
        if exists is not None:
            reached = reached.join(exists, [*scope, "node"], "left_semi")
        fresh = reached.join(nodes.select(*walk), walk, "left_anti")
        nodes = nodes.unionByName(fresh.select(*walk, F.lit(hop).alias("hop"), "link_type"))
        frontier = fresh.select(*walk)
    edges = all_edges.select(*scope, "seed", "source", "target", "link_type").distinct()
    return nodes, edges


def link_graph(links: DataFrame, seeds: DataFrame, depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges within ``depth`` hops of each seed path, inside its vault if both
    tables name one."""
    scope = scope_of(links, seeds)
    hops = links.select(*scope, F.col("source_path").alias("node"), F.col("source_path").alias("source"), F.col("target_path").alias("target"), "link_type").distinct()
    start = seeds.select(*scope, F.col("path").alias("seed"), F.col("path").alias("node")).distinct()
    return traverse(start, depth, lambda f: f.join(hops, [*scope, "node"]).withColumn("to", F.col("target")))


def vault_graph(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """File nodes with display names, and distinct ``links_to`` edges."""
    files = chunks.filter(F.col("source_file") != "")
    scope = scope_of(chunks)
    nodes = files.select(*scope, "source_file").distinct().select(
        *scope, F.concat(F.lit("file:"), "source_file").alias("id"), F.lit("file").alias("type"), text.display_name(F.col("source_file")).alias("label")
    )
    edges = (
        files.select(*scope, F.concat(F.lit("file:"), "source_file").alias("source"), F.explode("links_to").alias("_t"))
        .filter(F.col("_t") != "")
        .select(*scope, "source", F.concat(F.lit("file:"), "_t").alias("target"), F.lit("links_to").alias("relationship"))
        .distinct()
    )
    return nodes, edges


def entity_graph(chunks: DataFrame, entity: str, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """Files that mention the entity (hop 1) and the files they link to."""
    scope = scope_of(chunks)
    links = chunks.select(*scope, F.col("source_file").alias("source_path"), F.explode("links_to").alias("target_path")).filter(F.col("target_path") != "")
    hits = chunks.filter((F.col("source_file") != "") & F.col("text").contains(entity)).select(*scope, F.col("source_file").alias("node")).distinct()
    me = F.lit(f"entity:{entity}")
    once = hits.select(*scope).distinct() if scope else hits.sparkSession.range(1)
    entity_node = once.select(*scope, me.alias("id"), F.lit("entity").alias("type"), F.lit(entity).alias("label"))
    if depth <= 0:
        return entity_node, hits.limit(0).select(*scope, me.alias("source"), me.alias("target"), F.lit("contains").alias("relationship"))
    hops = links.select(*scope, F.col("source_path").alias("node"), F.col("source_path").alias("source"), F.col("target_path").alias("target"), F.lit("links_to").alias("link_type")).distinct()
    files, edges = traverse(hits.select(*scope, me.alias("seed"), "node"), depth, lambda f: f.join(hops, [*scope, "node"]).withColumn("to", F.col("target")))
    # One edge per file found: from the smallest file of the hop before.
    walk = (
        edges.join(files.select(*scope, F.col("node").alias("source"), F.col("hop").alias("_h")), [*scope, "source"])
        .join(files.select(*scope, F.col("node").alias("target"), F.col("hop").alias("_t")), [*scope, "target"])
        .filter(F.col("_t") == F.col("_h") + 1)
        .groupBy(*scope, "target")
        .agg(F.min("source").alias("source"))
    )
    file_nodes = files.select(*scope, F.concat(F.lit("file:"), "node").alias("id"), F.lit("file").alias("type"), text.display_name(F.col("node")).alias("label"))
    contains = hits.select(*scope, F.concat(F.lit("file:"), "node").alias("source"), me.alias("target"), F.lit("contains").alias("relationship"))
    linked = walk.select(*scope, F.concat(F.lit("file:"), "source").alias("source"), F.concat(F.lit("file:"), "target").alias("target"), F.lit("links_to").alias("relationship"))
    return entity_node.unionByName(file_nodes), contains.unionByName(linked)


def fact_edges(facts: DataFrame) -> DataFrame:
    """Edge columns of the facts as rows: ``(source, target, link_type)``."""
    none = F.array().cast("array<string>")

    def named(name: str, targets: Column) -> Column:
        return F.transform(targets, lambda x: F.struct(F.lit(name).alias("link_type"), x.alias("target")))

    all_ = F.concat(
        named("supersedes", F.array("supersedes")), named("refines", F.array("refines")),
        named("contradicts", F.coalesce("contradicts", none)), named("supports", F.coalesce("supports", none)),
    )
    scope = scope_of(facts)
    rows = facts.select(*scope, F.col("fact_key").alias("source"), F.explode(all_).alias("e")).select(*scope, "source", "e.target", "e.link_type")
    return rows.filter(F.coalesce(F.col("target") != "", F.lit(False))).distinct()


def fact_graph(facts: DataFrame, keys: DataFrame, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Facts around each key along its four edge columns, in both directions. With a
    ``vault`` column in both tables each vault is a graph of its own; edges to facts
    that do not exist are shown but not entered."""
    # Names of the reverse relations.
    reverse = {"supersedes": "superseded_by", "refines": "refined_by", "contradicts": "contradicted_by", "supports": "supported_by"}
    scope = scope_of(facts, keys)
    forward = fact_edges(facts)
    names = F.create_map(*[F.lit(x) for kv in reverse.items() for x in kv])
    both = forward.select(*scope, F.col("source").alias("node"), "source", "target", "link_type", F.col("target").alias("to")).unionByName(
        forward.select(*scope, F.col("target").alias("node"), "source", "target", names[F.col("link_type")].alias("link_type"), F.col("source").alias("to"))
    )
    known = facts.select(*scope, F.col("fact_key").alias("node")).distinct()
    start = keys.select(*scope, F.col("fact_key").alias("seed"), F.col("fact_key").alias("node")).distinct().join(known, [*scope, "node"], "left_semi")
    return traverse(start, depth, lambda f: f.join(both, [*scope, "node"]), known)
