"""The bi-temporal entity graph, as-of joins and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave import skew
from loreweave.functions import clock, text
from loreweave.operators.filters import valid_at
from loreweave.operators.links import scope_of
from loreweave.session import durable

# Levels of time cells below the one where cells and instants are equally many. Each one
# halves the rows that an uneven spread of instants lets through to the exact filter.
FINER = 3


def upsert_entities(entities: DataFrame, order: str = "seq") -> DataFrame:
    """One entity per (vault, lower-cased name, kind): the first id and spelling stay,
    the last non-empty summary wins."""
    summary = F.col("summary")
    return (
        entities.withColumn("_name", F.lower("name"))
        .groupBy("vault", "_name", "kind")
        .agg(
            F.min_by("id", order).alias("id"),
            F.min_by("name", order).alias("name"),
            F.coalesce(F.max_by(summary, F.when(F.coalesce(summary, F.lit("")) != "", F.col(order))), F.lit("")).alias("summary"),
        )
        .drop("_name")
    )


def resolve_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations between names to edges between ids; unresolved ones fall out. Names are
    looked up among the entities of the same vault and extraction, where both tables
    name them."""
    scope = scope_of(relations, entities)

    def side(role: str) -> DataFrame:
        return entities.groupBy(*scope, F.lower(F.trim("name")).alias(f"_{role}")).agg(F.min("id").alias(f"{role}_id"))

    named = relations.withColumns({"_source": F.lower(F.trim("source")), "_target": F.lower(F.trim("target"))})
    return (
        named.join(side("source"), [*scope, "_source"])
        .join(side("target"), [*scope, "_target"])
        .withColumn("type", text.normalize_rel_type(F.col("type")))
        .filter(F.col("type") != "")
        .drop("_source", "_target")
    )


def close_intervals(edges: DataFrame, single_valued: Column | None = None) -> DataFrame:
    """A later edge of the same (vault, source, type) ends the one before it.

    The earlier edge is marked invalid when the later one was created and its validity
    is cut at the later one's start. Types outside ``single_valued`` keep all edges.
    The next edge is found inside month segments, so a hot source stays splittable.
    """
    ends = F.lit(True) if single_valued is None else single_valued
    month = F.year("created_at") * 12 + F.month("created_at")
    ahead = skew.neighbour(
        edges, ["vault", "source_id", "type"], month, [F.col("created_at"), F.col("seq")],
        F.struct(F.col("valid_from").alias("at"), F.col("created_at").alias("made")), "_next",
    )
    hit = ends & F.col("_next").isNotNull() & F.col("invalidated_at").isNull()
    start = F.col("_next.at")
    return ahead.withColumns(
        {
            "valid_until": F.when(hit & (F.col("valid_until").isNull() | (F.col("valid_until") > start)), start).otherwise(F.col("valid_until")),
            "invalidated_at": F.when(hit, F.col("_next.made")).otherwise(F.col("invalidated_at")),
        }
    ).drop("_next")


def add_edges(edges: DataFrame, incoming: DataFrame, single_valued: Column | None = None) -> DataFrame:
    return close_intervals(edges.unionByName(incoming, allowMissingColumns=True), single_valued)


def invalidate_edges(edges: DataFrame, ids: DataFrame, as_of) -> DataFrame:
    """Soft delete: listed edges that are still current get ``invalidated_at``."""
    listed = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    now = F.when(F.col("_hit") & F.col("invalidated_at").isNull(), clock.instant(as_of)).otherwise(F.col("invalidated_at"))
    return edges.join(listed, "id", "left").withColumn("invalidated_at", now).drop("_hit")


def current_edges(edges: DataFrame, type_: str | None = None, entity: str | None = None) -> DataFrame:
    return _narrow(edges.filter(F.col("invalidated_at").isNull()), type_, entity)


def edges_as_of(edges: DataFrame, at, type_: str | None = None, entity: str | None = None) -> DataFrame:
    """Edges valid at one instant."""
    return _narrow(edges.filter(valid_at(clock.instant(at))), type_, entity)


def _narrow(edges: DataFrame, type_: str | None, entity: str | None) -> DataFrame:
    out = edges
    if type_:
        out = out.filter(F.col("type") == type_)
    if entity:
        out = out.filter((F.col("source_id") == entity) | (F.col("target_id") == entity))
    return out


def as_of_join(rows: DataFrame, instants: DataFrame) -> DataFrame:
    """Rows valid at each distinct instant of ``instants(at)``, NULL bounds being open;
    NULL instants match nothing.

    Time between the first and the last instant is a binary tree of cells. A row's
    interval is covered by at most two nodes a level, an instant lies in one node of
    each level, so both meet in one equi join on the node, each pair exactly once. The
    outermost cells of a cover may hold instants just outside the interval; the exact
    bounds are tested after the join. The depth follows the number of instants, not
    the length of time. The instants are kept as a table of known size: when they are
    few the optimiser broadcasts them and no row has to move to its nodes, of which
    those of long intervals would be hot.
    """
    asked = durable(instants.select("at").filter(F.col("at").isNotNull()).distinct())
    size = asked.agg(F.struct(F.min("at").alias("low"), F.max("at").alias("high"), F.count(F.lit(1)).alias("n"))).scalar()
    tree = F.struct(
        size.getField("low").alias("low"), size.getField("high").alias("high"),
        F.length(F.bin(clock.micros_between(size.getField("low"), size.getField("high")))).alias("bits"),
        (F.length(F.bin(size.getField("n"))) + FINER).alias("wanted"),
    )
    points = asked.withColumn("_t", tree).select("at", F.explode(_above(_cell(F.col("at")), _depth())).alias("_node"))

    start, end = F.col("valid_from"), F.col("valid_until")
    low, high = F.col("_t.low"), F.col("_t.high")
    placed = rows.withColumn("_t", tree).filter(
        (start.isNull() | (start <= high)) & (end.isNull() | (end > low)) & (start.isNull() | end.isNull() | (start < end))
    )
    first = _cell(F.greatest(start, low))
    last = _cell(F.least(end - F.expr("INTERVAL '0.000001' SECOND"), high))
    spread = placed.withColumn("_node", F.explode(_cover(first, last, _depth()))).drop("_t")
    return spread.join(points, "_node").filter(valid_at(F.col("at"))).drop("_node")


def _depth() -> Column:
    return F.least("_t.bits", "_t.wanted")


def _halved(c: Column, times: Column) -> Column:
    return F.call_function("shiftright", c, times.cast("int"))


def _cell(at: Column) -> Column:
    """Number of the smallest cell an instant lies in; cells are powers of two of
    microseconds wide."""
    return _halved(clock.micros_between(F.col("_t.low"), at), F.col("_t.bits") - _depth())


def _once(make, **values: Column) -> Column:
    """``make`` of a struct of the values, each computed once a row, not once a level."""
    return F.flatten(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), make))


def _two_to(power: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), power.cast("int"))


def _above(position: Column, depth: Column) -> Column:
    """Numbers of the nodes a cell lies in, one a level, the root being 1."""
    return _once(
        lambda v: F.transform(F.sequence(F.lit(0), v["depth"]), lambda level: _halved(v["leaf"], level)),
        leaf=position + _two_to(depth), depth=depth,
    )


def _cover(first: Column, last: Column, depth: Column) -> Column:
    """Fewest nodes that hold the cells from ``first`` to ``last`` and no others."""

    def ends(v: Column, level: Column) -> Column:
        left, right = _halved(v["first"] + _two_to(level) - 1, level), _halved(v["after"], level)
        base, some = _two_to(v["depth"] - level), left < right
        return F.array(F.when(some & (left % 2 == 1), left + base), F.when(some & (right % 2 == 1), right - 1 + base))

    nodes = _once(
        lambda v: F.flatten(F.transform(F.sequence(F.lit(0), v["depth"]), lambda level: ends(v, level))),
        first=first, after=last + 1, depth=depth,
    )
    return F.array_compact(nodes)


def facts_as_of(versions: DataFrame, instants: DataFrame, order: list[str]) -> DataFrame:
    """The latest version of each fact that was valid at each instant."""
    return skew.first_per_key(as_of_join(versions, instants), ["vault", "fact_key", "at"], [F.desc(c) for c in order])


def entity_as_of(entities: DataFrame, edges: DataFrame, at) -> DataFrame:
    """Each entity with its edges at an instant, one row per edge end."""
    live = edges_as_of(edges, at)
    ends = live.select("vault", F.col("source_id").alias("id"), F.col("id").alias("edge_id"), F.lit("out").alias("direction")).unionByName(
        live.select("vault", F.col("target_id").alias("id"), F.col("id").alias("edge_id"), F.lit("in").alias("direction"))
    )
    return entities.join(ends, ["vault", "id"], "left")


def route_to_vault(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Vault of each repository URL: an exact rule, else the longest rule that is a
    suffix after ``/``, ``.`` or ``:``. Suffixes become keys of an equi join."""
    url = F.col("repo_url")
    cuts = F.filter(F.sequence(F.lit(1), F.length(url)), lambda i: F.substr(url, i, F.lit(1)).isin("/", ".", ":"))
    keys = F.array_distinct(F.concat(F.array(url), F.transform(cuts, lambda i: F.substr(url, i + 1))))
    chosen = (
        events.select("repo_url").distinct()
        .select("repo_url", F.explode(keys).alias("pattern"))
        .join(rules.select("pattern", "vault"), "pattern")
        .groupBy("repo_url")
        .agg(F.max_by("vault", F.struct(F.length("pattern"), "vault")).alias("vault"))
    )
    return events.join(chosen, "repo_url", "left")


def stats(entities: DataFrame, edges: DataFrame) -> DataFrame:
    n = entities.agg(F.count(F.lit(1)).alias("n")).scalar()
    return edges.agg(
        F.count(F.lit(1)).alias("edges"), F.count_if(F.col("invalidated_at").isNotNull()).alias("invalidated")
    ).select(n.alias("entities"), "edges", "invalidated")
