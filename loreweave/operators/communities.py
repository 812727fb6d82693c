"""Communities of the entity graph by modularity, as DataFrame passes.

Edges are ``(u, v, w)`` with each undirected edge once; a self loop is ``u = v``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.session import durable


def undirected(edges: DataFrame) -> DataFrame:
    """Current edges between entities as weighted undirected pairs."""
    pair = edges.select(
        F.least("source_id", "target_id").alias("u"), F.greatest("source_id", "target_id").alias("v")
    )
    return pair.groupBy("u", "v").agg(F.count(F.lit(1)).cast("double").alias("w"))


def degrees(edges: DataFrame) -> DataFrame:
    """Weighted degree per node; a self loop counts twice."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("node"), "w")
    return ends.groupBy("node").agg(F.sum("w").alias("k"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row ``q``: share of inner weight minus what degrees alone would give."""
    lu = labels.select(F.col("node").alias("u"), F.col("label").alias("_lu"))
    lv = labels.select(F.col("node").alias("v"), F.col("label").alias("_lv"))
    inner = edges.join(lu, "u").join(lv, "v").agg(
        F.sum(F.when(F.col("_lu") == F.col("_lv"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("m")
    )
    spread = (
        degrees(edges).join(labels, "node").groupBy("label").agg(F.sum("k").alias("k"))
        .agg(F.sum(F.col("k") * F.col("k")).alias("squares"))
    )
    squares = spread.scalar()
    m = F.col("m")
    return inner.select(F.when(m > 0, F.col("inside") / m - squares / (4 * m * m)).otherwise(0.0).alias("q"))


def aggregate_graph(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Collapse nodes to their labels; inner weight becomes a self loop, so the total
    weight stays."""
    lu = labels.select(F.col("node").alias("u"), F.col("label").alias("_lu"))
    lv = labels.select(F.col("node").alias("v"), F.col("label").alias("_lv"))
    return (
        edges.join(lu, "u").join(lv, "v")
        .groupBy(F.least("_lu", "_lv").alias("u"), F.greatest("_lu", "_lv").alias("v"))
        .agg(F.sum("w").alias("w"))
    )


def _score(edges: DataFrame, labels: DataFrame) -> float:
    return modularity(edges, labels).first()["q"] or 0.0


def _move(edges: DataFrame, degree: DataFrame, labels: DataFrame, total: float, upward: bool) -> DataFrame:
    """One synchronous pass: every node looks for the neighbouring label with the best
    gain; only moves towards larger (or smaller) labels are made, so two nodes never
    swap. Weights to a label are partially summed before any shuffle by node."""
    both = edges.filter("u <> v")
    both = both.select("u", "v", "w").unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    near = (
        both.join(labels.select(F.col("node").alias("v"), "label"), "v")
        .groupBy(F.col("u").alias("node"), "label")
        .agg(F.sum("w").alias("w"))
    )
    own = labels.select("node", "label", F.lit(0.0).alias("w"))
    options = near.unionByName(own).groupBy("node", "label").agg(F.sum("w").alias("w"))
    sums = degree.join(labels, "node").groupBy("label").agg(F.sum("k").alias("total"))
    mine = degree.join(labels.select("node", F.col("label").alias("mine")), "node")
    stays = F.col("label") == F.col("mine")
    gain = F.col("w") - (F.col("total") - F.when(stays, F.col("k")).otherwise(0.0)) * F.col("k") / F.lit(total)
    scored = options.join(sums, "label").join(mine, "node").withColumn("gain", F.round(gain, 9))
    best = scored.groupBy("node", "mine").agg(
        F.max(F.when(stays, F.col("gain"))).alias("stay"), F.max(F.struct("gain", "label")).alias("top")
    )
    better = F.col("top.gain") > F.col("stay") + 1e-9
    way = F.col("top.label") > F.col("mine") if upward else F.col("top.label") < F.col("mine")
    return best.select("node", F.when(better & way, F.col("top.label")).otherwise(F.col("mine")).alias("label"))


def detect(edges: DataFrame, nodes: DataFrame, max_levels: int = 10, max_passes: int = 20, tolerance: float = 1e-4) -> DataFrame:
    """``(node, label)`` for every node: local moves, collapse, repeat.

    A pass is kept only when modularity rises, so the result is never worse than all
    nodes apart; nodes without edges stay alone. Each pass is checkpointed. The label
    of a community is its smallest member.
    """
    level = durable(edges)
    all_nodes = nodes.select("node").distinct()
    member = durable(all_nodes.select("node", F.col("node").alias("label")))
    total = 2 * (level.agg(F.sum("w")).first()[0] or 0.0)
    if total == 0:
        return member
    quality = _score(level, durable(degrees(level).select("node", F.col("node").alias("label"))))
    for _ in range(max_levels):
        degree = durable(degrees(level))
        labels = degree.select("node", F.col("node").alias("label"))
        start, misses, upward = quality, 0, False
        for _ in range(max_passes):
            moved = durable(_move(level, degree, labels, total, upward))
            score = _score(level, moved)
            if score > quality + tolerance:
                labels, quality, misses = moved, score, 0
            else:
                misses += 1
                if misses == 2:
                    break
            upward = not upward
        if quality <= start + tolerance:
            break
        step = labels.withColumnRenamed("node", "_at").withColumnRenamed("label", "_to")
        member = durable(
            member.join(step, member["label"] == step["_at"], "left").select("node", F.coalesce("_to", "label").alias("label"))
        )
        level = durable(aggregate_graph(level, labels))
    names = member.groupBy("label").agg(F.min("node").alias("name"))
    return member.join(names, "label").select("node", F.col("name").alias("label"))


def by_size(labels: DataFrame) -> DataFrame:
    """Communities with their size, largest first; members stay in the label table."""
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "label")


def community_context(labels: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """What a summariser needs of each community, one line per row: member names and
    the facts of edges inside it."""
    names = labels.join(entities.select(F.col("id").alias("node"), "name"), "node").filter(F.col("name") != "")
    ls = labels.select(F.col("node").alias("source_id"), "label")
    lt = labels.select(F.col("node").alias("target_id"), F.col("label").alias("_other"))
    inner = edges.join(ls, "source_id").join(lt, "target_id").filter(
        (F.col("label") == F.col("_other")) & (F.trim(F.coalesce("fact", F.lit(""))) != "")
    )
    return names.select("label", F.lit("entity").alias("kind"), F.col("name").alias("line")).unionByName(
        inner.select("label", F.lit("fact").alias("kind"), F.col("fact").alias("line"))
    )
