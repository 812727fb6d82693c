"""Maintenance scans over the fact table.

Each scan is a *change set*: ``(vault, fact_key, new_status, reason)`` plus, for
conflicts, the keys to add. Scans are independent; :func:`apply_changes` combines
them under one fixed precedence so their order does not matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave import skew
from loreweave.functions import clock, text
from loreweave.functions import facts as ff
from loreweave.operators.facts import IDENTITY

PRECEDENCE = ["active", "needs_review", "rejected", "superseded"]


def active(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("status") == "active")


def _flag(rows: DataFrame, reason: str, status: str = "needs_review") -> DataFrame:
    return rows.select(*IDENTITY, F.lit(status).alias("new_status"), F.lit(reason).alias("reason"))


def referenced_keys(facts: DataFrame) -> DataFrame:
    """Keys that an active fact points to by one of its four edge columns."""
    base = ff.with_fact_columns(active(facts), ["supersedes", "refines", "contradicts", "supports"])
    none = F.array().cast("array<string>")
    edges = F.concat(
        F.array("supersedes", "refines"), F.coalesce("contradicts", none), F.coalesce("supports", none)
    )
    return (
        base.select("vault", F.explode(edges).alias("fact_key"))
        .filter(ff.present(F.col("fact_key")))
        .distinct()
    )


def unreferenced(facts: DataFrame) -> DataFrame:
    """Active facts no active fact points to."""
    return active(facts).join(referenced_keys(facts), IDENTITY, "left_anti")


def ttl_stale(facts: DataFrame, as_of, importance_threshold: float = 0.0) -> DataFrame:
    """Active facts past their time to live, unless referenced or important enough."""
    due = active(facts).filter((F.col("ttl_days") > 0) & (F.col("expires_at") < clock.instant(as_of)))
    if importance_threshold > 0:
        due = due.filter(ff.importance(as_of) < importance_threshold)
    return _flag(due.join(referenced_keys(facts), IDENTITY, "left_anti"), "stale")


def expired(facts: DataFrame, as_of) -> DataFrame:
    return _flag(active(facts).filter(F.col("valid_until") < clock.instant(as_of)), "expired")


def low_confidence(facts: DataFrame, threshold: float = 0.5) -> DataFrame:
    return _flag(active(facts).filter(F.col("confidence") <= threshold), "low_confidence")


def source_deleted(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Active facts whose source has no chunk left in their vault. The chunk side
    is reduced to distinct sources; a hot source stays splittable on the fact side."""
    alive = chunks.select("vault", F.col("source_file").alias("source")).distinct()
    sourced = active(facts).filter(ff.present(F.col("source")))
    return _flag(sourced.join(alive, ["vault", "source"], "left_anti"), "source_deleted")


def supersede_by_reference(facts: DataFrame) -> DataFrame:
    """Active facts that another fact says it supersedes."""
    targets = (
        facts.filter(ff.present(F.col("supersedes")))
        .select("vault", F.col("supersedes").alias("fact_key"))
        .distinct()
    )
    return _flag(active(facts).join(targets, IDENTITY, "left_semi"), "superseded_by_reference", "superseded")


def supersede_by_version(facts: DataFrame, identity_suffix: bool = False) -> DataFrame:
    """Active versioned facts below the highest active version of their key prefix.

    ``identity_suffix`` also requires what follows the version to be equal.
    """
    group = ["vault", "_prefix", "_suffix"]
    key = F.col("fact_key")
    suffix = F.regexp_extract(key, r"^(?:.*/)?v0*[1-9][0-9]*((?:/.*)?)$", 1) if identity_suffix else F.lit("")
    versioned = (
        active(facts)
        .select(*IDENTITY, text.key_prefix(key).alias("_prefix"), suffix.alias("_suffix"), text.version_of_key(key).alias("_v"))
        .filter(F.col("_v") >= 1)
    )
    older = skew.per_key_max(versioned, group, "_v", "_top").filter(F.col("_v") < F.col("_top"))
    return older.select(
        *IDENTITY,
        F.lit("superseded").alias("new_status"),
        F.lit("superseded_by_version").alias("reason"),
        F.col("_top").alias("superseded_by"),
    )


def supersede_on_write(facts: DataFrame, written: DataFrame, as_of) -> DataFrame:
    """After an upsert: active facts with a lower version than a written key of the
    same prefix become superseded by that version."""
    key = F.col("fact_key")
    newest = (
        written.select("vault", text.key_prefix(key).alias("_prefix"), text.version_of_key(key).alias("_v"))
        .filter((F.col("_v") > 0) & (F.col("_prefix") != ""))
        .groupBy("vault", "_prefix")
        .agg(F.max("_v").alias("_newest"))
    )
    base = ff.with_fact_columns(facts, ["superseded_by", "updated_at"])
    joined = base.withColumn("_prefix", text.key_prefix(key)).join(newest, ["vault", "_prefix"], "left")
    hit = F.coalesce(
        (F.col("status") == "active") & (text.version_of_key(key) < F.col("_newest")), F.lit(False)
    )
    return joined.withColumns(
        {
            "status": F.when(hit, "superseded").otherwise(F.col("status")),
            "superseded_by": F.when(hit, F.col("_newest")).otherwise(F.col("superseded_by")),
            "updated_at": F.when(hit, clock.instant(as_of)).otherwise(F.col("updated_at")),
        }
    ).drop("_prefix", "_newest")


def unresolved_conflicts(facts: DataFrame) -> DataFrame:
    open_ = ~F.coalesce(F.col("conflict_resolved"), F.lit(False))
    return facts.filter(open_ & (F.size("contradicts") > 0)).withColumn(
        "fact_value", text.truncate(F.col("fact_value"), 200)
    )


def flag_conflicts(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """New snapshot with the marked side of each pair put up for review.

    ``pairs(vault, fact_key, other_key)`` names the fact to mark and the key it
    contradicts. Pairs come from a bounded sample (see ``vector.conflict_pairs``).
    """
    extra = pairs.groupBy(*IDENTITY).agg(F.array_sort(F.collect_set("other_key")).alias("_more"))
    had = F.coalesce("contradicts", F.array().cast("array<string>"))
    hit = F.size(F.array_except(F.coalesce("_more", F.array().cast("array<string>")), had)) > 0
    return (
        facts.join(extra, IDENTITY, "left")
        .withColumns(
            {
                "status": F.when(hit, "needs_review").otherwise(F.col("status")),
                "conflict_resolved": F.when(hit, False).otherwise(F.col("conflict_resolved")),
                "contradicts": F.when(hit, F.array_union(had, F.col("_more"))).otherwise(F.col("contradicts")),
            }
        )
        .drop("_more")
    )


def change_set(*changes: DataFrame) -> DataFrame:
    """One row per changed fact: the strongest status and how many scans asked."""
    rows = reduce(lambda a, b: a.unionByName(b), [c.select(*IDENTITY, "new_status", "reason") for c in changes])
    rank = F.array_position(F.array(*[F.lit(s) for s in PRECEDENCE]), F.col("new_status"))
    return rows.groupBy(*IDENTITY).agg(
        F.max_by("new_status", rank).alias("new_status"),
        F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"),
    )


def apply_changes(facts: DataFrame, changes: DataFrame, as_of) -> DataFrame:
    """Write a change set; a status never moves to a weaker one."""
    base = ff.with_fact_columns(facts, ["updated_at"])
    order = F.array(*[F.lit(s) for s in PRECEDENCE])
    stronger = F.coalesce(
        F.array_position(order, F.col("new_status")) > F.array_position(order, F.col("status")), F.lit(False)
    )
    return (
        base.join(changes.select(*IDENTITY, "new_status"), IDENTITY, "left")
        .withColumns(
            {
                "status": F.when(stronger, F.col("new_status")).otherwise(F.col("status")),
                "updated_at": F.when(stronger, clock.instant(as_of)).otherwise(F.col("updated_at")),
            }
        )
        .drop("new_status")
    )


def maintain(
    facts: DataFrame, chunks: DataFrame, as_of, confidence: float = 0.5, importance_threshold: float = 0.0
) -> DataFrame:
    """All status scans as one job: table in, next snapshot out."""
    changes = change_set(
        ttl_stale(facts, as_of, importance_threshold),
        expired(facts, as_of),
        low_confidence(facts, confidence),
        source_deleted(facts, chunks),
        supersede_by_reference(facts),
        supersede_by_version(facts),
    )
    return apply_changes(facts, changes, as_of)
