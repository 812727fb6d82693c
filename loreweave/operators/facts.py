"""Writing, changing and presenting facts. A write produces a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave import skew
from loreweave.functions import clock, text
from loreweave.functions import facts as ff

IDENTITY = ["vault", "fact_key"]
MAX_KEY_BYTES = 1024
MAX_VALUE_BYTES = 64 * 1024

# Columns a caller may change by a patch.
PATCHABLE = [
    "fact_value", "source", "source_type", "status", "supersedes", "refines", "supports", "confidence",
    "conflict_resolved", "confirmation_count", "last_confirmed_at", "valid_from", "valid_until", "ttl_days", "tags",
]

# Columns only the store sets; an upsert carries them over from the old row.
CARRIED = [
    "status", "supersedes", "refines", "superseded_by", "access_count", "conflict_resolved",
    "last_accessed_at", "contradicts", "supports",
]


def validate(incoming: DataFrame) -> DataFrame:
    """Add ``error``: NULL for rows that may be written."""
    key, value = F.col("fact_key"), F.col("fact_value")
    return incoming.withColumn(
        "error",
        F.when(~ff.present(key) | ~ff.present(value), "INVALID_INPUT")
        .when(F.octet_length(key) > MAX_KEY_BYTES, "KEY_TOO_LONG")
        .when(F.octet_length(value) > MAX_VALUE_BYTES, "VALUE_TOO_LARGE"),
    )


def reconsolidation(as_of, window_minutes: int = 30) -> dict[str, Column]:
    """Stamp and chain entry for a change that follows a recall within the window."""
    now = clock.instant(as_of)
    since = clock.micros_between(F.col("last_recalled_at"), now)
    due = F.coalesce((since >= 0) & (since <= window_minutes * 60_000_000), F.lit(False))
    chain = F.coalesce("reconsolidation_chain", F.array().cast("array<timestamp_ntz>"))
    return {
        "reconsolidated_at": F.when(due, now).otherwise(F.col("reconsolidated_at")),
        "reconsolidation_chain": F.when(due, F.array_append(chain, now)).otherwise(F.col("reconsolidation_chain")),
    }


def reconsolidate(facts: DataFrame, updates: DataFrame, window_minutes: int = 30) -> DataFrame:
    """Apply the reconsolidation rule at ``updates(vault, fact_key, updated_at)``."""
    base = ff.with_fact_columns(facts, ["last_recalled_at", "reconsolidated_at", "reconsolidation_chain"])
    last = updates.groupBy(*IDENTITY).agg(F.max("updated_at").alias("_at"))
    joined = base.join(last, IDENTITY, "left")
    return joined.withColumns(reconsolidation(F.col("_at"), window_minutes)).drop("_at")


def upsert(facts: DataFrame, incoming: DataFrame, as_of, order: list[str]) -> DataFrame:
    """Last write per (vault, key) wins; lifecycle columns of the old row survive.

    Both sides are unique per key after the de-duplication, so the full join moves
    each row once and no key can be hot.
    """
    now = clock.instant(as_of)
    given = skew.first_per_key(incoming, IDENTITY, [F.desc(c) for c in order])
    given = ff.with_fact_columns(given).select(*IDENTITY, F.struct(*ff.FACT_COLUMNS).alias("n"))
    held = ff.with_fact_columns(facts).select(*IDENTITY, F.struct(*ff.FACT_COLUMNS).alias("o"))
    both = held.join(given, IDENTITY, "full_outer")

    new, old = (lambda c: F.col(f"n.{c}")), (lambda c: F.col(f"o.{c}"))
    created = F.coalesce(old("created_at"), now)
    ttl = F.coalesce(new("ttl_days"), F.lit(0))
    key = F.col("fact_key")
    written = {c: new(c) for c in ff.FACT_COLUMNS}
    written |= {c: old(c) for c in CARRIED}
    written |= {
        "created_at": created,
        "updated_at": now,
        "status": F.when(ff.present(old("status")), old("status")).otherwise("active"),
        "conflict_resolved": F.coalesce(old("conflict_resolved"), F.lit(False)),
        "last_confirmed_at": F.coalesce(old("last_confirmed_at"), now),
        "confirmation_count": F.when(old("confirmation_count") > 0, old("confirmation_count")).otherwise(1),
        "superseded_by": F.coalesce(old("superseded_by"), F.lit(0)),
        "access_count": F.coalesce(old("access_count"), F.lit(0)),
        "confidence": ff.clamp_confidence(new("confidence")),
        "ttl_days": ttl,
        "expires_at": ff.expires_at(now, ttl),
        "version": F.when(new("version") > 0, new("version")).otherwise(text.version_of_key(key)),
        "key_prefix": text.key_prefix(key),
        "valid_from": F.coalesce(new("valid_from"), created),
    }
    kept = F.col("n").isNull()
    return both.select(
        *IDENTITY,
        *[F.when(kept, old(c)).otherwise(written[c]).alias(c) for c in ff.FACT_COLUMNS if c not in IDENTITY],
    )


def update(
    facts: DataFrame, patches: DataFrame, as_of, order: list[str] | None = None, window_minutes: int | None = None
) -> DataFrame:
    """Change only the columns a patch sets (non-NULL). Unknown keys are ignored."""
    now = clock.instant(as_of)
    base = ff.with_fact_columns(facts)
    fields = [c for c in PATCHABLE if c in patches.columns]
    if order:
        patches = skew.first_per_key(patches, IDENTITY, [F.desc(c) for c in order])
    set_ = patches.select(*IDENTITY, F.struct(*fields).alias("p"))
    joined = base.join(set_, IDENTITY, "left")
    hit = F.col("p").isNotNull()
    changes = {c: F.coalesce(F.col(f"p.{c}"), F.col(c)) for c in fields}
    if "ttl_days" in fields:
        ttl = F.col("p.ttl_days")
        changes["expires_at"] = F.when(ttl.isNotNull(), ff.expires_at(now, ttl)).otherwise(F.col("expires_at"))
    changes["updated_at"] = F.when(hit, now).otherwise(F.col("updated_at"))
    if window_minutes is not None:
        stamped = reconsolidation(as_of, window_minutes)
        changes |= {c: F.when(hit, v).otherwise(F.col(c)) for c, v in stamped.items()}
    return joined.withColumns(changes).drop("p")


def bulk_patch(facts: DataFrame, keys: DataFrame, patch: dict, as_of) -> tuple[DataFrame, DataFrame]:
    """One patch for many keys: the new snapshot, and one outcome row per key."""
    wanted = keys.select(*IDENTITY).distinct()
    values = {c: F.lit(v).cast(ff.FACT_COLUMNS[c]) for c, v in patch.items()}
    snapshot = update(facts, wanted.withColumns(values), as_of)
    known = facts.select(*IDENTITY).distinct().withColumn("_known", F.lit(True))
    outcome = wanted.join(known, IDENTITY, "left").select(
        *IDENTITY,
        F.coalesce("_known", F.lit(False)).alias("ok"),
        F.when(F.col("_known").isNull(), "NOT_FOUND").alias("error"),
    )
    return snapshot, outcome


def delete(facts: DataFrame, keys: DataFrame) -> DataFrame:
    return facts.join(keys.select(*IDENTITY).distinct(), IDENTITY, "left_anti")


def present_facts(facts: DataFrame, as_of, half_life: float = ff.HALF_LIFE_DAYS) -> DataFrame:
    """Response projection: status default and the two decayed scores."""
    return facts.withColumns(
        {
            "status": F.when(ff.present(F.col("status")), F.col("status")).otherwise("active"),
            "accessibility": ff.accessibility(as_of, half_life),
            "effective_confidence": ff.effective_confidence(as_of, half_life),
        }
    )


def backfill_defaults(facts: DataFrame, as_of) -> DataFrame:
    """Fill lifecycle columns that older rows lack."""
    now = clock.instant(as_of)
    base = ff.with_fact_columns(facts)
    empty = F.array().cast("array<string>")
    touched = F.coalesce("updated_at", now)
    defaults = {
        "status": F.lit("active"), "confidence": F.lit(1.0), "source_type": F.lit("manual"),
        "conflict_resolved": F.lit(True), "confirmation_count": F.lit(1), "created_at": touched,
        "last_confirmed_at": touched, "supersedes": F.lit(""), "key_prefix": text.key_prefix(F.col("fact_key")),
        "contradicts": empty, "source": F.lit(""), "ttl_days": F.lit(0),
        "version": text.version_of_key(F.col("fact_key")), "superseded_by": F.lit(0),
        "refines": F.lit(""), "supports": empty,
    }
    return base.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def history(facts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Created, updated, then review decisions; order by (fact_key, stage, at)."""

    def stage(df: DataFrame, n: int, event: Column, at: str) -> DataFrame:
        return df.filter(F.col(at).isNotNull()).select(
            "fact_key", F.lit(n).alias("stage"), event.alias("event"), F.col(at).alias("at")
        )

    known = facts.select("fact_key").distinct()
    return (
        stage(facts, 0, F.lit("created"), "created_at")
        .unionByName(stage(facts, 1, F.lit("updated"), "updated_at"))
        .unionByName(stage(resolutions.join(known, "fact_key", "left_semi"), 2, F.col("action"), "created_at"))
    )


def provenance_links(facts: DataFrame) -> DataFrame:
    """One resolvable link per fact that names a source."""
    return facts.filter(ff.present(F.col("source"))).select(
        "vault",
        F.concat(F.lit("fact:"), F.col("fact_key")).alias("source_path"),
        F.col("source").alias("target_path"),
        F.lit("provenance").alias("link_type"),
        F.concat(F.lit("fact: "), F.col("fact_key")).alias("context"),
    )


def provenance(facts: DataFrame, links: DataFrame) -> DataFrame:
    """Each fact with the target of its provenance link, when there is one."""
    targets = (
        links.filter(F.col("link_type") == "provenance")
        .groupBy("vault", F.col("source_path").alias("_node"))
        .agg(F.min("target_path").alias("target"))
    )
    base = ff.with_fact_columns(facts, ["related_chunks"])
    return (
        base.withColumn("_node", F.concat(F.lit("fact:"), F.col("fact_key")))
        .join(targets, ["vault", "_node"], "left")
        .select(
            "vault", "fact_key", "fact_value", "source", "source_type", "created_at", "updated_at", "related_chunks",
            "target", ff.present(F.col("target")).alias("resolved"),
        )
    )
