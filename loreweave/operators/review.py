"""The review queue: why a fact waits, decisions on it, and what decisions teach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave import skew
from loreweave.functions import clock
from loreweave.functions import facts as ff
from loreweave.operators.facts import IDENTITY, reconsolidation

REASONS = ["stale", "contradiction", "low_confidence", "supersession", "unread"]


def reason_conditions(as_of, low_confidence: float = 0.5) -> dict[str, Column]:
    now = clock.instant(as_of)

    def older(c: str) -> Column:
        return clock.days_between(F.col(c), now) > 30

    reads = F.coalesce("access_count", F.lit(0))
    never = (reads == 0) & F.col("created_at").isNotNull()
    return {
        "stale": F.col("expires_at") < now,
        "contradiction": (F.size("contradicts") > 0) & ~F.coalesce("conflict_resolved", F.lit(False)),
        "low_confidence": F.col("confidence") < low_confidence,
        "supersession": ff.present(F.col("supersedes")),
        "unread": F.when(never, older("created_at")).otherwise(
            F.col("last_accessed_at").isNotNull() & older("last_accessed_at")
        ),
    }


def queue(
    facts: DataFrame,
    as_of,
    low_confidence: float = 0.5,
    reason: str | None = None,
    tag: str | None = None,
    source_type: str | None = None,
    max_confidence: float | None = None,
) -> DataFrame:
    """Facts waiting for review with ``reasons``, the conditions that hold now."""
    rows = facts.filter(
        (F.col("status") == "needs_review") & ff.present(F.col("fact_key")) & ff.present(F.col("fact_value"))
    )
    if tag:
        rows = rows.filter(F.array_contains("tags", tag))
    if source_type:
        rows = rows.filter(F.col("source_type") == source_type)
    if max_confidence is not None:
        rows = rows.filter(F.col("confidence") < max_confidence)
    conditions = reason_conditions(as_of, low_confidence)
    wanted = [r for r in REASONS if reason in (None, "all", r)]
    found = F.filter(F.array(*[F.when(conditions[r], F.lit(r)) for r in wanted]), lambda r: r.isNotNull())
    return rows.withColumn("reasons", found)


def queue_reasons(queue_rows: DataFrame) -> DataFrame:
    return queue_rows.select(*IDENTITY, F.explode("reasons").alias("reason"))


def stats(facts: DataFrame, as_of, low_confidence: float = 0.5, half_life: float = ff.HALF_LIFE_DAYS) -> DataFrame:
    """Counts of the queue in total, by reason and by source type, one row each.

    A missing confidence counts as zero here, so such facts are low-confidence.
    """
    now = clock.instant(as_of)
    base = facts.filter(F.col("status") == "needs_review").withColumn("confidence", ff.number("confidence"))
    flat = queue(
        base.withColumns({"fact_value": F.lit("-"), "fact_key": F.lit("-")}), as_of, low_confidence
    ).select(
        F.when(ff.present(F.col("source_type")), F.col("source_type")).otherwise("unknown").alias("source_type"),
        F.filter("reasons", lambda r: r != "unread").alias("reasons"),
        "created_at",
        clock.days_between(F.col("created_at"), now).alias("pending"),
        ff.accessibility(as_of, half_life).alias("accessibility"),
    )
    labels = F.concat(
        F.array(
            F.struct(F.lit("total").alias("grouping"), F.lit("").alias("label")),
            F.struct(F.lit("source_type").alias("grouping"), F.col("source_type").alias("label")),
        ),
        F.transform("reasons", lambda r: F.struct(F.lit("reason").alias("grouping"), r.alias("label"))),
    )
    return (
        flat.withColumn("g", F.explode(labels))
        .groupBy("g.grouping", "g.label")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("created_at").alias("oldest"),
            F.avg(F.coalesce("pending", F.lit(0.0))).alias("avg_pending_days"),
            F.avg("accessibility").alias("avg_accessibility"),
        )
    )


def resolve(facts: DataFrame, decisions: DataFrame, as_of, window_minutes: int = 30) -> DataFrame:
    """New snapshot after ``decisions``, one per (vault, key) at most.

    Decision columns: ``action`` and, optionally, new_key, new_value, confidence,
    conflict_resolved, ttl_days, tags, source, source_type.
    """
    now = clock.instant(as_of)
    kinds = {
        "action": "string", "new_key": "string", "new_value": "string", "confidence": "double",
        "conflict_resolved": "boolean", "ttl_days": "int", "tags": "array<string>", "source": "string",
        "source_type": "string",
    }
    given = decisions.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in decisions.columns})
    joined = ff.with_fact_columns(facts).join(
        given.select(*IDENTITY, F.struct(*kinds).alias("d")), IDENTITY, "left"
    )
    action, d = F.col("d.action"), (lambda c: F.col(f"d.{c}"))
    confirm, supersede = action == "confirm", action == "supersede"
    reject, reclassify = action == "reject", action == "reclassify"
    any_ = confirm | supersede | reject | reclassify
    keep = confirm | reclassify
    stamped = reconsolidation(as_of, window_minutes)
    fresh_tags = reclassify & d("tags").isNotNull()
    fresh_ttl = reclassify & d("ttl_days").isNotNull()

    def put(cond: Column, value: Column, old: str) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), value).otherwise(F.col(old))

    changed = joined.withColumns(
        {
            "status": F.when(keep, "active").when(supersede, "superseded").when(reject, "rejected").otherwise(F.col("status")),
            "last_confirmed_at": put(confirm, now, "last_confirmed_at"),
            "confirmation_count": put(confirm, F.coalesce("confirmation_count", F.lit(0)) + 1, "confirmation_count"),
            "confidence": put(keep & d("confidence").isNotNull(), d("confidence"), "confidence"),
            "conflict_resolved": put(keep & d("conflict_resolved").isNotNull(), d("conflict_resolved"), "conflict_resolved"),
            "supersedes": put(supersede & ff.present(d("new_key")), d("new_key"), "supersedes"),
            "ttl_days": put(fresh_ttl, d("ttl_days"), "ttl_days"),
            "expires_at": put(fresh_ttl, ff.expires_at(now, d("ttl_days")), "expires_at"),
            "tags": put(fresh_tags, d("tags"), "tags"),
            "source": put(reclassify & ff.present(d("source")), d("source"), "source"),
            "source_type": put(reclassify & ff.present(d("source_type")), d("source_type"), "source_type"),
            "updated_at": put(any_, now, "updated_at"),
            **{c: put(supersede | reject, v, c) for c, v in stamped.items()},
        }
    )
    columns = list(ff.FACT_COLUMNS)
    born = (
        joined.filter((action == "supersede") & ff.present(d("new_key")) & ff.present(d("new_value")))
        .select(
            "vault",
            d("new_key").alias("fact_key"),
            d("new_value").alias("fact_value"),
            "source",
            "source_type",
            "tags",
            F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
            F.lit("active").alias("status"),
            F.lit("").alias("supersedes"),
            F.array().cast("array<string>").alias("contradicts"),
            F.lit(True).alias("conflict_resolved"),
            F.lit(1).alias("confirmation_count"),
            now.alias("last_confirmed_at"),
            now.alias("created_at"),
            now.alias("updated_at"),
            F.lit(0).alias("ttl_days"),
        )
    )
    born = skew.first_per_key(born, IDENTITY, [F.col("fact_value")])
    born = ff.with_fact_columns(born).select(*columns)
    old = changed.select(*columns).join(born.select(*IDENTITY), IDENTITY, "left_anti")
    return old.unionByName(born)


def resolution_log(decisions: DataFrame, as_of) -> DataFrame:
    """Rows to append to the resolution history."""
    return decisions.select(
        "fact_key",
        "action",
        F.lit("manual").alias("reason_type"),
        F.lit(None).cast("double").alias("similarity"),
        clock.instant(as_of).alias("created_at"),
    )


def threshold_recommendations(resolutions: DataFrame, min_samples: int = 3) -> DataFrame:
    """Accept rate per reason and the threshold it suggests."""
    # Current threshold, the raised/lowered values, by reason.
    rules = {"conflict": (0.85, 0.90, 0.80), "low_confidence": (0.5, 0.4, 0.6)}
    rates = (
        resolutions.groupBy("reason_type")
        .agg(
            F.count(F.lit(1)).alias("sample_size"),
            F.count_if(F.col("action").isin("confirm", "reclassify")).alias("accepted"),
            F.count_if(F.col("action") == "reject").alias("rejected"),
        )
        .filter(F.col("sample_size") >= min_samples)
        .withColumn("accept_rate", F.col("accepted") / F.col("sample_size"))
        .withColumn("reject_rate", F.col("rejected") / F.col("sample_size"))
    )
    current, recommended = F.lit(0.0), F.lit(0.0)
    for reason, (now, on_reject, on_accept) in rules.items():
        is_it = F.col("reason_type") == reason
        current = F.when(is_it, now).otherwise(current)
        recommended = F.when(
            is_it,
            F.when(F.col("reject_rate") > 0.3, on_reject).when(F.col("accept_rate") > 0.85, on_accept).otherwise(now),
        ).otherwise(recommended)
    return (
        rates.withColumn("current", current)
        .withColumn("recommended", recommended)
        .withColumn("auto_apply", (F.col("recommended") != F.col("current")) & (F.col("recommended") != 0))
    )
