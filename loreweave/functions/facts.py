"""Scores and derived columns of a fact row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.functions import clock

HALF_LIFE_DAYS = 30.0
MAX_STABILITY = 12.0

# Every lifecycle column a fact may carry; absent ones are added as NULL.
FACT_COLUMNS = {
    "vault": "string", "fact_key": "string", "fact_value": "string", "tags": "array<string>",
    "source": "string", "source_type": "string", "category": "string", "confidence": "double",
    "status": "string", "version": "int", "key_prefix": "string", "supersedes": "string",
    "superseded_by": "int", "refines": "string", "contradicts": "array<string>",
    "supports": "array<string>", "conflict_resolved": "boolean", "confirmation_count": "int",
    "access_count": "int", "last_confirmed_at": "timestamp_ntz", "last_accessed_at": "timestamp_ntz",
    "last_recalled_at": "timestamp_ntz", "created_at": "timestamp_ntz", "updated_at": "timestamp_ntz",
    "ttl_days": "int", "expires_at": "timestamp_ntz", "valid_from": "timestamp_ntz",
    "valid_until": "timestamp_ntz", "related_chunks": "array<string>",
    "reconsolidated_at": "timestamp_ntz", "reconsolidation_chain": "array<timestamp_ntz>",
}


def with_fact_columns(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    absent = {n: F.lit(None).cast(FACT_COLUMNS[n]) for n in names or FACT_COLUMNS if n not in df.columns}
    return df.withColumns(absent) if absent else df


def present(c: Column) -> Column:
    """Neither NULL nor empty."""
    return F.coalesce(c != "", F.lit(False))


def number(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def normalize_confidence(c: Column) -> Column:
    """Scores above 1 are on a ten-point scale."""
    unit = F.when(c > 1.0, c / 10.0).otherwise(c)
    return F.greatest(F.lit(0.0), F.least(unit, F.lit(1.0)))


def clamp_confidence(c: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), F.least(c, F.lit(1.0))), F.lit(1.0))


def expires_at(start: Column, ttl_days: Column) -> Column:
    return F.when(ttl_days > 0, clock.plus_days(start, ttl_days))


def stability() -> Column:
    """How much longer than the base half-life a fact stays accessible."""
    total = (
        F.lit(1.0)
        + F.log1p(number("access_count"))
        + F.log1p(number("confirmation_count")) * 1.5
        + normalize_confidence(number("confidence")) * 2.0
        + F.when(number("ttl_days") > 0, F.least(number("ttl_days") / HALF_LIFE_DAYS, F.lit(3.0))).otherwise(0.0)
    )
    return F.least(F.greatest(total, F.lit(1.0)), F.lit(MAX_STABILITY))


def accessibility(as_of, half_life: float = HALF_LIFE_DAYS) -> Column:
    """Exponential decay since the latest of confirmation, access and creation."""
    half_life = half_life if half_life > 0 else HALF_LIFE_DAYS
    anchor = F.greatest("last_confirmed_at", "last_accessed_at", "created_at")
    days = clock.days_between(anchor, clock.instant(as_of))
    kept = F.exp(-days * math.log(2) / (stability() * half_life))
    return F.when(anchor.isNull() | (days <= 0), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(kept, F.lit(1.0))))


def effective_confidence(as_of, half_life: float = HALF_LIFE_DAYS) -> Column:
    base = F.coalesce(normalize_confidence(F.col("confidence")), F.lit(1.0))
    return base * accessibility(as_of, half_life)


def importance(as_of) -> Column:
    """0.3 access + 0.3 recency + 0.2 confirmations + 0.2 confidence, each in [0, 1]."""
    seen = F.coalesce("last_accessed_at", "created_at")
    recency = F.coalesce(
        F.greatest(1.0 - clock.days_between(seen, clock.instant(as_of)) / 365.0, F.lit(0.0)), F.lit(0.0)
    )
    total = (
        0.3 * F.least(number("access_count") / 100.0, F.lit(1.0))
        + 0.3 * recency
        + 0.2 * F.least(number("confirmation_count") / 10.0, F.lit(1.0))
        + 0.2 * normalize_confidence(number("confidence"))
    )
    return F.greatest(F.lit(0.0), F.least(total, F.lit(1.0)))
