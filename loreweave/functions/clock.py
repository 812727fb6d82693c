"""Time without the wall clock. All table times are zone-less UTC timestamps."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

def instant(as_of) -> Column:
    """``as_of`` given as a column, a datetime or an ISO string."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, datetime):
        as_of = as_of.isoformat(sep=" ")
    return F.lit(str(as_of)).cast("timestamp_ntz")


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def days_between(start: Column, end: Column) -> Column:
    """Fractional days from ``start`` to ``end``."""
    return micros_between(start, end) / F.lit(86_400_000_000.0)


def hours_between(start: Column, end: Column) -> Column:
    return micros_between(start, end) / F.lit(3_600_000_000.0)


def plus_days(start: Column, days: Column) -> Column:
    return start + F.make_dt_interval(days=days.cast("int"))


def parse_instant(text: Column) -> Column:
    """RFC 3339 or plain date text to a UTC timestamp; NULL when it is neither."""
    has_zone = text.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    offset = F.regexp_extract(text, r"([+-])(\d\d):?(\d\d)$", 0)
    sign = F.when(F.startswith(offset, F.lit("-")), F.lit(-1)).otherwise(F.lit(1))
    minutes = sign * (
        F.coalesce(F.regexp_extract(offset, r"(\d\d):?(\d\d)$", 1).try_cast("int"), F.lit(0)) * 60
        + F.coalesce(F.regexp_extract(offset, r"(\d\d):?(\d\d)$", 2).try_cast("int"), F.lit(0))
    )
    local = F.regexp_replace(text, r"(Z|[+-]\d\d:?\d\d)$", "").try_cast("timestamp_ntz")
    plain = text.try_cast("timestamp_ntz")
    timed = text.contains("T") & has_zone
    return F.when(timed, local - F.make_dt_interval(mins=minutes)).when(
        text.rlike(r"^\d{4}-\d{2}-\d{2}$"), plain
    )
