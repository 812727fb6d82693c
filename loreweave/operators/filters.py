"""Projections, predicates, paging and listings over facts, chunks, logs, sessions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.functions import clock, text

RESERVED_PREFIX = "_system/"


# ── predicates ────────────────────────────────────────────────────────────────
def keyword(column: str, value) -> Column:
    """Equality; on a list column it means membership (``list_has``)."""
    return F.col(column) == F.lit(value)


def list_has(column: str, value) -> Column:
    return F.array_contains(F.col(column), F.lit(value))


def number_range(column: str, gt=None, gte=None, lt=None, lte=None) -> Column:
    c = F.col(column)
    parts = []
    if gt is not None:
        parts.append(c > F.lit(gt))
    if gte is not None:
        parts.append(c >= F.lit(gte))
    if lt is not None:
        parts.append(c < F.lit(lt))
    if lte is not None:
        parts.append(c <= F.lit(lte))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def time_range(column: str, since=None, until=None) -> Column:
    return number_range(
        column,
        gte=None if since is None else clock.instant(since),
        lte=None if until is None else clock.instant(until),
    )


def prefix(column: str, value: str) -> Column:
    return F.startswith(F.col(column), F.lit(value))


def missing(column: str) -> Column:
    return F.col(column).isNull()


def build_filter(
    must: Iterable[Column] = (), should: Iterable[Column] = (), must_not: Iterable[Column] = ()
) -> Column:
    """All of ``must``, at least one of ``should`` (when given), none of ``must_not``.

    NULL counts as "does not match" for each condition, so trees can be nested.
    """

    def sure(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    parts = [sure(c) for c in must] + [~sure(c) for c in must_not]
    options = [sure(c) for c in should]
    if options:
        parts.append(reduce(lambda a, b: a | b, options))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def recall_filter(path_prefix=None, tags: Iterable[str] = (), date_from=None, date_to=None) -> Column:
    """Filter of a recall request: source prefix, every tag, time of last update."""
    must = [list_has("tags", t) for t in tags]
    if path_prefix:
        must.append(prefix("source_file", path_prefix))
    if date_from is not None or date_to is not None:
        must.append(time_range("file_last_updated", date_from, date_to))
    return build_filter(must=must)


def active_at(mode: str, now, start: str = "valid_from", end: str = "valid_until") -> Column:
    """``active`` (or empty), ``active_at:<time>`` or ``all``, on a half-open interval."""
    if mode == "all":
        return F.lit(True)
    if mode in ("", "active"):
        at = clock.instant(now)
    elif mode.startswith("active_at:"):
        at = clock.parse_instant(F.lit(mode.split(":", 1)[1]))
    else:
        raise ValueError(f"unknown time filter mode {mode!r}")
    return valid_at(at, start, end)


def valid_at(at: Column, start: str = "valid_from", end: str = "valid_until") -> Column:
    return (F.col(start).isNull() | (F.col(start) <= at)) & (F.col(end).isNull() | (at < F.col(end)))


# ── paging and lookups ────────────────────────────────────────────────────────
def scroll(df: DataFrame, key: str, limit: int, after=None, where: Column | None = None) -> DataFrame:
    """One keyset page in key order. ``is_next`` marks the extra row whose key is
    the cursor of the following page."""
    page = df if where is None else df.filter(where)
    if after is not None:
        page = page.filter(F.col(key) > F.lit(after))
    page = page.orderBy(key).limit(limit + 1)
    rank = F.row_number().over(_one_page(key))
    return page.withColumn("is_next", rank > F.lit(limit))


def _one_page(key: str):
    from pyspark.sql import Window

    return Window.orderBy(key)


def get_by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is listed; the size of ``ids`` decides the join strategy."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value))


# ── listings ──────────────────────────────────────────────────────────────────
def detail(df: DataFrame, level: str) -> DataFrame:
    """``l0`` hides text and first paragraph, ``l1`` the text, ``l2`` nothing."""
    out = df
    if level in ("l0", "l1"):
        out = out.withColumn("text", F.lit(""))
    if level == "l0":
        out = out.withColumn("first_paragraph", F.lit(""))
    return out


def list_facts(
    facts: DataFrame,
    now,
    tag: str | None = None,
    status: str | None = None,
    conflict_resolved: bool | None = None,
    time: str = "active",
    key_prefix: str = "",
    key_contains: str = "",
    reserved: str = RESERVED_PREFIX,
) -> DataFrame:
    must = [active_at(time, now)]
    if tag:
        must.append(list_has("tags", tag))
    if status:
        must.append(keyword("status", status))
    if conflict_resolved is not None:
        must.append(keyword("conflict_resolved", conflict_resolved))
    if key_prefix:
        must.append(prefix("fact_key", key_prefix))
    if key_contains:
        must.append(F.col("fact_key").contains(key_contains))
    return facts.filter(build_filter(must=must, must_not=[prefix("fact_key", reserved)]))


def list_chunks(chunks: DataFrame) -> DataFrame:
    """Summary columns of the chunks; text and vector are not read."""
    want = ["vault", "chunk_id", "source_file", "chunk_index", "header", "file_last_updated"]
    return chunks.select(*[c for c in want if c in chunks.columns])


def list_logs(
    logs: DataFrame, limit: int, agent=None, type_=None, tag=None, since=None, until=None, before: str | None = None
) -> DataFrame:
    """Newest entries first; ``cursor`` is the id as 16 hex digits."""
    must = []
    if agent:
        must.append(keyword("agent", agent))
    if type_:
        must.append(keyword("type", type_))
    if tag:
        must.append(list_has("tags", tag))
    if since is not None or until is not None:
        must.append(time_range("created_at", since, until))
    if before is not None:
        must.append(F.col("id") < F.lit(int(before, 16)))
    page = logs.filter(build_filter(must=must)).orderBy(F.desc("id")).limit(limit)
    return page.withColumn("cursor", F.lower(F.lpad(F.hex("id"), 16, "0")))


def list_sessions(sessions: DataFrame, limit: int, offset: int = 0, vault: str | None = None) -> DataFrame:
    live = sessions.filter(~F.coalesce(F.col("archived"), F.lit(False)))
    if vault:
        live = live.filter(keyword("vault", vault))
    return live.orderBy(F.desc("updated_at"), "session_id").offset(offset).limit(limit)


def distinct_paths(links: DataFrame) -> DataFrame:
    return links.select(F.col("source_path").alias("path")).distinct()


def is_indexable(listing: DataFrame, path: str = "path") -> DataFrame:
    """Flag each path under both extension profiles."""
    return listing.withColumn("in_vault", text.is_indexable(F.col(path), "vault")).withColumn(
        "in_documents", text.is_indexable(F.col(path), "documents")
    )
