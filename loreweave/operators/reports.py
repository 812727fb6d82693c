"""Statistics, health reports and audits over the engine's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave import skew
from loreweave.functions import clock, text
from loreweave.functions import facts as ff
from loreweave.operators import review, vector
from loreweave.operators.links import scope_of


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


# ── vaults, agents, logs ──────────────────────────────────────────────────────
def vault_stats(chunks: DataFrame, approximate: bool = False) -> DataFrame:
    files = F.approx_count_distinct("source_file") if approximate else F.count_distinct("source_file")
    return chunks.groupBy("vault").agg(
        F.count(F.lit(1)).alias("chunks"), files.alias("files"), F.max("file_last_updated").alias("last_updated")
    )


def coverage_gaps(chunks: DataFrame, min_files: int = 10) -> DataFrame:
    return vault_stats(chunks).filter(F.col("files") < min_files).withColumn("severity", F.lit("low_coverage"))


def agent_stats(facts: DataFrame) -> DataFrame:
    """Facts per source, mean confidence and share flagged for review."""
    agent = F.when(ff.present(F.col("source")), F.col("source")).otherwise("unknown")
    return (
        facts.groupBy(agent.alias("agent"))
        .agg(
            F.count(F.lit(1)).alias("facts_written"),
            F.avg(ff.number("confidence")).alias("avg_confidence"),
            F.count_if(F.col("status") == "needs_review").alias("flag_count"),
        )
        .withColumn("flag_rate_pct", F.col("flag_count") / F.col("facts_written") * 100)
    )


def debt_report(facts: DataFrame, chunks: DataFrame, as_of, low_confidence: float = 0.5) -> DataFrame:
    """Review backlog and index totals as ``(metric, value, at)`` rows."""
    backlog = review.stats(facts, as_of, low_confidence).filter(F.col("grouping") != "source_type")
    queue = backlog.select(
        F.concat(F.lit("review_"), F.when(F.col("grouping") == "total", "queue_size").otherwise(F.col("label"))).alias("metric"),
        F.col("n").alias("value"),
        F.when(F.col("grouping") == "total", F.col("oldest")).alias("at"),
    )
    stats = vault_stats(chunks).agg(
        F.count(F.lit(1)).alias("vault_count"), F.sum("files").alias("total_files"), F.sum("chunks").alias("total_chunks")
    )
    totals = stats.unpivot([], ["vault_count", "total_files", "total_chunks"], "metric", "value")
    return queue.unionByName(totals.withColumn("at", F.lit(None).cast("timestamp_ntz")))


# Which log types count as created, updated, deleted.
DIGEST_TYPES = {
    "created": ["fact_created", "created", "ingest"],
    "updated": ["fact_updated", "updated"],
    "deleted": ["deleted", "fact_deleted"],
}


def digest(logs: DataFrame, as_of, hours: int = 24) -> DataFrame:
    since = clock.instant(as_of) - F.make_dt_interval(hours=F.lit(hours))
    agent = F.when(ff.present(F.col("agent")), F.col("agent")).otherwise("system")
    return (
        logs.filter(F.col("created_at") >= since)
        .groupBy(agent.alias("agent"))
        .agg(*[F.count_if(F.col("type").isin(t)).alias(k) for k, t in DIGEST_TYPES.items()], F.count(F.lit(1)).alias("events"))
    )


def briefing(logs: DataFrame, chunks: DataFrame, facts: DataFrame, sessions: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Event counts, vault sizes, review backlog and last session as rows."""
    since = clock.instant(as_of) - F.make_dt_interval(hours=F.lit(hours))

    def section(df: DataFrame, name: str, label: Column, n: Column) -> DataFrame:
        return df.select(F.lit(name).alias("section"), label.alias("label"), n.cast("long").alias("n"))

    events = logs.filter(F.col("created_at") >= since).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    waiting = facts.filter(F.col("status") == "needs_review").groupBy("vault").agg(F.count(F.lit(1)).alias("n"))
    last = skew.first_per_key(sessions.filter(~F.coalesce("archived", F.lit(False))), ["vault"], [F.desc("updated_at"), F.col("session_id")])
    return _union([
        section(events, "events", F.col("type"), F.col("n")),
        section(vault_stats(chunks), "vault_files", F.col("vault"), F.col("files")),
        section(waiting, "review", F.col("vault"), F.col("n")),
        section(last, "last_session", F.concat("vault", F.lit("/"), "session_id"), F.col("turn_count")),
    ])


def request_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("endpoint", "status").agg(F.count(F.lit(1)).alias("n"))


def scan_health(runs: DataFrame) -> DataFrame:
    return runs.groupBy("scan").agg(
        F.count(F.lit(1)).alias("runs"), F.max("at").alias("last_run"), F.sum("flagged").alias("flagged"), F.sum("resolved").alias("resolved")
    )


def extraction_stats(runs: DataFrame) -> DataFrame:
    return runs.agg(
        F.sum("attempted").alias("total_attempted"), F.sum("created").alias("facts_created"), F.sum("skipped").alias("facts_skipped"),
        F.sum("rejected").alias("facts_rejected"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"), F.max("at").alias("last_extraction"),
    )


def freshness(facts: DataFrame, as_of, hours: float = 24) -> DataFrame:
    """Hours since the newest write and whether that calls for an alert."""
    at = F.coalesce("updated_at", "created_at")
    newest = facts.agg(F.max(at).alias("last_write"), F.max_by("fact_key", F.struct(at, "fact_key")).alias("fact_key"), F.count(F.lit(1)).alias("n"))
    since = clock.hours_between(F.col("last_write"), clock.instant(as_of))
    return newest.select(
        "fact_key", "last_write", since.alias("hours_since"), F.coalesce((F.col("n") == 0) | (since >= hours), F.lit(False)).alias("alert")
    )


def prune_to_newest(logs: DataFrame, max_rows: int) -> DataFrame:
    """Keep the newest rows; a top-n by id, not a window over the whole table."""
    return logs.orderBy(F.desc("id")).limit(max_rows)


# ── files ─────────────────────────────────────────────────────────────────────
def stale_files(files: DataFrame, as_of, days: int = 90) -> DataFrame:
    age = clock.days_between(F.col("mtime"), clock.instant(as_of))
    return files.filter(age > days).withColumn("days_stale", age.cast("int"))


def duplicate_names(files: DataFrame) -> DataFrame:
    """Files that share a name with a file of their vault earlier in path order (one row each)."""
    scope = scope_of(files)
    named = files.select(*scope, text.basename(F.col("path")).alias("filename"), "path")
    first = named.groupBy(*scope, "filename").agg(F.min("path").alias("path_a"))
    return named.join(first, [*scope, "filename"]).filter(F.col("path") > F.col("path_a")).select(*scope, "filename", "path_a", F.col("path").alias("path_b"))


def empty_dirs(listing: DataFrame) -> DataFrame:
    """Directories of ``listing(path, is_dir)`` that hold nothing, or nothing that can
    be indexed. Each entry reports to all its ancestors; counts are summed partially."""
    parts = F.split("path", "/")
    depth = F.size(parts)
    bare = ~text.basename(F.col("path")).contains(".")
    indexable = ~F.col("is_dir") & (bare | text.extension(F.col("path")).isin(text.VAULT_EXTENSIONS))
    above = F.transform(F.sequence(F.lit(1), depth - 1), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("dir"), (i == depth - 1).alias("direct")))
    reports = listing.filter(depth > 1).select(F.explode(above).alias("a"), "is_dir", indexable.alias("ok")).select("a.dir", "a.direct", "is_dir", "ok")
    own = listing.filter("is_dir").select(F.col("path").alias("dir"), F.lit(None).cast("boolean").alias("direct"), F.lit(None).cast("boolean").alias("is_dir"), F.lit(False).alias("ok"))
    return (
        reports.unionByName(own)
        .groupBy("dir")
        .agg(
            F.count_if(F.col("direct")).alias("entries"), F.count_if(F.col("direct") & ~F.col("is_dir")).alias("files"), F.count_if("ok").alias("indexable"),
            F.max(F.col("direct").isNull()).alias("listed"),
        )
        .filter(F.col("listed") & (F.col("files") == 0) & ((F.col("entries") == 0) | (F.col("indexable") == 0)))
        .select("dir", F.when(F.col("entries") == 0, "empty").otherwise("no_indexable").alias("reason"))
    )


def index_consistency(files: DataFrame, chunks: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Per vault: files in the index against files on disk."""
    disk = files.filter(~F.startswith(text.basename(F.col("path")), F.lit("."))).groupBy("vault").agg(F.count(F.lit(1)).alias("disk_files"))
    indexed = chunks.groupBy("vault").agg(F.count_distinct("source_file").alias("indexed_files"))
    both = indexed.join(disk, "vault", "full_outer").fillna(0, ["indexed_files", "disk_files"])
    delta = F.when(F.col("indexed_files") > 0, (F.col("indexed_files") - F.col("disk_files")) / F.col("indexed_files"))
    hit = (F.col("indexed_files") > 0) & ((F.col("disk_files") == 0) | (delta > threshold))
    return both.withColumn("delta", delta).withColumn("affected", F.coalesce(hit, F.lit(False)))


def diff_listings(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Added, modified and deleted paths between two ``(path, mtime)`` listings; with a
    ``vault`` column in both, paths are compared inside their vault."""
    keys = [c for c in ("vault", "path") if c in previous.columns and c in current.columns]
    a, b = previous.select(*keys, F.col("mtime").alias("_old")), current.select(*keys, F.col("mtime").alias("_new"))
    action = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(F.col("_new") > F.col("_old"), "modified")
    return a.join(b, keys, "full_outer").select(*keys, action.alias("action")).filter(F.col("action").isNotNull())


# ── contradictions and pairs ──────────────────────────────────────────────────
def cross_vault_contradictions(facts: DataFrame) -> DataFrame:
    """Every value of each key on which vaults disagree: the vaults that hold it, the
    smallest of them, and how many values the key has in all.

    Two vaults contradict each other exactly if they hold different rows of a key, so
    all pairs follow from these rows, of which there are no more than facts.
    """
    rows = facts.filter(ff.present(F.col("fact_key"))).select("fact_key", "vault", F.col("fact_value").alias("value")).distinct()
    values = rows.groupBy("fact_key", "value").agg(F.count(F.lit(1)).alias("vaults"), F.min("vault").alias("first_vault"), F.max("vault").alias("last_vault"))
    clash = (
        values.groupBy("fact_key")
        .agg(F.count(F.lit(1)).alias("n_values"), F.min("first_vault").alias("_a"), F.max("last_vault").alias("_b"))
        .filter((F.col("n_values") > 1) & (F.col("_a") < F.col("_b")))
    )
    return values.join(clash, "fact_key").select("fact_key", "value", "vaults", "first_vault", "n_values")


def shared_keys(facts: DataFrame, left: str, right: str) -> DataFrame:
    """Keys present in both vaults."""

    def keys(v: str) -> DataFrame:
        return facts.filter(F.col("vault") == v).select("fact_key")

    return keys(left).intersect(keys(right))


def zip_facts_chunks(facts: DataFrame, chunks: DataFrame, chunk_key: str, n: int) -> DataFrame:
    """The first ``n`` active facts and chunks side by side, for a comparer."""
    a = facts.filter((F.col("status") == "active") & ff.present(F.col("fact_value"))).orderBy("vault", "fact_key").limit(n)
    a = a.withColumn("place", F.row_number().over(Window.orderBy("vault", "fact_key")))
    b = chunks.filter(ff.present(F.col("text"))).orderBy(chunk_key).limit(n).withColumn("place", F.row_number().over(Window.orderBy(chunk_key)))
    return a.select("place", "fact_key", "fact_value").join(b.select("place", chunk_key, "text"), "place")


def cross_source_pairs(chunks: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Up to ``n`` random pairs of chunks from different files, for a comparer."""
    few = vector.sample(chunks.select(F.col(key).alias("id"), "source_file", "text"), "id", 2 * n, seed)
    order = Window.orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}"))), "id")
    placed = few.withColumn("_n", F.row_number().over(order)).withColumn("pair", F.floor((F.col("_n") - 1) / 2))

    def side(odd: int, s: str) -> DataFrame:
        return placed.filter(F.col("_n") % 2 == odd).select(
            "pair", F.col("id").alias(f"id_{s}"), F.col("source_file").alias(f"source_{s}"), text.truncate(F.col("text"), 200).alias(f"text_{s}")
        )

    both = side(1, "a").join(side(0, "b"), "pair")
    return both.filter((F.col("source_a") != F.col("source_b")) & (F.col("source_a") != "") & (F.col("source_b") != ""))


def audit(files: DataFrame, facts: DataFrame, chunks: DataFrame, listing: DataFrame, as_of, checks: list[str] | None = None, stale_days: int = 90) -> DataFrame:
    """Findings of the chosen checks as ``(check, subject, detail)``."""

    def rows(df: DataFrame, name: str, subject: Column, detail: Column) -> DataFrame:
        return df.select(F.lit(name).alias("check"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))

    from loreweave.operators.lifecycle import expired, unresolved_conflicts

    makers = {
        "staleness": lambda: rows(stale_files(files, as_of, stale_days), "staleness", F.col("path"), F.col("days_stale")),
        "duplicates": lambda: rows(duplicate_names(files), "duplicates", F.col("path_b"), F.col("path_a")),
        "gaps": lambda: rows(empty_dirs(listing), "gaps", F.col("dir"), F.col("reason")),
        "consistency": lambda: rows(index_consistency(files, chunks).filter("affected"), "consistency", F.col("vault"), F.col("disk_files")),
        "conflicts": lambda: rows(unresolved_conflicts(facts), "conflicts", F.concat("vault", F.lit("/"), "fact_key"), F.array_join("contradicts", ",")),
        "contradictions": lambda: rows(cross_vault_contradictions(facts), "contradictions", F.concat("first_vault", F.lit("/"), "fact_key"), F.col("value")),
        "expired": lambda: rows(expired(facts, as_of), "expired", F.concat("vault", F.lit("/"), "fact_key"), F.col("reason")),
    }
    return _union([makers[c]() for c in checks or makers])
