"""Push notifications, event envelopes and log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUSH_SCHEMA = (
    "struct<ref:string,before:string,after:string,"
    "commits:array<struct<added:array<string>,removed:array<string>,modified:array<string>>>,"
    "repository:struct<full_name:string,clone_url:string,html_url:string>,"
    "project:struct<git_http_url:string,path_with_namespace:string>>"
)

# Limits of a log entry, in bytes.
MAX_NAME, MAX_BODY, MAX_TAGS = 256, 64 * 1024, 50


def path_escape(path: Column) -> Column:
    """Percent-encode a URL path segment (slashes included)."""
    out = F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    # Characters a path segment may hold unescaped.
    for code, char in (("%7E", "~"), ("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%3D", "="), ("%3A", ":"), ("%40", "@")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def read_push_events(events: DataFrame) -> DataFrame:
    """Changed files of push payloads ``(provider, body)``, each file once per event,
    with the address of its raw content. Removed files are not listed."""
    p = F.from_json("body", PUSH_SCHEMA)
    rest = [c for c in events.columns if c != "body"]
    parsed = events.select(*rest, p.alias("p")).filter(F.col("p").isNotNull())
    files = F.array_distinct(
        F.flatten(
            F.transform(
                "p.commits",
                lambda c: F.concat(F.coalesce(c["added"], F.array().cast("array<string>")), F.coalesce(c["modified"], F.array().cast("array<string>"))),
            )
        )
    )
    is_lab = F.col("provider") == "gitlab"
    clone = F.when(is_lab, F.col("p.project.git_http_url")).otherwise(F.col("p.repository.clone_url"))
    repo = F.regexp_replace(clone, r"\.git$", "")
    file = path_escape(F.col("path"))
    raw = (
        F.when(F.col("provider") == "github", F.concat(F.lit("https://raw.githubusercontent.com/"), "p.repository.full_name", F.lit("/"), "p.after", F.lit("/"), file))
        .when(is_lab, F.concat(repo, F.lit("/-/raw/"), F.col("p.after"), F.lit("/"), file))
        .when(F.col("provider") == "gitea", F.concat("p.repository.html_url", F.lit("/raw/"), "p.after", F.lit("/"), file))
    )
    return parsed.select(*rest, "p", F.explode(files).alias("path")).select(
        *rest, repo.alias("repo_url"), F.col("p.ref").alias("ref"), F.col("p.before").alias("before"), F.col("p.after").alias("after"), "path", raw.alias("raw_url")
    )


def to_event_stream(df: DataFrame, type_: Column, source: str, at: str, data: list[str], allowed: list[str] | None = None) -> DataFrame:
    """Rows wrapped in a CloudEvents 1.0 envelope; ``allowed`` keeps only those types.

    The id is a hash of type, time and data, so a replay yields the same ids.
    """
    body = F.to_json(F.struct(*data))
    time = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    out = df.select(
        F.lit("1.0").alias("specversion"), F.substring(F.sha2(F.concat_ws("|", type_, F.col(at).cast("string"), body), 256), 1, 32).alias("id"),
        F.lit(source).alias("source"), type_.alias("type"), time.alias("time"), body.alias("data"),
    )
    return out if allowed is None else out.filter(F.col("type").isin(allowed))


def validate_logs(logs: DataFrame) -> DataFrame:
    """Add ``error``: NULL for rows that may be appended."""
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    return logs.withColumn(
        "error",
        F.when(F.octet_length("agent") > MAX_NAME, "AGENT_TOO_LONG")
        .when(F.octet_length("type") > MAX_NAME, "TYPE_TOO_LONG")
        .when(F.octet_length("body") > MAX_BODY, "BODY_TOO_LARGE")
        .when(F.size(tags) > MAX_TAGS, "TOO_MANY_TAGS")
        .when(F.exists(tags, lambda t: t == ""), "EMPTY_TAG")
        .when(F.exists(tags, lambda t: F.octet_length(t) > MAX_NAME), "TAG_TOO_LONG"),
    )


def append_logs(logs: DataFrame, path: str) -> None:
    """Append valid rows to the log table, partitioned by day."""
    good = validate_logs(logs).filter(F.col("error").isNull()).drop("error")
    good.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def append_log_stream(stream: DataFrame, path: str, checkpoint: str):
    """Streaming form of :func:`append_logs`; returns the started query."""
    good = validate_logs(stream).filter(F.col("error").isNull()).drop("error")
    return (
        good.withColumn("day", F.to_date("created_at")).writeStream.partitionBy("day").format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
