"""Vault folders: documents, inbox notes, chunk export and import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave import schemas
from loreweave.functions import text


def _relative(root: str) -> Column:
    """Path below ``root`` of the file a row was read from."""
    full = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.substring_index(full, root.rstrip("/") + "/", -1)


def read_vault(spark: SparkSession, path: str, vault: str, profile: str = "vault") -> DataFrame:
    """One row per indexable file: ``(vault, path, text, mtime)``."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    files = raw.select(
        F.lit(vault).alias("vault"), _relative(path).alias("path"), F.col("value").alias("text"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("mtime"),
    )
    return files.filter(text.is_indexable(F.col("path"), profile))


def parse_inbox(notes: DataFrame) -> DataFrame:
    """Front matter and body of inbox notes ``(path, text)``."""
    body = F.col("text")
    head = F.regexp_extract(body, r"(?s)\A---\n(.*?)\n---\n", 1)
    has_head = body.rlike(r"(?s)\A---\n.*?\n---\n")

    def field(name: str) -> Column:
        value = text.squeeze(F.regexp_extract(head, rf"(?m)^[ \t]*{name}:(.*)$", 1))
        return F.regexp_replace(value, '^"+|"+$', "")

    tags = F.transform(
        F.split(F.regexp_replace(field("tags"), r"^\[+|\]+$", ""), ","), lambda x: F.regexp_replace(text.squeeze(x), '^"+|"+$', "")
    )
    return notes.select(
        F.regexp_replace(text.basename(F.col("path")), r"\.md$", "").alias("id"),
        F.when(has_head, field("title")).otherwise("").alias("title"),
        F.when(has_head, F.regexp_replace(body, r"(?s)\A---\n.*?\n---\n", "")).otherwise(body).alias("content"),
        F.when(has_head, field("source")).otherwise("").alias("source"),
        F.when(has_head, F.filter(tags, lambda x: x != "")).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.when(has_head, field("created_at")).otherwise("").alias("created_at"),
        F.when(has_head, field("processed").isin("true", "yes")).otherwise(False).alias("processed"),
    )


def read_inbox(spark: SparkSession, path: str) -> DataFrame:
    """Notes of a vault's inbox folder, newest first."""
    raw = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    notes = raw.select(F.col("_metadata.file_name").alias("path"), F.col("value").alias("text"))
    return parse_inbox(notes).orderBy(F.desc("created_at"), "id")


def inbox_id(title: Column) -> Column:
    return text.slugify(title)


def export_chunks(chunks: DataFrame, path: str) -> None:
    """All chunks as JSON lines; one file per task, nothing passes the driver."""
    chunks.write.mode("overwrite").json(path)


def import_chunks(spark: SparkSession, path: str, vault: str) -> DataFrame:
    """Exported chunks under a new vault, with ids made from source and position."""
    rows = spark.read.schema(schemas.CHUNKS).json(path)
    return rows.withColumns({"vault": F.lit(vault), "chunk_id": text.chunk_id(F.col("source_file"), F.col("chunk_index"))})


def write_snapshot(df: DataFrame, path: str, partition: str = "vault") -> None:
    """Replace only the partitions present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
