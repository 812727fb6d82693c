"""Structured Streaming jobs: windowed counts, sessions, de-duplication, upserts.

Zone-less times of the tables become session-zone timestamps here, because event time
and watermarks need them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from loreweave.functions import text
from loreweave.operators import chunking, facts, lifecycle
from loreweave.session import shared_dir

WATERMARK = "10 minutes"


def file_stream(spark: SparkSession, path: str, schema, pattern: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def table_stream(spark: SparkSession, sf_dir: str, name: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A given table as a stream, be it one file or a folder of part files. The braces
    make the path a pattern, which the file source lists either way."""
    return file_stream(spark, f"{sf_dir}/{name}.{{parquet}}", schema, files_per_trigger=files_per_trigger)


def with_event_time(stream: DataFrame, at: str, delay: str = WATERMARK) -> DataFrame:
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)


def live_counts(logs: DataFrame, window: str = "1 hour", slide: str | None = None, at: str = "created_at") -> DataFrame:
    """Events per time window, type and agent (tumbling, or sliding with ``slide``)."""
    w = F.window(at, window, slide) if slide else F.window(at, window)
    return logs.groupBy(w.alias("w"), "type", "agent").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "type", "agent", "n"
    )


def session_activity(turns: DataFrame, gap: str = "30 minutes", at: str = "created_at") -> DataFrame:
    """Stretches of activity per session; one is closed after ``gap`` of silence, which
    is when a session counts as idle."""
    w = F.session_window(at, gap)
    return turns.groupBy(w.alias("w"), "session_id").agg(F.count(F.lit(1)).alias("turns")).select(
        "session_id", F.col("w.start").alias("start"), F.col("w.end").alias("idle_at"), "turns"
    )


def session_counters(turns: DataFrame) -> DataFrame:
    """Running turn count and last update per session (update mode)."""
    return turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("turn_count"), F.max("created_at").alias("updated_at"))


def dedup_events(events: DataFrame, key: str = "id") -> DataFrame:
    """Each event id once within the watermark."""
    return events.dropDuplicatesWithinWatermark([key])


def run_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Process what is there in micro-batches, then stop."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class VersionedTable:
    """A table kept as numbered snapshots under one folder.

    A batch writes snapshot ``n + 1`` from snapshot ``n``, so a batch that is replayed
    after a failure writes the same folder again and nothing is applied twice.
    """

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _dir(self, n: int) -> str:
        return f"{self.path}/v{n:08d}"

    def exists(self, n: int) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self._dir(n) + "/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def last(self) -> int:
        """Number of the newest snapshot, -1 without any."""
        n = -1
        while self.exists(n + 1):
            n += 1
        return n

    def read(self, n: int) -> DataFrame:
        if n < 0 or not self.exists(n):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._dir(n))

    def write(self, n: int, df: DataFrame) -> None:
        names = [f.name for f in self.schema]
        df.select(*names).write.mode("overwrite").parquet(self._dir(n))


def upsert_facts_batch(table: VersionedTable, as_of, order: list[str]) -> Callable[[DataFrame, int], None]:
    """Batch function: upsert, then let new versions supersede older ones."""

    def apply(batch: DataFrame, n: int) -> None:
        held = table.read(n - 1)
        written = facts.upsert(held, batch, as_of, order)
        table.write(n, lifecycle.supersede_on_write(written, batch, as_of))

    return apply


def index_files_batch(table: VersionedTable, as_of, max_tokens: int = 2000) -> Callable[[DataFrame, int], None]:
    """Batch function: re-chunk changed files ``(vault, path, text)``."""

    def apply(batch: DataFrame, n: int) -> None:
        held = table.read(n - 1)
        table.write(n, chunking.ingest_documents(held, batch, as_of, max_tokens))

    return apply


def stream_vault(spark: SparkSession, path: str, vault: str) -> DataFrame:
    """New and rewritten files of a vault folder as a stream of whole documents. Paths are
    decoded, so a blank in a name is a blank, as in ``read_vault``."""
    raw = spark.readStream.schema("value string").option("recursiveFileLookup", "true").text(path, wholetext=True)
    relative = F.url_decode(F.regexp_replace(F.substring_index(F.col("_metadata.file_path"), path.rstrip("/") + "/", -1), r"\+", "%2B"))
    docs = raw.select(F.lit(vault).alias("vault"), relative.alias("path"), F.col("value").alias("text"))
    return docs.filter(text.is_indexable(F.col("path")))


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and read back all it put out.

    State and output go to the shared folder. Without a batch the result is empty, with the
    stream's columns. In update mode a key may come out more than once; ``batch`` tells
    which of its rows is the latest.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = StructType([*stream.schema.fields, StructField("batch", IntegerType())])
    spark.createDataFrame([], schema).write.parquet(f"{base}/out/part=-1")

    def store(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{base}/out/part={n}")

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STATE_STORE)
    try:
        query = stream.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(schema).parquet(f"{base}/out").drop("part")
