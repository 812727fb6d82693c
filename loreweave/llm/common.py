"""Shared pieces: words, table access, global order, connected components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loreweave.session import durable, release

# What separates words (blank and the five ASCII control blanks).
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other letter as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def count_words(text: Column) -> Column:
    """Number of blank-separated words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key's text, modulo ``n``; a null key gives null."""
    return F.crc32(key.cast("string")) % F.lit(n)


def numbered(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows in a global order, with ``_part`` (range partition, ascending along the
    order) and ``_index`` (place inside it). No key has to fit one task: the range
    cut looks at all order columns. Written to the shared folder, so a lost executor
    cannot change the numbers.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    seen = F.monotonically_increasing_id()
    return durable(
        ranged.withColumn("_seen", seen)
        .withColumn("_part", F.shiftright("_seen", 33).cast("int"))
        .withColumn("_index", F.col("_seen").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_seen")
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, root)``, root the
    smallest node, for every node that has an edge to another one.

    Large-star and small-star steps in turn. Only minima are grouped (partially
    before the shuffle), so a node with very many edges is never gathered in one
    task; each step is written and the one before it deleted.
    """
    now = durable(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u <> v")
            .distinct()
        )
        then = durable(small)
        seen = then.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        release(now)
        now = then
        if seen == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = seen


