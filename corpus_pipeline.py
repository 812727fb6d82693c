"""A corpus from raw documents: quality, repeated lines, near-duplicates, benchmark
passages, then the mix of sources. Each stage is written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.llm import decontam, linededup, mixing, quality, simhash
from loreweave.llm.common import count_words, table
from loreweave.session import durable


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier does not reject."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.keep_good(docs, labels, ~quality.held_out(F.col("doc_id")))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines."""
    return linededup.drop_repeated(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates."""
    return simhash.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once for each copy the mix takes, with the copy's number from 1."""
    rows = docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), F.struct(*docs.columns).alias("row"))
    taken = mixing.mix(rows).filter("copies > 0")
    return taken.select("row.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy_number"))


STAGES = [
    ("quality", quality_stage),
    ("lines", lines_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: SQL can express neither the classifier nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
