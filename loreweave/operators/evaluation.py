"""Scoring of benchmark answers, latency and failure reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave import models, skew
from loreweave.functions import text

# Answers that decline, and error prefixes that are already known.
REFUSALS = [
    "answer_failed", "cannot answer", "not provided", "no context",
    "i don't know", "i'm not sure", "unable to answer",
]
KNOWN_ERRORS = ["POST /ask", "POST /vault", "ConnectionError"]
TIMEOUT_MS = 30000


def score_answers(results: DataFrame, judge: models.Completer | None = None) -> DataFrame:
    """Add ``score`` and ``correct`` (at least 0.5).

    ``judge`` maps a prompt to a number as text; without it, or where it gives none,
    the score is 1 for an exact match of trimmed, lower-cased texts.
    """
    exact = F.when(F.lower(text.squeeze(F.col("answer"))) == F.lower(text.squeeze(F.col("ground_truth"))), 1.0).otherwise(0.0)
    if judge is None:
        scored = results.withColumn("score", exact)
    else:
        prompt = F.concat(F.lit("Question: "), "question", F.lit("\nExpected: "), "ground_truth", F.lit("\nAnswer: "), "answer")
        judged = models.complete(results.withColumn("_prompt", prompt), judge, "_prompt", "_verdict")
        value = F.greatest(F.lit(0.0), F.least(F.col("_verdict").try_cast("double"), F.lit(1.0)))
        verdict = F.when(F.col("_verdict").try_cast("double").isNotNull(), value)
        scored = judged.withColumn("score", F.coalesce(verdict, exact)).drop("_prompt", "_verdict")
    return scored.withColumn("correct", F.col("score") >= 0.5)


def score_batch(results: DataFrame) -> DataFrame:
    """Accuracy in total, by question type and by configuration."""
    return (
        results.groupingSets([[], ["question_type"], ["config"]], "question_type", "config")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if("correct").alias("n_correct"))
        .withColumn("accuracy", F.round(F.col("n_correct") / F.col("total"), 4))
        .withColumnRenamed("n_correct", "correct")
    )


def compare_to_baseline(current: DataFrame, baseline: DataFrame, margin: float = 0.01) -> DataFrame:
    """Change of accuracy per question type (NULL type is the total)."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.filter(F.col("config").isNull()).select(F.coalesce("question_type", F.lit("(all)")).alias("question_type"), F.col("accuracy").alias(name))

    delta = F.coalesce("current", F.lit(0.0)) - F.coalesce("baseline", F.lit(0.0))
    return (
        side(current, "current").join(side(baseline, "baseline"), "question_type", "full_outer")
        .withColumn("delta", F.round(delta, 4))
        .withColumn("verdict", F.when(F.col("delta") < -margin, "regression").when(F.col("delta") > margin, "improvement").otherwise("stable"))
    )


def latency_summary(results: DataFrame, elapsed_seconds: float | None = None) -> DataFrame:
    """p50, p95 and p99 as ``sorted[int(n * p)]``, request and error counts."""
    points = skew.order_statistics(results, "latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    counts = results.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"))
    rate = F.col("total") / F.lit(elapsed_seconds) if elapsed_seconds else F.lit(0.0)
    return counts.select(
        "total", "errors", rate.alias("throughput_rps"), *[points.select(p).scalar().alias(p) for p in ("p50", "p95", "p99")]
    )


def classify_failures(results: DataFrame, conversations_total: int = 0, conversations_ingested: int = 0, comparison: DataFrame | None = None) -> DataFrame:
    """One row per issue: ``(pattern, label, n, total)``."""
    has_error = F.coalesce("error", F.lit("")) != ""
    total = results.agg(F.count(F.lit(1)).alias("n")).scalar()

    def issue(df: DataFrame, pattern: str, label, n) -> DataFrame:
        return df.select(F.lit(pattern).alias("pattern"), label.alias("label"), n.cast("long").alias("n"))

    failed = conversations_total - conversations_ingested
    ingest = results.sparkSession.range(1 if conversations_total and failed / conversations_total > 0.01 else 0)
    by_type = results.filter(has_error).groupBy("question_type").agg(F.count(F.lit(1)).alias("n")).filter("n > 3")
    slow = results.agg(F.count_if(F.col("latency_ms") >= TIMEOUT_MS).alias("n"), F.count(F.lit(1)).alias("t")).filter("t > 0 and n / t > 0.05")
    declined = results.filter(~has_error & text.any_of(F.lower(F.coalesce("answer", F.lit(""))), REFUSALS)).agg(F.count(F.lit(1)).alias("n")).filter("n > 3")
    modes = (
        results.filter(has_error).groupBy(F.substring_index("error", ":", 1).alias("mode")).agg(F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") > 1) & ~F.col("mode").isin(KNOWN_ERRORS))
    )
    parts = [
        issue(ingest, "ingest_failures", F.lit(""), F.lit(failed)),
        issue(by_type, "error_cluster", F.col("question_type"), F.col("n")),
        issue(slow, "timeouts", F.lit(""), F.col("n")),
        issue(declined, "synthesis_failure", F.lit(""), F.col("n")),
        issue(modes, "new_error_mode", F.col("mode"), F.col("n")),
    ]
    if comparison is not None:
        worse = comparison.filter(F.col("verdict") == "regression")
        parts.append(issue(worse, "regression", F.col("question_type"), F.round(-F.col("delta") * 100)))
    return reduce(lambda a, b: a.unionByName(b), parts).withColumn("total", total)
