"""As-of joins: few instants reach the rows, rows do not move to the instants' nodes."""

from pyspark.sql import functions as F

from loreweave.operators import graph as gr


def test_few_instants_are_broadcast_whatever_they_come_from(spark):
    day = F.timestamp_seconds((F.col("id") % 30) * 86_400).cast("timestamp_ntz")
    instants = spark.range(3_000_000).select(day.alias("at"))
    rows = spark.range(30_000_000).select("id", day.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_until"))
    plan = gr.as_of_join(rows, instants)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
