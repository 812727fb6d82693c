"""Window-like results per key that never put a whole key into one task.

A plain window function sends every row of a key to one task, which fails when a
single session or source holds a large share of the table. The helpers here cut
each key into order-preserving *segments*, work inside (key, segment), and carry
only one small row per segment across the cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = "_segment"


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    segment: Column,
    order: Sequence[Column],
    value: Column,
    out: str,
) -> DataFrame:
    """Inclusive running sum of ``value`` per key in ``order``.

    ``segment`` must be non-decreasing along ``order`` inside a key.
    """
    cut = df.withColumn(SEGMENT, segment).withColumn("_value", value)
    before = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys, SEGMENT)
        .agg(F.sum("_value").alias("_total"))
        .select(*keys, SEGMENT, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*keys, SEGMENT).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.join(offsets, [*keys, SEGMENT])
        .withColumn(out, F.col("_offset") + F.sum("_value").over(inside))
        .drop(SEGMENT, "_value", "_offset")
    )


def position(
    df: DataFrame, keys: Sequence[str], segment: Column, order: Sequence[Column], out: str = "pos"
) -> DataFrame:
    """Dense 1-based position of each row inside its key."""
    return running_sum(df, keys, segment, order, F.lit(1).cast("long"), out)


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    segment: Column,
    order: Sequence[Column],
    what: Column,
    out: str,
    ahead: bool = True,
) -> DataFrame:
    """``lead`` (or ``lag``) by one row per key; ``what`` must be a struct column."""
    cut = df.withColumn(SEGMENT, segment).withColumn("_what", what)
    by_segment = Window.partitionBy(*keys).orderBy(SEGMENT)
    rank = F.struct(*order)
    edge = F.min_by("_what", rank) if ahead else F.max_by("_what", rank)
    step = F.lead("_edge").over(by_segment) if ahead else F.lag("_edge").over(by_segment)
    edges = (
        cut.groupBy(*keys, SEGMENT).agg(edge.alias("_edge")).select(*keys, SEGMENT, step.alias("_beyond"))
    )
    inside = Window.partitionBy(*keys, SEGMENT).orderBy(*order)
    near = F.lead("_what").over(inside) if ahead else F.lag("_what").over(inside)
    return (
        cut.join(edges, [*keys, SEGMENT])
        .withColumn(out, F.coalesce(near, F.col("_beyond")))
        .drop(SEGMENT, "_what", "_beyond")
    )


def with_halo(df: DataFrame, pos: str, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """Cut each key into blocks of ``size`` positions and copy the rows near a cut
    into the block that needs them, so frames of up to ``before`` preceding and
    ``after`` following rows can be computed inside (key, ``_block``). Rows a block
    owns have ``_own = true``; drop the others afterwards."""
    home = F.floor(F.col(pos) / F.lit(size))
    blocks = F.array_distinct(
        F.array(
            home,
            F.floor((F.col(pos) + F.lit(before)) / F.lit(size)),
            F.floor((F.col(pos) - F.lit(after)) / F.lit(size)),
        )
    )
    return df.withColumn("_block", F.explode(blocks)).withColumn("_own", F.col("_block") == home)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per group.

    Spark turns this shape into a partial limit before the shuffle, so a hot group
    ships at most ``n`` rows per input partition.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= F.lit(n))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``."""
    return top_per_group(df, keys, order, 1, "_rank").drop("_rank")


def per_key_max(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Attach the maximum of ``value`` per key by a partial aggregate and a join
    back (which AQE can split on a hot key) instead of a window."""
    top = df.groupBy(*keys).agg(F.max(value).alias(out))
    return df.join(top, list(keys))


def order_statistics(df: DataFrame, value: str, fractions: dict[str, float]) -> DataFrame:
    """Exact order statistics ``sorted[int(n * p)]`` of a non-negative column.

    Copies of a value are counted first; values are then cut into logarithmic
    buckets (a few ten thousand at most), so the cumulative count runs over a
    bounded table and only the buckets holding an answer are ranked.
    """
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_b", F.floor(F.log1p("_v") * 1000))
    )
    everything = Window.partitionBy(F.lit(0))
    upto = everything.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        counts.groupBy("_b")
        .agg(F.sum("_c").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
        .withColumn("_total", F.sum("_n").over(everything))
        .withColumn(
            "_want",
            F.explode(
                F.array(
                    *[F.struct(F.lit(k).alias("name"), F.lit(p).alias("p")) for k, p in fractions.items()]
                )
            ),
        )
        .withColumn("_index", F.floor(F.col("_total") * F.col("_want.p")))
        .filter((F.col("_index") >= F.col("_before")) & (F.col("_index") < F.col("_before") + F.col("_n")))
        .select("_b", "_before", "_index", F.col("_want.name").alias("_name"))
    )
    inside = Window.partitionBy("_name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    hits = (
        counts.join(buckets, "_b")
        .withColumn("_upto", F.col("_before") + F.sum("_c").over(inside))
        .filter(F.col("_upto") > F.col("_index"))
    )
    return hits.groupBy().agg(
        *[F.min(F.when(F.col("_name") == k, F.col("_v"))).alias(k) for k in fractions]
    )
