"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, target over size.
Expected copies are summed along an order by size, one offset per source is added,
and a document is emitted once for each integer the sum passes. Neighbours in the
order have like sizes, so the words a source gives stay within about one document
of its target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreweave.llm.common import count_words, numbered
from loreweave.session import durable

#: Weights in order of source, repeated, and the most copies of a source's words.
WEIGHTS = (1, 2, 3)
MOST = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes(source, source_size)``, one row per source, with its ``target``.

    Sources in code point order, null last, take ``weights`` in turn and share the
    sum of all sizes; a target stops at ``most`` times the source's size and what is
    over goes to the others by weight. A source stops once its share of what the
    stopped ones before it leave is too large; in order of ``most * size / weight``
    the stopped ones come first, so one pass of running sums settles all.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = sizes.withColumn(
        "weight", F.array(*[F.lit(int(w)) for w in weights])[(F.row_number().over(order) - 1) % len(weights)].cast("long")
    ).withColumn("most", F.col("source_size") * most)
    ranked = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    share = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    tested = weighted.withColumn("_left", left).withColumn("_share", share).withColumn(
        "_stops", F.col("weight") * F.col("_left") > F.col("most") * F.col("_share")
    )
    free = F.first(F.when(~F.col("_stops"), F.struct("_left", "_share")), ignorenulls=True).over(
        ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return (
        tested.withColumn("_free", free)
        .withColumn(
            "target",
            F.when(F.col("_stops"), F.col("most").cast("double")).otherwise(
                F.col("weight") * F.col("_free._left") / F.col("_free._share")
            ),
        )
        .select("source", "source_size", "target")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``docs(doc_id, source, size, ...)`` with ``source_size``, ``target`` and ``copies``.

    ``size`` is a long. Null sources are one source. Null ids sort as empty text.
    Sources without words have target 0 and no copies. Repeated rows are documents
    of their own. All other columns are kept; names starting with ``_`` are reserved.
    An empty table gives an empty one. The offset is a hash of the source, so reruns
    agree.
    """
    tie = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    placed = numbered(docs, [F.col("source").asc_nulls_last(), F.col("size"), F.md5(tie), tie])
    parts = placed.groupBy("source", "_part").agg(
        F.min("_index").alias("_first"), F.count(F.lit(1)).alias("_rows"), F.sum("size").alias("_words")
    )
    parts = durable(parts)
    goal = targets(parts.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, most)
    ahead = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        parts.withColumn("_ahead", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)))
        .withColumnRenamed("source", "_source")
        .join(goal.withColumnRenamed("source", "_goal"), F.col("_source").eqNullSafe(F.col("_goal")))
        .select("_source", F.col("_part").alias("_p"), "_first", "_ahead", "source_size", "target")
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    name = F.coalesce(F.col("source").cast("string"), F.lit("null"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), name)), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    place = F.col("_ahead") + F.col("_index") - F.col("_first")
    return (
        placed.join(parts, placed["source"].eqNullSafe(parts["_source"]) & (F.col("_part") == F.col("_p")))
        .withColumn("_rate", rate)
        .withColumn("_offset", offset)
        .withColumn(
            "copies",
            (F.floor((place + 1) * F.col("_rate") + F.col("_offset")) - F.floor(place * F.col("_rate") + F.col("_offset"))).cast("long"),
        )
        .drop("_source", "_p", "_part", "_index", "_first", "_ahead", "_rate", "_offset")
    )


def sized(docs: DataFrame) -> DataFrame:
    """Documents with ``size``, their number of words."""
    return docs.withColumn("size", count_words(F.col("text")))


# The query's weights, cap and offsets are those of the module above.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, 3 * source_size AS most, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS BIGINT) AS weight FROM s
), r AS (
  SELECT *, (SELECT sum(source_size) FROM s) - coalesce(sum(most) OVER b, 0) AS l,
    (SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER b, 0) AS sh, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS k
  FROM w WINDOW b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT l, sh FROM r WHERE NOT weight * l > most * sh ORDER BY k LIMIT 1
), t AS (
  SELECT r.source, source_size, CASE WHEN weight * r.l > most * r.sh THEN CAST(most AS DOUBLE)
    ELSE CAST(weight * f.l AS DOUBLE) / CAST(f.sh AS DOUBLE) END AS target FROM r, f
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    row_number() OVER (PARTITION BY d.source ORDER BY size, md5(coalesce(CAST(doc_id AS VARCHAR), '')), coalesce(CAST(doc_id AS VARCHAR), '')) AS i,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    CAST(CAST('0x' || substr(md5('mix:' || coalesce(d.source, 'null')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(floor(i * rate + u) - floor((i - 1) * rate + u) AS BIGINT) * size AS taken
FROM p
"""


def op3(spark, sf_dir: str) -> DataFrame:
    from loreweave.llm.common import table

    docs = durable(sized(table(spark, sf_dir, "documents")).select("doc_id", "source", "size"))
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
