"""Interaction audit of filters: what each filter removes, in every order.

The removal game of a set of filters is the number of documents that fail at least one
of them. All its values follow from one count per combination of failures, so documents
are read once and five flags are all that is kept of them. The Hart-Mas-Colell potential
of a coalition is its value plus the potentials of the coalitions with one filter less,
over its size; a filter's Shapley value is the grand potential minus the potential
without it. Differences of coalition values give the steps of every order.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.llm.common import WORD, table
from loreweave.session import durable

#: Filters in the order of their bits.
NAMES = "ABCDE"


def failures(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` with ``mask``, the failed filters A to D as bits, and
    ``digest`` of the text. A null text is empty; other columns are kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.col("_words")
    return (
        docs.withColumn("_words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
        .withColumn("_n", F.size(words))
        .withColumn(
            "mask",
            F.when(F.col("_n") < 50, 1).otherwise(0)
            + F.when(100 * F.size(F.array_distinct(words)) < 65 * F.col("_n"), 2).otherwise(0)
            + F.when(100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text), 4).otherwise(0)
            + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0),
        )
        .withColumn("digest", F.sha2(text, 256))
        .drop("_words", "_n")
    )


def combinations(flagged: DataFrame) -> DataFrame:
    """``flagged(doc_id, part, digest, mask, good, toxic)`` as counts ``(part, mask, n, good,
    toxic)``, ``mask`` now with E: a smaller ``doc_id`` has the same text.

    Equal rows are counted first and then the smallest id of a part's copies with its
    count, so a text with very many copies is a few rows when its smallest id is sought.
    A null id is neither smaller nor larger than another; rows of the smallest id pass.
    """
    kind = ["digest", "part", "mask", "good", "toxic"]
    counted = flagged.groupBy(*kind, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    copies = counted.groupBy(*kind).agg(
        F.min("doc_id").alias("least"),
        F.min_by("n", "doc_id").alias("at_least"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"),
        F.sum("n").alias("all"),
    )
    first = F.min("least").over(Window.partitionBy("digest"))
    passing = F.col("no_id") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    both = F.array(F.struct("mask", F.col("passing").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("all") - F.col("passing")).alias("n")))
    return (
        copies.withColumn("first", first)
        .withColumn("passing", passing)
        .select("part", "good", "toxic", F.explode(both).alias("_c"))
        .filter("_c.n > 0")
        .groupBy("part", F.col("_c.mask").alias("mask"))
        .agg(*[F.sum(F.when(f, F.col("_c.n")).otherwise(0)).alias(a) for a, f in (("n", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic")))])
    )


def game(value: Column, filters: int) -> Column:
    """Values of all coalitions, by their bits, from an array with an entry per mask:
    what fails at least one filter of the coalition is all but what fails none."""
    full = (1 << filters) - 1
    everything = F.aggregate(value, F.lit(0).cast("long"), lambda a, x: a + x)

    def lost(coalition: Column) -> Column:
        spared = F.transform(value, lambda x, mask: F.when(mask.bitwiseAND(coalition) == 0, x).otherwise(0))
        return everything - F.aggregate(spared, F.lit(0).cast("long"), lambda a, x: a + x)

    return F.transform(F.sequence(F.lit(0), F.lit(full)), lost)


def potential(game: Column, filters: int) -> Column:
    """Potentials of all coalitions, by their bits, times ``filters!``, which makes them whole.

    A coalition without one filter has a smaller number, so one fold in order of numbers
    finds the smaller potentials ready.
    """
    scale = factorial(filters)

    def grow(known: Column, coalition: Column) -> Column:
        less = sum(
            (F.when(coalition.bitwiseAND(F.lit(1 << i)) != 0, F.get(known, coalition - F.lit(1 << i))).otherwise(F.lit(0).cast("long")) for i in range(filters)),
            start=F.lit(0).cast("long"),
        )
        return F.array_append(known, F.call_function("div", F.get(game, coalition) * F.lit(scale) + less, F.bit_count(coalition).cast("long")))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << filters) - 1)), F.array(F.lit(0).cast("long")), grow)


def audit(counts: DataFrame, names: str = NAMES) -> DataFrame:
    """``counts(part, mask, n, good, toxic)`` as a row per part, order and step.

    Each part needs only an array of ``2 ** len(names)`` counts; without rows the result
    is empty. Masks that no document has count 0. Games and potentials, a row per part,
    are written once, as every step looks them up.
    """
    k = len(names)
    masks = range(1 << k)
    arrays = counts.groupBy("part").agg(
        *[F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).cast("long") for m in masks]).alias(c) for c in ("n", "good", "toxic")]
    )
    games = arrays.select("part", "n", game(F.col("n"), k).alias("lost"), game(F.col("good"), k).alias("good"), game(F.col("toxic"), k).alias("toxic"))
    solved = durable(durable(games).withColumn("potential", potential(F.col("lost"), k)))
    steps = [
        F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(sum(1 << names.index(x) for x in order[:i])).alias("before"), F.lit(1 << names.index(f)).alias("bit"))
        for order in permutations(names)
        for i, f in enumerate(order)
    ]
    at = solved.withColumn("_s", F.explode(F.array(*steps)))
    before, bit = F.col("_s.before"), F.col("_s.bit")
    gain = lambda name: F.get(name, before + bit) - F.get(name, before)
    return at.select(
        "part",
        F.col("_s.filter_order").alias("filter_order"),
        F.col("_s.step").alias("step"),
        (F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x) - F.get("lost", before + bit)).alias("kept"),
        gain("lost").alias("removed"),
        (F.get("lost", bit) - gain("lost")).alias("redundant"),
        F.get("n", bit).alias("unique_fails"),
        gain("good").alias("good_lost"),
        gain("toxic").alias("toxic_lost"),
        (F.get("potential", F.lit((1 << k) - 1)) - F.get("potential", F.lit((1 << k) - 1) - bit)).alias("shapley"),
    )


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with booleans ``good`` and ``toxic``: some label of its id says so. Ids
    without labels and null ids are neither."""
    known = labels.groupBy(F.col("doc_id").alias("_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    marked = docs.join(known, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    return marked.fillna({"good": False, "toxic": False})


def op13(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.col("source"), F.lit("")).alias("part"))
    flags = durable(failures(docs).select("doc_id", "part", "mask", F.unhex("digest").alias("digest")))
    return audit(durable(combinations(labelled(flags, table(spark, sf_dir, "labels")))))


# Names, bits and thresholds are those of the module above.
ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
      + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
      + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
      + CASE WHEN coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), c AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask
), k AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit
), o AS (
  SELECT a.name || b.name || d.name || e.name || g.name AS filter_order, [a.bit, b.bit, d.bit, e.bit, g.bit] AS bits
  FROM k a, k b, k d, k e, k g
  WHERE a.bit + b.bit + d.bit + e.bit + g.bit = 31 AND len(list_distinct([a.bit, b.bit, d.bit, e.bit, g.bit])) = 5
), s AS (
  SELECT filter_order, CAST(i AS INTEGER) AS step, bits[i] AS bit, CAST(coalesce(list_sum(bits[1:i - 1]), 0) AS INTEGER) AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS i)
), r AS (
  SELECT part, filter_order, step, bit,
    CAST(sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit
)
SELECT * EXCLUDE (bit), CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""
