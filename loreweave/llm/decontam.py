"""Benchmark decontamination over a distributed positional inverted index.

The index holds one row per term and document with the sorted positions of the term.
A phrase is looked up from its rarest terms: their position lists, each moved back by
the term's place in the phrase, are intersected; what is left are starts on which the
whole phrase is then compared. Only DataFrame functions are used, and only lists of
terms that some phrase is looked up by are ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.llm.common import lower_ascii, table
from loreweave.session import durable

# What separates words; words are ASCII letters, digits and all beyond ASCII.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a window, and one hit word in so many makes a document contaminated.
WINDOW, SHARE = 13, 20


def words_of(text: Column) -> Column:
    """Words in order, A-Z in lower case; null has none."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAPS)
    return F.filter(parts, lambda w: w != "")


def keyed(docs: DataFrame) -> DataFrame:
    """``(doc_id, _hash, words)``; id and text hash tell documents apart, so rows that
    share an id but not a text stay apart, and equal rows are one document."""
    return docs.select("doc_id", F.xxhash64("text").alias("_hash"), words_of(F.col("text")).alias("words"))


def postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """The index ``(term, doc_id, _hash, positions)`` of ``keyed`` documents, positions
    from 0 and ascending. With distinct ``terms(term)`` it holds those terms only."""
    flat = docs.select("doc_id", "_hash", F.posexplode("words").alias("pos", "term"))
    if terms is not None:
        flat = flat.join(terms, "term")
    return flat.groupBy("term", "doc_id", "_hash").agg(F.sort_array(F.collect_set("pos")).alias("positions"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, n)``: occurrences of each of ``terms`` in ``keyed`` documents, 0 included."""
    seen = docs.select(F.explode("words").alias("term")).join(terms, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.join(seen, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def moved(positions: Column, by: Column) -> Column:
    """A position list moved back by a term's place; starts before the text are none."""
    return F.filter(F.transform(positions, lambda p: p - by), lambda p: p >= 0)


def rarest_terms(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """``(phrase_id, a, b)``: the two rarest words of each of ``phrases(phrase_id, words)``
    by ``counts(term, n)``, as structs of term and place; of one word both are that word."""
    places = phrases.select("phrase_id", F.posexplode("words").alias("at", "term")).join(counts, "term")
    order = Window.partitionBy("phrase_id").orderBy("n", "term", "at")
    return (
        places.withColumn("k", F.row_number().over(order))
        .filter("k <= 2")
        .groupBy("phrase_id")
        .agg(F.min_by(F.struct("term", "at"), "k").alias("a"), F.max_by(F.struct("term", "at"), "k").alias("b"))
    )


def phrase_starts(index: DataFrame, rare: DataFrame) -> DataFrame:
    """Where the two rarest terms of each phrase stand as in the phrase: ``(phrase_id,
    doc_id, _hash, starts)``, the words between not yet compared."""
    first = rare.withColumn("term", F.col("a.term")).join(index, "term")
    first = first.select("phrase_id", "doc_id", "_hash", "b", moved(F.col("positions"), F.col("a.at")).alias("starts")).filter(F.size("starts") > 0)
    second = index.select(F.col("term").alias("_t"), F.col("doc_id").alias("_d"), F.col("_hash").alias("_h"), F.col("positions").alias("_p"))
    both = first.join(second, (F.col("b.term") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_h")))
    return both.select(
        "phrase_id", "doc_id", "_hash", F.array_intersect("starts", moved(F.col("_p"), F.col("b.at"))).alias("starts")
    ).filter(F.size("starts") > 0)


def phrase_matches(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """Exact occurrences of ``phrases(phrase_id, words)`` in ``keyed`` documents:
    ``(phrase_id, doc_id, _hash, start, n_words, doc_words)``. Repeated phrase ids count once;
    phrases without words occur nowhere.

    Terms are written before they meet the texts, so their size decides how they are
    joined and the words of all texts are not shuffled for a short list.
    """
    phrases = durable(phrases.dropDuplicates(["phrase_id"]))
    terms = durable(phrases.select(F.explode("words").alias("term")).distinct())
    rare = durable(rarest_terms(phrases, term_counts(docs, terms)))
    probes = durable(rare.select(F.explode(F.array("a.term", "b.term")).alias("term")).distinct())
    index = durable(postings(docs, probes))
    starts = durable(phrase_starts(index, rare))
    places = starts.join(phrases.withColumnRenamed("words", "phrase"), "phrase_id")
    found = places.groupBy("doc_id", "_hash").agg(F.collect_list(F.struct("phrase_id", "phrase", "starts")).alias("places"))
    found = durable(found.withColumnsRenamed({"doc_id": "_d", "_hash": "_h"}))
    keys = durable(found.select("_d", "_h"))
    texts = docs.join(keys, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_h")), "left_semi")
    texts = texts.dropDuplicates(["doc_id", "_hash"])
    met = texts.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_h")))
    met = met.select("doc_id", "_hash", "words", F.size("words").cast("long").alias("doc_words"), F.explode("places").alias("p"))
    n = F.size("p.phrase")
    exact = F.filter("p.starts", lambda s: F.slice("words", s + 1, n) == F.col("p.phrase"))
    return met.select("p.phrase_id", "doc_id", "_hash", n.alias("n_words"), "doc_words", F.explode(exact).alias("start"))


def proximity_matches(docs: DataFrame, pairs: DataFrame, within: int) -> DataFrame:
    """Documents in which both terms of ``pairs(pair_id, a, b)`` stand at most ``within``
    words apart, in either order: ``(pair_id, doc_id, _hash, nearest)``. ``a = b`` asks
    for two places of one term."""
    terms = durable(pairs.select(F.explode(F.array("a", "b")).alias("term")).distinct())
    index = durable(postings(docs, terms))
    left = pairs.join(index, F.col("a") == F.col("term")).select("pair_id", "a", "b", "doc_id", "_hash", F.col("positions").alias("pa"))
    right = index.select(F.col("term").alias("_t"), F.col("doc_id").alias("_d"), F.col("_hash").alias("_h"), F.col("positions").alias("pb"))
    both = left.join(right, (F.col("b") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_h")))
    tagged = F.sort_array(
        F.concat(
            F.transform("pa", lambda p: F.struct(p.alias("p"), F.lit(0).alias("s"))),
            F.when(F.col("a") == F.col("b"), F.array().cast("array<struct<p:int,s:int>>")).otherwise(F.transform("pb", lambda p: F.struct(p.alias("p"), F.lit(1).alias("s")))),
        )
    )
    step = F.zip_with(
        F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))),
        F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))),
        lambda x, y: F.when((x["s"] != y["s"]) | (F.col("a") == F.col("b")), y["p"] - x["p"]),
    )
    return both.withColumn("t", tagged).select("pair_id", "doc_id", "_hash", F.array_min(step).alias("nearest")).filter(F.col("nearest") <= within)


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``(item_id, phrase_id, words)``: each run of ``size`` words of ``items(item_id,
    text)``; a shorter item is one window, one without words none. Equal windows
    share a ``phrase_id``."""
    listed = items.select("item_id", words_of(F.col("text")).alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - size + 1, F.lit(1)))
    return listed.select("item_id", F.explode(starts).alias("s"), "all").select(
        "item_id", F.sha2(F.array_join(F.slice("all", F.col("s"), size), " "), 256).alias("phrase_id"), F.slice("all", F.col("s"), size).alias("words")
    )


def hit_documents(docs: DataFrame, items: DataFrame, size: int = WINDOW, share: int = SHARE) -> DataFrame:
    """For each document with an occurrence of a window: ``(_d, _h)``, its id and text
    hash, ``n_hit``, ``n_items``, ``item_ids`` and ``contaminated``."""
    parts = durable(windows(items, size))
    found = phrase_matches(keyed(docs), parts.select("phrase_id", "words"))
    spans = durable(
        found.groupBy("doc_id", "_hash", "start").agg(
            F.max("n_words").alias("n"), F.max("doc_words").alias("doc_words"), F.collect_set("phrase_id").alias("ids")
        )
    )
    # Overlapping occurrences: words covered by sorted spans, counted past the last end.
    cover = F.aggregate(
        F.sort_array(F.collect_list(F.struct("start", "n"))),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["start"] + x["n"]).alias("end"),
            (acc["hit"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(acc["end"], x["start"]))).alias("hit"),
        ),
        lambda acc: acc["hit"],
    )
    hits = spans.groupBy("doc_id", "_hash").agg(cover.cast("long").alias("n_hit"), F.max("doc_words").alias("doc_words"))
    ids = (
        spans.select("doc_id", "_hash", F.explode("ids").alias("phrase_id")).distinct()
        .join(durable(parts.select("phrase_id", "item_id").distinct()), "phrase_id")
        .groupBy("doc_id", "_hash")
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"), F.count_distinct(F.struct("item_id")).alias("n_items"))
        .withColumnsRenamed({"doc_id": "_d", "_hash": "_h"})
    )
    both = hits.join(ids, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_h")))
    bad = (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("doc_words"))
    return durable(both.select("_d", "_h", "n_hit", "n_items", "item_ids", bad.alias("contaminated")))


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, share: int = SHARE) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``n_words``, ``n_hit`` (words inside any
    occurrence of a window), ``n_items``, ``item_ids`` (sorted as strings) and
    ``contaminated`` (``n_hit > 0`` and ``share * n_hit >= n_words``).

    Null and empty texts have no words and are clean. Without items all is clean.
    Items with a null id count, their id is no part of ``item_ids``. Rows that share id
    and text get the same result, each its own row. Other columns are ignored.
    """
    per_doc = hit_documents(docs, items, size, share)
    counted = docs.select("doc_id", F.xxhash64("text").alias("_hash"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    return counted.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_h")), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce("contaminated", F.lit(False)).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, columns as they are."""
    bad = durable(hit_documents(docs, items, size, share).filter("contaminated").select("_d", "_h"))
    of = docs.withColumn("_hash", F.xxhash64("text"))
    return of.join(bad, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_h")), "left_anti").select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s : s + 12], ' ') AS p
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), m AS (
  SELECT dw.doc_id, dw.s, dw.n, iw.item_id FROM dw JOIN iw USING (n, p)
), h AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS x FROM m) GROUP BY 1
), i AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY 1
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""


def op7(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated"
    )

