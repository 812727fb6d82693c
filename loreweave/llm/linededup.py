"""Deletes later copies of repeated runs of lines.

The lines of all documents, in order of document and line, are sequences of line ids
(equal lines share an id, ids ascend along line hashes, a document's end matches
nothing). A suffix array over them is built by prefix doubling: the rank of a suffix by its
first 2^k lines comes from the ranks of its two halves. Suffixes whose longest common
prefix reaches a given length are one interval of the array, named by the two ranks
that cover that length. Every line starts, and ends, one shortest run of ``min_words``
words; the union of these shortest runs is that of all runs at least as long, so the
intervals of the shortest runs tell each line of a maximal repeated run. The first
member of an interval stays, the runs of all later ones go.

Lines met once end every run, and ranks held by one suffix are dropped as soon as
seen, so each round works on what still repeats. A shortest run has at most
``min_words`` lines, which bounds the rounds by the logarithm of that number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreweave.llm.common import WORD, count_words, numbered, table
from loreweave.session import durable, release

#: Words a repeated run needs before its later copies go.
MIN_WORDS = 50

DOC = ["doc_id", "_hash"]


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_hash", F.xxhash64("text"))


def lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, _hash, line, seq, a, b, words)`` of each line with a word: its place
    among all lines and among those, two hashes of it without outer blanks, its words.
    Rows that share id and text are one document here."""
    one = F.regexp_replace(F.col("value"), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    split = F.filter(
        F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("value"))),
        lambda s: s["value"].rlike(WORD),
    )
    flat = docs.select(*DOC, F.posexplode(split).alias("seq", "l")).select(*DOC, "seq", "l.line", F.col("l.value").alias("value"))
    trimmed = flat.withColumn("value", one)
    return trimmed.select(
        *DOC, "line", "seq", F.xxhash64("value").alias("a"), F.xxhash64(F.concat(F.lit("+"), "value")).alias("b"), count_words(F.col("value")).alias("words")
    )


def _ranked(pairs: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` that occur more than once with a ``rank`` ascending along them."""
    again = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a", "b")
    placed = numbered(again, [F.col("a"), F.col("b")])
    return placed.select("a", "b", (F.shiftleft(F.col("_part").cast("long"), 33) + F.col("_index")).alias("rank"))


def shortest_runs(repeated: DataFrame, min_words: int) -> DataFrame:
    """For each repeated line the shortest runs of repeated lines of ``min_words``
    words that start and that end with it: ``(doc_id, _hash, start, length)``."""
    doc = Window.partitionBy(*DOC).orderBy("seq")
    upto = (
        repeated.withColumn("stretch", F.col("seq") - F.row_number().over(doc))
        .withColumn("upto", F.sum("words").over(Window.partitionBy(*DOC, "stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("before", F.col("upto") - F.col("words"))
        .withColumn("ahead", -F.col("before"))
    )
    stretch = Window.partitionBy(*DOC, "stretch")
    # The next line that begins min_words or more after this one begins, seen backwards.
    beyond = F.min("seq").over(stretch.orderBy("ahead").rangeBetween(Window.unboundedPreceding, -min_words))
    until = F.max("seq").over(stretch.orderBy("upto").rangeBetween(Window.unboundedPreceding, -min_words))
    total = F.sum("words").over(stretch)
    last, first = F.max("seq").over(stretch), F.min("seq").over(stretch)
    ends = F.coalesce(beyond - 1, F.when(total - F.col("before") >= min_words, last))
    starts = F.coalesce(until + 1, F.when(F.col("upto") >= min_words, first))
    both = upto.select(*DOC, "seq", starts.alias("begin"), ends.alias("end")).select(
        *DOC,
        F.explode(F.array(F.struct(F.col("seq").alias("start"), F.col("end")), F.struct(F.col("begin").alias("start"), F.col("seq").alias("end")))).alias("r"),
    )
    return both.filter("r.start is not null and r.end is not null").select(*DOC, "r.start", (F.col("r.end") - F.col("r.start") + 1).alias("length")).distinct()


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The shortest runs that have an earlier copy: ``(doc_id, _hash, start, length)``
    with ``first``, the (doc_id, _hash, start) of the earliest one. ``start`` counts
    lines with words. ``docs`` must have been ``keyed``; null ids come before others."""
    flat = durable(lines(docs))
    ids = _ranked(flat.select("a", "b"))
    # suffix array by the first line; ranks of suffixes met once are already gone
    ranks = durable(flat.join(ids, ["a", "b"]).select(*DOC, "seq", "words", "rank"))
    runs = durable(shortest_runs(ranks, min_words).withColumn("level", F.floor(F.log2("length")).cast("int")))
    top = runs.agg(F.max("level")).first()[0]
    named, now = [], ranks.drop("words")
    for level in range(0, 0 if top is None else top + 1):
        if level:
            half = 1 << (level - 1)
            doc = Window.partitionBy(*DOC).orderBy("seq").rangeBetween(half, half)
            pairs = durable(now.withColumn("b", F.max("rank").over(doc)).filter("b is not null").withColumnRenamed("rank", "a"))
            doubled = _ranked(pairs.select("a", "b"))
            then = durable(pairs.join(doubled, ["a", "b"]).select(*DOC, "seq", "rank"))
            release(pairs)
            now = then
        mine = runs.filter(F.col("level") == level)
        left = now.select(*[F.col(c).alias(f"_{c}1") for c in DOC], F.col("seq").alias("_s1"), F.col("rank").alias("left"))
        right = now.select(*[F.col(c).alias(f"_{c}2") for c in DOC], F.col("seq").alias("_s2"), F.col("rank").alias("right"))
        at = lambda n, place: F.col("doc_id").eqNullSafe(F.col(f"_doc_id{n}")) & (F.col("_hash") == F.col(f"__hash{n}")) & (F.col(f"_s{n}") == place)
        covered = mine.join(left, at(1, F.col("start"))).join(right, at(2, F.col("start") + F.col("length") - (1 << level)))
        named.append(durable(covered.select(*DOC, "start", "length", "left", "right")))
    if not named:
        none = runs.select(*DOC, "start", "length")
        return none.withColumn("first", F.struct(*DOC, "start")).limit(0)
    every = named[0]
    for more in named[1:]:
        every = every.unionByName(more)
    interval = ["length", "left", "right"]
    here = F.struct(*DOC, "start")
    firsts = every.groupBy(*interval).agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return every.join(firsts, interval).filter(~F.col("first").eqNullSafe(here)).select(*DOC, "start", "length", "first")


def deletions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, _hash, gone)``: sorted numbers, counted among lines with words, of the
    lines to delete, for documents that lose any."""
    runs = repeated_runs(docs, min_words).select(*DOC, "start", "length").distinct()
    each = runs.select(*DOC, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("seq"))
    return each.groupBy(*DOC).agg(F.sort_array(F.collect_set("seq")).alias("gone"))


def _without(docs: DataFrame, min_words: int) -> DataFrame:
    """``docs`` with texts put together anew, ``_lines`` and ``_gone``."""
    of = keyed(docs)
    # Lists of line numbers pack so well that the size of their file says little about
    # their size in memory, so they are never broadcast.
    lost = durable(deletions(of.select("doc_id", "text", "_hash"), min_words)).withColumnsRenamed({"doc_id": "_d", "_hash": "_h"}).hint("merge")
    met = of.join(lost, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_h")), "left")
    names, at = docs.columns, docs.columns.index("text")

    def cut(text: str | None, gone: list[int] | None) -> tuple[str | None, int]:
        if text is None:
            return None, 0
        out, n, gone = [], 0, set(gone or ())
        for line in text.split("\n"):
            if line.strip("\x20\x09\x0a\x0b\x0c\x0d"):
                n += 1
                if n - 1 in gone:
                    continue
            out.append(line)
        return "\n".join(out), n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = [g.as_py() or [] for g in b.column(len(names))]
            done = [cut(t.as_py(), g) for t, g in zip(b.column(at), gone)]
            columns = list(b.columns[: len(names)])
            columns[at] = pa.array([d[0] for d in done], pa.string())
            counts = pa.array([d[1] for d in done], pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, counts, pa.array(gone, pa.list_(pa.int32()))], [*names, "_lines", "_gone"])

    made = T.StructType([*docs.schema.fields, T.StructField("_lines", T.LongType()), T.StructField("_gone", T.ArrayType(T.IntegerType()))])
    return met.select(*names, F.col("gone").alias("_gone")).mapInArrow(run, made)


def deduplicate(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs(doc_id, text, ...)`` without later copies of repeated runs of lines, with
    ``n_lines`` (lines with a word) and ``deleted`` (their numbers from 0, ascending).

    A run counts from ``min_words`` words; where runs overlap, each line of any later
    copy goes, also within one document. Order is that of ``doc_id`` (null first), then
    of a text hash. Lines are equal if they are without outer blanks; lines without
    words belong to no run and stay, so do null and empty texts. Rows that share id and
    text are one document and get the same result. The text is put together from the
    lines left. Other columns are kept, but ``n_lines`` and ``deleted`` are replaced;
    names starting with ``_`` are reserved. An empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "deleted")]
    return _without(docs, min_words).select(*kept, F.col("_lines").alias("n_lines"), F.col("_gone").alias("deleted"))


def drop_repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated runs gone and ``n_chars`` counted anew; a document that
    loses all its lines goes with them. Columns stay as they are."""
    cut = _without(docs, min_words).filter((F.size("_gone") == 0) | (F.size("_gone") < F.col("_lines")))
    if "n_chars" in docs.columns:
        changed = F.when(F.size("_gone") > 0, F.length("text")).otherwise(F.col("n_chars"))
        cut = cut.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


ORACLE = r"""
WITH l AS (
  SELECT doc_id, line, regexp_replace(value, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS value, value AS raw
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
), k AS (
  SELECT doc_id, value, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS seq, len(regexp_extract_all(value, '[^\x20\x09-\x0D]+')) AS w
  FROM l WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')
), r AS (
  SELECT *, seq - row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS g
  FROM k WHERE value IN (SELECT value FROM k GROUP BY value HAVING count(*) > 1)
), u AS (
  SELECT *, sum(w) OVER (PARTITION BY doc_id, g ORDER BY seq) AS upto FROM r
), p AS (
  SELECT doc_id, s, e FROM (
    SELECT a.doc_id, a.seq AS s, min(b.seq) AS e FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.g = b.g AND b.seq >= a.seq
      AND b.upto - a.upto + a.w >= 50 GROUP BY 1, 2
    UNION
    SELECT a.doc_id, max(a.seq) AS s, b.seq AS e FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.g = b.g AND b.seq >= a.seq
      AND b.upto - a.upto + a.w >= 50 GROUP BY a.doc_id, b.seq)
), c AS (
  SELECT p.doc_id, s, e, string_agg(value, chr(10) ORDER BY seq) AS content
  FROM p JOIN r ON p.doc_id = r.doc_id AND r.seq BETWEEN s AND e GROUP BY ALL
), f AS (
  SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, s) AS n FROM c
), x AS (
  SELECT doc_id, list_sort(list_distinct(flatten(list(generate_series(s, e))))) AS gone FROM f WHERE n > 1 GROUP BY 1
)
SELECT d.doc_id, CAST(coalesce((SELECT count(*) FROM k WHERE k.doc_id = d.doc_id), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(gone), 0) AS BIGINT) AS n_deleted, coalesce(array_to_string(gone, ','), '') AS deleted
FROM documents d LEFT JOIN x ON d.doc_id = x.doc_id
"""


def op2(spark, sf_dir: str) -> DataFrame:
    """The lines that go, without putting the texts together again."""
    docs = keyed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lost = durable(deletions(docs)).withColumnsRenamed({"doc_id": "_d", "_hash": "_h"}).hint("merge")
    counted = docs.select(*DOC, F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(WORD))).cast("long").alias("n_lines"))
    met = counted.join(lost, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_h")), "left")
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    return met.select("doc_id", "n_lines", F.size(gone).cast("long").alias("n_deleted"), F.array_join(gone.cast("array<string>"), ",").alias("deleted"))
