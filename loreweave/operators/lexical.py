"""Inverted index, BM25, sparse vectors."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreweave import skew
from loreweave.functions import text
from loreweave.session import durable

K1, B = 1.5, 0.75
#: Query-term rows and queries that travel to the tasks, and scores a task holds at a time.
BROADCAST_TERMS, BROADCAST_QUERIES = 1 << 17, 1 << 12
SCORES = 1 << 21


def each(words: str | Column) -> Column:
    """One row per word and a null for none, to be filtered out: a plain ``explode`` has
    the words of every text taken once more to test that there are any."""
    return F.explode_outer(words)


def postings(docs: DataFrame, key: str, body: str = "text") -> DataFrame:
    """``(key, term, tf, doc_len)``. A document sits in one input partition, so the
    partial count leaves one row per (document, term) to shuffle. Write the result
    partitioned by vault to reuse it between query batches."""
    words = docs.select(key, text.tokens(F.col(body)).alias("_w"))
    return (
        words.select(key, F.size("_w").alias("doc_len"), each("_w").alias("term"))
        .filter("term is not null")
        .groupBy(key, "doc_len", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def collection_stats(docs: DataFrame, body: str = "text") -> DataFrame:
    """One row: number of documents and their mean length in tokens."""
    return docs.agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg(F.size(text.tokens(F.col(body)))).alias("avg_len")
    )


def term_stats(index: DataFrame) -> DataFrame:
    """Document frequency per term, from postings. Counting ``tf`` keeps the columns of
    the index the same as in its other uses, so its shuffle is shared."""
    return index.groupBy("term").agg(F.count("tf").alias("df"))


def document_frequency(docs: DataFrame, body: str = "text") -> DataFrame:
    """Document frequency per term straight from the texts: each document names a term
    once, so only partial counts per term are shuffled, not (document, term) rows."""
    return (
        docs.select(each(F.array_distinct(text.tokens(F.col(body)))).alias("term"))
        .filter("term is not null")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def query_terms(queries: DataFrame, body: str = "text") -> DataFrame:
    """``(query_id, term, times)``: repeated query terms count repeatedly."""
    return (
        queries.select("query_id", each(text.tokens(F.col(body))).alias("term"))
        .filter("term is not null")
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("times"))
    )


def bm25(
    queries: DataFrame,
    index: DataFrame,
    stats: DataFrame,
    key: str,
    limit: int,
    k1: float = K1,
    b: float = B,
    variant: str = "reference",
    frequencies: DataFrame | None = None,
    broadcast_terms: int = BROADCAST_TERMS,
) -> DataFrame:
    """Top ``limit`` documents per query, ties by key.

    ``reference`` normalises by ``b * len / mean`` and floors the idf at zero;
    ``okapi`` is the textbook form. ``frequencies(term, df)`` stands for those of a wider
    collection; without it they are counted from the index, whose rows of asked terms are
    kept for both uses.

    Up to ``broadcast_terms`` query-term rows (counted first) travel to the tasks, which
    score documents for all queries and hand on only the best ``limit`` per query. Beyond that scores are rows of a join, one per query and document.
    """
    n, mean = stats.select(F.col("n_docs")).scalar(), stats.select(F.col("avg_len")).scalar()
    wanted = query_terms(queries)
    given = wanted.limit(broadcast_terms + 1).toArrow()
    asked = wanted.select("term").distinct()
    small = len(given) <= broadcast_terms and len(pc.unique(given.column("query_id"))) <= BROADCAST_QUERIES
    if small:
        # Of known size, so the optimiser drops other terms before they are counted.
        wanted = queries.sparkSession.createDataFrame(given, wanted.schema)
        asked = queries.sparkSession.createDataFrame(pa.table({"term": pc.unique(given.column("term"))}), asked.schema)
    hits = index.join(asked, "term", "left_semi")
    if frequencies is None:
        # Read twice: for the frequencies and for the scores.
        hits = durable(hits)
    known = term_stats(hits) if frequencies is None else frequencies.join(asked, "term", "left_semi")
    df = F.col("df")
    if variant == "reference":
        idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(0.0))
        norm = F.when(mean > 0, b * (F.col("doc_len") / mean)).otherwise(1.0)
    elif variant == "okapi":
        idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
        norm = F.when(mean > 0, 1 - b + b * (F.col("doc_len") / mean)).otherwise(1.0)
    else:
        raise ValueError(f"unknown variant {variant!r}")
    weighted = wanted.join(known, "term").select("query_id", "term", (F.col("times") * idf).alias("weight"))
    part: Column = (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * norm)
    if small:
        scored = _best_in_tasks(hits.select(key, "term", part.alias("part")), weighted, key, limit)
    else:
        scored = (
            hits.join(weighted, "term")
            .groupBy("query_id", key)
            .agg(F.round(F.sum(F.col("weight") * part), 6).alias("score"))
        )
    return skew.top_per_group(scored, ["query_id"], [F.desc("score"), F.col(key)], limit)


def _best_in_tasks(parts: DataFrame, weighted: DataFrame, key: str, limit: int) -> DataFrame:
    """``(query_id, key, score)``: of every task its best ``limit`` documents per query,
    ties by key, from ``parts(key, term, part)`` and few ``weighted(query_id, term, weight)``."""
    given = weighted.toArrow().combine_chunks().sort_by("term")
    terms, asks = (given.column(c).combine_chunks().dictionary_encode("encode") for c in ("term", "query_id"))
    names, ask, weight = asks.dictionary, asks.indices.to_numpy().astype(np.int64), given.column("weight").to_numpy()
    count = np.bincount(terms.indices.to_numpy(), minlength=len(terms.dictionary))
    start = np.cumsum(count) - count
    numbers = pa.table({"term": terms.dictionary, "_t": pa.array(np.arange(len(count), dtype=np.int32))})
    schema = T.StructType([weighted.schema["query_id"], parts.schema[key], T.StructField("score", T.DoubleType())])

    def best(q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Of each query the ``limit`` best places; of equal scores the first stand."""
        order = np.lexsort((np.arange(len(q)), -score, q))
        return order[np.arange(len(q)) - np.searchsorted(q[order], q[order]) < limit]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
        """Keys of whole documents, and of their entries the document, term and part."""
        rest = None
        for batch in itertools.chain(batches, [None]):
            rows = pa.Table.from_batches([b for b in (rest, batch) if b is not None]).combine_chunks() if rest or batch else None
            if rows is None or not len(rows):
                continue
            keys = rows.column(0).combine_chunks()
            one, two = keys.slice(1), keys.slice(0, len(keys) - 1)
            other = pc.and_not(pc.fill_null(pc.not_equal(one, two), True), pc.and_(one.is_null(), two.is_null()))
            first = np.concatenate([[0], np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1])
            upto = len(rows) if batch is None else first[-1]  # the last one may go on
            rest = rows.slice(upto).to_batches()[0] if upto < len(rows) else None
            first = first[first < upto]
            if len(first):
                of = np.repeat(np.arange(len(first)), np.diff(np.append(first, upto)))
                yield keys.take(pa.array(first)), of, *(rows.column(c).to_numpy()[:upto] for c in (1, 2))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, SCORES // max(1, len(names)))
        q, score, found = np.zeros(0, np.int64), np.zeros(0), None
        for keys, of, t, part in documents(batches):
            pairs = np.cumsum(np.bincount(of, count[t], minlength=len(keys)))
            entry = np.searchsorted(of, np.arange(len(keys) + 1))
            at = 0
            while at < len(keys):
                to = np.searchsorted(pairs, (pairs[at - 1] if at else 0) + SCORES, "right")
                to = min(max(to, at + 1), at + step, len(keys))
                some = slice(entry[at], entry[to])
                n, times = to - at, count[t[some]]
                asked = np.arange(times.sum()) + np.repeat(start[t[some]] - np.cumsum(times) + times, times)
                cell = ask[asked] * n + np.repeat(of[some] - at, times)
                raw = np.bincount(cell, weight[asked] * np.repeat(part[some], times), minlength=len(names) * n).reshape(-1, n)
                hit = np.zeros(raw.shape, bool)
                hit.reshape(-1)[cell] = True
                if n > limit:
                    # Only what may be among the best is rounded.
                    hit &= raw >= (np.partition(raw, n - limit, axis=1)[:, n - limit] - 2e-6)[:, None]
                i, j = np.nonzero(hit)
                rounded = np.floor(raw[i, j] * 1e6 + 0.5) / 1e6
                few = best(i, rounded)
                more = keys.take(pa.array(j[few] + at))
                # Documents come in order of key, so what was found before stands first.
                q, score, found = np.concatenate([q, i[few]]), np.concatenate([score, rounded[few]]), more if found is None else pa.concat_arrays([found, more])
                few = best(q, score)
                q, score, found = q[few], score[few], found.take(pa.array(few))
                at = to
        if len(q):
            yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), found, pa.array(score)], schema.names)

    spark = parts.sparkSession
    numbered = parts.join(spark.createDataFrame(numbers, "term string, _t int"), "term").select(key, "_t", "part")
    return numbered.repartition(key).sortWithinPartitions(key).mapInArrow(scan, schema)


def sparse_encode(docs: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Unit-length tf-idf weights ``(key, term, weight)``.

    A document has a bounded vocabulary, but its norm is taken by an aggregate and
    a join back all the same, so partial sums travel instead of rows. Postings are
    counted once and kept; frequencies and norms are tables of known size, which the
    optimiser broadcasts while they are small.
    """
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    idf = 1 + F.log((n + 1) / (F.col("df") + 1))
    held = durable(index.select(key, "term", "tf"))
    raw = held.join(durable(term_stats(held)), "term").select(key, "term", (F.col("tf") * idf).alias("w"))
    norms = durable(raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")))
    return raw.join(norms, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))
