"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words, of its pairs of neighbours and
of pairs with one word between. Each training shard runs follow-the-regularised-leader
over its rows: every coordinate has its own rate, and L1 keeps weights of rare or
undecided features at exactly zero. After each pass the shards' states are averaged
and the next pass starts from there. What is left are a few thousand weights, bounded
by the number of hash cells, that go to the tasks for scoring.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreweave.llm.common import crc_mod, table
from loreweave.session import durable, release

#: Hash cells, most labelled rows learned from (about so many, by hash of the id, of
#: more), shards and passes. The bound is what makes a broadcast of the labels safe.
CELLS, ROWS, SHARDS, PASSES = 1 << 20, 60_000, 6, 8
#: Rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 0.8, 1.0, 2.0, 0.1
THRESHOLD = 0.3
#: Words of a text that are hashed at a time.
PIECE = 1 << 20

# Odd multipliers that mix word hashes of a pair and of a skip-gram.
_PAIR, _SKIP, _FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Hasher:
    """Feature cells of a text; remembers the hashes of a bounded number of words."""

    def __init__(self, cells: int = CELLS):
        self.cells, self.known = np.uint64(cells - 1), {}

    def _words(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > 500_000:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)

    def _fold(self, h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(31))) * _FOLD
        return (h ^ (h >> np.uint64(29))) & self.cells

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = _WORD.findall((text or b"").lower())
        found = []
        for at in range(0, len(words), PIECE):
            h = self._words(words[at : at + PIECE + 2])
            last = at + PIECE >= len(words)
            grams = [h if last else h[:PIECE], h[:-1] * _PAIR + h[1:], h[:-2] * _SKIP + h[2:] * _PAIR]
            found.append(np.unique(self._fold(np.concatenate(grams)).astype(np.int32)))
        return np.unique(np.concatenate(found)) if len(found) > 1 else found[0] if found else np.zeros(0, np.int32)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    over = np.abs(z) > L1
    return np.where(over, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)


def _chance(total: float) -> float:
    return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))


def _learn(rows: Iterable[tuple[np.ndarray, float]], z: np.ndarray, n: np.ndarray) -> None:
    """One pass over ``rows`` of (cells, label); the last cell of the state is the bias."""
    for cells, y in rows:
        at = np.append(cells, len(z) - 1)
        w = _weights(z[at], n[at])
        g = _chance(w.sum()) - y
        squared = n[at] + g * g
        z[at] += g - (np.sqrt(squared) - np.sqrt(n[at])) / ALPHA * w
        n[at] = squared


def features(docs: DataFrame) -> DataFrame:
    """``(shard, place, label, cells)`` of ``docs(place, label, text)``; ``place`` orders
    a shard's rows, ``cells`` are packed steps from one cell to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        hashed, pack = Hasher(), zstandard.ZstdCompressor(level=3)
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                cells = [pack.compress(np.diff(hashed(t.as_py()), prepend=np.int32(0)).tobytes()) for t in part.column(2).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cells, pa.binary())], ["place", "label", "cells"])

    made = docs.select("place", "label", "text").mapInArrow(run, "place bigint, label double, cells binary")
    return made.withColumn("shard", F.pmod(F.col("place"), F.lit(SHARDS)).cast("int"))


def _walker(state: dict[str, np.ndarray]):
    """One pass of a shard from a shared state; gives the shard's state."""

    def walk(key: tuple, rows: pa.Table) -> pa.Table:
        import zstandard

        rows = rows.sort_by([("place", "ascending"), ("label", "ascending")])
        z, n = np.zeros(CELLS + 1), np.zeros(CELLS + 1)
        z[state["cell"]], n[state["cell"]] = state["z"], state["n"]
        unpack = zstandard.ZstdDecompressor()
        cells = (np.cumsum(np.frombuffer(unpack.decompress(c.as_py()), np.int32)) for c in rows.column("cells"))
        _learn(zip(cells, rows.column("label").to_numpy()), z, n)
        # What a rare feature has gathered is far below L1 and is not worth sending.
        at = np.flatnonzero(np.abs(z) > 0.25 * L1)
        return pa.table({"cell": at.astype(np.int32), "z": z[at].astype(np.float32), "n": n[at].astype(np.float32)})

    return walk


def fit(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Weights from ``labelled(doc_id, text, label)``: their cells, their values and the
    bias. Null labels are left out. Without rows the bias is 0."""
    known = labelled.filter(F.col("label").isNotNull()).withColumn("place", F.xxhash64("doc_id", "text"))
    shards = durable(features(known.withColumn("label", F.col("label").cast("double"))).repartition(SHARDS, "shard"))
    state = {"z": np.zeros(0), "n": np.zeros(0), "cell": np.zeros(0, np.int64)}
    for _ in range(PASSES):
        per = shards.groupBy("shard").applyInArrow(_walker(state), "cell int, z float, n float")
        made = durable(per.groupBy("cell").agg((F.sum("z") / SHARDS).alias("z"), (F.sum("n") / SHARDS).alias("n")))
        rows = made.filter(F.abs("z") > 0.05 * L1).collect()
        release(made)
        state = {
            "cell": np.array([r["cell"] for r in rows], dtype=np.int64),
            "z": np.array([r["z"] for r in rows], dtype=float),
            "n": np.array([r["n"] for r in rows], dtype=float),
        }
    release(shards)
    w = _weights(state["z"], state["n"])
    order = np.argsort(state["cell"])
    cell, w = state["cell"][order], w[order]
    bias = float(w[cell == CELLS].sum())
    use = (w != 0) & (cell < CELLS)
    return {"cell": cell[use], "weight": w[use], "bias": np.array([bias])}


def score(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """The columns of ``docs`` but ``text``, and ``score``. Whole texts are looked at;
    null and empty ones get what the bias gives."""
    kept = [c for c in docs.columns if c not in ("text", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hasher()
        weight = np.zeros(CELLS, dtype=np.float32)
        weight[model["cell"]] = model["weight"]
        bias = float(model["bias"][0])
        for b in batches:
            scores = [float(_chance(bias + weight[hashed(t.as_py())].sum(dtype=np.float64))) for t in b.column(len(kept)).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(scores, pa.float64())], [*kept, "score"])

    kind = T.StructType([docs.schema[c] for c in kept] + [T.StructField("score", T.DoubleType())])
    return docs.select(*kept, "text").mapInArrow(run, kind)


def classify(docs: DataFrame, labels: DataFrame, train: Column) -> DataFrame:
    """``(doc_id, score)`` per row of ``docs(doc_id, text)``, learned from
    ``labels(doc_id, label)`` of documents for which ``train`` holds. A label without a
    document, a null label and a null id teach nothing; repeated labels each count."""
    known = durable(labels.filter(train & F.col("label").isNotNull()).select("doc_id", "label"))
    n = known.count()
    if n > ROWS:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(ROWS / n * (1 << 30)))
    labelled = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    return score(docs.select("doc_id", "text"), fit(labelled))


def held_out(key: Column) -> Column:
    """The quarter of documents whose labels are never learned from; null ids are none."""
    return F.coalesce(crc_mod(key, 4) == 2, F.lit(False))


def op6(spark, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    docs = table(spark, sf_dir, "documents")
    scored = classify(docs, labels, ~held_out(F.col("doc_id")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
