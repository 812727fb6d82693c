"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Each text becomes a row of statistics of its letters, words and lines. Cosines of
random projections of the standardised statistics approximate a Gaussian kernel; the
ridge weights over them solve normal equations that every partition sums for itself,
so what reaches the driver is one square matrix, however many rows are labelled. The
raw scores are counted on a fixed grid and made monotone by pooling adjacent cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreweave.llm.common import crc_mod, table
from loreweave.session import durable

#: Cosine features, ridge strength, kernel width (times the square root of the number of
#: statistics), cells of the calibration grid and its range.
COSINES, RIDGE, WIDTH, CELLS, LOW, HIGH = 256, 1.0, 1.0, 1024, -1.0, 2.0
SEED = 17
THRESHOLD = 0.5

CLASSES = 13


def _classes() -> np.ndarray:
    """Class of each byte: letters, digits, blanks, marks and bytes beyond ASCII."""
    c = np.full(256, 11, dtype=np.uint8)
    for chars, k in (
        (b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" ", 3), (b"\n", 4),
        (b"\t\r\x0b\x0c", 5), (b".", 6), (b",", 7), (b"!?", 8), (b"|", 9), (b"#$%&*@^~+=<>_/\\{}", 10),
    ):
        c[list(chars)] = k
    c[128:] = 12
    return c


def _share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


def statistics(text: bytes | None) -> list[float]:
    """Statistics of one UTF-8 text; an empty or null one has zeros throughout."""
    raw = text or b""
    counts = np.bincount(_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=CLASSES)
    n = len(raw)
    words = raw.split()
    m = len(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=m)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    letters = int(counts[0] + counts[1] + counts[12])
    return [
        *(counts / max(n, 1)).tolist(),
        float(np.log1p(n)),
        float(np.log1p(m)),
        float(lengths.mean()) if m else 0.0,
        float(lengths.std()) if m else 0.0,
        _share(int((lengths <= 3).sum()), m),
        _share(int((lengths > 12).sum()), m),
        _share(len(set(words)), m),
        _share(len(set(zip(words, words[1:]))), m - 1),
        _share(sum(map(bytes.isupper, words)), m),
        _share(sum(map(bytes.isalpha, words)), m),
        _share(sum(map(bytes.istitle, words)), m),
        _share(len(set(lines)), len(lines)),
        float(np.log1p(m / len(lines))) if lines else 0.0,
        _share(int(counts[1]), letters),
        _share(int(counts[6] + counts[7]), m),
        _share(int(counts[10]), m),
    ]


_CLASS = _classes()
STATISTICS = len(statistics(b""))


@dataclass(frozen=True)
class Model:
    """Standardisation, projections, ridge weights and the calibration curve."""

    mean: np.ndarray
    scale: np.ndarray
    project: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    curve_at: np.ndarray
    curve: np.ndarray

    def cosines(self, x: np.ndarray) -> np.ndarray:
        return _cosines((x - self.mean) / self.scale, self.project, self.phase)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1. A small share of the raw score keeps the order inside a
        level of the calibration curve."""
        raw = self.cosines(x) @ self.weights
        level = np.interp(raw, self.curve_at, self.curve) if len(self.curve_at) else np.clip(raw, 0.0, 1.0)
        return 0.999 * level + 0.001 / (1 + np.exp(-4 * (np.clip(raw, LOW, HIGH) - 0.5)))


def _cosines(x: np.ndarray, project: np.ndarray, phase: np.ndarray) -> np.ndarray:
    z = np.cos(np.clip(x, -8, 8) @ project + phase) * np.sqrt(2.0 / len(phase))
    return np.hstack([z, np.ones((len(x), 1))])


def describe(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but ``text``, and ``stats``, its statistics."""
    kept = [c for c in docs.columns if c not in ("text", "stats")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = [statistics(t.as_py()) for t in b.column(len(kept)).cast(pa.binary())]
            values = pa.array(np.array(flat, dtype=np.float32).reshape(-1))
            offsets = pa.array(np.arange(0, len(values) + 1, STATISTICS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.ListArray.from_arrays(offsets, values)], [*kept, "stats"])

    kind = T.StructType([docs.schema[c] for c in kept] + [T.StructField("stats", T.ArrayType(T.FloatType()))])
    return docs.select(*kept, "text").mapInArrow(run, kind)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, STATISTICS)


def _normal(labelled: DataFrame, mean: np.ndarray, scale: np.ndarray, project: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """Sums of the outer products of (cosines, label), each partition adding its own rows."""
    size = len(phase) + 2

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in batches:
            for at in range(0, len(b), 2048):
                part = b.slice(at, 2048)
                z = _cosines((_matrix(part.column(0)) - mean) / scale, project, phase)
                z = np.hstack([z, part.column(1).to_numpy(zero_copy_only=False).reshape(-1, 1)])
                total += z.T @ z
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(list(total))], ["i", "row"])

    def add(rows: pa.Table) -> pa.Table:
        values = rows.column("row").combine_chunks().flatten().to_numpy().reshape(-1, size)
        return pa.table({"i": rows.column("i")[:1], "row": pa.array([values.sum(axis=0)])})

    kind = "i int, row array<double>"
    rows = labelled.select("stats", F.col("label").cast("double")).mapInArrow(partial, kind).groupBy("i").applyInArrow(add, kind).collect()
    total = np.zeros((size, size))
    for r in rows:
        total[r["i"]] = r["row"]
    return total


def _monotone(at: np.ndarray, positive: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent cells until the share of positives never falls."""
    blocks: list[list[float]] = []
    for x, p, k in zip(at, positive, n):
        blocks.append([x * k, p, k])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    where, share = np.array([b[0] / b[2] for b in blocks]), np.array([(b[1] + 0.5) / (b[2] + 1.0) for b in blocks])
    return where, np.maximum.accumulate(share)


def fit(labelled: DataFrame) -> Model:
    """A model from ``labelled(stats, label)``, label 0 or 1; rows with a null label are
    left out. Without rows every score is one half."""
    known = labelled.filter(F.col("label").isNotNull())
    rng = np.random.default_rng(SEED)
    project = rng.normal(size=(STATISTICS, COSINES)) / (WIDTH * np.sqrt(STATISTICS))
    phase = rng.uniform(0, 2 * np.pi, COSINES)
    sums = known.agg(
        F.count(F.lit(1)),
        *[F.avg(F.col("stats")[i]) for i in range(STATISTICS)],
        *[F.stddev_pop(F.col("stats")[i]) for i in range(STATISTICS)],
    ).first()
    if not sums[0]:
        one = np.zeros(COSINES + 1)
        one[-1] = 0.5
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS), project, phase, one, np.zeros(0), np.zeros(0))
    mean = np.array(sums[1 : STATISTICS + 1], dtype=float)
    scale = np.array(sums[STATISTICS + 1 :], dtype=float)
    scale = np.where(scale > 1e-6, scale, 1.0)
    total = _normal(known, mean, scale, project, phase)
    left = total[:-1, :-1] + RIDGE * np.diag([1.0] * COSINES + [1e-6])
    model = Model(mean, scale, project, phase, np.linalg.solve(left, total[:-1, -1]), np.zeros(0), np.zeros(0))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = model.cosines(_matrix(b.column(0))) @ model.weights
            cell = ((np.clip(raw, LOW, HIGH) - LOW) / (HIGH - LOW) * (CELLS - 1)).round().astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell), b.column(1)], ["cell", "label"])

    cells = known.select("stats", F.col("label").cast("double")).mapInArrow(place, "cell int, label double")
    grid = sorted(cells.groupBy("cell").agg(F.sum("label"), F.count(F.lit(1))).collect())
    at = LOW + np.array([g[0] for g in grid]) * (HIGH - LOW) / (CELLS - 1)
    curve_at, curve = _monotone(at, np.array([g[1] for g in grid]), np.array([g[2] for g in grid], dtype=float))
    return Model(mean, scale, project, phase, model.weights, curve_at, curve)


def score(described: DataFrame, model: Model) -> DataFrame:
    """``described`` rows with ``score`` in place of ``stats``."""
    kept = [c for c in described.columns if c not in ("stats", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = model.score(_matrix(b.column(len(kept)))) if len(b) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(scores)], [*kept, "score"])

    kind = T.StructType([described.schema[c] for c in kept] + [T.StructField("score", T.DoubleType())])
    return described.select(*kept, "stats").mapInArrow(run, kind)


def learn(described: DataFrame, labels: DataFrame, train: Column) -> Model:
    """A model from ``described(doc_id, stats)`` and ``labels(doc_id, label)`` of
    documents for which ``train`` holds. A label without a document, a null label and
    a null id teach nothing; repeated labels each count, and rows that share an id take
    the label each."""
    known = labels.filter(train & F.col("label").isNotNull())
    return fit(durable(described.join(known, "doc_id").select("stats", "label")))


def classify(docs: DataFrame, labels: DataFrame, train: Column) -> DataFrame:
    """``(doc_id, score)`` per row of ``docs(doc_id, text)``, learned as in ``learn``.

    Only the text is looked at. Null and empty texts are scored like any other.
    """
    described = durable(describe(docs.select("doc_id", "text")))
    return score(described, learn(described, labels, train))


def keep_good(docs: DataFrame, labels: DataFrame, train: Column, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, columns as they are. Texts
    are judged where they are read: none is shuffled."""
    model = learn(describe(docs.select("doc_id", "text")), labels, train)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                stats = np.array([statistics(t.as_py()) for t in b.column(at).cast(pa.binary())], dtype=np.float32)
                yield b.filter(pa.array(model.score(stats.astype(np.float64)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(key: Column) -> Column:
    """The third of documents whose labels are never learned from; null ids are none."""
    return F.coalesce(crc_mod(key, 3) == 1, F.lit(False))


def op1(spark, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classify(docs, labels, ~held_out(F.col("doc_id")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
