"""Cosine search and vector upkeep.

Search never forms query x row pairs as rows: each task multiplies a block of
vectors with the queries and hands on only the best ``k`` per query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreweave import skew
from loreweave.functions import facts as ff
from loreweave.session import durable

BROADCAST_QUERIES = 1024
#: Vectors of a tile, rows and vector elements a task holds, scores it holds at a time.
QUERY_BLOCK = 10_000
ROW_BLOCK = 1 << 19
ROW_VALUES = 1 << 25
SCORES = 1 << 23
TILE_SCORES = 1 << 21
#: Buckets of the compared column, and cells of queries x rows for each core.
BUCKETS = 1024
CELLS_PER_CORE = 4


# ── expressions ───────────────────────────────────────────────────────────────
def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vector columns; 0 for unequal length, empty or zero vectors."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0)
    return F.when(usable, _dot(a, b) / norm).otherwise(0.0)


def is_zero_vector(v: Column) -> Column:
    return F.forall(v, lambda x: x == 0)


# ── block kernel ──────────────────────────────────────────────────────────────
def _normal(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _unit(vectors: list) -> np.ndarray:
    return _normal(np.concatenate(vectors).reshape(len(vectors), -1))


def _best(rows: np.ndarray, queries: np.ndarray, k: int, threshold: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and query indices and rounded scores of the best ``k`` rows per query; among
    equal scores the first rows win, so callers sort rows by key.

    Only what may be among them is rounded: the ``k``-th best score, or the threshold,
    less what rounding can shift.
    """
    found = []
    n, step = len(rows), max(1, SCORES // max(len(rows), 1))
    for at in range(0, len(queries), step):
        raw = queries[at : at + step] @ rows.T
        if threshold is not None:
            near = raw >= threshold - 2e-6
        if n > k and (threshold is None or np.count_nonzero(near) > 4 * k * len(raw)):
            cut = np.partition(raw, n - k, axis=1)[:, n - k] - 2e-6
            near = raw >= (cut if threshold is None else np.maximum(cut, threshold - 2e-6))[:, None]
        elif threshold is None:
            near = np.ones(raw.shape, bool)
        q, r = np.nonzero(near)
        score = np.round(raw[q, r], 6) + 0.0
        if threshold is not None:
            ok = score >= threshold
            q, r, score = q[ok], r[ok], score[ok]
        order = np.lexsort((r, -score, q))
        q, r, score = q[order], r[order], score[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k
        found.append((r[first], q[first] + at, score[first]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _search_block(queries: pd.DataFrame, rows: pd.DataFrame, key: str, k: int, threshold, within: str | None, per: str | None) -> pd.DataFrame:
    """Exact top ``k`` of one block. ``queries`` and ``rows`` carry an ``embedding``."""
    found = []
    rows = rows.sort_values(key, kind="stable").reset_index(drop=True)
    rows["_dim"] = rows["embedding"].map(len)
    queries = queries.assign(_dim=queries["embedding"].map(len)).reset_index(drop=True)
    row_parts = rows.groupby(["_dim", within or per] if within or per else ["_dim"], sort=False).indices
    query_parts = queries.groupby(["_dim", within] if within else ["_dim"], sort=False).indices
    for part, r in row_parts.items():
        q = query_parts.get(part if within else (part[0] if per else part))
        if q is None:
            continue
        block, asked = rows.iloc[r], queries.iloc[q]
        i, j, score = _best(_unit(block["embedding"].tolist()), _unit(asked["embedding"].tolist()), k, threshold)
        hit = {"query_id": asked["query_id"].to_numpy()[j], key: block[key].to_numpy()[i], "score": score}
        if per:
            hit[per] = np.full(len(i), part[1], dtype=object)
        found.append(pd.DataFrame(hit))
    return pd.concat(found) if found else pd.DataFrame()


def _keep(found: pd.DataFrame, key: str, k: int, per: str | None) -> pd.DataFrame:
    group = ["query_id", per] if per else ["query_id"]
    ordered = found.sort_values([*group, "score", key], ascending=[True] * len(group) + [False, True], kind="stable")
    return ordered.groupby(group, sort=False).head(k)


# ── cells ─────────────────────────────────────────────────────────────────────
def _true_at(near: np.ndarray) -> np.ndarray:
    """Where a mostly false mask of whole words is true."""
    words = np.flatnonzero(near.view(np.uint64))
    at = (words[:, None] * 8 + np.arange(8)).ravel()
    return at[near[at]]


def _nearest(queries: np.ndarray, tiles: list[np.ndarray], k: int, threshold: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_best`` for unit queries and rows as they are, which come in tiles.

    Scores are taken in single precision first; what may be among the best by the bound
    of its error is scored again in double precision. The ``k``-th best so far is the
    bar for the next tile.
    """
    slack = (queries.shape[1] + 8) * 2.0**-23 + 1e-6
    single = queries.astype(np.float32)
    bar = np.full(len(queries), -np.inf if threshold is None else threshold - slack, np.float32)
    step = max(1, TILE_SCORES // max(map(len, tiles)))
    best = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))] * -(-len(queries) // step)
    base = 0
    for tile in tiles:
        unit, n = _normal(tile), len(tile)
        across = np.ascontiguousarray(unit.astype(np.float32).T)
        for b, at in enumerate(range(0, len(queries), step)):
            asked, bars = queries[at : at + step], bar[at : at + step]
            raw = single[at : at + step] @ across
            near = np.zeros(-(-raw.size // 8) * 8, bool)
            np.greater_equal(raw, bars[:, None], out=near[: raw.size].reshape(raw.shape))
            if n > k and np.count_nonzero(near) > 4 * k * len(asked):
                groups = min(n, 16 * k)  # the k-th best of their largest is no more than the k-th best
                largest = raw[:, : n // groups * groups].reshape(len(asked), -1, groups).max(axis=1)
                cut = np.partition(largest, groups - k, axis=1)[:, groups - k] - np.float32(2 * slack)
                np.greater_equal(raw, np.maximum(cut, bars)[:, None], out=near[: raw.size].reshape(raw.shape))
            hit = _true_at(near)
            if not len(hit):
                continue
            i, j = hit // n, hit % n
            exact = np.round(np.einsum("ij,ij->i", asked[i], unit[j]), 6) + 0.0
            if threshold is not None:
                ok = exact >= threshold
                i, j, exact = i[ok], j[ok], exact[ok]
            q, r, score = (np.concatenate(x) for x in zip(best[b], (i, j + base, exact)))
            order = np.lexsort((r, -score, q))
            q, r, score = q[order], r[order], score[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            last = place == k - 1
            bars[q[last]] = np.maximum(bars[q[last]], (score[last] - slack).astype(np.float32))
            first = place < k
            best[b] = q[first], r[first], score[first]
        base += n
    found = [(r, q + b * step, score) for b, (q, r, score) in enumerate(best)]
    return tuple(np.concatenate(x) for x in zip(*found))


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _parts(batch: pa.RecordBatch, by_part: bool) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The rows of each dimension and compared value, in order; null compares with none."""
    dim = pc.list_value_length(batch.column("embedding")).to_numpy(zero_copy_only=False)
    coded = batch.column("_part").dictionary_encode()
    part = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False) if by_part else np.zeros(len(dim), int)
    for d, p in dict.fromkeys(zip(dim.tolist(), part.tolist())):
        if p >= 0:
            at = np.flatnonzero((dim == d) & (part == p))
            yield (d, coded.dictionary[p].as_py() if by_part else None), batch if len(at) == len(batch) else batch.take(pa.array(at))


class _Cell:
    """The rows of a cell, by dimension and compared value, in the order of their keys."""

    def __init__(self, within: bool, per: bool):
        self.within, self.per = within, per
        self.tiles: dict[tuple, list[np.ndarray]] = {}
        self.keys: dict[tuple, list[pa.Array]] = {}

    def add(self, batch: pa.RecordBatch) -> None:
        for name, rows in _parts(batch, self.within or self.per):
            tiles, m = self.tiles.setdefault(name, []), _matrix(rows.column("embedding"))
            if tiles and len(tiles[-1]) + len(m) <= QUERY_BLOCK:
                tiles[-1] = np.concatenate([tiles[-1], m])
            else:
                tiles.append(m.copy())
            self.keys.setdefault(name, []).append(rows.column("_key"))

    def search(self, batch: pa.RecordBatch, k: int, threshold, names: list[str]) -> Iterator[pa.RecordBatch]:
        for name, asked in _parts(batch, self.within):
            unit = _normal(_matrix(asked.column("embedding")))
            for held in [h for h in self.tiles if (h[0] == name[0] if self.per else h == name)]:
                r, q, score = _nearest(unit, self.tiles[held], k, threshold)
                if len(self.keys[held]) > 1:
                    self.keys[held] = [pa.concat_arrays(self.keys[held])]
                columns = [asked.column("query_id").take(pa.array(q)), self.keys[held][0].take(pa.array(r)), pa.array(score)]
                if self.per:
                    columns.append(pa.array([held[1]] * len(q), batch.schema.field("_part").type))
                yield pa.RecordBatch.from_arrays(columns, names=names)


def _grid(sizes: dict, rows_held: int, cells: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """``(bucket, first cell, query splits, row splits)`` of each bucket with queries and
    rows, and the number of cells.

    A bucket is cut by its share of the pairs, and so that a cell holds at most
    ``rows_held`` rows; each side is copied as often as the other is cut, so the larger
    one is cut more. Small buckets share a cell.
    """
    total = sum(q * r for q, r in sizes.values())
    plan, n = [], 0
    shared = None
    for bucket, (q, r) in sorted(sizes.items()):
        want = max(1, min(round(cells * q * r / total), q * r >> 22))
        r_splits = max(-(-r // rows_held), min(want, round(math.sqrt(want * r / q))), 1)
        q_splits = min(q, -(-want // r_splits))
        if q_splits * r_splits > 1:
            plan.append((bucket, n, q_splits, r_splits))
            n += q_splits * r_splits
            continue
        if shared is None or shared[1] + r > rows_held or shared[2] + q * r > total / cells:
            shared = [n, 0, 0]
            n += 1
        shared[1:] = shared[1] + r, shared[2] + q * r
        plan.append((bucket, shared[0], 1, 1))
    return plan, n


def _search_cells(asked: DataFrame, held: DataFrame, schema: T.StructType, key: str, k: int, threshold, within: str | None, per: str | None) -> DataFrame:
    """Best rows of each query and cell. Both sides are written once, counted, cut into
    cells and sent there, the rows of a cell before its queries: a task keeps the rows
    and takes the queries a batch at a time."""
    asked, held = durable(asked), durable(held)

    def bucket() -> Column:
        return (F.pmod(F.xxhash64(within), F.lit(BUCKETS)) if within else F.lit(0)).cast("int")

    def counted(df: DataFrame) -> dict:
        found = df.groupBy(bucket().alias("b")).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).collect()
        return {r["b"]: (r["n"], r["dim"]) for r in found}

    queries, rows = counted(asked), counted(held)
    sizes = {b: (queries[b][0], rows[b][0]) for b in queries if b in rows}
    spark = asked.sparkSession
    if not sizes:
        return spark.createDataFrame([], schema)
    rows_held = max(1, min(ROW_BLOCK, ROW_VALUES // max(dim for _, dim in rows.values())))
    plan, n = _grid(sizes, rows_held, CELLS_PER_CORE * spark.sparkContext.defaultParallelism)
    grid = F.broadcast(spark.createDataFrame(plan, "_b int, _first int, _qs int, _rs int"))

    def own(column: str, splits: str) -> Column:
        return F.pmod(F.xxhash64(column), F.col(splits)).cast("int")

    def every(splits: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(splits) - 1))

    cell = (F.col("_first") + F.col("_q") * F.col("_rs") + F.col("_r")).alias("_cell")
    part = F.col(within or per) if within or per else F.lit("")
    none = F.lit(None).cast(held.schema[per].dataType) if per else F.lit("")
    left = asked.withColumn("_b", bucket()).join(grid, "_b").withColumn("_q", own("query_id", "_qs")).withColumn("_r", every("_rs"))
    right = held.withColumn("_b", bucket()).join(grid, "_b").withColumn("_r", own(key, "_rs")).withColumn("_q", every("_qs"))
    left = left.select(
        cell, F.lit(1).alias("_kind"), (part if within else none).alias("_part"), "query_id",
        F.lit(None).cast(held.schema[key].dataType).alias("_key"), "embedding",
    )
    right = right.select(
        cell, F.lit(0).alias("_kind"), part.alias("_part"),
        F.lit(None).cast(asked.schema["query_id"].dataType).alias("query_id"), F.col(key).alias("_key"), "embedding",
    )
    names = schema.names

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, at = _Cell(bool(within), bool(per)), None
        for batch in batches:
            runs = batch.column("_cell").to_numpy() * 2 + batch.column("_kind").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), len(runs)]
            for start, stop in zip(cuts, cuts[1:]):
                if stop > start:
                    if runs[start] // 2 != at:
                        cell, at = _Cell(bool(within), bool(per)), runs[start] // 2
                    run = batch.slice(start, stop - start)
                    if runs[start] % 2:
                        yield from cell.search(run, k, threshold, names)
                    else:
                        cell.add(run)

    sent = left.unionByName(right).repartitionById(n, F.col("_cell")).sortWithinPartitions("_cell", "_kind", "_part", "_key")
    return sent.mapInArrow(search, schema)


def knn_batch(
    queries: DataFrame,
    rows: DataFrame,
    key: str,
    k: int = 10,
    threshold: float | None = None,
    within: str | None = None,
    per: str | None = None,
    broadcast_queries: int = BROADCAST_QUERIES,
) -> DataFrame:
    """Exact cosine top ``k`` of every query: ``(query_id, key, score, rank)``.

    ``within`` compares a query only with rows of the same value of that column (its
    vault); ``per`` keeps the top ``k`` for each value of that row column. Scores are
    rounded to six digits and ties go to the smaller key. Queries without a vector
    give no rows and rows of another dimension are passed over.

    Up to ``broadcast_queries`` queries (counted first) travel to the tasks and the
    rows are scanned in place. Beyond that both sides are cut into cells, a few for
    each core and more only where a task could not hold its rows.
    """
    q_cols = ["query_id", *([within] if within else []), "embedding"]
    r_cols = [key, *([within or per] if within or per else []), "embedding"]
    asked = queries.select(*q_cols).filter(F.size("embedding") > 0)
    held = rows.select(*r_cols).filter(F.size("embedding") > 0)
    fields = [asked.schema["query_id"], held.schema[key], T.StructField("score", T.DoubleType())]
    if per:
        fields.append(held.schema[per])
    schema = T.StructType(fields)
    empty = [f.name for f in fields]
    options = (key, k, threshold, within, per)

    first = asked.limit(broadcast_queries + 1).toPandas()
    if len(first) <= broadcast_queries:

        def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = pd.DataFrame(columns=empty)
            for frame in frames:
                if len(frame) and len(first):
                    hits = _search_block(first, frame, *options)
                    if len(hits):
                        best = _keep(pd.concat([best, hits]) if len(best) else hits, key, k, per)
            if len(best):
                yield best[empty]

        found = held.mapInPandas(scan, schema)
    else:
        found = _search_cells(asked, held, schema, key, k, threshold, within, per)
    group = ["query_id", per] if per else ["query_id"]
    return skew.top_per_group(found, group, [F.desc("score"), F.col(key)], k)


def knn(query: DataFrame, rows: DataFrame, key: str, k: int = 10, threshold: float | None = None, where: Column | None = None) -> DataFrame:
    """Single-query form with an optional row filter, which reaches the scan."""
    return knn_batch(query, rows if where is None else rows.filter(where), key, k, threshold)


def batch_outcome(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per query of a batch: number of hits, top score, error for bad ones."""
    found = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top_score"))
    bad = F.coalesce(F.size("embedding"), F.lit(0)) <= 0
    return queries.join(found, "query_id", "left").select(
        "query_id",
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
        F.coalesce("top_score", F.lit(0.0)).alias("top_score"),
        F.when(bad, "no embedding").alias("error"),
    )


def knn_cross_vault(queries: DataFrame, rows: DataFrame, key: str, k: int = 10, threshold: float | None = None) -> DataFrame:
    """Top ``k`` in each vault, then the top ``k`` of those."""
    per_vault = knn_batch(queries, rows, key, k, threshold, per="vault").drop("rank")
    return skew.top_per_group(per_vault, ["query_id"], [F.desc("score"), F.col(key)], k)


def knn_expand(queries: DataFrame, chunks: DataFrame, facts: DataFrame, chunk_key: str, fact_key: str, k: int = 10) -> DataFrame:
    """Chunks and facts in one ranking."""

    def hits(rows: DataFrame, key: str, kind: str) -> DataFrame:
        found = knn_batch(queries, rows, key, k)
        return found.select("query_id", F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), "score")

    both = hits(chunks, chunk_key, "chunk").unionByName(hits(facts, fact_key, "fact"))
    return skew.top_per_group(both, ["query_id"], [F.desc("score"), F.col("kind"), F.col("id")], k)


# ── facts and vectors ─────────────────────────────────────────────────────────
def link_facts_to_chunks(facts: DataFrame, chunks: DataFrame, chunk_key: str, k: int = 10, threshold: float = 0.7) -> DataFrame:
    """``(query_id, related_chunks)``: the best chunks of each fact in its vault."""
    hits = knn_batch(facts, chunks, chunk_key, k, threshold, within="vault")
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col(chunk_key).cast("string").alias("id"))))
    return hits.groupBy("query_id").agg(F.transform(ordered, lambda x: x["id"]).alias("related_chunks"))


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows in the order of a hash of the key: random-looking but repeatable."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def conflict_pairs(facts: DataFrame, key: str, threshold: float = 0.85, n: int = 50, seed: int = 0) -> DataFrame:
    """Similar pairs inside a sample of active, unresolved facts.

    The sample is the feature here; it is bounded, so it is paired inside one row.
    The newer fact is the one to mark, then the less confident, then the larger key.
    """
    if n > 1000:
        raise ValueError("conflict_pairs compares a sample of at most 1000 facts")
    open_ = (
        (F.col("status") == "active") & ~F.coalesce("conflict_resolved", F.lit(False))
        & ff.present(F.col("fact_key")) & ff.present(F.col("fact_value"))
    )
    few = sample(facts.filter(open_), key, n, seed).select(
        F.struct("created_at", (-F.col("confidence")).alias("doubt"), "fact_key", F.col(key).alias("id"), "vault", "embedding").alias("f")
    )
    paired = (
        few.groupBy().agg(F.array_sort(F.collect_list("f")).alias("all"))
        .select("all", F.explode("all").alias("marked"))
        .select("marked", F.explode(F.filter("all", lambda o: o < F.col("marked"))).alias("other"))
    )
    score = F.round(cosine(F.col("marked.embedding"), F.col("other.embedding")), 6)
    return paired.select(
        F.col("marked.vault").alias("vault"),
        F.col("marked.fact_key").alias("fact_key"),
        F.col("marked.id").alias("id"),
        F.col("other.fact_key").alias("other_key"),
        F.col("other.id").alias("other_id"),
        score.alias("score"),
    ).filter(F.col("score") >= threshold)


def zero_vectors(facts: DataFrame) -> DataFrame:
    return facts.filter(is_zero_vector(F.col("embedding")))


def dimension_report(df: DataFrame) -> DataFrame:
    return df.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"))


def dedup_against_existing(incoming: DataFrame, facts: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Decide per incoming fact, by its best match among facts of the same key:
    ``skip`` a near copy, ``supersede`` an active older value, else ``write``."""
    held = facts.select("vault", "fact_key", F.col("embedding").alias("_old"), F.coalesce("status", F.lit("")).alias("_status"))
    judged = incoming.join(held, ["vault", "fact_key"], "left").withColumn(
        "_score", F.when(F.col("_old").isNotNull(), cosine(F.col("embedding"), F.col("_old")))
    )
    keep = [c for c in incoming.columns if c not in ("vault", "fact_key", "embedding")]
    return (
        judged.groupBy("vault", "fact_key", *keep)
        .agg(F.max("_score").alias("similarity"), F.max(F.col("_status").isin("active", "")).alias("_live"))
        .select(
            "vault", "fact_key", *keep, "similarity",
            F.when(F.col("similarity") >= threshold, "skip")
            .when(F.col("similarity").isNotNull() & F.col("_live"), "supersede")
            .otherwise("write").alias("decision"),
        )
    )


def project_2d(df: DataFrame, key: str, label: str | None = None, source: str | None = None) -> DataFrame:
    """The two main directions of the vectors: ``(key, x, y, label)``.

    The covariance is summed on the executors; only a ``dim`` x ``dim`` matrix comes
    back. The largest loading of each direction is made positive.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    vectors = df.withColumn("_v", array_to_vector(F.col("embedding").cast("array<double>")))
    axes = PCA(k=2, inputCol="_v", outputCol="_p").fit(vectors).pc.toArray()
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(2)])
    mean = vectors.select(Summarizer.mean(F.col("_v")).alias("m")).first()["m"].toArray()
    shift = mean @ axes

    def along(i: int) -> Column:
        weights = F.array(*[F.lit(float(w)) for w in axes[:, i]])
        return _dot(F.col("embedding"), weights) - F.lit(float(shift[i]))

    names = [F.when(ff.present(F.col(c).cast("string")), F.col(c).cast("string")) for c in (label, source) if c]
    name = F.coalesce(*names, F.lit("")) if names else F.lit("")
    return df.select(key, along(0).alias("x"), along(1).alias("y"), name.alias("label"))
