"""SimHash near-duplicates, linked through vantage-point trees.

A fingerprint has 64 bits; two that differ in at most three bits differ in at most
one bit of their upper or of their lower half. So there is one vantage-point tree
per half: an inner node holds a vantage value and the median distance to it, its
near side takes members up to that distance and its far side the rest. By the
triangle bound a search of radius one visits both sides only within one bit of the
cut; elsewhere a branch is pruned. The upper levels of each tree are built from a
bounded sample and cut the fingerprints into shards. Each fingerprint lives in one
shard of a tree and also visits the shards across cuts it is close to. Inside a
shard the tree goes on until its blocks are small, and blocks are compared whole.
Pairs are exact: the sample decides where cuts lie, never which pairs are found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreweave.llm.common import components, table
from loreweave.session import durable

#: Bits that may differ, and what that leaves for the closer half.
RADIUS, HALF_RADIUS = 3, 1
#: Most fingerprints sampled to place cuts, and the members a shard should have.
SAMPLE, SHARD = 65_536, 1_024
#: Members or visitors of a shard that one task compares; larger shards are cut.
CELL = 32_768
#: Members of a block that are compared without a further cut.
BLOCK = 64


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].astype(">u8").view(np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes | None, shingle: int) -> int:
    """SimHash of UTF-8 text over ``shingle``-word shingles, as an unsigned integer."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    digest = xxhash.xxh64_intdigest
    return _majority(np.fromiter((digest(r, 42) for r in runs), dtype=np.uint64, count=len(runs)))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """The columns of ``docs`` but ``text``, and ``fp``, which holds the 64 bits as a long.

    Only A-Z is put in lower case. A text with fewer words than a shingle is one
    shingle; without words (null too) it gets 0. Whole texts count, however long.
    """
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(kept)).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(fps.view(np.int64))], [*kept, "fp"])

    kind = T.StructType([docs.schema[c] for c in kept] + [T.StructField("fp", T.LongType())])
    return docs.select(*kept, "text").mapInArrow(run, kind)


def _halves(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = fps.view(np.uint64)
    return (bits >> np.uint64(32)).astype(np.uint32), bits.astype(np.uint32)


def _cut(values: np.ndarray, seed: int) -> tuple[np.uint32, int] | None:
    """A vantage value and the distance that halves ``values`` best, or None if
    every tried vantage leaves them together."""
    rng = np.random.default_rng(seed)
    best = None
    for vantage in values[rng.integers(0, len(values), 4)]:
        d = np.bitwise_count(values ^ vantage)
        mu = int(np.median(d))
        for cut in (mu - 1, mu):
            near = int((d <= cut).sum())
            # Members near the cut are searched from both sides, so few should be.
            close = int(((d >= cut) & (d <= cut + 1)).sum())
            cost = max(near, len(d) - near) + close
            if 0 < near < len(d) and (best is None or cost < best[0]):
                best = (cost, vantage, cut)
    return best and best[1:]


def build_tree(values: np.ndarray, leaf: int) -> list[tuple[int, int, int, int]]:
    """Nodes ``(vantage, cut, near, far)`` from a sample of half fingerprints; a
    child number below 0 is shard ``-1 - child``. A tree of one shard has no node."""
    nodes: list[list[int]] = []
    shards = 0
    todo = [(np.unique(values), -1, 0)]
    while todo:
        members, parent, side = todo.pop()
        found = _cut(members, len(nodes)) if len(members) > leaf else None
        if found is None:
            child, shards = -1 - shards, shards + 1
        else:
            child = len(nodes)
            vantage, cut = found
            nodes.append([int(vantage), int(cut), 0, 0])
            near = np.bitwise_count(members ^ vantage) <= cut
            todo += [(members[near], child, 2), (members[~near], child, 3)]
        if parent >= 0:
            nodes[parent][side] = child
    return [tuple(n) for n in nodes]


def _route(values: np.ndarray, nodes: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, shards and whether the shard is the row's home."""
    if not nodes:
        return np.arange(len(values)), np.zeros(len(values), np.int32), np.ones(len(values), bool)
    tree = np.array(nodes, dtype=np.int64)
    row, at, home = np.arange(len(values)), np.zeros(len(values), np.int64), np.ones(len(values), bool)
    out = []
    while len(row):
        vantage, cut = tree[at, 0].astype(np.uint32), tree[at, 1]
        d = np.bitwise_count(values[row] ^ vantage).astype(np.int64)
        near, far = d <= cut + HALF_RADIUS, d > cut - HALF_RADIUS
        inside = d <= cut
        nxt = np.concatenate([tree[at[near], 2], tree[at[far], 3]])
        rows = np.concatenate([row[near], row[far]])
        homes = np.concatenate([(home & inside)[near], (home & ~inside)[far]])
        done = nxt < 0
        out.append((rows[done], (-1 - nxt[done]).astype(np.int32), homes[done]))
        row, at, home = rows[~done], nxt[~done], homes[~done]
    return tuple(np.concatenate(x) for x in zip(*out))


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of ``n`` points over edges ``a - b``."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _search(members, visitors, half_m, half_v, seed, out) -> None:
    """Appends linked (visitor, member) index pairs; arrays hold indexes."""
    fps_m, fps_v, of_m, of_v = half_m[0], half_v[0], half_m[1], half_v[1]
    found = _cut(of_m[members], seed) if len(members) > BLOCK else None
    if found is None:
        for at in range(0, len(visitors), 4_096):
            v = visitors[at : at + 4_096]
            for to in range(0, len(members), 1_024):
                m = members[to : to + 1_024]
                i, j = np.nonzero(np.bitwise_count(fps_v[v][:, None] ^ fps_m[m][None, :]) <= RADIUS)
                _keep(out, v, m, i, j)
        return
    vantage, cut = found
    d_m = np.bitwise_count(of_m[members] ^ vantage)
    d_v = np.bitwise_count(of_v[visitors] ^ vantage).astype(np.int64)
    near = d_m <= cut
    _search(members[near], visitors[d_v <= cut + HALF_RADIUS], half_m, half_v, seed + 1, out)
    _search(members[~near], visitors[d_v > cut - HALF_RADIUS], half_m, half_v, seed + 2, out)


def _spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Indexes of few of the edges ``a - b`` among ``n`` points that connect what all do."""
    back = np.arange(len(a) - 1, -1, -1)
    first_a, first_b = np.full(n, -1), np.full(n, -1)
    first_a[a[back]], first_b[b[back]] = back, back  # the last write, the first edge, stays
    keep = np.union1d(first_a[first_a >= 0], first_b[first_b >= 0])
    while True:
        have = _forest(a[keep], b[keep], n)
        cross = np.flatnonzero(have[a] != have[b])
        if not len(cross):
            return keep
        x, y = have[a[cross]], have[b[cross]]
        keep = np.concatenate([keep, cross[np.unique(np.minimum(x, y) * n + np.maximum(x, y), return_index=True)[1]]])


def _keep(out: list, v: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Adds the pairs ``v[i], m[j]`` to ``out``; of very many, a spanning forest."""
    if len(i) > 8 * (len(v) + len(m)):
        few = _spanning(i, j + len(v), len(v) + len(m))
        i, j = i[few], j[few]
    if len(i):
        out.append((v[i], m[j]))
    if len(out) > 256:
        a, b = np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])
        points, code = np.unique(np.concatenate([a * 2, b * 2 + 1]), return_inverse=True)
        few = _spanning(code[: len(a)], code[len(a) :], len(points))
        out[:] = [(a[few], b[few])]


def _cells(routed: DataFrame, key: str, *more: str, load: Column | None = None, most: int | None = None) -> DataFrame:
    """Rows ``(tree, shard, r, c, key, more, member)`` of shards cut in cells: a large shard's
    members by row, its visitors by column, so that each pair meets in one cell and a
    cell holds about ``CELL`` of either at most, or rows of about ``most`` in ``load``."""
    load, most = (F.lit(1) if load is None else load).cast("long"), most or CELL
    sizes = (
        routed.groupBy("tree", "shard")
        .agg(F.sum(F.col("home").cast("long") * load).alias("members"), F.sum(load).alias("visitors"))
        .select(
            "tree", "shard",
            F.ceil(F.col("members") / most).cast("int").alias("rows"),
            F.ceil(F.col("visitors") / most).cast("int").alias("cols"),
        )
    )
    seed = F.xxhash64(key)
    whole = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_member = F.transform(whole("cols"), lambda c: F.struct(F.pmod(seed, F.col("rows")).cast("int").alias("r"), c.alias("c"), F.lit(True).alias("member")))
    as_visitor = F.transform(whole("rows"), lambda r: F.struct(r.alias("r"), F.pmod(seed, F.col("cols")).cast("int").alias("c"), F.lit(False).alias("member")))
    none = F.array().cast("array<struct<r:int,c:int,member:boolean>>")
    met = routed.join(sizes, ["tree", "shard"]).filter("rows > 0")
    dealt = met.withColumn("cell", F.explode(F.concat(F.when(F.col("home"), as_member).otherwise(none), as_visitor)))
    return dealt.select("tree", "shard", F.col("cell.r").alias("r"), F.col("cell.c").alias("c"), key, *more, F.col("cell.member").alias("member"))


def link(fps: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` among distinct fingerprints ``fps(fp)`` that connect exactly
    what pairs of at most three differing bits connect. A shard gives a spanning
    forest of its pairs, so the edges grow with the fingerprints."""
    n = fps.count()
    share = min(1.0, SAMPLE / max(n, 1))
    sample = fps.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    values = np.array([r[0] for r in sample.toLocalIterator()], dtype=np.int64)
    leaf = max(8, int(SHARD * len(values) / max(n, 1)))
    trees = [build_tree(half, leaf) for half in _halves(values)] if len(values) else [[], []]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            for t, half in enumerate(_halves(fp)):
                rows, shard, home = _route(half, trees[t])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), t, np.int32)), pa.array(shard), pa.array(fp[rows]), pa.array(home)],
                    ["tree", "shard", "fp", "home"],
                )

    routed = fps.select("fp").mapInArrow(route, "tree int, shard int, fp bigint, home boolean")
    dealt = _cells(routed, "fp")

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        fp = rows.column("fp").to_numpy()
        member = rows.column("member").to_numpy(zero_copy_only=False)
        m, v = fp[member], fp[~member]
        t = key[0].as_py()
        out: list = []
        _search(np.arange(len(m)), np.arange(len(v)), (m.view(np.uint64), _halves(m)[t]), (v.view(np.uint64), _halves(v)[t]), 0, out)
        a = np.concatenate([v[x] for x, _ in out] or [np.zeros(0, np.int64)])
        b = np.concatenate([m[y] for _, y in out] or [np.zeros(0, np.int64)])
        points, code = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = _forest(code[: len(a)], code[len(a) :], len(points))
        edge = root != np.arange(len(points))
        return pa.table({"a": points[edge], "b": points[root[edge]]})

    return dealt.groupBy("tree", "shard", "r", "c").applyInArrow(compare, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Each row of ``docs(doc_id, text)`` as ``(doc_id, fp, component_id)``.

    ``component_id`` is the smallest ``doc_id`` reachable over links, the row's own
    included; null ids are ignored in it unless a component has no other. Equal
    texts, repeated rows and texts without words (fingerprint 0) are linked like any
    others. Rows of an empty table give an empty result. Copies are gathered by
    fingerprint first, so a large group of them costs one row in all that follows.
    Columns besides the two are ignored.
    """
    marked = durable(fingerprints(docs.select("doc_id", "text"), shingle))
    low = _groups(marked, F.col("doc_id"))
    return marked.join(low, "fp").select("doc_id", "fp", F.col("first").alias("component_id"))


def _groups(marked: DataFrame, member: Column) -> DataFrame:
    """``(fp, first)``: for each fingerprint the least ``member`` of its component."""
    known = durable(marked.groupBy("fp").agg(F.min(member).alias("first")))
    groups = components(link(known.select("fp")))
    rooted = known.join(groups, known["fp"] == groups["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return rooted.select("fp", "root").join(rooted.groupBy("root").agg(F.min("first").alias("first")), "root").select("fp", "first")


# ── near-duplicates by similarity ─────────────────────────────────────────────
# Near are texts with four fifths or more of their distinct shingles in common. Sketches
# only find candidates, which are then compared by their shingles. Such texts differ in
# about 15 % of their bits, too far apart for one 64-bit fingerprint and a small radius. So
# a sketch has three fingerprints, 192 bits. In such a pair each 16-bit block differs in at
# most one bit with probability 0.28, and at least one of twelve blocks does with 0.98 (at
# 10 % of the bits, 0.9998). There is a vantage-point tree of radius one per block; what
# meets in a shard is a candidate if whole sketches differ in at most ``LIKE`` bits.

#: Fingerprints of a sketch, bits of a block, bits that may differ, members of a shard.
WORDS, BITS, LIKE, WIDE = 3, 16, 40, 16_384
#: Candidates that a row has compared by joins, before what is left is compared in cells.
FEW = 1
#: Shingles of members or of visitors that one task compares.
LOAD = 1 << 21

_SPREAD = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _remixed(h: np.ndarray) -> np.ndarray:
    """Another hash of the same shingles."""
    h = (h ^ (h >> np.uint64(30))) * _SPREAD[0]
    h = (h ^ (h >> np.uint64(27))) * _SPREAD[1]
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """Hashes of the distinct shingles of a text, in order; without words there are none."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = (b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1)))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(r, 42) for r in runs), dtype=np.uint64))


def sketch(h: np.ndarray) -> list[int]:
    """``WORDS`` SimHash fingerprints of a text's ``shingles``, as signed integers."""
    if not len(h):
        return [0] * WORDS
    out = []
    for _ in range(WORDS):
        mark = _majority(h)
        out.append(mark - (1 << 64) if mark >> 63 else mark)
        h = _remixed(h)
    return out


def sketches(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The columns of ``docs`` but ``text``, and of each text ``marks``, its sketch, ``set``,
    a digest of its distinct shingles, and ``size``, their number."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            marks, sets, sizes = [], [], []
            for t in b.column(len(kept)).cast(pa.binary()):
                h = shingles(t.as_py(), shingle)
                marks.append(sketch(h))
                sets.append(xxhash.xxh3_128_digest(h.tobytes()))
                sizes.append(len(h))
            more = [pa.array(marks, pa.list_(pa.int64())), pa.array(sets, pa.binary()), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *more], [*kept, "marks", "set", "size"])

    more = [T.StructField("marks", T.ArrayType(T.LongType())), T.StructField("set", T.BinaryType()), T.StructField("size", T.IntegerType())]
    return docs.select(*kept, "text").mapInArrow(run, T.StructType([docs.schema[c] for c in kept] + more))


def shingle_sets(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """``(id, shingles)`` of ``docs(id, text)``: hashes of the distinct shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0), b.column(1).cast(pa.binary())):
                h = pa.array(shingles(t.as_py(), shingle).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], pa.int64()), pa.ListArray.from_arrays([0, len(h)], h)], ["id", "shingles"])

    return docs.select("id", "text").mapInArrow(run, "id bigint, shingles array<bigint>")


def _marks(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, WORDS).view(np.uint64)


def _block(marks: np.ndarray, t: int) -> np.ndarray:
    """Block ``t`` of each sketch, as a small integer."""
    per = 64 // BITS
    return ((marks[:, t // per] >> np.uint64(BITS * (t % per))) & np.uint64((1 << BITS) - 1)).astype(np.uint32)


def _alike(of, marks, size, label, tree, members, visitors, seed=0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As ``_search``, tile by tile the pairs (visitor, member) of candidates: sketches that have
    other labels and sizes that allow a link. A pair belongs to the first tree in whose block it
    differs in at most one bit. In a tile a visitor's members keep their order."""
    found = _cut(of[members], seed) if len(members) > BLOCK else None
    if found is None:
        for at in range(0, len(visitors), 2_048):
            v = visitors[at : at + 2_048]
            for to in range(0, len(members), 1_024):
                m = members[to : to + 1_024]
                near = np.bitwise_count(of[v][:, None] ^ of[m][None, :]) <= 1
                near &= label[v][:, None] != label[m][None, :]
                near &= (5 * size[v][:, None] >= 4 * size[m][None, :]) & (5 * size[m][None, :] >= 4 * size[v][:, None])
                i, j = np.nonzero(near)
                apart = marks[v[i]] ^ marks[m[j]]
                close = np.bitwise_count(apart).sum(axis=1, dtype=np.int64) <= LIKE
                for t in range(tree):
                    close &= np.bitwise_count(_block(apart, t)) > 1
                if close.any():
                    yield v[i[close]], m[j[close]]
        return
    vantage, cut = found
    d_m = np.bitwise_count(of[members] ^ vantage)
    d_v = np.bitwise_count(of[visitors] ^ vantage).astype(np.int64)
    near = d_m <= cut
    yield from _alike(of, marks, size, label, tree, members[near], visitors[d_v <= cut + 1], seed + 1)
    yield from _alike(of, marks, size, label, tree, members[~near], visitors[d_v > cut - 1], seed + 2)


def _cell(key: tuple, rows: pa.Table) -> tuple[np.ndarray, ...]:
    """What ``_alike`` takes of a cell's rows, and before it their ids."""
    member, ids = rows.column("member").to_numpy(zero_copy_only=False), rows.column("id").to_numpy()
    marks, size, label = _marks(rows.column("marks")), rows.column("size").to_numpy().astype(np.int64), rows.column("label").to_numpy()
    tree = key[0].as_py()
    return ids, _block(marks, tree), marks, size, label, tree, np.flatnonzero(member), np.flatnonzero(~member)


def _first(visitor: np.ndarray, member: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` pairs of each visitor, in the order given."""
    order = np.argsort(visitor, kind="stable")
    visitor, member = visitor[order], member[order]
    kept = np.arange(len(visitor)) - np.searchsorted(visitor, visitor) < n
    return visitor[kept], member[kept]


def _once(ids: np.ndarray, *cell) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The candidates of a cell, each pair in one of the two cells it meets in only."""
    for v, m in _alike(*cell):
        one = ids[v] < ids[m]
        if one.any():
            yield v[one], m[one]


def _meeting(key: tuple, rows: pa.Table) -> pa.Table:
    """The rows of a cell that are candidates of others there."""
    hit = np.zeros(rows.num_rows, bool)
    for v, m in _once(*_cell(key, rows)):
        hit[v] = hit[m] = True
    return rows.filter(pa.array(hit))


def _near(key: tuple, rows: pa.Table) -> pa.Table:
    """Links ``(a, b)`` in a cell that connect what all of its candidates with four fifths or
    more of their ``shingles`` in common connect, fewer than it has labels. A pair that is
    connected already is not compared."""
    ids, *cell = _cell(key, rows)
    lists = [c for c in rows.column("shingles").chunks if len(c)]
    sizes = np.concatenate([c.value_lengths().to_numpy() for c in lists]).astype(np.int64)
    code = np.unique(np.concatenate([c.flatten().to_numpy() for c in lists]), return_inverse=True)[1]
    start, root = np.cumsum(sizes) - sizes, np.unique(cell[3], return_inverse=True)[1]
    mark, edges = np.zeros(len(code), bool), []
    for visitors, members in _once(ids, *cell):
        order = np.argsort(members, kind="stable")
        cuts = np.flatnonzero(np.diff(members[order])) + 1
        for v, m in zip(np.split(visitors[order], cuts), members[order][np.r_[0, cuts]]):
            v = v[root[v] != root[m]]
            if not len(v):
                continue
            own, ends = code[start[m] : start[m] + sizes[m]], np.cumsum(sizes[v])
            mark[own] = True
            at = np.arange(ends[-1]) + np.repeat(start[v] - (ends - sizes[v]), sizes[v])
            seen = np.r_[0, np.cumsum(mark[code[at]])]
            mark[own] = False
            both = seen[ends] - seen[ends - sizes[v]]
            v = v[9 * both >= 4 * (sizes[v] + sizes[m])]
            joined, first = np.unique(root[v], return_index=True)
            edges += [(ids[x], ids[m]) for x in v[first]]
            root[np.isin(root, joined)] = root[m]
    a, b = np.array(edges, np.int64).reshape(-1, 2).T
    return pa.table({"a": a, "b": b})


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose ``sets(id, shingles)`` have four fifths or more in common."""
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(one, "a").join(two, "b").filter(9 * both >= 4 * (F.size("of_a") + F.size("of_b"))).select("a", "b")


def link_similar(known: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges ``(a, b)`` between ``known(id, marks, size)`` that connect what the candidates of
    four fifths or more common shingles connect. ``sets_of`` gives ``(id, shingles)`` of a
    table of ids.

    Every edge is compared by its shingles. First come the first ``FEW`` candidates of each
    row over all trees, in an order that all rows share, so a group of copies meets at one of
    them; what these link needs no more comparing. Rows with more candidates then meet again,
    with their shingles, and a cell compares all of them that are still apart. Texts that are
    candidates but not near cost time there, a pair each, but no rows: a cell hands on fewer
    links than it has labels. A pair is left over only if both its rows are, so none is lost.
    """
    n = known.count()
    share = min(1.0, SAMPLE / 4 / max(n, 1))
    sample = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("marks")
    values = np.array([r[0] for r in sample.toLocalIterator()], dtype=np.int64).reshape(-1, WORDS).view(np.uint64)
    trees_n = WORDS * 64 // BITS
    leaf = max(8, int(WIDE * len(values) / max(n, 1)))
    trees = [build_tree(_block(values, t), leaf) if len(values) else [] for t in range(trees_n)]
    more = ["marks", "size", "label"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = _marks(b.column(1))
            for t in range(trees_n):
                rows, shard, home = _route(_block(marks, t), trees[t])
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), t, np.int32)), pa.array(shard), *[c.take(take) for c in b.columns], pa.array(home)],
                    ["tree", "shard", "id", *more, "home"],
                )

    def dealt(labelled: DataFrame, **cut) -> DataFrame:
        routed = labelled.select("id", *more).mapInArrow(route, "tree int, shard int, id bigint, marks array<bigint>, size int, label bigint, home boolean")
        return _cells(routed, "id", *more, **cut)

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        ids, *cell, members, visitors = _cell(key, rows)
        place = _remixed(ids.view(np.uint64) + np.uint64(FEW)).view(np.int64)
        members = members[np.argsort(place[members])]

        def first(out: list) -> tuple[np.ndarray, np.ndarray]:
            a, b = (np.concatenate([x[k] for x in out] or [np.zeros(0, np.int64)]) for k in (0, 1))
            order = np.argsort(place[b])
            return _first(a[order], b[order], FEW + 1)

        out: list = []
        for v, m in _alike(*cell, members, visitors):
            out.append(_first(v, m, FEW + 1))
            if len(out) > 256:
                out = [first(out)]
        a, b = first(out)
        nth = np.arange(len(a)) - np.searchsorted(a, a)
        others = np.zeros(len(a), bool)
        others[:-1] = nth[1:] == FEW  # the next pair is one too many
        a, b, others = (x[nth < FEW] for x in (a, b, others))
        return pa.table({"of": ids[a], "with": ids[b], "place": place[b], "more": others})

    # ``(a, b)`` to compare, and ``(a, null)`` for rows with pairs left over.
    labelled = known.withColumn("label", F.col("id"))
    met = dealt(labelled).groupBy("tree", "shard", "r", "c").applyInArrow(compare, "of bigint, with bigint, place bigint, more boolean")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("of").orderBy("place"))).filter(F.col("rank") <= FEW + 1)
    pair = F.struct(F.least("of", "with").alias("a"), F.greatest("of", "with").alias("b"))
    alone = F.struct(F.col("of").alias("a"), F.lit(None).cast("long").alias("b"))
    told = F.array_compact(F.array(F.when(F.col("rank") <= FEW, pair), F.when((F.col("rank") == FEW + 1) | F.col("more"), alone)))
    found = durable(ranked.select(F.inline(told)).distinct())
    ids = found.select(F.explode(F.array("a", "b")).alias("id")).filter("id is not null").distinct()
    sets = durable(sets_of(durable(ids)))
    edges = durable(verified(found.filter("b is not null"), sets))
    left = durable(found.filter("b is null").select(F.col("a").alias("id")))
    if left.isEmpty():
        return edges
    waiting = known.join(left, "id", "left_semi").join(components(edges), F.col("id") == F.col("node"), "left")
    apart = dealt(durable(waiting.select("id", "marks", "size", F.coalesce("root", "id").alias("label"))), load=F.greatest("size", F.lit(1)), most=LOAD)
    meeting = durable(apart.groupBy("tree", "shard", "r", "c").applyInArrow(_meeting, apart.schema))
    near = meeting.join(sets, "id").groupBy("tree", "shard", "r", "c").applyInArrow(_near, "a bigint, b bigint")
    return durable(edges.unionByName(near))


def keep_first(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id
    (null ids last, then by a hash of the text). Of repeated equal rows one stays.

    Near are texts with four fifths or more of their distinct ``shingle``-word shingles in
    common. Texts without words are one group. All columns stay as they are.
    """
    of = docs.withColumn("_hash", F.xxhash64("text"))
    marked = durable(sketches(of.select("doc_id", "_hash", "text"), shingle))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_hash"))
    grouped = marked.groupBy("set").agg(least.alias("first"), F.first("marks").alias("marks"), F.first("size").alias("size"))
    known = durable(grouped.withColumn("id", F.monotonically_increasing_id()))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_h"))

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = known.join(ids, "id", "left_semi").select("id", F.col("first.doc_id").alias("_d"), F.col("first._hash").alias("_h"))
        return shingle_sets(of.join(durable(wanted), same).select("id", "text"), shingle).dropDuplicates(["id"])

    groups = components(link_similar(known.select("id", "marks", "size"), sets_of))
    rooted = known.join(groups, known["id"] == groups["node"], "left").select("set", "first", F.coalesce("root", "id").alias("root"))
    low = rooted.select("set", "root").join(rooted.groupBy("root").agg(F.min("first").alias("first")), "root").select("set", "first")
    rows = marked.groupBy("doc_id", "_hash", "set").agg(F.count(F.lit(1)).alias("rows")).join(low, "set")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("_hash") == F.col("first._hash"))
    verdict = durable(rows.select(F.col("doc_id").alias("_d"), F.col("_hash").alias("_h"), stays.alias("stays"), "rows"))
    kept = of.join(durable(verdict.filter("not stays")).hint("merge"), same, "left_anti")
    equal = durable(verdict.filter("stays and rows > 1"))
    if not equal.isEmpty():
        kept = kept.join(equal, same, "left_anti").unionByName(kept.join(equal, same, "left_semi").dropDuplicates(["doc_id", "_hash"]))
    return kept.select(*docs.columns)


def op5(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
