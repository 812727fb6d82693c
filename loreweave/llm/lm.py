"""Language-model scores from an Elias-Fano trie of n-gram counts, up to three words.

Training. Tasks count the runs of three tokens in their texts and pack the counts for
the shard of the first word; a shard merges them, smooths, and writes one file with its
part of the trie: words, pairs below their first word, triples below their pair. Each
level is one monotone sequence of ``context * words + word`` in Elias-Fano form, with
monotone pointers from a node to its children and one byte for the smoothed
probability. A very frequent word is spread over all shards by its second word, a very
frequent pair by its third; their totals are summed over shards and sent along.

Scoring. Tasks map the files of the shared folder into memory and look up the distinct
pairs and triples of a batch of texts, shard after shard: the place of a word among the
successors of its context is found by a successor search inside the context's range.
The counts, the files and the look-ups all grow with the corpus; no n-gram is dropped.
A smoothed probability mixes the context's counts with that of the shorter context,
which weighs as much as ``PAIR`` or ``TRIPLE`` occurrences (Dirichlet smoothing).
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import crc_mod, table
from loreweave.llm.eliasfano import EliasFano
from loreweave.session import durable, shared_dir

#: Bytes of text a shard takes, tokens a task gathers before it packs or looks up, and the
#: weights of the shorter contexts.
SHARD_BYTES, BATCH, PAIR, TRIPLE = 12 << 20, 1 << 20, 64.0, 16.0
#: Texts sampled to find frequent words and pairs, and the share of a shard from which one
#: counts as frequent.
SAMPLE, FREQUENT = 2_000, 0.25
#: Bytes of a text that are cut into words at a time.
PIECE = 4 << 20

# Hashes of what stands before a text, after it, and beyond; words hash elsewhere.
BEGIN, END, NONE = 1, 2, 0
_MIX, _FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BLANKS = b" \t\n\r\x0b\x0c"


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * _MIX) ^ (b + (a >> np.uint64(29)))
    h = (h ^ (h >> np.uint64(32))) * _FOLD
    return h ^ (h >> np.uint64(32))


def words(raw: bytes) -> Iterator[list[bytes]]:
    """Words of a text in pieces; only A-Z is put in lower case."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        while end < len(raw) and raw[end] not in _BLANKS:
            end += 1
        yield raw[at:end].lower().split()
        at = end


class _Batch:
    """Codes of the tokens of some texts, and the hash of each code's word."""

    def __init__(self):
        self.known: dict = defaultdict(count().__next__)
        for special in (NONE, BEGIN, END):  # codes 0, 1, 2
            self.known[special]
        self.parts: list[np.ndarray] = []
        self.lengths: list[int] = []
        self.size = 0

    def add(self, raw: bytes) -> None:
        code = self.known.__getitem__
        parts = [np.fromiter(map(code, w), dtype=np.int32, count=len(w)) for w in words(raw)]
        n = sum(map(len, parts))
        self.parts += [np.array([1], np.int32), *parts, np.array([2, 0, 0], np.int32)]
        self.lengths.append(n + 4)
        self.size += n + 4

    def close(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all texts (begin, words, end, none, none each), hashes by code with
        codes in order of hash, and the lengths of the texts."""
        import xxhash

        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((w if isinstance(w, int) else digest(w) for w in self.known), dtype=np.uint64, count=len(self.known))
        order = np.argsort(hashes)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return place[np.concatenate(self.parts)], hashes[order], np.array(self.lengths)


def _distinct(columns: list[np.ndarray], kinds: int, **want) -> tuple:
    """np.unique over rows of codes below ``kinds``; gives the columns and what is wanted."""
    bits = max(1, (kinds - 1).bit_length())
    if bits * len(columns) <= 63:
        key = columns[0].astype(np.int64)
        for c in columns[1:]:
            key = (key << bits) | c
        found = np.unique(key, **want)
        key = found[0] if want else found
        out = []
        for k in range(len(columns) - 1, -1, -1):
            out.append((key >> (bits * k)) & ((1 << bits) - 1))
        return out, *(found[1:] if want else ())
    found = np.unique(np.stack(columns, axis=1), axis=0, **want)
    return [c for c in (found[0] if want else found).T], *(found[1:] if want else ())


@dataclass(frozen=True)
class Layout:
    """Where n-grams live: number of shards, and the words and pairs spread over all."""

    shards: int
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    def hot_word(self, a: np.ndarray) -> np.ndarray:
        return np.isin(a, self.words) if len(self.words) else np.zeros(len(a), bool)

    def hot_pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.isin(_mixed(a, b), self.pairs) if len(self.pairs) else np.zeros(len(a), bool)

    def place(self, a: np.ndarray, b: np.ndarray | None = None, c: np.ndarray | None = None) -> np.ndarray:
        key = _mixed(a, a)
        if b is not None:
            spread = self.hot_word(a)
            if spread.any():
                key = np.where(spread, _mixed(a, b), key)
                if c is not None:
                    key = np.where(self.hot_pair(a, b), _mixed(_mixed(a, b), c), key)
        return (key % np.uint64(self.shards)).astype(np.int64)


def _each_batch(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[_Batch, list[tuple[int, pa.RecordBatch]]]]:
    """Gathers texts until there are enough tokens; with each batch come the slices of rows in it."""
    now, rows = _Batch(), []
    for b in batches:
        first = 0
        for i, t in enumerate(b.column(column).cast(pa.binary())):
            now.add(t.as_py() or b"")
            if now.size >= BATCH:
                rows.append(b.slice(first, i + 1 - first))
                yield now, rows
                now, rows, first = _Batch(), [], i + 1
        if first < len(b):
            rows.append(b.slice(first))
    if rows:
        yield now, rows


def frequent(docs: DataFrame, texts: int, shards: int) -> Layout:
    """A layout whose frequent words and pairs come from a sample by hash of about
    ``SAMPLE`` texts. The sample decides where counts are kept, never what they are."""
    share = min(1.0, SAMPLE / max(texts, 1))
    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in _each_batch(batches, 0):
            codes, hashes, _ = batch.close()
            one, n = np.unique(codes, return_counts=True)
            (a, b), m = _distinct([codes[:-1], codes[1:]], len(hashes), return_counts=True)
            rows = [(np.zeros(len(one), np.int8), hashes[one], n), (np.ones(len(a), np.int8), _mixed(hashes[a], hashes[b]), m)]
            rows[1] = tuple(x[m > 1] for x in rows[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[k] for r in rows])) for k in (0, 1, 2)], ["pair", "h", "n"])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(b.column(1).to_numpy().view(np.int64)), pa.array(b.column(2).to_numpy().astype(np.int64))], ["pair", "h", "n"])

    counts = durable(some.select("text").mapInArrow(signed, "pair tinyint, h bigint, n bigint").groupBy("pair", "h").agg(F.sum("n").alias("n")))
    total = counts.filter("pair = 0").agg(F.sum("n")).first()[0] or 0
    hot = counts.filter(F.col("n") > max(20.0, FREQUENT * total / shards)).filter(~((F.col("pair") == 0) & (F.col("h") == NONE)))
    found = hot.collect()  # at most shards / FREQUENT of either kind
    pick = lambda k: np.array([r["h"] for r in found if r["pair"] == k], dtype=np.int64).view(np.uint64)
    return Layout(shards, pick(0), pick(1))


def _packed(codes: list[np.ndarray], n: np.ndarray, hashes: np.ndarray) -> bytes:
    """Counted triples with a dictionary of the hashes they use, as steps of seven bytes
    wherever those are enough."""
    used = np.zeros(len(hashes), bool)
    for c in codes:
        used[c] = True
    place = np.cumsum(used, dtype=np.uint32) - np.uint32(1)
    words = hashes[used]
    kind = np.uint16 if len(words) <= 1 << 16 else np.uint32
    steps = np.diff(words, prepend=np.uint64(0))
    step = 8 if (steps >> np.uint64(56)).any() else 7
    listed = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :step])
    sizes = np.array([len(words), len(n), np.dtype(kind).itemsize, step], np.int64)
    return b"".join([sizes.tobytes(), listed.tobytes(), n.astype(np.uint32).tobytes(), *(place[c].astype(kind).tobytes() for c in codes)])


def _unpacked(data: bytes) -> list[np.ndarray]:
    words, rows, width, step = (int(x) for x in np.frombuffer(data, np.int64, 4))
    steps, at = np.zeros((words, 8), np.uint8), 32 + step * words
    steps[:, :step] = np.frombuffer(data, np.uint8, step * words, 32).reshape(-1, step)
    hashes = np.cumsum(steps.reshape(-1).view(np.uint64), dtype=np.uint64)
    n = np.frombuffer(data, np.uint32, rows, at)
    codes = np.frombuffer(data, np.uint16 if width == 2 else np.uint32, 3 * rows, at + 4 * rows).reshape(3, rows)
    return [*(hashes[c] for c in codes), n.astype(np.int64)]


def counted(docs: DataFrame, layout: Layout) -> DataFrame:
    """``(shard, data)``: packed counts of the runs of three tokens of ``docs(text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        for batch, _ in _each_batch(batches, 0):
            codes, hashes, _ = batch.close()
            codes = np.append(codes, [0, 0])
            keep = codes[:-2] != 0
            (a, b, c), n = _distinct([codes[:-2][keep], codes[1:-1][keep], codes[2:][keep]], len(hashes), return_counts=True)
            abc = a, b, c
            shard = layout.place(hashes[a], hashes[b], hashes[c])
            order = np.argsort(shard, kind="stable")
            ends = np.searchsorted(shard[order], np.arange(layout.shards + 1))
            for s in np.flatnonzero(np.diff(ends)):
                at = order[ends[s] : ends[s + 1]]
                data = _packed([x[at] for x in abc], n[at], hashes)
                yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int32()), pa.array([pack.compress(data)], pa.binary())], ["shard", "data"])

    return docs.select("text").mapInArrow(run, "shard int, data binary")


def _quantised(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
    """One byte for each positive number and the table of what the bytes mean: all
    logarithms if they are few, else quantiles of those that occur."""
    logs, place = np.unique(np.log10(values), return_inverse=True)
    levels = logs
    if len(logs) > 256:
        levels = np.unique(np.quantile(logs, np.linspace(0, 1, 256)))
        place = np.searchsorted((levels[1:] + levels[:-1]) / 2, logs)[place]
    return {name: place.astype(np.uint8), f"{name}.table": 10.0**levels}


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> str:
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    head, at = {}, 0
    for k, a in arrays.items():
        head[k] = (a.dtype.str, len(a), at)
        at += a.nbytes + (-a.nbytes) % 8
    top = json.dumps(head).encode()
    top += b" " * (-(len(top) + 8) % 8)
    path = f"{base}/{name}"
    with store.open_output_stream(path, compression=None) as out:
        out.write(len(top).to_bytes(8, "little") + top)
        for a in arrays.values():
            out.write(a.tobytes() + b"\0" * ((-a.nbytes) % 8))
    return path


def _load(folder: str, path: str) -> dict[str, np.ndarray]:
    """Arrays of a file: mapped where the store has plain files, else read at once."""
    store, _ = _store(folder)
    if isinstance(store, fs.LocalFileSystem):
        data = np.asarray(np.memmap(path, dtype=np.uint8, mode="r"))
    else:
        with store.open_input_file(path) as source:
            data = np.frombuffer(source.read_buffer(), dtype=np.uint8)
    size = int(data[:8].view(np.int64)[0])
    head = json.loads(bytes(data[8 : 8 + size]))
    return {k: data[8 + size + at :][: n * np.dtype(kind).itemsize].view(kind) for k, (kind, n, at) in head.items()}


def build_shard(a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray, layout: Layout) -> tuple[dict[str, np.ndarray], list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """The trie of one shard from counts of triples (rows may repeat), and the partial
    totals of frequent words and pairs: ``(kind, hashes, own counts, counts below)``."""
    order = np.lexsort((c, b, a))
    a, b, c, n = a[order], b[order], c[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])]))
    a, b, c, n = a[first], b[first], c[first], np.add.reduceat(n, first)
    # pairs and words are where their part of the triples begins
    p = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    pair_a, pair_b, pair_n = a[p], b[p], np.add.reduceat(n, p)
    pair_below = np.add.reduceat(np.where(c != NONE, n, 0), p)
    w = np.flatnonzero(np.concatenate([[True], pair_a[1:] != pair_a[:-1]]))
    word, word_n = pair_a[w], np.add.reduceat(pair_n, w)
    word_below = np.add.reduceat(np.where(pair_b != NONE, pair_n, 0), w)
    hot_w, hot_p = layout.hot_word(word), layout.hot_pair(pair_a, pair_b) & layout.hot_word(pair_a)
    totals = [(0, word[hot_w], word_n[hot_w], word_below[hot_w]), (1, _mixed(pair_a, pair_b)[hot_p], pair_n[hot_p], pair_below[hot_p])]

    vocab = np.unique(np.concatenate([word, pair_b, c]))
    size = len(vocab)
    ids = lambda h: np.searchsorted(vocab, h).astype(np.uint64)
    real = pair_b != NONE
    of = np.repeat(np.arange(len(w)), np.diff(np.append(w, len(pair_a))))
    node = np.cumsum(real) - 1  # place among real pairs
    below_w = np.where(hot_w, 0, word_below)[of]
    share = np.where(below_w > 0, pair_n / (below_w + PAIR), pair_n.astype(float))
    deep = c != NONE
    of_pair = np.repeat(np.arange(len(p)), np.diff(np.append(p, len(a))))
    below_p = np.where(hot_p, 0, pair_below)[of_pair]
    share3 = np.where(below_p > 0, n / (below_p + TRIPLE), n.astype(float))
    pointers2 = np.concatenate([[0], np.cumsum(np.add.reduceat(real.astype(np.int64), w))])
    children = np.add.reduceat(deep.astype(np.int64), p)[real]
    pointers3 = np.concatenate([[0], np.cumsum(children)])
    levels = {
        "vocab": EliasFano.build(vocab, (1 << 64) - 1),
        "level1": EliasFano.build(ids(word), size),
        "level2": EliasFano.build(of[real].astype(np.uint64) * np.uint64(size) + ids(pair_b[real]), len(w) * size),
        "level3": EliasFano.build(node[of_pair[deep]].astype(np.uint64) * np.uint64(size) + ids(c[deep]), int(real.sum()) * size),
        "pointers2": EliasFano.build(pointers2, int(pointers2[-1]) + 1),
        "pointers3": EliasFano.build(pointers3, int(pointers3[-1]) + 1),
    }
    arrays = {k: v for name, level in levels.items() for k, v in level.arrays(name).items()}
    back = np.where(pair_below > 0, TRIPLE / (pair_below + TRIPLE), 1.0)[real]
    arrays |= {
        "count": word_n.astype(np.int64),
        "below": word_below.astype(np.int64),
    }
    for name, values in (("pair", share[real]), ("back", back), ("triple", share3[deep])):
        arrays |= _quantised(name, values)
    return arrays, totals


@dataclass
class Shard:
    """One mapped shard."""

    arrays: dict[str, np.ndarray]

    def __post_init__(self):
        for name in ("vocab", "level1", "level2", "level3", "pointers2", "pointers3"):
            setattr(self, name, EliasFano.of(self.arrays, name))

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Places of words in the shard's vocabulary, each distinct one looked up once."""
        one, inverse = np.unique(h, return_inverse=True)
        return self.vocab.find(one)[inverse]

    def values(self, name: str, node: np.ndarray) -> np.ndarray:
        """Decoded probabilities of nodes; any for those not there (-1)."""
        return self.arrays[f"{name}.table"][self.arrays[name][np.maximum(node, 0)]]

    def word(self, h: np.ndarray) -> np.ndarray:
        one, inverse = np.unique(h, return_inverse=True)
        at = self.vocab.find(one)
        found = np.full(len(one), -1, np.int64)
        ok = at >= 0
        found[ok] = self.level1.find(at[ok].astype(np.uint64))
        return found[inverse]

    def child(self, level: EliasFano, node: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Nodes of the words at places ``at`` of the vocabulary below ``node``."""
        found = np.full(len(at), -1, np.int64)
        ok = np.flatnonzero((node >= 0) & (at >= 0))
        found[ok] = level.find(node[ok].astype(np.uint64) * np.uint64(self.vocab.n) + at[ok].astype(np.uint64))
        return found

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.child(self.level2, self.word(a), self.ids(b))

    def successors(self, node: int, level: int) -> np.ndarray:
        """Hashes of the words below a node of ``level`` 1 or 2, by its pointers."""
        pointers, below = (self.pointers2, self.level2) if level == 1 else (self.pointers3, self.level3)
        lo, hi = (int(x) for x in pointers.get(np.array([node, node + 1])))
        return self.vocab.get(below.get(np.arange(lo, hi)).astype(np.int64) - node * self.vocab.n)


@dataclass(frozen=True)
class Model:
    """What tasks get sent: where the shards are, totals of frequent words and pairs, and
    the sizes of the training text."""

    folder: str
    paths: list[str]
    layout: Layout
    tokens: int
    distinct: int
    hot: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    def total(self, kind: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, own, below = self.hot[kind]
        at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
        ok = keys[at] == h if len(keys) else np.zeros(len(h), bool)
        pick = lambda v: np.where(ok, v[at], 0) if len(keys) else np.zeros(len(h), np.int64)
        return pick(own), pick(below)


def train(docs: DataFrame, folder: str) -> Model:
    """Counts ``docs(text)`` and writes the trie into ``folder``, a URI that driver and
    executors reach. Null texts are empty; each text, empty ones too, has one end."""
    sizes = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    layout = frequent(docs, sizes[1], max(1, -(-int(sizes[0] or 0) // SHARD_BYTES)))

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        parts = [_unpacked(unpack.decompress(x.as_py())) for x in rows.column("data")]
        a, b, c, n = (np.concatenate([x[k] for x in parts]) for k in range(4))
        del parts
        arrays, totals = build_shard(a, b, c, n, layout)
        shard = key[0].as_py()
        path = _save(folder, f"{shard:06d}-{uuid.uuid4().hex}.trie", arrays)
        word_hashes = EliasFano.of(arrays, "vocab").get(EliasFano.of(arrays, "level1").get(np.arange(len(arrays["count"]))).astype(np.int64))
        own = (word_hashes != BEGIN) & ~layout.hot_word(word_hashes)
        kinds = [np.array([2])] + [np.full(len(t[1]), t[0]) for t in totals]
        hashes = [np.array([shard])] + [t[1].view(np.int64) for t in totals]
        counts = [np.array([int(arrays["count"][own].sum())])] + [t[2] for t in totals]
        below = [np.array([int(own.sum())])] + [t[3] for t in totals]
        size = sum(map(len, kinds))
        return pa.table(
            {
                "kind": pa.array(np.concatenate(kinds).astype(np.int32)), "h": pa.array(np.concatenate(hashes).astype(np.int64)),
                "own": pa.array(np.concatenate(counts).astype(np.int64)), "below": pa.array(np.concatenate(below).astype(np.int64)),
                "path": pa.array([path] + [None] * (size - 1), pa.string()),
            }
        )

    packed = counted(docs, layout).groupBy("shard")
    made = durable(packed.applyInArrow(build, "kind int, h bigint, own bigint, below bigint, path string"))
    paths = [""] * layout.shards
    tokens = distinct = 0
    for r in made.filter("kind = 2").collect():  # one row per shard
        paths[r["h"]], tokens, distinct = r["path"], tokens + r["own"], distinct + r["below"]
    hot = {}
    for kind in (0, 1):  # one row per frequent word or pair
        rows = made.filter(F.col("kind") == kind).groupBy("h").agg(F.sum("own").alias("own"), F.sum("below").alias("below")).collect()
        h = np.array([r["h"] for r in rows], dtype=np.int64).view(np.uint64)
        order = np.argsort(h)
        hot[kind] = (h[order], *(np.array([r[k] for r in rows], dtype=np.int64)[order] for k in ("own", "below")))
    counts = hot[0][1][hot[0][0] != BEGIN]
    return Model(folder, paths, layout, tokens + int(counts.sum()), distinct + int((counts > 0).sum()), hot)


class Scorer:
    """Looks up n-grams in the mapped shards."""

    def __init__(self, model: Model):
        self.model, self.open = model, {}

    def shard(self, s: int) -> Shard | None:
        if not self.model.paths[s]:
            return None
        if s not in self.open:
            if len(self.open) >= 4 and not isinstance(_store(self.model.folder)[0], fs.LocalFileSystem):
                self.open.pop(next(iter(self.open)))  # not mapped but read: keep few
            self.open[s] = Shard(_load(self.model.folder, self.model.paths[s]))
        return self.open[s]

    def _by_shard(self, look, *places: np.ndarray) -> None:
        """Calls ``look`` for each shard with the indexes that each of ``places`` has there."""
        orders = [np.argsort(p, kind="stable") for p in places]
        ends = [np.searchsorted(p[o], np.arange(self.model.layout.shards + 1)) for p, o in zip(places, orders)]
        for s in np.flatnonzero(sum(np.diff(e) for e in ends)):
            shard = self.shard(int(s))
            if shard is not None:
                look(shard, *(o[e[s] : e[s + 1]] for o, e in zip(orders, ends)))

    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of words and their nodes, -1 for unknown and for frequent ones."""
        n, _ = self.model.total(0, h)
        nodes = np.full(len(h), -1, np.int64)
        rest = np.flatnonzero(~self.model.layout.hot_word(h))

        def look(shard: Shard, at: np.ndarray) -> None:
            node = shard.word(h[rest[at]])
            nodes[rest[at]] = node
            n[rest[at]] = np.where(node >= 0, shard.arrays["count"][np.maximum(node, 0)], 0)

        self._by_shard(look, self.model.layout.place(h[rest]))
        return n, nodes

    def grams(self, hashes: np.ndarray, nodes: np.ndarray, a: np.ndarray, b: np.ndarray, context: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
        """For pairs of codes ``a, b`` with their words' ``nodes``: the part of b's
        probability after a that counts give, the weight left to the shorter context of a,
        and the same weight for the pair as a context. For triples of a pair ``context`` and
        a code ``c``: the part of c's probability after the pair that counts give.

        A shard is visited once: the words that its pairs and triples name are looked up
        together, and a triple goes on from the node of its pair, which is in the same
        shard unless the pair is a frequent one.
        """
        layout = self.model.layout
        of_a, of_b, nodes = hashes[a], hashes[b], nodes.copy()
        hot_word = layout.hot_word(hashes)
        frequent, hot_a = np.flatnonzero(hot_word), hot_word[a]
        hot = hot_a & layout.hot_pair(of_a, of_b)
        _, below = self.model.total(0, of_a)
        n, deep = self.model.total(1, _mixed(of_a, of_b))
        left = np.where(hot_a, PAIR / (below + PAIR), 1.0)
        seen = np.where(hot, n / (below + PAIR), 0.0)
        back = np.where(hot & (deep > 0), TRIPLE / (deep + TRIPLE), 1.0)
        seen3 = np.zeros(len(c))
        rest = np.flatnonzero(~hot)
        places = layout.place(of_a, of_b)
        places3, spread = places[context], hot[context]
        places3[spread] = layout.place(of_a[context[spread]], of_b[context[spread]], hashes[c[spread]])
        named, ids, pair_nodes = np.zeros(len(hashes), bool), np.full(len(hashes), -1, np.int64), np.full(len(a), -1, np.int64)

        def look(shard: Shard, at: np.ndarray, at3: np.ndarray) -> None:
            at, on = rest[at], context[at3]
            also = np.unique(on[hot[on]])  # frequent pairs are in every shard
            named[b[at]] = named[b[also]] = named[c[at3]] = named[frequent] = True
            used = np.flatnonzero(named)
            named[used] = False
            ids[used] = shard.vocab.find(hashes[used])
            ok = frequent[ids[frequent] >= 0]
            nodes[frequent] = -1
            nodes[ok] = shard.level1.find(ids[ok])
            word, own = nodes[a[at]], ~hot_a[at]
            node = shard.child(shard.level2, word, ids[b[at]])
            pair_nodes[at] = node
            if len(also):
                pair_nodes[also] = shard.child(shard.level2, nodes[a[also]], ids[b[also]])
            under = np.where(word >= 0, shard.arrays["below"][np.maximum(word, 0)], 0)
            left[at] = np.where(own, PAIR / (under + PAIR), left[at])
            ok = node >= 0
            if ok.any():
                value = shard.values("pair", node)
                seen[at] = np.where(ok, np.where(own, value, value / (below[at] + PAIR)), 0.0)
                back[at] = np.where(ok, shard.values("back", node), 1.0)
            node = shard.child(shard.level3, pair_nodes[on], ids[c[at3]])
            ok = node >= 0
            if ok.any():
                value = shard.values("triple", node)
                seen3[at3] = np.where(ok, np.where(hot[on], value / (deep[on] + TRIPLE), value), 0.0)

        self._by_shard(look, places[rest], places3)
        return seen, left, back, seen3

    def score(self, batch: _Batch) -> tuple[np.ndarray, ...]:
        """Per text: tokens, known tokens, base score and score."""
        codes, hashes, lengths = batch.close()
        starts = np.cumsum(lengths) - lengths
        counts, nodes = self.words(hashes)
        one = (counts + 1.0) / (self.model.tokens + self.model.distinct + 1.0)
        token = np.ones(len(codes), bool)
        for skip in (starts, starts + lengths - 1, starts + lengths - 2):
            token[skip] = False
        at = np.flatnonzero(token)
        (a, b), inverse = _distinct([codes[at - 1], codes[at]], len(hashes), return_inverse=True)
        third = np.ones(len(at), bool)
        third[np.searchsorted(at, starts + 1)] = False  # first tokens have one before them
        before = np.flatnonzero(third) - 1  # the token before is the pair that is the context
        (context, c), inverse3 = _distinct([inverse[before], codes[at[third]]], max(len(a), len(hashes)), return_inverse=True)
        seen2, left2, back, seen3 = self.grams(hashes, nodes, a, b, context, c)
        p = (seen2 + left2 * one[b])[inverse]
        p[third] = seen3[inverse3] + back[inverse[before]] * p[third]
        of = np.concatenate([[0], np.cumsum(lengths - 3)[:-1]])
        known, base = counts[codes[at]] > 0, np.log10(one[codes[at]])
        add = lambda v: np.add.reduceat(v, of)
        return lengths - 3, add(known.astype(np.int64)), add(base), add(np.log10(np.minimum(p, 1.0)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, n_tokens, n_known, base_score, score)`` per row of ``docs(doc_id, text)``.

    Tokens are the words and one end; null and empty texts have the end alone. Scores
    are log10 probabilities of the whole text. Without training texts each token has
    probability one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch, rows in _each_batch(batches, 1):
            ids = pa.concat_arrays([r.column(0) for r in rows])
            n, known, base, full = scorer.score(batch)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(full)],
                ["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")


def held_out(key: Column) -> Column:
    """The seventh of documents that is not learned from; null ids are learned from."""
    return F.coalesce(crc_mod(key, 7) == 2, F.lit(False))


def op9(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = f"{shared_dir(spark)}/trie-{uuid.uuid4().hex}"
    folder = folder if ":/" in folder else f"file://{folder}"
    model = train(docs.filter(~held_out(F.col("doc_id"))), folder)
    scored = score(docs, model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
