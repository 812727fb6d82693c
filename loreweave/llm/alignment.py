"""Alignment of two tokenizers on the same text by galloping intersection.

Both tokenizers cut the bytes of a text; the ends of their tokens are two ascending
lists. The shorter list drives: each of its ends is sought in the longer one from where
it should lie, by steps that double until it is bracketed and then by halving. Common
ends cut both token lists into groups, and the differences of the common ranks are the
ranges of tokens that overlap. A batch of texts is laid end to end, so all ends of a batch
gallop together.
"""

from __future__ import annotations

import ctypes
import hashlib
import json
import os
import re
import sys
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loreweave.llm.common import table
from loreweave.session import durable

#: Where the vocabulary files of public tokenizers lie on every executor.
FOLDER = "/opt/tokenizers"
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text tokenised and aligned together; one text may exceed it. Token lists and
#: their arrays take some hundred bytes per byte of text while a piece is in work.
PIECE = 1 << 18
#: Bytes of text whose links share one dictionary of pairs.
CHUNK = 8 << 20
#: Ids of B lie below this; a pair of ids is one number, A's id times it plus B's.
WIDTH = 1 << 20

# How byte-level vocabularies cut text into words before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Letters and signs whose classes are the same in every version of Unicode in use.
COMMON = re.compile("[\t-\r -~ -ɏΑ-ΡΣ-ώА-я‐-‧ぁ-ゔァ-ヺ一-龥가-힣]*")

ALIGNED = "chunk long, n_a long, n_b long, n_groups long, groups_sha256 string, groups string, codes array<int>, pairs array<long>, times array<long>"


class ByteLevel:
    """A byte-level tokenizer from its JSON file.

    Merges numbered in order of the vocabulary are ranks, which a faster library takes; texts
    with rare signs, and vocabularies numbered otherwise, go through the file's own library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
        letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in letters)}
        vocabulary = self.slow.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        self.fast = self._ranks(spec, vocabulary)

    def _ranks(self, spec: dict, vocabulary: dict):
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        if not plain or any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
            return None
        import tiktoken

        ranks = {self.bytes[i]: i for i in range(256 + len(pairs))}
        return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        quick = [self.fast is not None and COMMON.fullmatch(t) is not None for t in texts]
        rest = iter(self.slow.encode_batch([t for t, q in zip(texts, quick) if not q], add_special_tokens=False))
        return [self.fast.encode_ordinary(t) if q else next(rest).ids for t, q in zip(texts, quick)]


class Pieces:
    """A piece tokenizer with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(path_a), Pieces(path_b)


class Common(NamedTuple):
    """Ranks in both lists of the ends they share, ascending."""

    a: np.ndarray
    b: np.ndarray


def gallop(keys: np.ndarray, long: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Place of the first entry of ``long[low:high]`` that is not below each key (``high`` if
    none is), all keys at once. Steps from ``start`` double away from it, up or down, until
    the key is bracketed; halving finishes."""
    n = len(keys)
    if n == 0 or len(long) == 0:
        return low.copy()
    under = np.zeros(n, bool)
    inside = start < high
    under[inside] = long[start[inside]] < keys[inside]
    left, right = np.where(under, start + 1, low), np.where(under, high, start)
    live, step = np.arange(n), 1
    while len(live):
        up = under[live]
        probe = np.where(up, start[live] + step, start[live] - step)
        fits = (probe < high[live]) & (probe >= low[live])
        live, up, probe = live[fits], up[fits], probe[fits]
        less = long[probe] < keys[live]
        left[live[less]] = probe[less] + 1
        right[live[~less]] = probe[~less]
        live = live[less == up]
        step *= 2
    live = np.flatnonzero(left < right)
    while len(live):
        middle = (left[live] + right[live]) >> 1
        less = long[middle] < keys[live]
        left[live[less]] = middle[less] + 1
        right[live[~less]] = middle[~less]
        live = live[left[live] < right[live]]
    return left


def intersect(ends_a: np.ndarray, ends_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> Common:
    """Ranks of the common ends of texts laid end to end. Text ``t`` has the ends
    ``at_a[t]`` to ``at_a[t + 1]`` of A and likewise of B; the shorter list of each text
    drives the search in the longer one."""
    n_a, n_b = np.diff(at_a), np.diff(at_b)
    found = []
    for keys, long, at_k, at_l, n_k, n_l, drives in ((ends_a, ends_b, at_a, at_b, n_a, n_b, n_a <= n_b), (ends_b, ends_a, at_b, at_a, n_b, n_a, n_b < n_a)):
        text = np.repeat(np.arange(len(n_k)), np.where(drives, n_k, 0))
        rank = np.arange(len(text)) - np.repeat(np.cumsum(np.where(drives, n_k, 0)) - np.where(drives, n_k, 0), np.where(drives, n_k, 0))
        mine = at_k[text] + rank
        low, high = at_l[text], at_l[text + 1]
        start = low + rank * n_l[text] // np.maximum(n_k[text], 1)
        place = gallop(keys[mine], long, low, high, start)
        hit = place < high
        hit[hit] = long[place[hit]] == keys[mine[hit]]
        found.append((mine[hit], place[hit]))
    (a1, b1), (b2, a2) = found
    a, b = np.concatenate([a1, a2]), np.concatenate([b1, b2])
    order = np.argsort(a, kind="stable")
    return Common(a[order], b[order])


@lru_cache(maxsize=4)
def _decimal(n: int) -> np.ndarray:
    """Decimal digits of all numbers below ``n``, right-aligned, zero bytes before them."""
    width = len(str(max(n - 1, 0)))
    numbers = np.arange(n)[:, None] // 10 ** np.arange(width - 1, -1, -1)
    return np.where((numbers > 0) | (np.arange(width) == width - 1), numbers % 10 + 48, 0).astype(np.uint8)


def group_texts(ids_a: np.ndarray, ids_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, common: Common, sizes: tuple[int, int]) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each text. Differences of common ranks are the lengths of
    the groups; tokens take their place among both lists by the group they are in."""
    group_a = np.searchsorted(common.a, np.arange(len(ids_a)))
    group_b = np.searchsorted(common.b, np.arange(len(ids_b)))
    before_a, before_b = np.append(0, common.a + 1), np.append(0, common.b + 1)
    place_a = np.arange(len(ids_a)) + before_b[group_a]
    place_b = np.arange(len(ids_b)) + before_a[group_b + 1]
    width = max(len(str(max(sizes) - 1)), 1) + 1
    cells = np.zeros((len(ids_a) + len(ids_b), width), np.uint8)
    table = _decimal(max(sizes))
    cells[place_a, : table.shape[1]] = table[ids_a]
    cells[place_b, : table.shape[1]] = table[ids_b]
    cells[:, -1] = ord(",")
    cells[place_a[common.a], -1] = ord("|")
    cells[place_b[common.b], -1] = ord(";")
    used = cells != 0
    ends = np.append(0, np.cumsum(used.sum(axis=1)))
    flat = cells[used].tobytes()
    cuts = ends[at_a + at_b]
    return [flat[i : j - 1] if j > i else b"" for i, j in zip(cuts[:-1], cuts[1:])]


class Aligned(NamedTuple):
    """Token counts, group text and linked id pairs of one text."""

    n_a: int
    n_b: int
    groups: bytes
    links: np.ndarray


def align(texts: list[str | None], a: ByteLevel, b: Pieces) -> list[Aligned]:
    """The alignment of each text. A null or empty text has no tokens, nor has one whose
    tokens' bytes, joined, are not a space and the text in either tokenizer."""
    whole = [t if t else None for t in texts]
    given = [i for i, t in enumerate(whole) if t is not None]
    ids_a, ids_b = a.encode([" " + whole[i] for i in given]), b.encode([whole[i] for i in given])
    kept_a, kept_b = [[] for _ in texts], [[] for _ in texts]
    for i, x, y in zip(given, ids_a, ids_b):
        raw = b" " + whole[i].encode()
        if b"".join(map(a.bytes.__getitem__, x)) == raw and b"".join(map(b.bytes.__getitem__, y)) == raw:
            kept_a[i], kept_b[i] = x, y
    flat = []
    for kept, lengths in ((kept_a, a), (kept_b, b)):
        at = np.append(0, np.cumsum([len(x) for x in kept]))
        ids = np.fromiter((i for x in kept for i in x), np.int64, at[-1])
        flat.append((ids, at, np.cumsum(_lengths(lengths)[ids])))
    (ids_a, at_a, ends_a), (ids_b, at_b, ends_b) = flat
    common = intersect(ends_a, ends_b, at_a, at_b)
    groups = group_texts(ids_a, ids_b, at_a, at_b, common, (len(a.bytes), len(b.bytes)))
    pairs = ids_a[common.a] * WIDTH + ids_b[common.b]
    cuts = np.searchsorted(common.a, at_a)
    return [Aligned(len(x), len(y), g, pairs[i:j]) for x, y, g, i, j in zip(kept_a, kept_b, groups, cuts[:-1], cuts[1:])]


def _lengths(tokenizer) -> np.ndarray:
    if not hasattr(tokenizer, "lengths"):
        tokenizer.lengths = np.array([len(x) for x in tokenizer.bytes], np.int64)
    return tokenizer.lengths


def _pieces(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together."""
    begin = size = 0
    for i, n in enumerate(sizes):
        size += n
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


def _give_back() -> None:
    """Return freed memory to the system; a worker that waits for its next task keeps
    little more than its tokenizers."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def _text(raw: bytes | None) -> str | None:
    try:
        return None if raw is None else raw.decode()
    except UnicodeDecodeError:
        return None


class _Chunk:
    """Rows whose links share one dictionary. Group texts are kept only if asked for,
    their digests always."""

    def __init__(self, number: int, groups: bool):
        self.number, self.size, self.groups = number, 0, groups
        self.rows, self.n_a, self.n_b, self.links, self.digests, self.texts = [], [], [], [], [], []

    def add(self, rows: pa.RecordBatch, done: list[Aligned], size: int) -> None:
        self.rows.append(rows)
        self.size += size
        for d in done:
            self.n_a.append(d.n_a)
            self.n_b.append(d.n_b)
            self.links.append(d.links)
            self.digests.append(hashlib.sha256(d.groups).hexdigest() if d.n_a else "")
            self.texts.append(d.groups.decode() if self.groups else None)

    def batches(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The rows, each link as its place among the chunk's distinct pairs, then a row with
        these pairs, ascending, and how often each is linked."""
        pairs, codes, times = np.unique(np.concatenate(self.links), return_inverse=True, return_counts=True)
        found = [len(x) for x in self.links]
        offsets = np.append(0, np.cumsum(found)).astype(np.int32)
        n, given = len(found), pa.Table.from_batches(self.rows).combine_chunks()
        made = {
            "chunk": pa.array([self.number] * n, pa.int64()),
            "n_a": pa.array(self.n_a, pa.int64()),
            "n_b": pa.array(self.n_b, pa.int64()),
            "n_groups": pa.array(found, pa.int64()),
            "groups_sha256": pa.array(self.digests, pa.string()),
            "codes": pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes.astype(np.int32))),
            "groups": pa.array(self.texts, pa.string()),
        }
        columns = [made[f.name] if f.name in made else given.column(f.name).combine_chunks() if f.name in given.column_names else pa.nulls(n, f.type) for f in schema]
        yield from pa.Table.from_arrays(columns, schema=schema).to_batches()
        made = {"chunk": pa.array([self.number], pa.int64()), "pairs": pa.array([pairs], pa.list_(pa.int64())), "times": pa.array([times], pa.list_(pa.int64()))}
        yield pa.RecordBatch.from_arrays([made.get(f.name, pa.nulls(1, f.type)) for f in schema], schema=schema)


def aligned(docs: DataFrame, folder: str = FOLDER, groups: bool = False, piece: int = PIECE, chunk: int = CHUNK) -> DataFrame:
    """``docs(text, ...)`` with the columns of ``ALIGNED`` in place of the text.

    Each task tokenises and aligns its own rows, ``piece`` bytes at a time, and gathers
    them in chunks of about ``chunk`` bytes. ``codes`` are the links of a text, as places
    in its chunk's distinct pairs; these come in a row of their own, with null in all columns
    but ``chunk``, ``pairs`` and ``times``. ``groups`` is filled on request. A text that is null,
    empty or not valid UTF-8, or that its tokens do not give back, has no tokens. Other
    columns are kept under their names with ``_`` before, so none clashes.
    """
    path_a, path_b = f"{folder}/{FILE_A}", f"{folder}/{FILE_B}"
    given = docs.select(F.col("text").cast("binary").alias("text"), *[F.col(f"`{c}`").alias(f"_{c}") for c in docs.columns if c != "text"])
    schema = StructType([f for f in given.schema.fields if f.name != "text"] + StructType.fromDDL(ALIGNED).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizers(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        held = _Chunk(number, groups)
        for batch in batches:
            raw, rows = batch.column("text"), batch.drop_columns(["text"])
            sizes = pc.fill_null(pc.binary_length(raw), 0).to_pylist()
            for i, j in _pieces(sizes, piece):
                done = align([_text(x) for x in raw.slice(i, j - i).to_pylist()], *pair)
                held.add(rows.slice(i, j - i), done, sum(sizes[i:j]))
                if held.size >= chunk:
                    yield from held.batches(to_arrow_schema(schema))
                    number += 1
                    held = _Chunk(number, groups)
                    _give_back()
        if held.rows:
            yield from held.batches(to_arrow_schema(schema))
        del held
        _give_back()

    return given.mapInArrow(run, schema)


def pair_counts(links: DataFrame) -> DataFrame:
    """``links(pair, n)`` summed to ``(pair, count, best)``: how often two ids are linked, and
    whether no other A id is linked more often to the B id."""
    counted = durable(links.groupBy("pair").agg(F.sum("n").alias("count")))
    b = F.col("pair").bitwiseAND(F.lit(WIDTH - 1))
    top = counted.groupBy(b.alias("_b")).agg(F.max("count").alias("_top"))
    return counted.join(top, b == F.col("_b")).select("pair", "count", (F.col("count") == F.col("_top")).alias("best"))


def scored(rows: DataFrame) -> DataFrame:
    """Rows of ``aligned``, as a stored table, with ``n_best`` and ``count_sum``.

    Only a chunk's distinct pairs are sent to the counts and come back; its rows look them
    up by their codes. A chunk is bounded by its text, however often a pair occurs.
    """
    named = rows.filter("pairs is not null").select("chunk", F.explode(F.arrays_zip("pairs", "times")).alias("_p"))
    asked = durable(named.select("chunk", F.col("_p.pairs").alias("pair"), F.col("_p.times").alias("n")))
    known = asked.select("chunk", "pair").join(pair_counts(asked), "pair")
    texts = rows.filter("pairs is null").drop("pairs", "times")
    schema = StructType([f for f in texts.schema.fields if f.name not in ("chunk", "codes")] + StructType.fromDDL("n_best long, count_sum long").fields)

    def look_up(texts: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(known.column("pair").to_numpy())
        codes = texts.column("codes").combine_chunks()
        flat, cuts = codes.flatten().to_numpy(), codes.offsets.to_numpy() - codes.offsets[0].as_py()
        out = texts.drop_columns(["chunk", "codes"])
        for name, of in (("n_best", "best"), ("count_sum", "count")):
            value = known.column(of).to_numpy()[order].astype(np.int64)
            running = np.zeros(len(flat) + 1, np.int64)
            np.cumsum(value[flat], out=running[1:])
            out = out.append_column(name, pa.array(np.diff(running[cuts]), pa.int64()))
        _give_back()
        return out

    return texts.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(look_up, schema)


def op11(spark, sf_dir: str) -> DataFrame:
    rows = durable(aligned(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("groups"))
    return scored(rows).select(
        F.col("_doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256"
    )
