"""Secret scan: fixed patterns, and guess costs of values in credential contexts.

A value after a word such as ``pwd`` or ``credential`` is cut into parts by dynamic
programming so that guessing it costs least: dictionary words by their rank, dates,
repeats, keyboard walks, and brute force per letter for the rest. Values that cost
enough guesses are secrets; weak ones such as ``password: see below`` are not. The
dictionary holds the most frequent words of the scanned documents themselves.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreweave.llm.common import lower_ascii, table
from loreweave.session import durable, release

#: Words of the dictionary, the longest part a segmentation uses, and the guesses (as a
#: power of ten) from which a value is a secret.
DICTIONARY, LONGEST, GUESSES = 20_000, 40, 9.0
#: Guesses per letter of a brute-force part, and for starting another part.
BRUTE, PART = 1.0, 0.3

# The base patterns, their least lengths and the order of kinds.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "guess")

#: A longer run of hex letters than most words have, to find candidates fast.
_LONG_HEX = re.compile(rb"[0-9a-f]{32,}")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Words that announce a credential; the value is what follows a colon or equals sign.
_CONTEXTS = (b"passphrase", b"password", b"passwd", b"pwd", b"passcode", b"credential", b"secret", b"token", b"apikey", b"api_key", b"private_key", b"access_key")
CONTEXT = re.compile(
    rb"""(?:passphrase|password|passwd|pwd|passcode|credentials?|secret|token|api_?key|private_key|access_key)["']?[\x20\t]*[:=][\x20\t]*["']?([^\x00-\x20"'`,;<>()\[\]{}]+)""",
    re.IGNORECASE,
)

# Rows of a keyboard, and passwords everyone tries.
KEYBOARD = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
COMMON = ("password", "admin", "letmein", "welcome", "monkey", "dragon", "master", "secret", "changeme", "default", "login", "test", "example", "none", "null", "true", "false", "redacted", "xxxx")
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0?[1-9]|1[0-2])(?:[-/._]?(?:0?[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)\d\d")
_UNLEET = str.maketrans({"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})


def _walks() -> set[str]:
    near = set()
    for row in KEYBOARD:
        for a, b in zip(row, row[1:]):
            near |= {a + b, b + a}
    return near


_NEAR = _walks()


def guess_cost(value: str, ranks: dict[str, int], enough: float = math.inf) -> float:
    """Least guesses, as a power of ten, over all segmentations of ``value``.

    A repeat or walk is one part however long; other parts span at most ``LONGEST``
    letters. So unless a longer repeat or walk is going on, a segmentation passes one of
    the last that many places, and costs only grow: the search stops once all of them
    cost ``enough``. Runs in time linear in the length.
    """
    low = value.lower()
    plain = low.translate(_UNLEET)
    n = len(low)
    best = [0.0] + [math.inf] * n
    run = walk = 0
    for end in range(1, n + 1):
        c = low[end - 1]
        run = run + 1 if end > 1 and low[end - 2] == c else 1
        walk = walk + 1 if end > 1 and low[end - 2 : end] in _NEAR else 1
        least = best[end - 1] + BRUTE * (1.0 if c.isalnum() else 1.5)
        if run > LONGEST:
            least = min(least, best[end - run] + math.log10(12.0 * run) + PART)
        if walk > LONGEST:
            least = min(least, best[end - walk] + math.log10(40.0 * walk) + PART)
        for size in range(2, min(LONGEST, end) + 1):
            start = end - size
            cost = math.inf
            if size <= run:
                cost = math.log10(12.0 * size)
            if size <= walk and size >= 3:
                cost = min(cost, math.log10(40.0 * size))
            part = low[start:end]
            rank = ranks.get(part)
            if rank is None:
                rank = 2 * ranks.get(plain[start:end], 0)
            if rank:
                cost = min(cost, math.log10(rank + 1.0) + (0.3 if value[start:end] != part else 0.0))
            elif c.isdigit() and 4 <= size <= 10 and _DATE.fullmatch(part):
                cost = min(cost, math.log10(365.0 * 60))
            least = min(least, best[start] + cost + PART)
        best[end] = least
        if run <= LONGEST and walk <= LONGEST and min(best[max(0, end - LONGEST) : end + 1]) >= enough:
            return enough
    return best[n]


def _strong(value: bytes, ranks: dict[str, int]) -> bool:
    return guess_cost(value.decode("utf-8", "replace"), ranks, GUESSES) >= GUESSES


def base_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` in bytes of the fixed patterns; kinds by place in KINDS."""
    found = []
    low = raw.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= LEAST["access"]]
    # A match takes a whole run of hex letters, so only runs that are long enough count.
    found += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(raw)]
    return sorted(found)


def guessed_spans(raw: bytes, ranks: dict[str, int]) -> list[tuple[int, int, int]]:
    """Spans of the values in credential contexts that are costly to guess."""
    low = raw.lower()
    if not any(k in low for k in _CONTEXTS):
        return []
    return [(m.start(1), 3, m.end(1)) for m in CONTEXT.finditer(raw) if _strong(m.group(1), ranks)]


def _in_letters(raw: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte places as code points, walking the text once."""
    places = sorted({p for s, _, e in spans for p in (s, e)})
    at, letters, known = 0, 0, {}
    for p in places:
        letters += len(raw[at:p].decode("utf-8"))
        at, known[p] = p, letters
    return [(known[s], k, known[e]) for s, k, e in spans]


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> dict[str, int]:
    """Ranks of the ``size`` most frequent words (letters only, three or more, A-Z in
    lower case) of whole ``docs(text)``; counted before the shuffle, ties by word.

    How many words have about which count says first from where on the top ones lie, so
    that only they and a few more are sorted, not ``size`` rows of each task.
    """
    words = F.explode(F.split(lower_ascii(F.col("text")), r"[^\p{L}]+"))
    counts = docs.select(words.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.length("word") >= 3)
    counts = durable(counts.withColumn("level", F.floor(F.log2("n") * 8).cast("int")))
    enough, least = 0, 0
    for r in sorted(counts.groupBy("level").count().collect(), reverse=True):
        enough, least = enough + r["count"], r["level"]
        if enough >= size:
            break
    top = counts.filter(F.col("level") >= least).orderBy(F.desc("n"), "word").limit(size).collect()
    release(counts)
    ranks = {w: i + 1 for i, w in enumerate(COMMON)}
    for r in top:
        ranks.setdefault(r["word"], len(ranks) + 1)
    return ranks


def scan(docs: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """The columns of ``docs`` but ``text``, and ``secrets``, an array of structs
    ``(kind, start, end)`` by start, then as ``KINDS`` are listed. Places are code
    points, ends exclusive. Null and empty texts have none; spans of different kinds may
    overlap. Whole texts are looked at, values of any length too.
    """
    kept = [c for c in docs.columns if c not in ("text", "secrets")]
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(len(kept)).cast(pa.binary()):
                raw = t.as_py() or b""
                spans = sorted(base_spans(raw) + guessed_spans(raw, ranks))
                rows.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in _in_letters(raw, spans)])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(rows, span)], [*kept, "secrets"])

    item = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    kind = T.StructType([docs.schema[c] for c in kept] + [T.StructField("secrets", T.ArrayType(item))])
    return docs.select(*kept, "text").mapInArrow(run, kind)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, dictionary(docs))
    text = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    number = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("secrets", lambda x: x["kind"] != "guess")
    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("secrets")).alias("spans"),
    )
