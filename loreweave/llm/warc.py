"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding some whole records,
and a last skippable frame with the table of their sizes, as the public seekable format
has it. Any Zstandard tool unpacks the whole; a reader with the table unpacks one frame.
The index maps each record to its bundle, frame and place inside it. Tasks write bundles
under names of their own and the index is written last, so what a lost task left behind
is never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import table
from loreweave.session import durable, shared_dir

#: Uncompressed bytes of a frame and compressed bytes of a bundle; one record may exceed a frame.
FRAME, BUNDLE, LEVEL = 1 << 20, 64 << 20, 3
#: Most tasks that read bundles at a time; each reads one after the other.
READERS = 10_000
#: Least payload bytes for which equal payloads become revisits.
LEAST = 0
# Numbers of the seekable format, and the revisit profile of WARC 1.1.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

_INDEX = "record_id string, bundle string, frame int, frame_at bigint, frame_bytes bigint, offset bigint, length bigint"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: str | None, url: str | None, payload: bytes, refers: str | None, revisit: bool) -> tuple[str, bytes]:
    """Id and bytes of one record. The block is an HTTP response; a revisit has its
    head only, whose Content-Length is that of the full payload."""
    name = f"urn:page:{quote(page, safe='')}" if page is not None else f"urn:uuid:{uuid.uuid4()}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.insert(4, f"WARC-Target-URI: {quote(url, safe=_URI)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{quote(refers or '', safe='')}>"]
    block = http if revisit else http + payload
    head.append(f"Content-Length: {len(block)}")
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_URI = "!#$%&'()*+,/:;=?@[]-._~"
_ID = re.compile(r"<urn:page:(.*)>")


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at ``at`` as a dict, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    start, size = end + 4, int(fields["Content-Length"])
    block = data[start : start + size]
    http_end = block.index(b"\r\n\r\n")
    http = dict(x.split(": ", 1) for x in block[:http_end].decode().split("\r\n")[1:])
    kind, payload = fields["WARC-Type"], block[http_end + 4 :]
    found = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and digest(payload) != found:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    page, refers = _ID.fullmatch(fields["WARC-Record-ID"]), _ID.fullmatch(fields.get("WARC-Refers-To", ""))
    return {
        "page": unquote(page[1]) if page else None,
        "url": fields.get("WARC-Target-URI"),
        "record_type": kind,
        "payload": payload if kind == "response" else None,
        "payload_bytes": int(http["Content-Length"]),
        "payload_digest": found,
        "refers": unquote(refers[1]) if refers else None,
    }, start + size + 4


class _Bundle:
    """Writes one bundle: records into frames, then the table of frames."""

    def __init__(self, store: fs.FileSystem, path: str):
        import zstandard

        self.out, self.path = store.open_output_stream(path, compression=None), path
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_checksum=True)
        self.at, self.table, self.open, self.size, self.rows = 0, [], [], 0, []

    def add(self, name: str, data: bytes) -> None:
        if self.size and self.size + len(data) > FRAME:
            self.flush()
        self.open.append((name, self.size, len(data), data))
        self.size += len(data)

    def flush(self) -> None:
        if not self.open:
            return
        frame = self.pack.compress(b"".join(x[3] for x in self.open))
        for name, offset, length, _ in self.open:
            self.rows.append((name, self.path, len(self.table), self.at, len(frame), offset, length))
        self.table.append((len(frame), self.size))
        self.out.write(frame)
        self.at, self.open, self.size = self.at + len(frame), [], 0

    def close(self) -> list[tuple]:
        self.flush()
        entries = b"".join(struct.pack("<II", *t) for t in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries)) + entries)
        self.out.close()
        return self.rows


def frames(source: pa.NativeFile) -> list[tuple[int, int]]:
    """Place and compressed size of each frame, from the table at the end of a bundle."""
    size = source.size()
    source.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    source.seek(size - 9 - width * count)
    raw = source.read(width * count)
    found, at = [], 0
    for i in range(count):
        packed = struct.unpack_from("<I", raw, i * width)[0]
        found.append((at, packed))
        at += packed
    return found


def plan(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``(page, url, payload, revisit, refers)`` for each row of ``pages(page_id, url,
    html)``: of equal payloads of ``least`` bytes or more the smallest page_id is a
    response and the others revisit it. Null html is an empty payload. Rows with a null
    id never are the smallest; a group of only such rows is all responses, and so are
    all rows that share the smallest id.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload")).withColumn("sha", F.sha1("payload"))
    size = F.octet_length("payload")
    first = rows.filter(size >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False)) & (size >= least)
    return rows.join(first, "sha", "left").select(
        F.col("page_id").cast("string").alias("page"), "url", "payload", revisit.alias("revisit"), F.col("first").cast("string").alias("refers")
    )


def write(planned: DataFrame, folder: str) -> DataFrame:
    """Writes bundles into ``folder`` (a URI all executors reach) and gives the index,
    itself written: one row per record. Memory holds one frame and one record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        bundle = None
        for b in batches:
            for page, url, payload, revisit, refers in zip(*b.columns):
                bundle = bundle or _Bundle(store, f"{base}/{uuid.uuid4().hex}.warc.zst")
                bundle.add(*record(page.as_py(), url.as_py(), payload.as_py(), refers.as_py(), revisit.as_py()))
                if bundle.at >= BUNDLE:
                    yield _index(bundle.close())
                    bundle = None
        if bundle:
            yield _index(bundle.close())

    return durable(planned.select("page", "url", "payload", "revisit", "refers").mapInArrow(run, _INDEX))


def _index(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["record_id", "bundle", "frame", "frame_at", "frame_bytes", "offset", "length"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


_READ = "page string, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers string"


def _batch(rows: list[dict], payloads: bool) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]
    names = [x.split(" ")[0] for x in _READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([None if n == "payload" and not payloads else r[n] for r in rows], k) for n, k in zip(names, kinds)], names)


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """All records of the bundles of ``index``, frame after frame by their seek tables,
    payloads held against their digests; without ``payloads`` that column is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        store, _ = fs.FileSystem.from_uri(folder)
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for path in b.column(0).to_pylist():
                with store.open_input_file(path) as source:
                    for at, size in frames(source):
                        source.seek(at)
                        data, place, rows = unpack.decompress(source.read(size)), 0, []
                        while place < len(data):
                            row, place = parse(data, place)
                            rows.append(row)
                        yield _batch(rows, payloads)

    bundles = durable(index.select("bundle").distinct())
    # Paths are few bytes that stand for many, so their number says how many tasks to make.
    tasks = max(1, min(bundles.count(), READERS))
    return bundles.repartition(tasks, "bundle").mapInArrow(run, _READ)


def lookup(index: DataFrame, folder: str, ids: DataFrame) -> DataFrame:
    """The records of ``ids(record_id)``, each read from its own frame only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        store, _ = fs.FileSystem.from_uri(folder)
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for path, at, size, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                with store.open_input_file(path) as source:
                    source.seek(at)
                    data = unpack.decompress(source.read(size))
                yield _batch([parse(data[offset : offset + length])[0]], True)

    return index.join(ids, "record_id", "left_semi").select("bundle", "frame_at", "frame_bytes", "offset", "length").mapInArrow(run, _READ)


ORACLE = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages
), f AS (
  SELECT h, min(page_id) AS first FROM p GROUP BY h
)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(h, CAST(5 * i // 4 + 1 AS INT), 2) AS INT) >> CAST(3 - (5 * i) % 4 AS INT)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p JOIN f USING (h)
"""


def op8(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    folder = folder if ":/" in folder else f"file://{folder}"
    found = read(write(plan(pages), folder), folder, payloads=False)
    return found.select(
        F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(kind).alias("refers_to")
    )
