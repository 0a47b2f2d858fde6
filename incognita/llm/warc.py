"""WARC archives: a writer with one gzip member a record, and a sequential reader that inflates and verifies them.

An archive is a file of gzip members one after another, each a WARC/1.1 record. Tasks write files of up to about
``ARCHIVE_BYTES`` to a shared folder (any store that Arrow opens; the names count that their tasks committed) and read them
back as streams. Where only Spark reaches the store, archives are binary rows of a table instead. The reader inflates piece
by piece, frames blocks by Content-Length and checks block and payload digests, which must be there; a revisit's claims
are checked against the response that it refers to.

Of pages with equal payloads of at least ``LEAST`` bytes, that with the largest page_id is written as a response, the
others as revisits that refer to it; smaller payloads are all responses. Copies are found by digests alone; html moves
once, dealt by page_id and digest, and small pages stay where they are.

Edge cases: null html counts as empty; a null page_id is written as such, ranks below all others and refers to nothing
if it is the largest; rows that repeat the largest page_id are all responses; further columns are ignored; an empty table
gives no archive and no record.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAST = 1000
#: An archive is closed once it has this many bytes; one that is a row of a table, once it has ROW_BYTES.
ARCHIVE_BYTES = 256 << 20
ROW_BYTES = 4 << 20
#: Tasks that read archives, at most.
READERS = 10_000
#: Compressed bytes that the reader takes at once.
READ_BYTES = 1 << 16
LEVEL = 5
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("5f0f9b1e-2f0a-4f0e-8a55-3c1f5e7c9d10")
DATE = "1970-01-01T00:00:00Z"


class DamagedArchive(ValueError):
    """The bytes aren't whole WARC records, or a digest doesn't match."""


@dataclass
class Record:
    """A WARC record; ``payload`` is what follows the HTTP head, empty for revisits."""

    headers: dict[str, str]
    block: bytes
    payload: bytes = field(default=b"")


def digest(data: bytes) -> str:
    """A labelled digest as WARC headers have it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def hex_digest(label: str) -> str:
    """The bare lower-case hexadecimal digits of a labelled digest."""
    return base64.b32decode(label.removeprefix("sha1:")).hex()


def record_id(page_id: int | None) -> str:
    """The URN of a page's record."""
    return f"<{uuid.uuid5(SPACE, str(page_id)).urn}>"


def member(headers: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in (headers | {"Content-Length": str(len(block))}).items())
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def _line(value: object) -> str:
    """A header value: control characters, which would end it, are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" and c != "%" else f"%{ord(c):02X}" for c in str(value))


def page_member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """The record of a page."""
    head = HTTP % len(payload)
    block = head if revisit else head + payload
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": _line(url or ""),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Block-Digest": digest(block),
        "WARC-Payload-Digest": digest(payload),
        "X-Page-ID": "" if page_id is None else str(page_id),
        "X-Payload-Length": str(len(payload)),
    }
    if revisit:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to), "X-Refers-To-Page-ID": str(refers_to)}
    return member(headers, block)


def inflate(source: BinaryIO) -> Iterator[bytes]:
    """The content of each gzip member, read from the source piece by piece."""
    rest = b""
    while True:
        rest = rest or source.read(READ_BYTES)
        if not rest:
            return
        unpacker, out = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not rest:
                rest = source.read(READ_BYTES)
                if not rest:
                    raise DamagedArchive("the last member is cut off")
            try:
                out.append(unpacker.decompress(rest))
            except zlib.error as e:
                raise DamagedArchive(str(e)) from e
            rest = unpacker.unused_data
        yield b"".join(out)


def parse(content: bytes, strict: bool = False) -> Record:
    """The record in a member's content, framed by its Content-Length; digests are verified, and if ``strict`` demanded."""
    head, gap, body = content.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or not version.startswith(b"WARC/1."):
        raise DamagedArchive("no WARC head")
    headers = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise DamagedArchive(f"no header: {name[:80]}")
        headers[name.strip()] = value.strip()
    n = int(headers.get("Content-Length", "-1"))
    if n < 0 or body[n:] != b"\r\n\r\n":
        raise DamagedArchive("Content-Length doesn't frame the block")
    if strict and not {"WARC-Block-Digest", "WARC-Payload-Digest"} <= headers.keys():
        raise DamagedArchive("no digest")
    block = body[:n]
    if "WARC-Block-Digest" in headers and digest(block) != headers["WARC-Block-Digest"]:
        raise DamagedArchive("block digest")
    payload = b""
    if headers.get("WARC-Type") == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if "WARC-Payload-Digest" in headers and digest(payload) != headers["WARC-Payload-Digest"]:
            raise DamagedArchive("payload digest")
    return Record(headers, block, payload)


def read_archive(source: BinaryIO, strict: bool = False) -> Iterator[Record]:
    """All records of an archive, in order."""
    return (parse(content, strict) for content in inflate(source))


def plan(pages: DataFrame) -> DataFrame:
    """page_id, url, html, refers_to, revisit: which rows are written as revisits, and of what."""
    page = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    large = F.octet_length("html") >= LEAST
    long = page.where(large).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    groups = common.cut(long.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("largest")), "digests")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    told = common.unskewed(long.select("page_id", "digest"), groups, ["digest"], "n", total).where("n > 1 and largest is not null")
    revisits = told.where(~F.col("page_id").eqNullSafe(F.col("largest"))).select(F.col("page_id").alias("of"), F.col("digest").alias("same"), F.col("largest").alias("refers_to")).distinct()
    joined = long.join(revisits, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("same")), "left")
    joined = joined.select("page_id", "url", "html", "refers_to", F.col("refers_to").isNotNull().alias("revisit"))
    return joined.union(page.where(~large).select("page_id", "url", "html", F.lit(None).cast("long"), F.lit(False)))


def _members(batches: Iterable[pa.RecordBatch]) -> Iterator[bytes]:
    for whole in batches:
        for b in common.slices(whole, 2):
            for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in b.columns)):
                yield page_member(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to, revisit)


def archives(pages: DataFrame) -> DataFrame:
    """archive, content: the pages as WARC archives of about ``ROW_BYTES``, for stores that only Spark reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, parts, size = TaskContext.get().partitionId(), 0, [], 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{task:06d}-{number:06d}.warc.gz"]), pa.array([b"".join(parts)], pa.binary())], ["archive", "content"])

        for m in _members(batches):
            parts.append(m)
            size += len(m)
            if size >= ROW_BYTES:
                yield closed()
                number, parts, size = number + 1, [], 0
        if parts:
            yield closed()

    return plan(pages).mapInArrow(run, "archive string, content binary")


def _store(folder: str) -> tuple[FileSystem, str]:
    """The file system of a folder's address, and the folder there."""
    return FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def write_files(pages: DataFrame, folder: str) -> DataFrame:
    """archive: the names of the archives that the pages were written to in a folder.

    A task that is run again writes files of other names; the rows that a committed task returns are what counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, path), context = _store(folder), TaskContext.get()
        store.create_dir(path, recursive=True)
        number, size, out, name = 0, 0, None, ""
        for m in _members(batches):
            if out is None:
                name = f"pages-{context.partitionId():06d}-{context.taskAttemptId()}-{number:06d}.warc.gz"
                out, size = store.open_output_stream(f"{path}/{name}", compression=None), 0
            out.write(m)
            size += len(m)
            if size >= ARCHIVE_BYTES:
                out.close()
                yield pa.RecordBatch.from_arrays([pa.array([name])], ["archive"])
                out, number = None, number + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["archive"])

    return plan(pages).mapInArrow(run, "archive string")


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _rows(found: list[dict[str, str]]) -> pa.RecordBatch:
    number = lambda name: pa.array([int(x[name]) if x.get(name) else None for x in found], pa.int64())
    text = lambda values: pa.array(list(values), pa.string())
    return pa.RecordBatch.from_arrays(
        [number("X-Page-ID"), number("X-Payload-Length"), text(hex_digest(x["WARC-Payload-Digest"]) for x in found), text(x["WARC-Type"] for x in found), number("X-Refers-To-Page-ID")],
        [c.split()[0] for c in RECORD.split(", ")],
    )


def _told(source: BinaryIO) -> Iterator[pa.RecordBatch]:
    """What the headers of an archive's records say, once their blocks are verified."""
    found = []
    for r in read_archive(source, strict=True):
        if r.headers["WARC-Type"] == "response" and len(r.payload) != int(r.headers["X-Payload-Length"]):
            raise DamagedArchive("payload length")
        found.append(r.headers)
        if len(found) >= 5000:
            yield _rows(found)
            found = []
    if found:
        yield _rows(found)


def read_files(names: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of the archives in a folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                with store.open_input_stream(f"{path}/{name}", compression=None, buffer_size=READ_BYTES) as source:
                    yield from _told(source)

    return names.select("archive").repartition(max(1, min(names.count(), READERS))).mapInArrow(run, RECORD)


def read_rows(stored: DataFrame) -> DataFrame:
    """The same of archives that are rows of a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                yield from _told(io.BytesIO(content.as_py()))

    return stored.select("content").mapInArrow(run, RECORD)


def verified(records: DataFrame) -> DataFrame:
    """The records, if every revisit's digest and length are those of the response it refers to."""
    facts = ["payload_digest", "payload_bytes"]
    claims = records.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), *facts).distinct()
    if not claims.join(records.where("record_type = 'response'").select("page_id", *facts).distinct(), ["page_id", *facts], "left_anti").isEmpty():
        raise DamagedArchive("a revisit refers to no response with its payload")
    return records


def write_and_read(pages: DataFrame) -> DataFrame:
    """Writes the archives to the shared folder, then reads them back."""
    folder = common.scratch(pages.sparkSession, "archives")
    try:
        _store(folder)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return verified(common.cut(read_rows(common.cut(archives(pages), "archives")), "records"))
    return verified(common.cut(read_files(common.cut(write_files(pages, folder), "names"), folder), "records"))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS largest FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN largest IS NOT NULL AND page_id IS DISTINCT FROM largest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM m
"""
