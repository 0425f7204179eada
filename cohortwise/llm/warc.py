"""WARC archives: writing one gzip member per record, and a sequential reader.

Records of equal payloads are told apart by a group's smallest page id: that one is a response,
the others revisit it. Archives are files below a folder that all executors share; they are written
and listed by Spark, so any of its file systems will do. The reader goes through an archive member
by member with an incremental inflater, frames each record by its content length, and checks the
digests of block and payload; whatever does not fit raises.

Defined results: null html is an empty payload; a null url leaves out the target; a null page id
never becomes the target of a revisit if its group has another id; rows that repeat a page id with
equal payloads are all of that id's type; no pages give no records; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.scratch import new_table_path

#: Smallest payload, in bytes, whose copies become revisits.
LEAST_PAYLOAD = 0
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_PER_FILE = 10_000
BLOCK = 1 << 16

RECORDS = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary, archive string, at long"
)


class ArchiveError(ValueError):
    """An archive that breaks framing or digests."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    name = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "none" else int(name)


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member."""
    digest = sha1_base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=~')}")
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    record = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


EMPTY_MEMBER = zlib.compressobj(6, zlib.DEFLATED, 31).flush()


def write_archives(pages: DataFrame, path: str, least_payload: int = LEAST_PAYLOAD) -> None:
    """Write (page_id, url, html) as archives below ``path``."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    # Only digests of two rows or more are looked up; Spark splits a digest that many rows have.
    copied = (
        rows.where(F.octet_length("payload") >= least_payload)
        .groupBy(F.col("digest").alias("of_digest"))
        .agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1 and original is not null")
        .select("of_digest", "original")
    )
    typed = rows.join(copied, F.col("digest") == F.col("of_digest"), "left")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    typed = typed.select("page_id", "url", "payload", F.col("original"), revisit.alias("revisit"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page_id, url, body, original, again = row
                record = member(page_id, url, body, original if again else None, again)
                # A member ends in the high byte of its size. The line end that Spark's text
                # writer adds is that zero byte; a huge record gets an empty member behind it.
                if record[-1]:
                    record += EMPTY_MEMBER
                made.append(record[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["record"])

    (
        typed.mapInArrow(pack, "record binary")
        .select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", "\x00")
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(path)
    )


@dataclass
class Record:
    """A record as read: headers by lower-case name, and its HTTP body."""

    headers: dict[str, str]
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    at: int = 0


def _headers(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode("utf-8").partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def members(data: memoryview) -> Iterator[tuple[int, Iterator[bytes]]]:
    """Start and inflated blocks of each gzip member in turn; each must be read to its end."""
    at = 0
    while at < len(data):
        inflater, start = zlib.decompressobj(31), at

        def blocks(inflater=inflater):
            nonlocal at
            while not inflater.eof:
                if at >= len(data):
                    raise ArchiveError("the archive ends within a record")
                fed = data[at : at + BLOCK]
                try:
                    out = inflater.decompress(fed)
                except zlib.error as error:
                    raise ArchiveError(str(error)) from error
                at += len(fed) - len(inflater.unused_data)
                if out:
                    yield out

        yield start, blocks()


def _record(start: int, blocks: Iterator[bytes]) -> Record | None:
    """A record out of one member: head, block of the stated length, two line ends, nothing more."""
    have = bytearray()

    def until(found) -> int:
        while (place := found()) < 0:
            more = next(blocks, None)
            if more is None:
                return -1
            have.extend(more)
        return place

    end = until(lambda: have.find(b"\r\n\r\n"))
    if end < 0:
        if have:
            raise ArchiveError("a record without the end of its head")
        return None  # an empty member
    lines = bytes(have[:end]).split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ArchiveError("not a WARC record")
    record = Record(_headers(lines[1:]), at=start)
    length = int(record.headers["content-length"])
    del have[: end + 4]
    if until(lambda: 0 if len(have) >= length + 4 else -1) < 0 or have[length:] != b"\r\n\r\n" or next(blocks, None):
        raise ArchiveError("a record's content length does not fit")
    block = bytes(have[:length])
    if "sha1:" + sha1_base32(block) != record.headers["warc-block-digest"]:
        raise ArchiveError("a block's digest does not fit")
    head, _, record.payload = block.partition(b"\r\n\r\n")
    record.http = _headers(head.split(b"\r\n")[1:])
    if record.headers["warc-type"] == "response":
        if len(record.payload) != int(record.http["content-length"]):
            raise ArchiveError("a payload's length does not fit")
        if "sha1:" + sha1_base32(record.payload) != record.headers["warc-payload-digest"]:
            raise ArchiveError("a payload's digest does not fit")
    return record


def records(data: bytes) -> Iterator[Record]:
    """All records of an archive in order."""
    for start, blocks in members(memoryview(data)):
        found = _record(start, blocks)
        for _ in blocks:
            raise ArchiveError("bytes behind a record")
        if found is not None:
            yield found


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives below ``path``; revisits have no payload of their own."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                ("payload", pa.binary()), ("archive", pa.string()), ("at", pa.int64()),
            ]
        )
        for batch in batches:
            for k in range(batch.num_rows):
                name, content, rows = batch.column("path")[k].as_py(), batch.column("content")[k].as_buffer(), []
                held = 0
                for r in records(content):
                    h = r.headers
                    url = h.get("warc-target-uri")
                    whole = h["warc-type"] == "response" and with_payload
                    rows.append(
                        {
                            "page_id": _page(h["warc-record-id"]),
                            "url": None if url is None else unquote(url),
                            "record_type": h["warc-type"],
                            "refers_to": _page(h["warc-refers-to"]) if "warc-refers-to" in h else None,
                            "payload_bytes": int(r.http["content-length"]),
                            "payload_digest": h["warc-payload-digest"].removeprefix("sha1:"),
                            "payload": r.payload if whole else None,
                            "archive": name,
                            "at": r.at,
                        }
                    )
                    held += len(r.payload) if whole else 0
                    if len(rows) >= 4096 or held > 1 << 24:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame, least_payload: int = LEAST_PAYLOAD, with_payload: bool = True) -> DataFrame:
    """Archive the pages in the shared folder and read the archives back."""
    spark = pages.sparkSession
    path = new_table_path(spark, "warc")
    write_archives(pages, path, least_payload)
    return read_archives(spark, path, with_payload)
