"""WARC archives of pages: writing them from rows, and a sequential reader.

Every record is one gzip member. The reader goes through an archive once, in pieces:
zlib's incremental decompressor for one member at a time, header lines up to the blank
line, then exactly ``Content-Length`` bytes of block, hashed as they pass. Nothing but
the current piece and, if asked for, the payload of one record is held. Both digests of
a record are verified. A member that cannot be read gives a row with its ``problem``, and
reading goes on at the next gzip signature.

Archives are written by the tasks to a folder all executors share, under names of their
own per attempt, so a task that runs twice leaves a file that no row refers to. Paths are
URIs that ``pyarrow.fs`` understands (local or mounted folders, HDFS, S3, GCS).

Payloads of ``least`` bytes or more that occur more than once are stored once: in the
record of the page with the largest id. The others are ``revisit`` records with the
payload's digest and the id of the record that has it; their block keeps the HTTP head,
and with it the payload's length.

Defined results: a null payload is empty; a null or empty URL gives a record without
target; null page ids count as least and come back as null; pages that share both id and
payload are all ``response``; line breaks in URLs are percent-encoded; an empty table
writes no archive and reads back no row. Input columns but the three named are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from convoscope.llm.common import arrow_map, shared_folder, small, stage

PIECE = 1 << 16
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    head = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: {digest(payload)}",
        f"WARC-Block-Digest: {digest(block)}",
        f"Content-Length: {len(block)}",
    ]
    if url:
        lines.insert(4, "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines.insert(5, f"WARC-Refers-To: <urn:page:{refers_to}>")
        lines.insert(6, f"WARC-Profile: {REVISIT}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member of its own."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class Record:
    """What the reader knows of a record once it has passed."""

    offset: int
    headers: dict[str, str] = field(default_factory=dict)
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes | None = None
    payload_bytes: int = 0
    payload_sha1: str = ""
    problem: str | None = None


class _Framing:
    """Takes a member's decompressed bytes in pieces and frames its one record."""

    def __init__(self, offset: int, keep: bool):
        self.record = Record(offset)
        self.keep = keep
        self.head = bytearray()
        self.left: int | None = None  # bytes of the block still to come; None in the header
        self.http_head: bytearray | None = bytearray()
        self.tail = bytearray()
        self.block, self.body = hashlib.sha1(), hashlib.sha1()
        self.parts: list[bytes] = []

    def feed(self, data: bytes) -> None:
        if self.left is None:
            seen = max(0, len(self.head) - 3)
            self.head += data
            end = self.head.find(b"\r\n\r\n", seen)
            if end < 0:
                return
            data = bytes(self.head[end + 4 :])
            lines = bytes(self.head[:end]).decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("no WARC version line")
            self.record.headers = _fields(lines[1:])
            self.left = int(self.record.headers.get("content-length", "-1"))
            if self.left < 0:
                raise ValueError("no content length")
        block, rest = data[: self.left], data[self.left :]
        self.left -= len(block)
        self.block.update(block)
        if self.http_head is not None:
            self.http_head += block
            end = self.http_head.find(b"\r\n\r\n")
            if end < 0:
                block = b""
            else:
                lines = bytes(self.http_head[:end]).decode("latin-1").split("\r\n")
                self.record.http = _fields(lines[1:])
                block = bytes(self.http_head[end + 4 :])
                self.http_head = None
        if block:
            self.body.update(block)
            self.record.payload_bytes += len(block)
            if self.keep:
                self.parts.append(block)
        self.tail += rest[:5]

    def close(self) -> Record:
        r = self.record
        if self.left is None:
            raise ValueError("the member ends inside the header")
        if self.left:
            raise ValueError(f"the member ends {self.left} bytes before the block does")
        if bytes(self.tail) != b"\r\n\r\n":
            raise ValueError("the record does not end with two line breaks")
        _same(r.headers.get("warc-block-digest"), self.block.digest(), "block")
        r.payload_sha1 = self.body.hexdigest()
        if r.headers.get("warc-type") == "revisit":
            r.payload_sha1 = _sha1_of(r.headers.get("warc-payload-digest", ""))
            r.payload_bytes = int(r.http.get("content-length", "0"))
        else:
            _same(r.headers.get("warc-payload-digest"), self.body.digest(), "payload")
            r.payload = b"".join(self.parts) if self.keep else None
        return r


def _fields(lines: list[str]) -> dict[str, str]:
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def _sha1_of(value: str) -> str:
    return base64.b32decode(value.partition(":")[2]).hex()


def _same(stated: str | None, found: bytes, what: str) -> None:
    if stated and _sha1_of(stated) != found.hex():
        raise ValueError(f"{what} digest {stated} does not match")


def read_records(stream, keep: bool = False) -> Iterator[Record]:
    """Records of a stream of gzip members, in order."""
    offset, data, ended = 0, b"", False  # data begins at offset

    def more() -> bytes:
        nonlocal ended
        piece = stream.read(PIECE)
        ended = not piece
        return piece

    while True:
        if not data and not ended:
            data = more()
        if not data:
            return
        start = offset
        unpack, framing, problem = zlib.decompressobj(31), _Framing(start, keep), None
        try:
            while not unpack.eof:
                out = unpack.decompress(data, PIECE)
                offset += len(data) - len(unpack.unconsumed_tail) - len(unpack.unused_data)
                data = unpack.unconsumed_tail or unpack.unused_data
                if problem is None:
                    try:
                        framing.feed(out)
                    except ValueError as error:  # the rest of the member is passed over
                        problem = str(error)
                if not unpack.eof and not data:
                    data = b"" if ended else more()
                    if not data and not out:
                        raise EOFError("the archive ends inside a member")
            if problem is None:
                yield framing.close()
                continue
        except (ValueError, EOFError, zlib.error) as error:
            problem = str(error)
        yield Record(start, headers=framing.record.headers, problem=problem)
        if unpack.eof:
            continue
        # Look for the next member, which begins with gzip's signature.
        if offset == start:
            data, offset = data[1:], offset + 1
        while True:
            at = data.find(b"\x1f\x8b\x08")
            if at >= 0:
                data, offset = data[at:], offset + at
                break
            drop = max(0, len(data) - 2)
            data, offset = data[drop:], offset + drop
            piece = b"" if ended else more()
            if not piece:
                return
            data += piece


def decided(pages: DataFrame, least: int = 1000) -> DataFrame:
    """``page_id, url, payload`` and ``first_id``: for a payload of ``least`` bytes or
    more that occurs more than once the largest page id that has it, else null."""
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url",
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("key", F.unhex(F.sha1("payload")))
    often = (
        rows.where(F.octet_length("payload") >= least).groupBy("key")
        .agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("key", "first_id")
    )
    return rows.join(small(often, "copies"), "key", "left").drop("key")


def write_archives(pages: DataFrame, folder: str, least: int = 1000) -> DataFrame:
    """Write a record per page; rows ``(path, records)`` of the archives, staged."""

    def work(batches):
        place, path = fs.FileSystem.from_uri(folder)
        place.create_dir(path, recursive=True)
        name = f"{path}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, n = None, 0
        for batch in batches:
            for row in batch.to_pylist():
                page, first = row["page_id"], row["first_id"]
                out = out or place.open_output_stream(name, compression=None)
                revisit = first is not None and page != first
                out.write(member(record(page, row["url"], row["payload"], first, revisit)))
                n += 1
        if out:
            out.close()
            yield pa.record_batch([pa.array([f"{folder}/{name.rpartition('/')[2]}"]), pa.array([n])], ["path", "records"])

    return stage(arrow_map(decided(pages, least), work, "path string, records bigint"), "manifest")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """A row per record of the archives named in ``path``, read one after the other:
    ``path, at`` (where its member begins), ``record_id, record_type, refers_to, url,
    payload_bytes, payload_digest`` (SHA-1, hex), ``payload`` if asked for, ``problem``."""
    kind = pa.schema([
        ("path", pa.string()), ("at", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()),
        ("refers_to", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("payload", pa.binary()), ("problem", pa.string()),
    ])

    def work(batches):
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                place, path = fs.FileSystem.from_uri(uri)
                rows, held = [], 0
                with place.open_input_stream(path, compression=None) as stream:
                    for r in read_records(stream, payloads):
                        h = r.headers
                        rows.append({
                            "path": uri, "at": r.offset, "record_id": h.get("warc-record-id"),
                            "record_type": None if r.problem else h.get("warc-type"),
                            "refers_to": h.get("warc-refers-to"), "url": h.get("warc-target-uri"),
                            "payload_bytes": r.payload_bytes, "payload_digest": r.payload_sha1,
                            "payload": r.payload, "problem": r.problem,
                        })
                        held += len(r.payload or b"") + 500
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=kind)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kind)

    schema = (
        "path string, at bigint, record_id string, record_type string, refers_to string, url string, "
        "payload_bytes bigint, payload_digest string, payload binary, problem string"
    )
    # An archive is read by one task, so each is a row of a partition of its own.
    count = max(1, archives.count())
    spread = archives.select("path").repartition(count)
    return arrow_map(spread, work, schema)


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Pages written to archives and read back."""
    folder = shared_folder(pages.sparkSession, "warc")
    if folder.startswith("/"):
        folder = "file://" + folder
    elif folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    return read_archives(write_archives(pages, folder, least))
