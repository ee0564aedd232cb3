"""WARC archives: one gzip member per record, and a sequential reader that verifies what it reads.

Pages with equal payloads are stored once: the one with the largest id is the response, the others are revisit records
that refer to it. The largest id per digest combines before the shuffle, and pages meet it in a join whose page side
can be split. Each attempt of a task writes an archive of its own; only finished attempts reach the manifest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.llm.common import scratch_path, stage
from tallymart.llm.shared_files import file_system

# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL, READ_BYTES = 6, 1 << 16
#: Capture time of pages, which the table does not tell.
CAPTURED = "1970-01-01T00:00:00Z"
MANIFEST = "path string, records long"


class Record(NamedTuple):
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes
    digest: str  # of the payload as read; of a revisit as stated


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One uncompressed record. A revisit has the HTTP head with the length of the payload, but not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + (b"" if revisit else payload)
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {CAPTURED}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        clean = "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
        lines.append(f"WARC-Target-URI: {clean}")
    if revisit:
        lines += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = LEVEL) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode().split(":", 1) for line in lines if line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def members(stream, size: int = READ_BYTES) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, read piece by piece."""
    rest = b""
    while True:
        inflater, parts = zlib.decompressobj(31), []
        while not inflater.eof:
            data = rest or stream.read(size)
            rest = b""
            if not data:
                if parts:
                    raise ValueError("archive ends inside a gzip member")
                return
            parts.append(inflater.decompress(data))
        rest = inflater.unused_data
        yield b"".join(parts)


def parse(member: bytes) -> Record:
    """One record, framed by its content length; raises if the frame or a digest does not fit."""
    head, found, body = member.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    headers = _fields(lines)
    length = int(headers["content-length"])
    if version != VERSION or not found or body[length:] != b"\r\n\r\n":
        raise ValueError("record is not framed by its content length")
    block = body[:length]
    if headers["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"block digest differs in {headers['warc-record-id']}")
    http_head, _, payload = block.partition(b"\r\n\r\n")
    http, stated = _fields(http_head.split(b"\r\n")[1:]), headers["warc-payload-digest"].removeprefix("sha1:")
    if headers["warc-type"] == "response" and (stated != base32_sha1(payload) or int(http["content-length"]) != len(payload)):
        raise ValueError(f"payload differs in {headers['warc-record-id']}")
    return Record(headers, http, payload, stated)


def write_warc(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_revisit_bytes: int = 0,
    root: str | None = None, level: int = LEVEL,
) -> DataFrame:
    """Write a record per page and return the manifest: `path` and `records` of each archive.

    A null html is empty. Of equal payloads of at least `least_revisit_bytes`, the rows with the largest id are
    responses (all of them if repeated) and the others revisits. A null id is never the largest; payloads with null
    ids only are all responses. An empty table gives an empty manifest.
    """
    root = root or scratch_path(pages.sparkSession, "warc")
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).cast("long").alias("_id"), F.col(url).alias("_url"), body.alias("_body"))
    rows = rows.withColumn("_sha", F.sha1("_body"))
    largest = rows.groupBy("_sha").agg(F.max("_id").alias("_first"))
    revisit = (F.octet_length("_body") >= least_revisit_bytes) & F.col("_first").isNotNull() & (
        F.col("_id").isNull() | (F.col("_id") != F.col("_first")))
    marked = rows.join(largest, "_sha").select("_id", "_url", "_body", "_first", revisit.alias("_revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{root}/pages-{uuid.uuid4().hex}.warc.gz"
        store, local = file_system(path)
        store.create_dir(local.rpartition("/")[0], recursive=True)
        count = 0
        with store.open_output_stream(local, compression=None) as out:
            for batch in batches:
                for row in zip(*(batch.column(i) for i in range(5)), strict=True):
                    page, link, payload, first, again = (v.as_py() for v in row)
                    out.write(gzip_member(record_bytes(page, link, payload, first, again), level))
                    count += 1
        if not count:
            store.delete_file(local)
            return
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64())], ["path", "records"])

    return stage(marked.mapInArrow(write, MANIFEST), "warc-manifest")


def read_warc(manifest: DataFrame, page_id: str = "page_id", with_payload: bool = True) -> DataFrame:
    """One row per record: id, `url`, `payload_bytes`, `payload_digest`, `record_type`, `refers_to` and `payload`.

    Length and digest of a revisit are those of the full payload, whose bytes are in the record referred to; its
    `payload` is null. Archives that are cut short or do not fit their lengths and digests raise an error.
    """
    types = [("id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
             ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]

    def id_of(name: str | None) -> int | None:
        number = (name or "")[len("<urn:page:"):-1]
        return int(number) if number else None

    def row(member: bytes) -> tuple:
        r = parse(member)
        revisit = r.headers["warc-type"] == "revisit"
        return (
            id_of(r.headers["warc-record-id"]), r.headers.get("warc-target-uri"), int(r.http["content-length"]), r.digest,
            r.headers["warc-type"], id_of(r.headers.get("warc-refers-to")),
            r.payload if with_payload and not revisit else None,
        )

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, [page_id, *(n for n, _ in types[1:])])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entry in batch.to_pylist():
                store, local = file_system(entry["path"])
                rows, held, count = [], 0, 0
                with store.open_input_stream(local, compression=None) as stream:
                    for member in members(stream):
                        rows.append(row(member))
                        held, count = held + len(member), count + 1
                        if len(rows) >= 1000 or held > 16 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)
                if count != entry["records"]:
                    raise ValueError(f"{entry['path']} has {count} records, not {entry['records']}")

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = f"`{page_id}` long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return manifest.repartitionByRange(n, "path").mapInArrow(read, schema)
