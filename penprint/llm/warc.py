"""WARC archives: one gzip member per record, revisit records for repeated payloads, a salvage reader.

A response record holds an HTTP header block and the payload; a revisit record holds the header block
only, whose Content-Length still tells the payload's size, and names the record it refers to. Tasks
write files of bounded size below the shared folder, each under its own name; a manifest of what
successful tasks wrote is all that readers look at, so a repeated task leaves no double records.

``read_records`` checks every record (gzip checksum, version line, block length, payload digest).
After a failed check it goes on at the next gzip member that holds a version line, or, in an
uncompressed file, at the next version line; the bytes between are reported as a quarantined gap.

Defined results: a null html is the empty payload; a null ``page_id`` is written as ``none`` and read as
null, and is never preferred over an id; rows that repeat the largest id of a payload are all
responses; a null url is left out; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penprint.llm.common import saved, table
from penprint.llm.files import Output, read_all
from penprint.session import scratch_path

FILE_BYTES = 32_000_000
PIECE = 16_384
# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
URN = "urn:penprint:page:"
VERSION_LINE = re.compile(rb"WARC/\d+\.\d+\r\n")
MANIFEST = "path string, records bigint, bytes bigint"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: object) -> str:
    return re.sub(r"[\r\n]+", " ", str(text))


def record(page_id: object, url: str | None, payload: bytes, refers_to: object = None, revisit: bool = False) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    head = [
        VERSION.decode(),
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{URN}{'none' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_line(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    whole = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(whole) + packer.flush()


@dataclass
class Record:
    start: int
    end: int
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]

    def page_id(self, header: str = "warc-record-id") -> int | None:
        found = re.fullmatch(rf"<{URN}(-?\d+)>", self.headers.get(header, ""))
        return int(found[1]) if found else None

    def payload_bytes(self) -> int:
        found = re.search(rb"(?im)^content-length:\s*(\d+)", self.block.partition(b"\r\n\r\n")[0])
        return int(found[1]) if found else len(self.payload)


@dataclass
class Salvage:
    """Records that passed their checks, and the byte ranges that did not."""

    records: list[Record] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)


def _parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at ``at`` and where it ends; ValueError if it is damaged."""
    body = data.find(b"\r\n\r\n", at)
    if body < 0 or not VERSION_LINE.match(data, at):
        raise ValueError("no version line")
    lines = data[at:body].split(b"\r\n")
    body += 4
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"\d+", headers.get("content-length", "")):
        raise ValueError("no length")
    length = int(headers["content-length"])
    if data[body + length : body + length + 4] != b"\r\n\r\n":
        raise ValueError("block length")
    block = data[body : body + length]
    named = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and named.startswith("sha1:"):
        if digest(block.partition(b"\r\n\r\n")[2]) != named[5:]:
            raise ValueError("payload digest")
    return headers, block, body + length + 4


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    """The gzip member at ``at`` and where it ends.

    It is fed piece by piece: what follows its end is copied, which must not be the rest of the file.
    """
    unpacker, parts = zlib.decompressobj(31), []
    while at < len(data) and not unpacker.eof:
        parts.append(unpacker.decompress(data[at : at + PIECE]))
        at += PIECE
    if not unpacker.eof:
        raise ValueError("gzip member is cut off")
    return b"".join(parts), min(at, len(data)) - len(unpacker.unused_data)


def _next(data: bytes, at: int) -> int:
    """The next place where a record may begin, or the end."""
    if data[:2] == b"\x1f\x8b" or not VERSION_LINE.match(data) and b"\x1f\x8b\x08" in data:
        while (at := data.find(b"\x1f\x8b\x08", at)) >= 0:
            try:
                if zlib.decompressobj(31).decompress(memoryview(data)[at : at + 4096], 16).startswith(b"WARC/"):
                    return at
            except zlib.error:
                pass
            at += 1
        return len(data)
    while (at := data.find(b"WARC/", at)) >= 0:
        if data[at - 1 : at] == b"\n" and VERSION_LINE.match(data, at):
            return at
        at += 1
    return len(data)


def read_records(data: bytes) -> Salvage:
    """All records of an archive that can be saved, and the gaps between them."""
    out, at = Salvage(), 0
    while at < len(data):
        try:
            if data[at : at + 2] == b"\x1f\x8b":
                whole, end = _member(data, at)
                headers, block, used = _parse(whole)
                if used != len(whole):
                    raise ValueError("more than one record in a member")
            else:
                headers, block, end = _parse(data, at)
            out.records.append(Record(at, end, headers, block))
            at = end
        except (ValueError, zlib.error) as error:
            later = _next(data, at + 1)
            out.gaps.append((at, later, str(error)[:80]))
            at = later
    return out


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``page_id, url, html`` rows as archives below ``folder`` and returns their manifest.

    Payloads are compared by their SHA-1; only ids and digests of repeats are gathered per payload.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    first = rows.groupBy("sha").agg(F.max("page_id").alias("response"))
    dealt = rows.join(first, "sha").select(
        "page_id", "url", "html", "response", (~F.col("page_id").eqNullSafe(F.col("response"))).alias("revisit")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, records, written = None, 0, []
        part = TaskContext.get().partitionId()

        def finish() -> None:
            file.close()
            written.append((file.path, records, file.size))

        for batch in batches:
            for page_id, url, html, response, revisit in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if file is None:
                    file, records = Output(f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.warc.gz"), 0
                file.write(record(page_id, url, html.encode("utf-8", "surrogatepass"), response, revisit))
                records += 1
                if file.size >= FILE_BYTES:
                    finish()
                    file = None
        if file is not None:
            finish()
        names = ["path", "records", "bytes"]
        columns = list(zip(*written, strict=True)) or [(), (), ()]
        types = [pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return saved(dealt.mapInArrow(work, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, path, start, end, gap``.

    A row per saved record, and one per quarantined gap: there ``gap`` tells the failed check.
    """
    schema = (
        "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, "
        "record_type string, refers_to bigint, path string, start bigint, end bigint, gap string"
    )
    names = [f.split()[0] for f in schema.split(", ")]
    types = [{"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]] for f in schema.split(", ")]

    def row(path: str, r: Record) -> tuple:
        kind = r.headers.get("warc-type")
        named = r.headers.get("warc-payload-digest", "").removeprefix("sha1:")
        return (
            r.page_id(), r.headers.get("warc-target-uri"), None if kind == "revisit" else r.payload,
            r.payload_bytes() if kind == "revisit" else len(r.payload), named, kind, r.page_id("warc-refers-to"),
            path, r.start, r.end, None,
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found = read_records(read_all(path))
                rows = [row(path, r) for r in found.records]
                rows += [(*[None] * 7, path, a, b, why) for a, b, why in found.gaps]
                for at in range(0, len(rows), 1000):
                    columns = list(zip(*rows[at : at + 1000], strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names
                    )

    files = max(1, manifest.count())
    dealt = manifest.select("path").repartition(files, "path")
    return dealt.mapInArrow(work, schema)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), scratch_path(spark, "warc"))
    found = read_archives(manifest).where(F.col("gap").isNull())
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT h, max(page_id) AS response FROM p GROUP BY h),
x AS (SELECT page_id, response, octet_length(encode(h)) AS n, sha1(h) AS s FROM p JOIN m USING (h)),
bits AS (
  SELECT page_id, response, n, list_transform(range(32), lambda i: (
      list_reduce(list_transform(range(5), lambda b:
        (((instr('0123456789abcdef', s[((i * 5 + b) // 4) + 1]) - 1) >> (3 - (i * 5 + b) % 4)) & 1) << (4 - b)),
        lambda a, c: a + c))) AS v
  FROM x)
SELECT page_id, n::BIGINT AS payload_bytes,
       list_reduce(list_transform(v, lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', k::INT + 1, 1)), lambda a, c: a || c)
         AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM bits"""
