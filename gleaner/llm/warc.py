"""WARC archives: pages written as records, one gzip member each, and read back by a sequential reader.

`write` makes archives of about ARCHIVE_BYTES in a folder: a task writes its rows one after the other and returns one row
an archive. Files of a task that is run again have other names, and only those of the table of archives count. Of pages
with equal payloads the one with the smallest id is a response, the others are revisits that name it and have no payload;
payloads below a size are responses all. Ties of id go by the row's number in a written table.

`read` goes through an archive from front to end: bytes are decompressed in blocks, a member ends where its compressed
stream does, the record's header gives the length of its block, and the digests of block and payload are taken along the
way. Without payloads, memory is bounded by HEADER_BYTES and BLOCK_BYTES whatever the length of records. A record whose
digest, length or header is wrong has an error, and reading goes on with the next member; after bytes that can't be
decompressed or a truncated member, the archive's rest is not read and an error says so. Archives that only Spark can
reach can be given as a column of bytes (`read_bytes`, for the binaryFile source).

Defined results: null html is empty; a null url has no WARC-Target-URI, and bytes of a url that a header can't hold are
written as %XX; a null id is the greatest, and read back as null. Repeated rows are records each: one response, the
others revisits. An empty table makes no archive. Other columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialized, shared_dir

ARCHIVE_BYTES = 256 << 20
BLOCK_BYTES = 1 << 20
HEADER_BYTES = 1 << 16
LEVEL = 6
DATE = "2026-01-01T00:00:00Z"

# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE_TYPE = "application/http;msgtype=response"
NOT_IN_HEADERS = re.compile(rb"[\x00-\x20\x7f]")

RECORDS = (
    "archive string, offset long, type string, record_id string, uri string, date string, payload_digest string,"
    " payload_bytes long, refers_to string, payload binary, error string"
)
FIELDS = [f.split()[0] for f in RECORDS.split(", ")]
TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
SCHEMA = pa.schema([(f.split()[0], TYPES[f.split()[1]]) for f in RECORDS.split(", ")])


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(kind: str, record_id: str, block: bytes, fields: dict[str, str], date: str = DATE) -> bytes:
    """A record as one gzip member."""
    lines = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date, "WARC-Block-Digest": f"sha1:{digest_of(block)}", **fields}
    head = "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return b"".join([deflate.compress(VERSION + head.encode()), deflate.compress(block), deflate.compress(b"\r\n\r\n"), deflate.flush()])


def page_record(page_id: int | None, url: bytes | None, payload: bytes, refers_to: str | None, record_id: str) -> bytes:
    """A page's response, or its revisit of another record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {"WARC-Payload-Digest": f"sha1:{digest_of(payload)}", "Content-Type": RESPONSE_TYPE}
    if url is not None:
        fields["WARC-Target-URI"] = NOT_IN_HEADERS.sub(lambda m: b"%%%02X" % m[0][0], url).decode("utf-8", "replace")
    if refers_to is None:
        return member("response", record_id, http + payload, fields)
    return member("revisit", record_id, http, fields | {"WARC-Refers-To": f"<{refers_to}>", "WARC-Profile": PROFILE})


def planned(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with `row`, `first` (the row that a row revisits) and `first_id` (its page_id); both null
    for responses."""
    raw = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), raw.alias("html"), F.sha2(raw, 256).alias("digest"))
    table = materialized(rows.withColumn("row", F.monotonically_increasing_id()))
    place = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"), "row")
    equal = table.where(F.length("html") >= least_bytes).groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    both = table.join(equal.select("digest", F.col("first.row").alias("first"), F.col("first.id").alias("first_id")), "digest", "left")
    revisit = F.col("first") != F.col("row")
    out = both.select("page_id", "url", "html", "row", F.when(revisit, F.col("first")).alias("first"), F.when(revisit, F.col("first_id")).alias("first_id"))
    out.gleaner_path = table.gleaner_path
    return out


def _record_id(page_id: object, row: int) -> str:
    return f"urn:page:{'' if page_id is None else page_id}:{row}"


def page_id_of(record_id: Column, kind: str = "long") -> Column:
    return F.nullif(F.regexp_extract(record_id, r"^urn:page:(.*):\d+$", 1), F.lit("")).cast(kind)


def write(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages to archives of the folder. path, records, bytes of each archive, a written table."""
    plan = planned(pages, least_bytes)
    run = uuid.uuid4().hex[:12]

    def write_part(batches):
        place, base = fs.FileSystem.from_uri(folder)
        place.create_dir(base)
        task = TaskContext.get()
        stem = f"{run}-{task.partitionId():05d}-{task.taskAttemptId()}"
        out, name, size, count, done = None, "", 0, 0, []

        def close() -> None:
            if out is not None:
                out.close()
                done.append((f"{folder}/{name}", count, size))

        for batch in batches:
            for page_id, url, html, row, first, first_id in zip(*(batch.column(i) for i in range(6)), strict=True):
                if out is None or size >= archive_bytes:
                    close()
                    name, size, count = f"{stem}-{len(done):04d}.warc.gz", 0, 0
                    out = place.open_output_stream(f"{base}/{name}", compression=None)
                    size = out.write(member("warcinfo", f"urn:warc:{name}", b"format: WARC File Format 1.1\r\n", {"WARC-Filename": name, "Content-Type": "application/warc-fields"})) or out.tell()
                refers = None if first.as_py() is None else _record_id(first_id.as_py(), first.as_py())
                text = url.as_buffer().to_pybytes() if url.is_valid else None
                record = page_record(page_id.as_py(), text, html.as_buffer().to_pybytes(), refers, _record_id(page_id.as_py(), row.as_py()))
                out.write(record)
                size, count = size + len(record), count + 1
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["path", "records", "bytes"])

    archives = materialized(plan.mapInArrow(write_part, "path string, records long, bytes long"))
    discard(plan)
    return archives


class Broken(ValueError):
    """An archive that can't be read on."""


class _Member:
    """The decompressed bytes of one gzip member, piece by piece. rest: compressed bytes that are read but not used."""

    def __init__(self, source: BinaryIO, rest: bytes) -> None:
        self.source, self.rest, self.inflate = source, rest, zlib.decompressobj(31)
        self.used = 0

    def read(self) -> bytes:
        """The next piece, of BLOCK_BYTES at most; nothing at the member's end."""
        while not self.inflate.eof:
            if not self.rest:
                self.rest = self.source.read(BLOCK_BYTES)
                if not self.rest:
                    raise Broken("truncated member")
            before = len(self.rest)
            try:
                piece = self.inflate.decompress(self.rest, BLOCK_BYTES)
            except zlib.error as e:
                raise Broken(f"not a gzip member: {e}") from None
            self.rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            self.used += before - len(self.rest)
            if piece:
                return piece
        return b""


def _headers(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in lines.decode("utf-8", "replace").split("\r\n") if line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _until_blank(source: _Member, data: bytes) -> tuple[bytes, bytes, bool]:
    """What comes before the first blank line and what follows it, as far as it is read; whether there is one."""
    while (at := data.find(b"\r\n\r\n")) < 0:
        if len(data) > HEADER_BYTES or not (piece := source.read()):
            return data, b"", False
        data += piece
    return data[: at + 2], data[at + 4 :], True


def _record(source: _Member, payloads: bool) -> dict:
    """One record; the member is read to its end."""
    head, data, found = _until_blank(source, b"")
    if not found or not head.startswith(b"WARC/"):
        while source.read():
            pass
        return {"error": "no record header"}
    fields = _headers(head.partition(b"\r\n")[2])
    out = {
        "type": fields.get("warc-type"), "record_id": fields.get("warc-record-id", "").strip("<>") or None, "uri": fields.get("warc-target-uri"),
        "date": fields.get("warc-date"), "refers_to": fields.get("warc-refers-to", "").strip("<>") or None,
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
    }
    length = fields.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        out["error"] = "no content length"
    left = int(length) if "error" not in out else 0
    block, payload, kept, size = hashlib.sha1(), hashlib.sha1(), [], 0
    http = b"" if fields.get("content-type", "").startswith("application/http") else None  # its header, until it has ended
    status: dict[str, str] = {}
    tail = b""
    while True:
        part, data = data[:left], data[left:]
        left -= len(part)
        block.update(part)
        if http is not None:
            http += part
            if (at := http.find(b"\r\n\r\n")) >= 0:
                status, part, http = _headers(http[:at].partition(b"\r\n")[2]), http[at + 4 :], None
            else:
                part = b""
                if len(http) > HEADER_BYTES:
                    http, out["error"] = None, out.get("error") or "no end of the HTTP header"
        payload.update(part)
        size += len(part)
        if payloads and part:
            kept.append(part)
        tail = (tail + data)[:5]
        if not (data := source.read()):
            break
    if left:
        out["error"] = out.get("error") or "block is shorter than its length"
    elif tail != b"\r\n\r\n":
        out["error"] = out.get("error") or "block is longer than its length"
    wanted = fields.get("warc-block-digest", "").removeprefix("sha1:")
    if wanted and wanted != base64.b32encode(block.digest()).decode():
        out["error"] = out.get("error") or "block digest differs"
    if out["type"] == "revisit":
        told = status.get("content-length", "")
        out["payload_bytes"] = int(told) if told.isascii() and told.isdigit() else None
        return out
    own = base64.b32encode(payload.digest()).decode()
    if out["payload_digest"] not in (None, own):
        out["error"] = out.get("error") or "payload digest differs"
    return out | {"payload_digest": own, "payload_bytes": size, "payload": b"".join(kept) if payloads else None}


def records_of(source: BinaryIO, payloads: bool = True) -> Iterator[dict]:
    """The records of an archive one after the other, each with the offset of its member."""
    rest, offset = b"", 0
    while True:
        if not rest and not (rest := source.read(BLOCK_BYTES)):
            return
        inside = _Member(source, rest)
        try:
            record = _record(inside, payloads)
        except Broken as e:
            yield {"offset": offset, "error": str(e)}
            return
        yield {"offset": offset, **record}
        rest, offset = inside.rest, offset + inside.used


def _batches(archive: str | None, records: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA in batches of about BLOCK_BYTES of payload."""
    rows, size = [], 0
    for record in records:
        rows.append({"archive": archive, **record})
        size += len(record.get("payload") or b"") + 256
        if size >= BLOCK_BYTES:
            yield pa.RecordBatch.from_pylist(rows, SCHEMA)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, SCHEMA)


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records (RECORDS) of the archives whose paths the column `path` has. Each archive is a task of its own, as far
    as there are tasks."""

    def read_part(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                place, name = fs.FileSystem.from_uri(path)
                with place.open_input_stream(name, compression=None) as source:
                    yield from _batches(path, records_of(source, payloads))

    tasks = max(1, archives.count())
    return archives.select("path").repartitionByRange(tasks, "path").mapInArrow(read_part, RECORDS)


def read_bytes(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """As `read`, of archives given whole by the columns path and content."""

    def read_part(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if content.is_valid:
                    yield from _batches(path, records_of(io.BytesIO(content.as_buffer()), payloads))

    return archives.select("path", "content").mapInArrow(read_part, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """Pages of the records: page_id, uri, payload_bytes, payload_digest, record_type, refers_to, error. A revisit has size
    and digest of the response that it names; one that names none, or one of another digest, has an error."""
    pages = records.where("type in ('response', 'revisit') or error is not null")
    known = records.where("type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d"), F.lit(True).alias("there")
    )
    both = pages.join(known.hint("merge"), "refers_to", "left")  # by the table of archives Spark can't tell its size
    revisit = F.col("type") == "revisit"
    lost = F.when(revisit & F.col("there").isNull(), "revisits no response").when(revisit & ~F.col("d").eqNullSafe(F.col("payload_digest")), "revisits another payload")
    return both.select(
        page_id_of(F.col("record_id")).alias("page_id"), "uri", F.when(revisit, F.col("b")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("d")).otherwise(F.col("payload_digest")).alias("payload_digest"), F.col("type").alias("record_type"),
        page_id_of(F.col("refers_to")).alias("refers_to"), F.coalesce("error", lost).alias("error"),
    )


def round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The pages as read back from archives of the shared folder. An error of any record stops the run."""
    archives = write(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}", least_bytes)
    back = resolved(materialized(read(archives, payloads=False)))
    sound = F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", F.lit("WARC"), "error"))).otherwise(F.col("record_type"))
    return back.select("page_id", "payload_bytes", "payload_digest", sound.alias("record_type"), "refers_to")
