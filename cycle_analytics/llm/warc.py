"""WARC archives written from page rows and read back as a table of chunks.

A payload travels as rows (record, chunk number, bytes) of at most `chunk` bytes. The writer streams the chunks of
a record into one gzip member after the other; the reader inflates block by block and gives chunk rows again, each
with the digest of the payload so far. Neither side allocates a record as a whole.

Of records with equal payloads the one with the largest id is stored as `response`; the others are `revisit`
records that name it. The choice is one aggregation over digests; only the join that brings it back moves payloads,
and Spark splits that join where one payload holds a large part of the rows.

Each task writes files of its own name into the shared folder and reports (file, offset, length) of its records.
That report is written as a table; only files of tasks that ended well are in it, so lost or repeated tasks do
no harm.

A null payload is empty. Line ends in a URL are taken out of its header. A null id has no id header and comes
back as null; it never is the record that others refer to unless no record with that payload has an id, in which
case all of them are responses. Rows repeated with the largest id are all responses. Extra columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cycle_analytics.llm.common import only
from cycle_analytics.session import new_folder, written

CHUNK = 1 << 20
FILE_BYTES = 256 << 20
CRLF = b"\r\n"
WARCINFO = b"software: page archive writer\r\nformat: WARC File Format 1.1\r\n"
GZIP = 31  # zlib's window setting for gzip members


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def with_decisions(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """id, url, payload, digest (hex), n_bytes, record_type, refers_to."""
    payload = F.encode(F.coalesce(F.col(f"`{payload_col}`"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload")
    ).select("id", "url", "payload", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("n_bytes"))
    kept = rows.groupBy("digest").agg(F.max("id").alias("kept"))
    revisit = (F.col("n_bytes") >= min_bytes) & (F.col("kept").isNotNull()) & ~F.col("id").eqNullSafe(F.col("kept"))
    return rows.join(kept, "digest").select(
        "id", "url", "payload", "digest", "n_bytes",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("kept")).alias("refers_to"),
    )


def chunked(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per chunk, the chunks of a record one after the other; revisits and empty payloads have one empty chunk."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    sized = records.withColumn("payload", body)
    cuts = F.transform(
        F.expr(f"sequence(0, greatest(0, (octet_length(payload) - 1) div {chunk}))"),
        lambda k: F.substring(F.col("payload"), k * chunk + 1, F.lit(chunk)),
    )
    return sized.select(
        "id", "url", "digest", "n_bytes", "record_type", "refers_to",
        F.expr(f"greatest(0, (octet_length(payload) - 1) div {chunk})").alias("last_chunk"),
        F.posexplode(cuts).alias("chunk_no", "chunk"),
    )


def record_head(id_, url, digest, n_bytes, record_type, refers_to) -> bytes:
    """Header lines of a record, and of the HTTP response in it."""
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
        if record_type == "response" else b""
    )
    lines = [
        "WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{base32(bytes.fromhex(digest))}",
        f"X-Payload-Length: {n_bytes}",
    ]
    if id_ is not None:
        lines.append(f"X-Page-Id: {id_}")
    if url:
        lines.append("WARC-Target-URI: " + url.replace("\r", "").replace("\n", ""))
    if record_type == "revisit":
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"X-Refers-To-Page: {refers_to}",
        ]
    else:
        lines.append("Content-Type: application/http;msgtype=response")
    lines.append(f"Content-Length: {len(http) + (n_bytes if http else 0)}")
    return "\r\n".join(lines).encode() + CRLF + CRLF + http


class ArchiveWriter:
    """Appends gzip members to numbered files of one task."""

    def __init__(self, folder: str):
        self.filesystem, self.root = fs.FileSystem.from_uri(folder)
        self.filesystem.create_dir(self.root, recursive=True)
        self.stream, self.place, self.name = None, 0, ""

    def put(self, data: bytes) -> None:
        self.stream.write(data)
        self.place += len(data)

    def begin(self) -> None:
        if self.stream is not None and self.place >= FILE_BYTES:
            self.close()
        if self.stream is None:
            self.name = f"pages-{uuid.uuid4().hex}.warc.gz"
            place = posixpath.join(self.root, self.name)
            self.stream, self.place = self.filesystem.open_output_stream(place, compression=None), 0
            info = (
                f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\n"
                "WARC-Date: 2000-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\n"
                f"Content-Length: {len(WARCINFO)}\r\n\r\n"
            ).encode()
            deflate = zlib.compressobj(6, zlib.DEFLATED, GZIP)
            self.put(deflate.compress(info + WARCINFO + CRLF + CRLF) + deflate.flush())
        self.start, self.deflate = self.place, zlib.compressobj(6, zlib.DEFLATED, GZIP)

    def add(self, data: bytes) -> None:
        packed = self.deflate.compress(data)
        if packed:
            self.put(packed)

    def end(self) -> tuple[str, int, int]:
        self.add(CRLF + CRLF)
        self.put(self.deflate.flush())
        return self.name, self.start, self.place - self.start

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Write chunk rows as archives below `folder`; the report has one row (file, offset, length) per record."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, report = None, []
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                *head, last_chunk, chunk_no, chunk = row
                if writer is None:
                    writer = ArchiveWriter(folder)
                if chunk_no == 0:
                    writer.begin()
                    writer.add(record_head(*head))
                writer.add(chunk)
                if chunk_no == last_chunk:
                    report.append(writer.end())
            if report:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in report]) for k in range(3)], names=["file", "offset", "length"]
                )
                report = []
        if writer is not None:
            writer.close()

    return chunks.mapInArrow(write, "file string, offset long, length long")


class RecordReader:
    """Inflates one gzip member of an archive block by block."""

    def __init__(self, file, offset: int, length: int):
        self.file, self.left, self.inflate, self.held = file, length, zlib.decompressobj(GZIP), b""
        file.seek(offset)

    def more(self) -> bool:
        if self.inflate.unconsumed_tail:
            data = self.inflate.unconsumed_tail
        else:
            data = self.file.read(min(self.left, CHUNK))
            self.left -= len(data)
        got = self.inflate.decompress(data, CHUNK) if data else b""
        self.held += got
        return bool(got) or bool(data)

    def head(self) -> list[str]:
        """Lines up to the next empty line."""
        while CRLF + CRLF not in self.held and self.more():
            pass
        head, _, self.held = self.held.partition(CRLF + CRLF)
        return head.decode().split("\r\n")

    def body(self, length: int, chunk: int) -> Iterator[bytes]:
        """The next `length` bytes in chunks of one size; at least one, be it empty."""
        given = 0
        while True:
            want = min(chunk, length - given)
            while len(self.held) < want and self.more():
                pass
            data, self.held = self.held[:want], self.held[want:]
            given += len(data)
            yield data
            if given >= length or len(data) < want:
                return


CHUNK_COLUMNS = (
    ("record_id", pa.string()), ("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("chunk_no", pa.int32()), ("chunk_bytes", pa.int64()), ("bytes_so_far", pa.int64()),
    ("digest_so_far", pa.string()), ("is_last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
)
CHUNK_SCHEMA = (
    "record_id string, id long, url string, record_type string, refers_to long, chunk_no int, chunk_bytes long, "
    "bytes_so_far long, digest_so_far string, is_last boolean, payload_bytes long, payload_digest string"
)


def read_chunks(report: DataFrame, folder: str, chunk: int = CHUNK, with_data: bool = False) -> DataFrame:
    """The chunk table of the archives in a report. `payload_bytes` and `payload_digest` are what the header states."""

    def rows_of(reader: RecordReader) -> Iterator[tuple]:
        fields = dict(line.split(": ", 1) for line in reader.head()[1:])
        kind, length = fields["WARC-Type"], int(fields["X-Payload-Length"])
        if kind == "response":
            reader.head()
        number = lambda name: int(fields[name]) if name in fields else None
        so_far, digest, body = 0, hashlib.sha1(), length if kind == "response" else 0
        for k, data in enumerate(reader.body(body, chunk)):
            digest.update(data)
            so_far += len(data)
            yield (
                fields["WARC-Record-ID"], number("X-Page-Id"), fields.get("WARC-Target-URI"), kind,
                number("X-Refers-To-Page"), k, len(data), so_far, base32(digest.copy().digest()), so_far >= body,
                length, fields["WARC-Payload-Digest"].removeprefix("sha1:"), *([data] if with_data else []),
            )

    types = [*CHUNK_COLUMNS, *([("data", pa.binary())] if with_data else [])]

    def give(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(types)], names=[n for n, _ in types]
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = fs.FileSystem.from_uri(folder)
        name, file, rows, held = None, None, [], 0
        for batch in batches:
            for path, offset, length in zip(*(column.to_pylist() for column in batch.columns)):
                if path != name:
                    if file is not None:
                        file.close()
                    name, file = path, filesystem.open_input_file(posixpath.join(root, path))
                for row in rows_of(RecordReader(file, offset, length)):
                    rows.append(row)
                    held += row[6] if with_data else 256
                    if held > 8 * CHUNK:
                        yield give(rows)
                        rows, held = [], 0
        if rows:
            yield give(rows)
        if file is not None:
            file.close()

    return report.mapInArrow(read, CHUNK_SCHEMA + (", data binary" if with_data else ""))


def archive(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    min_bytes: int = 0, chunk: int = CHUNK,
) -> DataFrame:
    """Write a record per row below `folder`; returns the written report."""
    records = with_decisions(pages, id_col, url_col, payload_col, min_bytes)
    return written(write_archives(chunked(records, chunk), folder), "warc-report")


def run_query(pages: DataFrame) -> DataFrame:
    folder = new_folder(pages.sparkSession, "warc")
    chunks = read_chunks(archive(only(pages, "page_id", "url", "html"), folder), folder).where("is_last")
    stored = F.col("record_type") == "response"
    return chunks.select(
        F.col("id").alias("page_id"),
        F.when(stored, F.col("bytes_so_far")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(stored, F.col("digest_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", "refers_to",
    )
