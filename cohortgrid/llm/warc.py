"""WARC archives: a writer and a sequential reader.

Writer: one record per page, one gzip member per record. Of records with equal
payloads one is a response, the others are revisit records that name it and
carry no payload. Reader: incremental zlib, member by member; a record's header
fields, then exactly Content-Length bytes of block, then two line ends; payload
digests of responses are checked, and anything else stops the run.

Scale: digests and copies are found on narrow rows, sums per digest are
pre-aggregated, and the html is shuffled once, by digest, against a written
table of digests seen twice or more, so Spark can split a hot payload. Archives
are rolled at ROLL bytes. They are written under spark.checkpoint.dir with names
of their own for each attempt; the manifest, a Spark table, lists those of
attempts that ended well, so a lost executor or a second attempt leaves at most
a file that nothing reads. Readers stream: a task holds one record.

Cases: null html is the empty payload; a null url leaves WARC-Target-URI out; of
rows with equal payload and the largest page_id all are responses (repeated
rows); a null page_id is never the largest; empty tables give no archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, written

#: Bytes at which a new archive is begun; payloads shorter than this many bytes are never revisits.
ROLL, MIN_REVISIT = 128 << 20, 0
READ = 1 << 20

# Fixed values of WARC 1.1.
VERSION, END = b"WARC/1.1", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, size: int, refers_to: int | None) -> bytes:
    """One record, compressed. refers_to: None for a response."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}".encode() + END
    block = head + payload if refers_to is None else head
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": None if url is None else quote(url, safe="".join(map(chr, range(0x21, 0x7F))) + "".join(set(url) - set(map(chr, range(0x21))))),
        "WARC-Payload-Digest": f"sha1:{base64.b32encode(sha1).decode()}",
        "WARC-Refers-To": None if refers_to is None else f"<urn:page:{refers_to}>",
        "WARC-Profile": None if refers_to is None else PROFILE,
        "X-Payload-Length": str(size),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    text = "\r\n".join(f"{k}: {v}" for k, v in fields.items() if v is not None)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(VERSION + b"\r\n" + text.encode() + END + block + END) + packer.flush()


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        out, name, n, size = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

        for b in batches:
            for page_id, url, html, sha1, length, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    fs.create_dir(path, recursive=True)
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                made = record(page_id, url, html or b"", bytes.fromhex(sha1), length, refers_to)
                out.write(made)
                n, size = n + 1, size + len(made)
                if size >= ROLL:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return write


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archives; returns the manifest: path, records, bytes."""
    html = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html).alias("sha1"), F.octet_length(html).cast("long").alias("bytes"))
    copies = rows.filter(F.col("bytes") >= MIN_REVISIT).groupBy("sha1", "bytes").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    joined = rows.join(written(copies, "warc-copies"), ["sha1", "bytes"], "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    ready = joined.select("page_id", "url", F.when(refers.isNull(), F.col("html")).alias("html"), "sha1", "bytes", refers.alias("refers_to"))
    return written(ready.mapInArrow(_writer(folder or new_path(pages.sparkSession, "warc")), MANIFEST), "warc-manifest")


def members(stream) -> Iterator[bytes]:
    """The contents of each gzip member, one at a time."""
    unpack, got, data = zlib.decompressobj(31), [], b""
    while data or (data := stream.read(READ)):
        got.append(unpack.decompress(data))
        data = unpack.unused_data
        if unpack.eof:
            yield b"".join(got)
            unpack, got = zlib.decompressobj(31), []
    if got:
        raise ValueError("an archive ends inside a gzip member")


def parsed(member: bytes) -> tuple:
    """A record's fields in the order of RECORDS."""
    at = member.find(END)
    lines = member[:at].split(b"\r\n")
    if at < 0 or lines[0] != VERSION:
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (x.decode().split(": ", 1) for x in lines[1:])}
    size = int(fields["content-length"])
    block = memoryview(member)[at + 4 : at + 4 + size]
    if len(block) != size or member[at + 4 + size :] != END:
        raise ValueError("a record's block isn't as long as its Content-Length says")
    start = member.find(END, at + 4, at + 4 + size) - at
    payload, response = bytes(block[start:]), fields["warc-type"] == "response"
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if response and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != int(fields["x-payload-length"])):
        raise ValueError(f"{fields['warc-record-id']}: the payload doesn't have its digest")
    number = lambda s: int(x) if (x := s[len("<urn:page:") : -1]) else None
    refers = fields.get("warc-refers-to")
    return number(fields["warc-record-id"]), fields.get("warc-target-uri"), int(fields["x-payload-length"]), digest, fields["warc-type"], refers and number(refers), payload if response else None


def _reader(with_payload: bool):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, name = file_system(path)
                rows, n, held = [], 0, 0
                with fs.open_input_stream(name, compression=None, buffer_size=READ) as stream:
                    for member in members(stream):
                        row = parsed(member)
                        rows.append(row if with_payload else (*row[:-1], None))
                        n, held = n + 1, held + (len(member) if with_payload else 200)
                        if held >= 16 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)
                if n != records:
                    raise ValueError(f"{path}: {n} records; the manifest has {records}")

    return read


def read_warc(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row per record of the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits)."""
    # A task per archive: by the size of the manifest's rows Spark would read them all in one.
    return manifest.select("path", "records").repartition(max(1, manifest.count())).mapInArrow(_reader(with_payload), RECORDS)
