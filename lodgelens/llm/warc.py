"""WARC archives: one gzip member per record, and a sequential reader.

Writing: every task writes its rows to archives of its own in a shared folder and returns a manifest row for each, so
that files of failed or repeated attempts are never read.  Reading: an archive is one unit of work; it is read in
blocks, inflated step by step, framed by Content-Length, and its digests are verified; no more than a block of a record
is held unless its payload is asked for.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelens.llm.common import grows, text_of
from lodgelens.session import StoredTables

BLOCK = 1 << 20
MAX_HEADER = 1 << 20
MANIFEST = "archive string, n_records long, n_bytes long"
RECORDS = (
    "archive string, record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, "
    "payload_digest string, verified boolean, payload binary"
)


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _header_value(text: str) -> str:
    """Without control characters, which would break the framing."""
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in text)


def record_bytes(record_id: str, kind: str, uri: str | None, date: str, payload: bytes, refers: str | None) -> bytes:
    """One record as a gzip member.  A revisit keeps the HTTP header, with the full length, and leaves the payload out."""
    sha1 = base32_sha1(hashlib.sha1(payload).digest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    fields = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {date}",
        f"WARC-Block-Digest: sha1:{base32_sha1(hashlib.sha1(block).digest())}",
        f"WARC-Payload-Digest: sha1:{sha1}",
    ]
    if uri is not None:
        fields.append(f"WARC-Target-URI: {_header_value(uri)}")
    if kind == "revisit":
        fields.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        fields.append(f"WARC-Refers-To: <{refers}>")
    fields += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


class Members:
    """The gzip members of a stream, inflated one after another in bounded chunks."""

    def __init__(self, stream, block: int = BLOCK):
        self.stream, self.block, self.data = stream, block, b""

    def another(self) -> bool:
        self.data = self.data or self.stream.read(self.block)
        return bool(self.data)

    def chunks(self) -> Iterator[bytes]:
        inflate = zlib.decompressobj(31)
        while not inflate.eof:
            self.data = self.data or self.stream.read(self.block)
            fed = bool(self.data)
            out = inflate.decompress(self.data, self.block)
            self.data = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            if out:
                yield out
            elif not fed and not inflate.eof:
                raise ValueError("the archive ends within a record")


def _fields(header: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = header.decode("utf-8", "replace").split("\r\n")
    pairs = (line.partition(":") for line in lines if line)
    return first, {name.strip().lower(): value.strip() for name, _, value in pairs}


def _head(chunks: Iterator[bytes], held: bytearray) -> bytes:
    """Moves the bytes before the first empty line out of ``held``, which is filled from ``chunks``."""
    at = held.find(b"\r\n\r\n")
    while at < 0:
        if len(held) > MAX_HEADER:
            raise ValueError("a header is too long")
        chunk = next(chunks, None)
        if chunk is None:
            raise ValueError("a header does not end")
        held += chunk
        at = held.find(b"\r\n\r\n")
    head = bytes(held[:at])
    del held[: at + 4]
    return head


def read_record(chunks: Iterator[bytes], keep_payload: bool) -> tuple:
    """(record_id, type, uri, refers_to, payload length, payload digest, verified, payload) of one member."""
    held = bytearray()
    version, fields = _fields(_head(chunks, held))
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    left = int(fields["content-length"])
    block, payload, kept = hashlib.sha1(), hashlib.sha1(), []
    http, length = bytearray(), 0
    in_payload = "http" not in fields.get("content-type", "")
    announced = None
    while True:
        part = bytes(held[:left])
        del held[: len(part)]
        left -= len(part)
        block.update(part)
        if not in_payload:
            http += part
            at = http.find(b"\r\n\r\n")
            if at < 0 and len(http) > MAX_HEADER:
                raise ValueError("an HTTP header is too long")
            if at >= 0 or not left:
                in_payload = True
                head = bytes(http[: at if at >= 0 else len(http)])
                part = bytes(http[at + 4 :]) if at >= 0 else b""
                announced = _fields(head)[1].get("content-length")
            else:
                part = b""
        payload.update(part)
        length += len(part)
        if keep_payload and part:
            kept.append(part)
        if not left:
            break
        chunk = next(chunks, None)
        if chunk is None:
            raise ValueError("a record is shorter than its Content-Length")
        held += chunk
    for chunk in chunks:
        held += chunk
        if len(held) > 4:
            break
    if bytes(held) != b"\r\n\r\n":
        raise ValueError("a record is longer than its Content-Length")
    kind = fields.get("warc-type", "")
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    own = base32_sha1(payload.digest())
    verified = fields.get("warc-block-digest", "").removeprefix("sha1:") == base32_sha1(block.digest())
    revisit = kind == "revisit"
    if not revisit:
        verified = verified and stated == own
    size = int(announced) if revisit and announced is not None else length
    strip = lambda name: fields[name].strip("<>") if name in fields else None
    body = b"".join(kept) if keep_payload and not revisit else None
    return (
        strip("warc-record-id"), kind, fields.get("warc-target-uri"), strip("warc-refers-to"), size,
        stated if revisit else own, verified, body,
    )


def write_archives(
    records: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", archive_bytes: int = 64 << 20
) -> DataFrame:
    """Manifest rows of archives written from (record_id, kind, uri, payload, refers_to); lazy, so store it once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        stream, name, records_in, bytes_in = None, "", 0, 0
        done = []
        for batch in batches:
            for at in range(batch.num_rows):
                row = [batch.column(k)[at].as_py() for k in range(5)]
                if stream is None:
                    name, records_in, bytes_in = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    stream = system.open_output_stream(f"{root}/{name}")
                data = record_bytes(row[0], row[1], row[2], date, row[3], row[4])
                stream.write(data)
                records_in, bytes_in = records_in + 1, bytes_in + len(data)
                if bytes_in >= archive_bytes:
                    stream.close()
                    stream = None
                    done.append((f"{folder}/{name}", records_in, bytes_in))
        if stream is not None:
            stream.close()
            done.append((f"{folder}/{name}", records_in, bytes_in))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["archive", "n_records", "n_bytes"])

    return records.mapInArrow(run, MANIFEST)


def read_archives(manifest: DataFrame, keep_payload: bool = True) -> DataFrame:
    """The records (``RECORDS``) of the archives that the column ``archive`` names; digests that differ give ``verified``
    false, broken framing is an error that names the archive."""
    types = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.bool_(), pa.binary()]
    names = [part.split()[0] for part in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for archive in batch.column(0).to_pylist():
                system, path = fs.FileSystem.from_uri(archive)
                rows, size = [], 0
                with system.open_input_stream(path) as stream:
                    members = Members(stream)
                    while members.another():
                        try:
                            record = read_record(members.chunks(), keep_payload)
                        except (ValueError, KeyError, zlib.error) as problem:
                            raise ValueError(f"{archive}: {problem}") from problem
                        rows.append((archive, *record))
                        size += len(record[-1] or b"")
                        if len(rows) >= 5000 or size >= 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return manifest.select("archive").mapInArrow(run, RECORDS)


def archive_pages(pages: DataFrame, min_bytes: int = 0, store: StoredTables | None = None) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) and return the stored manifest.

    Of the pages with equal payloads (by SHA-1 and length) of at least ``min_bytes``, the one with the largest page_id
    is a response and the others revisit it; rows that repeat that page_id are responses too.  A null html is an empty
    payload, a null url gives a record without target, a null page_id ranks below all others.  An empty table gives an
    empty manifest.
    """
    store = store or StoredTables(pages.sparkSession, "warc")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        text_of("html").cast("binary").alias("payload"),
    ).withColumns({"sha": F.sha1("payload"), "size": F.length("payload")})
    groups = store.put(
        rows.where(F.col("size") >= min_bytes)
        .groupBy("sha", "size")
        .agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
        .where("n > 1"),
        "groups",
    )
    last = F.when(F.coalesce(F.col("page_id"), F.col("last") - 1) < F.col("last"), F.col("last"))
    joined = rows.join(grows(groups), ["sha", "size"], "left").withColumn("refers", last)
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("none")))
    records = joined.select(
        name(F.col("page_id")).alias("record_id"),
        F.when(F.col("refers").isNull(), "response").otherwise("revisit").alias("kind"),
        F.col("url").alias("uri"),
        "payload",
        F.when(F.col("refers").isNotNull(), name(F.col("refers"))).alias("refers_to"),
    )
    return store.put(write_archives(records, f"{store.folder}/archives"), "manifest")
