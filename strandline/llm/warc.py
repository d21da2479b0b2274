"""WARC archives written and read as streams of chunks, so that no record is ever whole in memory.

Writing: the JVM cuts each payload into rows (record, chunk number, bytes); a task streams its rows into
one archive of gzip members, one per record, and lists the archive's segments in a manifest.
Reading: each segment is read in blocks; a record becomes rows (record, chunk number, size, digest), the
digest carried from chunk to chunk and stated on the last one.
Only archives named by the written manifest count, so what a lost or repeated task left behind is ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Scratch, map_arrow

_URN = "urn:strandline:page:"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


@dataclass(frozen=True)
class Archiving:
    """chunk: bytes of a payload row; segment: compressed bytes of an archive that one reader takes."""

    chunk: int = 256 << 10
    segment: int = 8 << 20
    least: int = 100
    date: str = "2026-01-01T00:00:00Z"
    broadcast_bytes: int = 8 << 20


def record_header(page_id, url, kind: str, size: int, digest: str, refers, date: str) -> bytes:
    """The header of a record and the HTTP header of its block."""
    http = _HTTP.format(size).encode() if kind == "response" else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_URN}{refers}>"]
    else:
        lines.append("Content-Type: application/http; msgtype=response")
    lines.append(f"Content-Length: {len(http) + (size if kind == 'response' else 0)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_warc(pages: DataFrame, scratch: Scratch, a: Archiving = Archiving()) -> DataFrame:
    """Archives pages (page_id, url, html); returns the manifest (path, start, size).

    Of payloads that are equal and have a.least bytes, the row with the smallest page_id is a response
    and others revisit it. Only the digests of repeated payloads are joined; they are broadcast while few.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("body"))
    rows = rows.withColumn("size", F.octet_length("body").cast("long")).withColumn("digest", F.sha2("body", 256))
    first = rows.where(F.col("size") >= a.least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    first = scratch.write(first, "repeated")
    side = F.broadcast(first) if first.count() * 96 <= a.broadcast_bytes else first
    response = F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.join(side, "digest", "left").withColumn("refers", F.when(~response, F.col("first")))
    # At least one row a record; a revisit has no bytes.
    n = F.when(F.col("refers").isNull(), F.greatest(F.lit(1), F.ceil(F.col("size") / a.chunk)).cast("int")).otherwise(1)
    # Only numbers are exploded; each row then takes its own bytes, so no second copy of a payload is made.
    rows = rows.select("page_id", "url", "size", "digest", "refers", "body", n.alias("chunks"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    data = F.when(F.col("refers").isNull(), F.substring(F.col("body"), F.col("chunk_no") * a.chunk + 1, F.lit(a.chunk)))
    rows = rows.select("page_id", "url", "size", "digest", "refers", "chunks", "chunk_no", data.alias("data"))
    folder = scratch.path("archives")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder)
        out = packer = None
        path, start, at = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
        entries: list[tuple[str, int, int]] = []
        digest = None
        for batch in batches:
            if out is None:
                files.create_dir(base, recursive=True)
                out = files.open_output_stream(path, compression=None)
            for page_id, url, size, said, refers, chunks, chunk_no, data in zip(*[batch.column(x).to_pylist() for x in ("page_id", "url", "size", "digest", "refers", "chunks", "chunk_no", "data")], strict=True):
                if chunk_no == 0:
                    packer = zlib.compressobj(1, wbits=31)
                    digest = hashlib.sha256()
                    kind = "response" if refers is None else "revisit"
                    at += out.write(packer.compress(record_header(page_id, url, kind, size, said, refers, a.date)))
                if data:
                    digest.update(data)
                    at += out.write(packer.compress(data))
                if chunk_no == chunks - 1:
                    if refers is None and digest.hexdigest() != said:
                        raise ValueError(f"page {page_id}: the chunks don't make its payload")
                    at += out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                    if at - start >= a.segment:
                        entries.append((path, start, at - start))
                        start = at
        if out is not None:
            out.close()
            if at > start:
                entries.append((path, start, at - start))
        cols = list(zip(*entries, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "start", "size"])

    manifest = scratch.write(map_arrow(rows, write, "path string, start bigint, size bigint"), "manifest")
    manifest._strandline_folder = folder
    return manifest


class _Block:
    """Bytes of a stream of gzip members, decompressed a block at a time."""

    def __init__(self, file, size: int, block: int = 256 << 10):
        self.file, self.left, self.block = file, size, block
        self.raw, self.data, self.open = b"", bytearray(), None

    def more(self) -> bool:
        """Adds some bytes to data; False at the segment's end."""
        while True:
            if not self.raw:
                if not self.left:
                    return False
                self.raw = self.file.read(min(self.block, self.left))
                if not self.raw:
                    raise EOFError("an archive is shorter than its manifest says")
                self.left -= len(self.raw)
            if self.open is None:
                self.open = zlib.decompressobj(wbits=31)
            part = self.open.decompress(self.raw, self.block)
            if self.open.eof:
                self.raw, self.open = self.open.unused_data, None
            else:
                self.raw = self.open.unconsumed_tail
            if part:
                self.data += part
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes before the next mark, which is dropped; None where the stream ends cleanly."""
        while (i := self.data.find(mark)) < 0:
            if not self.more():
                if self.data:
                    raise EOFError("a record's header is cut off")
                return None
        found = bytes(self.data[:i])
        del self.data[: i + len(mark)]
        return found

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in parts."""
        while n:
            if not self.data and not self.more():
                raise EOFError("a record is cut off")
            part = bytes(self.data[:n])
            del self.data[:n]
            n -= len(part)
            yield part


def _number(urn: str) -> int | None:
    return int(urn[len(_URN) + 1 : -1]) if len(urn) > len(_URN) + 2 else None


def read_warc(spark, manifest: DataFrame, with_data: bool = False) -> DataFrame:
    """The chunked record table of the archives in a manifest.

    Rows (page_id, url, record_type, refers_to, said_digest, chunk_no, payload_bytes so far, payload_digest
    on a record's last row, data if asked for). A record without payload has one row.
    """
    folder = manifest._strandline_folder
    names = ["page_id", "url", "record_type", "refers_to", "said_digest", "chunk_no", "payload_bytes", "payload_digest", "data"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=names)

    def records(block: _Block) -> Iterator[tuple]:
        while (head := block.until(b"\r\n\r\n")) is not None:
            lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            size, kind = int(fields["Content-Length"]), fields["WARC-Type"]
            if kind == "response":
                size -= len(block.until(b"\r\n\r\n")) + 4
            about = (_number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, _number(fields["WARC-Refers-To"]) if kind == "revisit" else None, fields["WARC-Payload-Digest"][7:])
            digest, done, no = hashlib.sha256(), 0, 0
            for part in block.take(size):
                digest.update(part)
                done += len(part)
                yield *about, no, done, digest.hexdigest() if done == size else None, part if with_data else None
                no += 1
            if not no:
                yield *about, 0, 0, digest.hexdigest(), b"" if with_data else None
            if b"".join(block.take(4)) != b"\r\n\r\n":
                raise ValueError("a record is longer than its header says")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start, size in zip(*[batch.column(x).to_pylist() for x in ("path", "start", "size")], strict=True):
                with files.open_input_file(path) as file:
                    file.seek(start)
                    rows, held = [], 0
                    for row in records(_Block(file, size)):
                        rows.append(row)
                        held += 200 + len(row[-1] or b"")
                        if held > 4_000_000:
                            yield batch_of(rows)
                            rows, held = [], 0
                    yield batch_of(rows)

    parts = max(1, min(manifest.count(), 100_000))
    schema = "page_id bigint, url string, record_type string, refers_to bigint, said_digest string, chunk_no int, payload_bytes bigint, payload_digest string, data binary"
    out = map_arrow(manifest.repartition(parts), read, schema)
    return out if with_data else out.drop("data")


def warc_round_trip(pages: DataFrame, a: Archiving = Archiving()) -> DataFrame:
    """Writes pages to archives, reads them back and returns one row of facts per page.

    Null html is an empty payload; null urls are left out of the header; a null page_id keeps its record.
    Rows that repeat the smallest page_id of equal payloads are responses like it. An empty table gives an
    empty result. Columns other than page_id, url and html are not read. A digest that differs raises.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    manifest = write_warc(pages, scratch, a)
    chunks = read_warc(pages.sparkSession, manifest)
    records = scratch.write(chunks.where("payload_digest is not null"), "records")
    fields = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = records.where("record_type = 'response'").withColumn("payload_digest", F.when(F.col("payload_digest") == F.col("said_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload differs from its digest"))))
    found = responses.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("said_digest"), F.col("payload_bytes").alias("bytes")).distinct()
    revisits = records.where("record_type = 'revisit'").join(found, ["refers_to", "said_digest"])
    return responses.select(fields).unionByName(revisits.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("said_digest").alias("payload_digest"), "record_type", "refers_to"))
