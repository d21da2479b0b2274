"""Media payloads kept as content-defined chunks: cut, deduplicated, stored once, put together and verified.

1. A rolling gear hash over the last 32 bytes cuts each payload where its low bits are zero.
2. Chunk digests (not bytes) are joined: each distinct payload has one writer, each distinct chunk one owner.
3. The texts are read again and every writer stores the chunks it owns, in one row, without a shuffle.
4. Payloads that own all their chunks are put together where they lie; only chunks that several payloads
   share, and payloads that lack some, move. Every medium is checked against its recorded digest.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Scratch, broadcast_small, map_arrow, slices, text_bytes

_GEAR = np.random.default_rng(576).integers(0, 2**32, 256, dtype=np.uint32)


@dataclass(frozen=True)
class Chunking:
    """Chunk sizes in bytes; mean must be a power of two. Payloads are padded with fill to multiples of unit."""

    least: int = 512
    mean: int = 2048
    most: int = 8192
    unit: int = 576
    fill: int = 255
    rate: int = 8000
    broadcast_bytes: int = 32 << 20


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of the 32 bytes that end there (fewer at the start)."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        more = h.copy()
        more[k:] += h[:-k] << np.uint32(k)
        h = more
    return h


def cut(marks: np.ndarray, lo: int, hi: int, c: Chunking) -> list[int]:
    """Chunk ends of the payload at lo..hi; marks are the sorted places after which a cut may fall."""
    ends = []
    while hi - lo > c.least:
        i = np.searchsorted(marks, lo + c.least)
        at = int(marks[i]) if i < len(marks) else hi
        lo = min(at, lo + c.most, hi)
        ends.append(lo)
    if not ends or ends[-1] < hi:
        ends.append(hi)
    return ends


def payloads(texts: pa.Array, c: Chunking) -> Iterator[tuple[int, memoryview, list[tuple[int, int]]]]:
    """(text bytes, payload, chunk bounds in it) of each text."""
    buffer, offsets = text_bytes(texts)
    data = np.frombuffer(buffer, np.uint8)
    sizes = np.diff(np.array(offsets, np.int64))
    full = np.maximum(1, -(-sizes // c.unit)) * c.unit
    at = np.concatenate(([0], np.cumsum(full)))
    joined = np.full(at[-1], c.fill, np.uint8)
    for i, n in enumerate(sizes):
        joined[at[i] : at[i] + n] = data[offsets[i] : offsets[i] + n]
    marks = np.flatnonzero((gear(joined) & np.uint32(c.mean - 1)) == 0) + 1
    view = memoryview(joined)
    for i, n in enumerate(sizes):
        ends = cut(marks, int(at[i]), int(at[i + 1]), c)
        starts = [int(at[i]), *ends[:-1]]
        yield int(n), view[at[i] : at[i + 1]], [(a - int(at[i]), b - int(at[i])) for a, b in zip(starts, ends, strict=True)]


def wave(payload: bytes, rate: int) -> bytes:
    """The stored form: a mono 8-bit wave file whose samples are the payload's bytes."""
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n + n % 2) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", n) + payload + b"\0" * (n % 2)


def samples(medium: bytes) -> bytes:
    """Reads the payload back from the stored form."""
    if medium[:4] != b"RIFF" or medium[8:16] != b"WAVEfmt ":
        raise ValueError("not a wave file")
    return medium[44 : 44 + struct.unpack_from("<I", medium, 40)[0]]


def feature(payload: bytes) -> str:
    """Whole-number features of the samples: least, most, sum, energy and crossings of the middle."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    high = x > 127
    return f"min={x.min()};max={x.max()};sum={x.sum()};energy={((x - 128) ** 2).sum()};crossings={int((high[1:] != high[:-1]).sum())}"


_FACTS = "mid binary, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _facts(mid: bytes, n_bytes: int, recorded: bytes, parts: list[bytes], rate: int) -> tuple:
    medium = wave(b"".join(parts), rate)
    read = samples(medium)
    digest = hashlib.sha256(read)
    if digest.digest() != recorded:
        raise ValueError(f"medium {mid.hex()} does not match its recorded digest")
    return mid, n_bytes, len(read), digest.hexdigest(), zlib.crc32(read[-32:]), len(medium), hashlib.sha256(medium).hexdigest(), feature(read)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in _FACTS.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=names)


def _mid(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def store_media(docs: DataFrame, scratch: Scratch, c: Chunking = Chunking(), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Writes three tables to the shared folder.

    refs (id, mid): each row's medium. plan (mid, pos, digest, own, shared): each medium's ordered chunk list.
    store (mid, n_bytes, n_chunks, whole, own): one row per medium, own holds (pos, shared, data) of owned chunks.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("mid", _mid(F.col("text")))
    id_type = docs.schema[id_col].dataType.simpleString()

    def reference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1000, 8_000_000):
            lists = [[hashlib.sha256(p[a:b]).digest() for a, b in bounds] for _, p, bounds in payloads(batch.column("text"), c)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mid"), pa.array(lists, pa.list_(pa.binary()))], names=["id", "mid", "chunks"])

    refs = scratch.write(map_arrow(texts, reference, f"id {id_type}, mid binary, chunks array<binary>"), "refs")
    writers = refs.groupBy("mid").agg(F.min("id").alias("writer"))
    first = refs.join(writers, "mid").where(F.col("id").eqNullSafe(F.col("writer")))
    chunks = first.select("mid", F.posexplode("chunks").alias("pos", "digest")).distinct()
    owners = chunks.groupBy("digest").agg(F.min(F.struct("mid", "pos")).alias("o"), F.count("*").alias("uses"))
    placed = chunks.join(owners, "digest")
    own = (F.col("o.mid") == F.col("mid")) & (F.col("o.pos") == F.col("pos"))
    plan = scratch.write(placed.select("mid", "pos", "digest", own.alias("own"), (F.col("uses") > 1).alias("shared")), "plan")
    # What a writer must know of its chunks: which it doesn't own, and which others need. Most need nothing.
    said = plan.where("shared").groupBy("mid").agg(F.collect_list(F.when(~F.col("own"), F.col("pos"))).alias("skip"), F.collect_list(F.when(F.col("own"), F.col("pos"))).alias("lend"))
    copies = refs.join(writers, "mid").where(~F.col("id").eqNullSafe(F.col("writer"))).select("id", "mid").distinct().withColumn("copy", F.lit(True))
    said = scratch.write(said, "said")
    copies = scratch.write(copies, "copies")
    big = lambda df, width: df.count() * width > c.broadcast_bytes
    said_side = broadcast_small(said, c.broadcast_bytes, 128)
    copies_side = copies if big(copies, 64) else F.broadcast(copies)
    same = texts["mid"].eqNullSafe(copies["mid"]) & texts["id"].eqNullSafe(copies["id"])
    mine = texts.join(copies_side, same, "left_anti").join(said_side, "mid", "left")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_type = pa.list_(pa.struct([("pos", pa.int32()), ("shared", pa.bool_()), ("data", pa.binary())]))
        for batch in slices(batches, "text", 1000, 8_000_000):
            rows = []
            for (n, p, bounds), skip, lend in zip(payloads(batch.column("text"), c), batch.column("skip").to_pylist(), batch.column("lend").to_pylist(), strict=True):
                skip, lend = set(skip or ()), set(lend or ())
                held = [{"pos": i, "shared": i in lend, "data": bytes(p[a:b])} for i, (a, b) in enumerate(bounds) if i not in skip]
                rows.append((n, len(bounds), hashlib.sha256(p).digest(), held))
            n, k, whole, held = zip(*rows, strict=True)
            cols = [batch.column("mid"), pa.array(n, pa.int64()), pa.array(k, pa.int32()), pa.array(whole, pa.binary()), pa.array(held, own_type)]
            yield pa.RecordBatch.from_arrays(cols, names=["mid", "n_bytes", "n_chunks", "whole", "own"])

    packs = map_arrow(mine.select("mid", "text", "skip", "lend"), pack, "mid binary, n_bytes bigint, n_chunks int, whole binary, own array<struct<pos:int,shared:boolean,data:binary>>")
    store = scratch.write(packs, "store")
    scratch.drop(said, copies)
    return refs, plan, store


def read_media(plan: DataFrame, store: DataFrame, c: Chunking = Chunking()) -> DataFrame:
    """One row of facts per medium, put together from the store's chunks and verified."""
    complete = F.size("own") == F.col("n_chunks")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                cols = [part.column(x).to_pylist() for x in ("mid", "n_bytes", "whole", "own")]
                yield _rows([_facts(mid, n, digest, [x["data"] for x in own], c.rate) for mid, n, digest, own in zip(*cols, strict=True)])

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by mid and pos, so one medium is open at a time."""
        rows, mid, seen, parts, head = [], None, -1, [], None
        for batch in batches:
            for m, pos, n, digest, data in zip(*[batch.column(x).to_pylist() for x in ("mid", "pos", "n_bytes", "whole", "data")], strict=True):
                if m != mid:
                    if mid is not None:
                        rows.append(_facts(mid, *head, parts, c.rate))
                    mid, seen, parts, head = m, -2, [], None
                if n is not None:
                    head = n, digest
                if pos > seen and data is not None:  # a repeated row may have stored a chunk twice
                    parts.append(data)
                    seen = pos
                if len(rows) == 500:
                    yield _rows(rows)
                    rows = []
        if mid is not None:
            rows.append(_facts(mid, *head, parts, c.rate))
        yield _rows(rows)

    lent = store.select(F.explode("own").alias("x"), "mid").where("x.shared").select("mid", "x.pos", "x.data")
    lent = plan.where("own and shared").join(lent, ["mid", "pos"]).select("digest", "data")
    needs = plan.where("not own").select("digest", "mid", "pos")
    fetched = needs.join(lent, "digest").select("mid", "pos", F.lit(None).cast("long").alias("n_bytes"), F.lit(None).cast("binary").alias("whole"), "data")
    lacking = store.where(~complete)
    heads = lacking.select("mid", F.lit(-1).alias("pos"), "n_bytes", "whole", F.lit(None).cast("binary").alias("data"))
    held = lacking.select("mid", F.explode("own").alias("x"), F.lit(None).cast("long").alias("n_bytes"), F.lit(None).cast("binary").alias("whole")).select("mid", "x.pos", "n_bytes", "whole", "x.data")
    rows = heads.unionByName(held).unionByName(fetched).repartition("mid").sortWithinPartitions("mid", "pos")
    return map_arrow(store.where(complete), whole, _FACTS).unionByName(map_arrow(rows, ordered, _FACTS)).dropDuplicates(["mid"])


def media_columns(docs: DataFrame, c: Chunking = Chunking(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Facts of each row's medium, read back from the chunk store.

    Null text counts as empty: one unit of fill bytes. Very long texts have more chunks. Equal texts share
    one stored medium and all values; repeated rows and null ids keep a row each; an empty table gives an
    empty result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "media")
    refs, plan, store = store_media(docs, scratch, c, id_col, text_col)
    facts = read_media(plan, store, c)
    return refs.select(F.col("id").alias(id_col), "mid").join(facts, "mid").drop("mid")
