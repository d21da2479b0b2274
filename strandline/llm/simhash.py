"""SimHash near-duplicates: meet-in-the-middle ball hashing.

1. A text's fingerprint has a bit set where over half of its shingles' 64-bit hashes have it set.
2. Each distinct fingerprint emits all variants within half the radius. Two fingerprints within the radius share a
   variant (flip half of the bits that differ in one, the rest in the other), and two that share one are within
   it: variants are looked up by equality only. Distinct fingerprints number 2081 at most on a variant.
3. Variants are dealt to buckets by a linear code of their bits: the code of a variant is that of its fingerprint,
   exclusive or that of its mask. So each pass makes its own part of the variants and no others, and a fingerprint
   is sent once to each bucket that has variants of it, where they follow from the two codes.
4. In a bucket, equal variants are found by sorting, and each fingerprint is linked with the least one there. Two
   fingerprints meet on many variants; their link is made on one of these only, their `home`, so it is made once
   whatever the buckets. Where a lesser one stands at the home of u and v, both are linked with it by pairs that are
   less than theirs, and so on down: all stay connected. Of these links each task keeps a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Scratch, map_arrow, slices
from strandline.llm.components import components

SEED = 42
BITS = 64


@dataclass(frozen=True)
class Balls:
    """Fingerprints of shingles of `width` words link at `radius` or fewer differing bits.

    passes (a power of two) bounds the shuffled bytes that stand at a time: 8 * variants / passes for each distinct
    fingerprint. bucket_rows is the number of variants aimed at that a task compares at once; there are least_buckets
    a pass or more. chunk is the number of fingerprints that are dealt at once.
    """

    width: int = 4
    radius: int = 4
    passes: int = 8
    bucket_rows: int = 2 << 20
    least_buckets: int = 512
    chunk: int = 1 << 15

    @property
    def variants(self) -> int:
        return sum(comb(BITS, k) for k in range(self.radius // 2 + 1))


def masks(most: int) -> np.ndarray:
    """All 64-bit values with at most this many bits set."""
    return np.array([sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(BITS), k)], np.uint64)


def codes(values: np.ndarray, bits: int) -> np.ndarray:
    """A linear code of each value: the code of x ^ y is the exclusive or of their codes."""
    rows = np.random.default_rng(20250613).integers(1, 2**63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros(len(values), np.int64)
    for k in range(bits):
        out |= (np.bitwise_count(values & rows[k]) & 1).astype(np.int64) << k
    return out


def shingle_digests(text: str | None, width: int) -> bytes:
    """XXH64 of each run of width words, repeats included, eight bytes each; of the whole sequence where there are fewer words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0D part words
    if not words:
        return b""
    line, digest = b" ".join(words), xxhash.xxh64_digest
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(line)]
    return b"".join([digest(line[a:b], SEED) for a, b in zip(starts, ends[min(width, len(words)) - 1 :])])


def fingerprint(digests: bytes) -> int:
    """A bit is set where over half of the digests have it set; zero without any."""
    rows, counts = np.frombuffer(digests, np.uint8).reshape(-1, 8), np.zeros(BITS, np.int64)
    for at in range(0, len(rows), 1 << 16):
        counts += np.unpackbits(rows[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(rows)).tobytes())


def _mark(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1000, 1_000_000):
            fp = np.array([fingerprint(shingle_digests(t, width)) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return run


def _emit(balls: Balls, turn: int, pass_bits: int, bucket_bits: int):
    """(bucket, fps): the fingerprints that have variants in each bucket of this pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codes(masks(balls.radius // 2), pass_bits + bucket_bits)
        # Fingerprints whose codes agree in the pass's bits take the same masks in a pass.
        steps = [np.unique(code[code % balls.passes == kind ^ turn] >> pass_bits) for kind in range(balls.passes)]
        for batch in batches:
            every = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(every), balls.chunk):
                fps = every[at : at + balls.chunk]
                own = codes(fps, pass_bits + bucket_bits)
                parts = [np.flatnonzero(own % balls.passes == kind) for kind in range(balls.passes)]
                bucket = np.concatenate([((own[mine] >> pass_bits)[:, None] ^ step[None, :]).ravel() for mine, step in zip(parts, steps)])
                fp = np.concatenate([np.repeat(fps[mine], len(step)) for mine, step in zip(parts, steps)])
                order = np.argsort(bucket, kind="stable")
                bucket, fp = bucket[order], fp[order]
                first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
                blobs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.append(8 * first, 8 * len(fp)).astype(np.int32)), pa.py_buffer(fp.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int64()), blobs], names=["bucket", "fps"])

    return run


def forest(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Numbers of the edges that, taken in order, join two parts that were apart."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    kept = []
    for i, (a, b) in enumerate(zip(u.tolist(), v.tolist())):
        if (a := root(a)) != (b := root(b)):
            up[max(a, b)] = min(a, b)
            kept.append(i)
    return np.array(kept, np.int64)


def home(u: np.ndarray, v: np.ndarray, half: int) -> np.ndarray:
    """Of all values within half bits of both u and v, at most 2 * half bits apart, one that is nearest to v."""
    apart, x = u ^ v, v.copy()
    far = np.bitwise_count(apart).astype(np.int64) - half
    for k in range(half):
        low = np.where(far > k, apart & (~apart + np.uint64(1)), np.uint64(0))
        apart, x = apart ^ low, x ^ low
    return x


def _meet(balls: Balls, turn: int, pass_bits: int, bucket_bits: int):
    """Links (u, v) of fingerprints with the least one at their home, a spanning forest of whole buckets; rows come by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = masks(balls.radius // 2)
        code = codes(flips, pass_bits + bucket_bits)
        by_code = np.argsort(code, kind="stable")
        flips, code = flips[by_code], code[by_code]

        def links(buckets: list[int], blobs: list[bytes]) -> pa.RecordBatch:
            fp = np.frombuffer(b"".join(blobs), np.uint64)
            bucket = np.repeat(np.array(buckets, np.int64), [len(x) // 8 for x in blobs])
            wanted = codes(fp, pass_bits + bucket_bits) ^ (bucket << pass_bits | turn)
            low, high = np.searchsorted(code, wanted), np.searchsorted(code, wanted, "right")
            ends = np.cumsum(high - low)
            mask = np.arange(ends[-1]) + np.repeat(low - (ends - (high - low)), high - low)
            fp = np.repeat(fp, high - low)
            variant = fp ^ flips[mask]
            order = np.argsort(variant)
            variant, fp = variant[order], fp[order]
            new = np.append(True, variant[1:] != variant[:-1])
            shared = ~(new & np.append(new[1:], True))
            variant, fp, first = variant[shared], fp[shared], np.flatnonzero(new[shared])
            low = np.repeat(np.minimum.reduceat(fp, first), np.diff(np.append(first, len(fp)))) if len(fp) else fp
            edges = np.column_stack((fp, low))[(fp != low) & (home(fp, low, balls.radius // 2) == variant)]
            edges = edges[np.bitwise_count(edges[:, 0] ^ edges[:, 1]) <= balls.radius]
            edges = edges[forest(edges[:, 0], edges[:, 1])]
            return pa.RecordBatch.from_arrays([pa.array(edges[:, k].copy().view(np.int64)) for k in (0, 1)], names=["u", "v"])

        buckets, blobs, size = [], [], 0
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("fps").to_pylist()):
                if 2 * size >= balls.bucket_rows and bucket != buckets[-1]:
                    yield links(buckets, blobs)
                    buckets, blobs, size = [], [], 0
                buckets.append(bucket)
                blobs.append(blob)
                size += len(blob) // 8
        if size:
            yield links(buckets, blobs)

    return run


def ball_links(prints: DataFrame, balls: Balls, scratch: Scratch) -> DataFrame:
    """(u, v): links between the distinct values of prints (fp); every pair within the radius is connected by them."""
    rows = prints.count() * balls.variants // balls.passes
    bits = balls.passes.bit_length() - 1, (max(balls.least_buckets, rows // balls.bucket_rows) - 1).bit_length()
    found = None
    for turn in range(balls.passes):
        dealt = map_arrow(prints, _emit(balls, turn, *bits), "bucket bigint, fps binary").repartition("bucket").sortWithinPartitions("bucket")
        links = scratch.write(map_arrow(dealt, _meet(balls, turn, *bits), "u bigint, v bigint"), f"links{turn}")
        found = links if found is None else found.unionByName(links)
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= balls.radius
    return found.where(near).distinct()


def simhash_dedup(docs: DataFrame, balls: Balls = Balls(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint, component_id), one row per input row.

    * fingerprint: 16 lowercase hex digits. Null, empty or word-less text: zero, which links like any other.
    * component_id: the smallest id reachable over links of radius bits or fewer. Copies share their fingerprint's component.
    * Null id: the row links like others and gets its component's smallest id, null where no row of it has one.
    * Repeated rows and ids: a row each. A bit set in just half of the hashes is 0. Empty table: empty result.
    * Very long texts are read whole; memory is bounded by the text and its hashes. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    kind = docs.schema[id_col].dataType.simpleString()
    items = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = scratch.write(map_arrow(items, _mark(balls.width), f"id {kind}, fp bigint"), "marked")
    classes = scratch.write(marked.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    found = components(ball_links(classes.select("fp"), balls, scratch), scratch)
    joined = classes.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left")
    joined = scratch.write(joined.select("fp", "rep", F.coalesce("component", "fp").alias("component")), "joined")
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    # A fingerprint that many rows share is one row here: the rows' side of the join can be split, this one repeated.
    of_print = joined.join(least, "component").select("fp", "component_id")
    out = marked.join(of_print, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
