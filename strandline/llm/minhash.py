"""Near-duplicate linking: one-permutation hashing with optimal densification, bands and star edges.

1. One hash per shingle; its high part names one of bins, the smallest low part in a bin is kept.
   An empty bin copies the first non-empty bin of its own fixed random sequence of bins
   (optimal densification), so two sets agree in a bin with a probability that is their similarity.
2. Items with equal sets are one class from here on; bins are cut into bands.
3. In each bucket of a band every class is paired with one centre only. Pairs are confirmed on full sets.
4. Buckets whose classes fall into several components are visited again with another centre; then classes
   of such buckets are joined on their rarest shingles, which any two sets that reach the threshold share:
   no link can hide behind a centre, and no group's pairs are listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Scratch, map_arrow, perhaps_in, slices
from strandline.llm.components import components
from strandline.llm.shingles import Powers, mix, shingle_sets

#: 64-bit words of a parity sketch: of a set of SHORT_SET shingles at most, and of a longer one.
SKETCH_WORDS, SHORT_WORDS, SHORT_SET = 16, 4, 256


@dataclass(frozen=True)
class Banding:
    """bands x rows bins. At similarity s a pair is missed with probability (1 - s**rows) ** bands."""

    width: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 6
    star_rounds: int = 1
    common_words: int = 1 << 16
    broadcast_bytes: int = 8 << 20

    @property
    def bins(self) -> int:
        return self.bands * self.rows


def signatures(flat: np.ndarray, sizes: np.ndarray, bins: int) -> np.ndarray:
    """One row of bins for each set; sizes, none of them 0, cut flat into sets."""
    h = mix(flat ^ np.uint64(0x5851F42D4C957F2D))
    cell = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64) + np.repeat(np.arange(len(sizes)) * bins, sizes)
    out = np.full(len(sizes) * bins, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(out, cell, h)
    full = np.zeros(len(out), bool)
    full[cell] = True
    out[~full] = 0
    out, full = out.reshape(-1, bins), full.reshape(-1, bins)
    alone = full.sum(1) == 1
    if alone.any():
        out[alone] = out[alone].max(1, keepdims=True)
    rows, cols = np.nonzero(~full & ~alone[:, None])
    attempt = 0
    while len(rows):
        attempt += 1
        donor = (mix(cols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        found = full[rows, donor]
        out[rows[found], cols[found]] = out[rows[found], donor[found]]
        rows, cols = rows[~found], cols[~found]
    return out


def band_keys(flat: np.ndarray, sizes: np.ndarray, b: Banding) -> np.ndarray:
    bins = signatures(flat, sizes, b.bins).reshape(len(sizes), b.bands, b.rows)
    key = np.broadcast_to(mix(np.arange(b.bands, dtype=np.uint64) + np.uint64(1)), bins.shape[:2])
    for r in range(b.rows):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + bins[:, :, r])
    return key.view(np.int64)


def _whole_hashes(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128 bits, as two columns, that stand for each whole set; none of them is empty."""
    if not len(starts):
        return np.zeros((0, 2), np.uint64)
    one, two = np.add.reduceat(mix(flat), starts), np.bitwise_xor.reduceat(mix(flat ^ np.uint64(0x243F6A8885A308D3)), starts)
    return np.column_stack((one, two + sizes.astype(np.uint64)))


def _sketch(b: Banding):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in slices(batches, "text", 256, 2_000_000):
            flat, ends = shingle_sets(batch.column("text"), b.width, powers)
            n = np.diff(ends)
            some = n > 0
            same = _whole_hashes(flat, ends[:-1][some], n[some])
            same = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.append(0, np.cumsum(16 * some)).astype(np.int32)), pa.py_buffer(same.tobytes())])
            keys = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(b.bands * some)), pa.int32()), pa.array(band_keys(flat, n[some], b).ravel()))
            carried = [c for c in batch.schema.names if c not in ("id", "text")]
            cols = [batch.column("id"), pa.array(n, pa.int64()), same, keys, *[batch.column(c) for c in carried]]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n", "same", "keys", *carried])

    return run


def _sets(width: int, wanted: np.ndarray | None = None):
    """(id, words); with wanted, only of rows whose bits `spot` and `other` are set in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in slices(batches, "text", 256, 2_000_000):
            if wanted is not None:
                spots = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("spot", "other")]
                batch = batch.filter(pa.array(np.logical_and(*((wanted[x >> 6] >> (x & 63) & 1).astype(bool) for x in spots))))
            flat, ends = shingle_sets(batch.column("text"), width, powers)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))], names=["id", "words"])

    return run


def _sets_of(ids: DataFrame, items: DataFrame, b: Banding, scratch: Scratch) -> DataFrame:
    """(id, words) of the items in ids.

    While ids are few they are broadcast. Beyond that a bitmap of at most broadcast_bytes, in which each id sets two bits,
    tells other items apart. While it has 6 bits an id, one in 12 of the others passes at most; they come along, as all
    callers join the sets with their ids, and no set is shuffled to find them. With fewer bits the sets meet the ids.
    """
    ids = scratch.write(ids.select("id").distinct(), "ids")
    kind = items.schema["id"].dataType.simpleString()
    schema, n = f"id {kind}, words array<bigint>", ids.count()
    if n * (32 if kind == "bigint" else 128) <= b.broadcast_bytes:
        return scratch.write(map_arrow(items.join(F.broadcast(ids), "id", "left_semi"), _sets(b.width), schema), "sets")
    bits = min(8 * b.broadcast_bytes, 1 << (16 * n).bit_length())
    spots = [F.pmod(F.xxhash64("id", *more), F.lit(bits)) for more in ((), (F.lit(1),))]
    marked = ids.select(F.explode(F.array(*spots)).alias("spot")).groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("bits")).toArrow()
    wanted = np.zeros((bits + 63) // 64, np.int64)
    wanted[marked["word"].to_numpy()] = marked["bits"].to_numpy()
    sets = map_arrow(items.select("id", "text", spots[0].alias("spot"), spots[1].alias("other")), _sets(b.width, wanted), schema)
    return scratch.write(sets if bits >= 6 * n else sets.join(ids, "id", "left_semi"), "sets")


def _confirm(pairs: DataFrame, items: DataFrame, b: Banding, scratch: Scratch) -> DataFrame:
    """The pairs (u, v) whose full sets reach the threshold. Sets are made for the texts in pairs only."""
    sets = _sets_of(pairs.select(F.explode(F.array("u", "v")).alias("id")), items, b, scratch)
    left, right = sets.select(F.col("id").alias("u"), F.col("words").alias("a")), sets.select(F.col("id").alias("v"), F.col("words").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    near = pairs.join(left, "u").join(right, "v").where(100 * both >= b.percent * (F.size("a") + F.size("b") - both))
    near = scratch.write(near.select("u", "v").distinct(), "near")
    scratch.drop(sets)
    return near


def parity_sketch(words: np.ndarray) -> np.ndarray:
    """Bits, as 64-bit words, that tell for each slot whether an odd number of shingles fell into it.

    A short set has few slots, so that its rows are short; only sketches of one length can be compared.
    """
    slots = 64 * (SHORT_WORDS if len(words) <= SHORT_SET else SKETCH_WORDS)
    slot = mix(words.view(np.uint64) ^ np.uint64(0x13198A2E03707344)) % np.uint64(slots)
    odd = np.bincount(slot.astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _rare_words_pairs(classes: DataFrame, items: DataFrame, b: Banding, scratch: Scratch) -> DataFrame:
    """Pairs (u, v) of classes (id, component) in different components that can reach the threshold: none is left out.

    Shingles are put in one order for all, frequent ones last. Two sets that reach the threshold share one
    of the first n - ceil(threshold * n) + 1, and at the first that they share what stands behind it must suffice. Any
    order gives whole results; the counts of the most frequent shingles (a bounded list) only make the shared ones rare.
    """
    kind = items.schema["id"].dataType.simpleString()
    sets = _sets_of(classes, items, b, scratch)
    counts = sets.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("c")).where("c >= 4")
    # Written, so that the shuffle of all shingles is off the disk before heads are dealt.
    common = scratch.write(counts.orderBy(F.desc("c"), "w").limit(b.common_words), "common").toArrow().sort_by("w")
    known, often = common["w"].to_numpy(), common["c"].to_numpy()

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, sketches = [], []
            for words in batch.column("words"):
                w = words.values.to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(known, w), max(0, len(known) - 1))
                c = np.where(known[at] == w, often[at], 0) if len(known) else np.zeros(len(w), np.int64)
                heads.append(w[np.lexsort((w, c))[: len(w) + (-b.percent * len(w) // 100) + 1]])
                sketches.append(parity_sketch(w))
            if heads:
                lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in of])), pa.int32()), pa.array(np.concatenate(of))) for of in (heads, sketches)]
                n = pa.array(batch.column("words").value_lengths().to_numpy(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id"), n, *lists], names=["id", "n", "head", "sketch"])

    # Heads meet their component as one row a set, and are dealt to rows after that.
    heads = map_arrow(sets, firsts, f"id {kind}, n bigint, head array<bigint>, sketch array<bigint>").join(classes, "id")
    heads = heads.select("id", "n", F.posexplode("head").alias("at", "w"), "sketch", "component")
    heads = scratch.write(heads, "heads")
    scratch.drop(sets)
    x = heads.select("w", F.col("id").alias("u"), F.col("n").alias("nu"), F.col("at").alias("iu"), F.col("component").alias("cu"), F.col("sketch").alias("su"))
    y = heads.select("w", F.col("id").alias("v"), F.col("n").alias("nv"), F.col("at").alias("iv"), F.col("component").alias("cv"), F.col("sketch").alias("sv"))
    # Of the shared shingles the first has all others behind it, in either set: the pair is made there, if not elsewhere, too.
    enough = (100 + b.percent) * F.least(F.col("nu") - F.col("iu"), F.col("nv") - F.col("iv")) >= b.percent * (F.col("nu") + F.col("nv"))
    size = 100 * F.least("nu", "nv") >= b.percent * F.greatest("nu", "nv")
    # Each differing shingle flips one parity bit, so the bits that differ can't outnumber the shingles that do.
    # Sketches of two lengths tell nothing of each other.
    odd = [F.bit_count(F.get("su", F.lit(i)).bitwiseXOR(F.get("sv", F.lit(i)))) for i in range(SKETCH_WORDS)]
    bits = sum(odd[1:SHORT_WORDS], odd[0]) + F.when(F.size("su") > SHORT_WORDS, sum(odd[SHORT_WORDS + 1 :], odd[SHORT_WORDS])).otherwise(0)
    alike = (F.size("su") != F.size("sv")) | ((100 + b.percent) * bits <= (100 - b.percent) * (F.col("nu") + F.col("nv")))
    # The set that is no longer than the other needs few of its head's rows.
    x = x.where((100 + b.percent) * (F.col("nu") - F.col("iu")) >= 2 * b.percent * F.col("nu"))
    once = (F.col("nu") < F.col("nv")) | ((F.col("nu") == F.col("nv")) & (F.col("u") < F.col("v")))
    near = once & (F.col("cu") != F.col("cv")) & size & enough & alike
    pairs = x.join(y, "w").where(near).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    pairs = scratch.write(pairs.distinct(), "rare")
    scratch.drop(heads)
    return pairs


def near_duplicates(items: DataFrame, b: Banding, scratch: Scratch) -> DataFrame:
    """(id, n, same, component) for each row of items (id, text), and its other columns; component: smallest id reachable.

    id is the item's key, of any type that orders; rows that share one are one item as far as their
    texts are equal. Rows with a null id or without words are linked with nothing: their component is their id.
    """
    kind = items.schema["id"].dataType.simpleString()
    carried = [f for f in items.schema.fields if f.name not in ("id", "text")]
    sketch = map_arrow(items, _sketch(b), ", ".join([f"id {kind}, n bigint, same binary, keys array<bigint>", *[f"{f.name} {f.dataType.simpleString()}" for f in carried]]))
    sketch = scratch.write(sketch, "sketch", "snappy")
    live = sketch.where((F.col("n") > 0) & F.col("id").isNotNull())
    # An item is left out only where a smaller one has its set: what has no copies needs no further test.
    many = live.groupBy("same").agg(F.count("*").alias("copies")).where("copies > 1").select("same").hint("shuffle_hash")
    copies = scratch.write(live.select("id", "same").join(many, "same"), "copies")
    copied = scratch.write(copies.groupBy("same").agg(F.min("id").alias("rep")), "classes")
    spare = copies.join(copied, "same").where("id <> rep").select("id", "same")
    # Only rows that a bitmap doesn't tell apart from the spare ones meet them, so keys of few rows are shuffled.
    spare = scratch.write(spare, "spare")
    split = perhaps_in(live.withColumn("row", F.xxhash64("id", "same")), "row", spare.select(F.xxhash64("id", "same").alias("id")), b.broadcast_bytes)
    reps = split.where("not perhaps").unionByName(split.where("perhaps").join(spare, ["id", "same"], "left_anti"))
    # Most keys are one item's alone. One shuffle serves their count and the join: both read the same columns.
    dealt = reps.select(F.col("id").alias("rep"), "n", F.explode("keys").alias("key")).repartition("key")
    many = dealt.groupBy("key").agg(F.expr("count(rep, n)").alias("held")).where("held > 1").select("key").hint("shuffle_hash")
    keyed = scratch.write(dealt.join(many, "key"), "keyed", "snappy")
    scratch.drop(copies, spare)
    centres = keyed.groupBy("key").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).where("centre < last").select("key", "centre")
    buckets = scratch.write(keyed.join(centres, "key"), "buckets")
    scratch.drop(keyed)
    tested = buckets.where("rep <> centre").select(F.col("rep").alias("u"), F.col("centre").alias("v"), "n")
    sizes = buckets.where("rep = centre").select(F.col("rep").alias("v"), F.col("n").alias("m")).distinct()
    fits = (100 * F.least("n", "m") >= b.percent * F.greatest("n", "m"))
    tested = scratch.write(tested.distinct().join(sizes, "v").where(fits).select("u", "v").distinct(), "pairs")
    links = _confirm(tested, items, b, scratch)
    found = components(links, scratch)
    rest = None
    for turn in range(b.star_rounds + 1):
        if rest is None:
            # Only buckets whose classes are in several components so far can hide a link.
            joined = buckets.select("key", "rep", "n").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
            # One shuffle serves the test and the join, as for the keys above.
            joined = joined.withColumn("component", F.coalesce("component", "rep")).repartition("key")
            split = joined.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.expr("count(rep, n)").alias("held")).where("lo < hi and held > 1").select("key").hint("shuffle_hash")
            rest = scratch.write(joined.join(split, "key"), "rest")
            scratch.drop(buckets)
            buckets = rest
        if rest.isEmpty():
            break
        a = rest.select("key", F.col("rep").alias("u"), "n", F.col("component").alias("cu"))
        c = rest.select("key", F.col("rep").alias("v"), F.col("n").alias("m"), F.col("component").alias("cv"))
        if turn < b.star_rounds:
            order = F.xxhash64("v", F.lit(turn))
            c = c.groupBy("key").agg(F.min_by(F.struct("v", "m", "cv"), order).alias("c")).select("key", "c.*")
            more = a.join(c, "key").where((F.col("u") != F.col("v")) & (F.col("cu") != F.col("cv")) & fits)
        else:
            more = _rare_words_pairs(rest.select(F.col("rep").alias("id"), "component").distinct(), items, b, scratch)
        more = more.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().join(tested, ["u", "v"], "left_anti")
        more = scratch.write(more, "more")
        if more.isEmpty():
            continue
        tested = tested.unionByName(more)
        new = _confirm(more, items, b, scratch)
        if not new.isEmpty():
            links, rest = links.unionByName(new), None
            found = components(links, scratch)
    scratch.drop(buckets)
    per_class = copied.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select(F.col("same").alias("of"), F.coalesce("component", "rep").alias("by_class"))
    own = found.select(F.col("node").alias("id"), F.col("component").alias("own"))
    # Most items have no copy and no link; bitmaps tell them, and only the others are shuffled.
    split = perhaps_in(sketch, "same", copied.select(F.col("same").alias("id")), b.broadcast_bytes).withColumnRenamed("perhaps", "copied")
    split = perhaps_in(split, "id", own.select("id"), b.broadcast_bytes).withColumn("perhaps", F.col("perhaps") | F.col("copied")).drop("copied")
    met = split.where("perhaps").join(per_class, F.col("id").isNotNull() & (F.col("same") == F.col("of")), "left").join(own, "id", "left")
    out = met.unionByName(split.where("not perhaps"), allowMissingColumns=True)
    return out.select("id", "n", "same", F.coalesce("by_class", "own", "id").alias("component"), *[f.name for f in carried])


def minhash_dedup(docs: DataFrame, banding: Banding = Banding(), id_col: str = "doc_id", text_col: str = "text", with_hash: bool = False) -> DataFrame:
    """Document near-duplicates: (id_col, n_shingles, component_id, kept), one row per input row.

    with_hash adds text_hash, the text's xxhash64, by which rows that share an id can be told apart.

    * Null or word-less text: n_shingles 0, component_id = own id, kept.
    * Fewer words than the shingle width: one shingle, the whole sequence.
    * Null id: linked with nothing, component_id null, kept (there is no one to yield to).
    * Repeated rows: each gets its own row; rows that share an id stay or go together when texts are equal.
    * Ties: the smallest id of a component is the one kept. Empty table: empty result.
    * Other columns, whatever their names, are not read.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    items = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.xxhash64(text_col).alias("text_hash")] if with_hash else []))
    out = near_duplicates(items, banding, scratch)
    kept = F.col("id").eqNullSafe(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"), *(["text_hash"] if with_hash else []))
