"""Removal of repeated passages: paragraph MinHash banding, exact confirmation, components.

1. Stretches of words that also stand in other documents are found by overlapping word shingles, wherever they
   begin or end. The least shingle of every window of shingles is an anchor, so two documents that share
   stretch_words words share an anchor; then all shingles near the ends of shared anchors are compared, which gives
   the borders to the word. Where stretches make a run of run_words words, with at most bridge_words changed
   words between them, the run's borders are paragraph borders; all other borders are line ends.
2. Paragraphs of least_words words are banded by MinHash; colliding ones are joined and confirmed by the
   exact Jaccard similarity of their five-word shingles. Tried as paragraphs, too: the lines that a run's border
   divides, and within a run the stretches that the same documents hold, so neighbouring passages of different
   holders are found both alone and together.
3. Confirmed pairs are clustered; of each component the first paragraph stays, the others are cut out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import Scratch, broadcast_small, map_arrow, perhaps_in, slices
from strandline.llm.minhash import Banding, near_duplicates
from strandline.llm.shingles import Powers, _chain, batch_words, word_edges


@dataclass(frozen=True)
class Passages:
    """rows=3, bands=12: a pair at similarity 0.8 is missed with probability (1 - 0.8**3) ** 12 = 0.0002."""

    least_words: int = 30
    run_words: int = 40
    shingle_words: int = 8
    stretch_words: int = 20
    bridge_words: int = 5
    banding: Banding = Banding(width=5, percent=80, bands=12, rows=3)
    broadcast_bytes: int = 16 << 20


def _slide(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best of each window of width values."""
    size = 1
    while 2 * size <= width:
        x, size = best(x[:-size], x[size:]), 2 * size
    return best(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def anchors(h: np.ndarray, width: int, whole: np.ndarray) -> np.ndarray:
    """Places of the values that are the least of some window of width values; whole tells of each window whether it counts."""
    if not len(whole):
        return np.zeros(0, np.int64)
    pad = np.zeros(width - 1, np.uint64)
    least = np.concatenate((pad, np.where(whole, _slide(h, width, np.minimum), np.uint64(0)), pad))
    return np.flatnonzero(_slide(least, width, np.maximum) == h)


def text_anchors(words: np.ndarray, bounds: np.ndarray, p: Passages) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of joined texts, whose first words are at bounds, and the anchors of each text's own windows."""
    h, n = _chain(words, p.shingle_words), max(0, len(words) - p.stretch_words + 1)
    # A window counts if its first and its last word are of one text.
    whole = np.arange(n) + p.stretch_words <= np.repeat(bounds[1:], np.diff(bounds))[:n]
    return h, anchors(h, p.stretch_words - p.shingle_words + 1, whole)


def near_ends(at: np.ndarray, kind: np.ndarray, first: np.ndarray, last: np.ndarray, n: int, width: int) -> np.ndarray:
    """The sorted places at, and all places of n in reach of one where the next is far or of another kind.

    first and last bound the text of each place. Where two kinds meet, the border lies between their places, so no
    place beyond the next one is looked at.
    """
    if not len(at):
        return at
    same = first[1:] == first[:-1]
    chained = (np.diff(at) <= width) & (kind[1:] == kind[:-1]) & same
    left, right = np.append(True, ~chained), np.append(~chained, True)
    before, behind = first - 1, last.copy()
    before[1:][same], behind[:-1][same] = at[:-1][same], at[1:][same]
    lo = np.concatenate((np.maximum(at - width, before + 1)[left], at[right] + 1))
    hi = np.concatenate((at[left], np.minimum(at + width + 1, behind)[right]))
    steps = np.bincount(lo, minlength=n + 1) - np.bincount(hi, minlength=n + 1)
    wanted = np.cumsum(steps[:n]) > 0
    wanted[at] = True
    return np.flatnonzero(wanted)


def stretches(pos: np.ndarray, width: int, bridge: int) -> list[tuple[int, int]]:
    """(first, last) index of each stretch of sorted shingle places whose words are apart by bridge words at most."""
    breaks = np.flatnonzero(np.diff(pos) > width + bridge) + 1
    return list(zip(np.append(0, breaks), np.append(breaks, len(pos)) - 1))


def pieces(data: bytes, runs: list[int], least_words: int) -> list[tuple[int, int]]:
    """Bounds of a text's paragraphs in bytes; together they are the text.

    Paragraphs end at line ends and at the borders of runs (start, end, start, end ...). Inside a run, short
    lines are joined to the next until they have least_words words, so a passage of short lines is one paragraph.
    """
    borders = {0, len(data), *[c for c in runs if 0 < c < len(data)]}
    at = data.find(b"\n")
    while at >= 0:
        borders.add(at + 1)
        at = data.find(b"\n", at + 1)
    order = sorted(borders)
    if not runs:
        return list(zip(order, order[1:]))
    spans = sorted(zip(runs[::2], runs[1::2]))
    out, i, open_ = [], 0, None
    for a, b in zip(order, order[1:]):
        while i < len(spans) and spans[i][1] <= a:
            i += 1
        inside = i < len(spans) and spans[i][0] <= a and b <= spans[i][1] + 1
        if open_ is not None and inside and open_[1] == i:
            a = open_[0]
            out.pop()
        out.append((a, b))
        open_ = (a, i) if inside and b - a < 30 * least_words and len(data[a:b].split(None, least_words)) < least_words else None
    return out


def paragraphs(data: bytes, runs: list[int], parts: list[int], least_words: int) -> list[tuple[int, int]]:
    """Bounds of all paragraphs that are tried; the first ones are the text together.

    The others overlap these: lines that a run's border divides, and parts (start, end, start, end ...) of runs,
    which are cut at line ends as a run is.
    """
    whole = pieces(data, runs, least_words)
    seen, more = {(a, a + len(data[a:b].rstrip())) for a, b in whole}, []

    def add(a: int, b: int) -> None:
        if (key := (a, a + len(data[a:b].rstrip()))) not in seen:
            seen.add(key)
            more.append((a, b))

    for c in runs:
        a, b = data.rfind(b"\n", 0, c) + 1, data.find(b"\n", c)
        add(a, len(data) if b < 0 else b + 1)
    for a, b in zip(parts[::2], parts[1::2]):
        for x, y in pieces(data[a:b], [0, b - a], least_words):
            add(a + x, a + y)
    return whole + more


def byte_bounds(data: bytes, bounds: list[int] | None) -> list[int]:
    """Bytes of bounds (first word, word behind the last, ...) of a text; words that it lacks are at its end."""
    if not bounds:
        return []
    starts, ends = word_edges(np.frombuffer(data, np.uint8))
    at, behind = np.array(bounds[::2]), np.array(bounds[1::2])
    a, b = np.append(starts, len(data))[np.minimum(at, len(starts))], np.append(ends, len(data))[np.minimum(behind - 1, len(ends))]
    return np.column_stack((a, b)).ravel().tolist()


def cut_bounds(parts: list[tuple[int, int]], gone: list[int], held: list[int]) -> list[tuple[int, int]]:
    """What is cut of a text. gone: paragraph << 32 | (1 + the paragraph that stays in its place, or 0); held: those
    that stay. What stays for a component is never cut, and no paragraph yields to one that overlaps it."""
    taken, out = sorted(parts[i] for i in held), []
    for code in sorted(gone):
        a, b = parts[code >> 32]
        if own := code & 0xFFFFFFFF:
            x, y = parts[own - 1]
            if x < b and a < y:
                continue
        for x, y in taken:
            if a < b and x < b and a < y:
                if a < x:
                    out.append((a, x))
                a = max(a, y)
        if a < b:
            out.append((a, b))
        taken = sorted([*taken, parts[code >> 32]])
    return sorted(out)


def _runs(docs: DataFrame, p: Passages, scratch: Scratch) -> DataFrame:
    """(id, cuts, parts): borders of runs of words that other documents hold too, and of the stretches within runs
    that are held by the same documents throughout; each is a first word and the word behind the last."""
    width, window = p.shingle_words, p.stretch_words - p.shingle_words + 1
    kind = docs.schema["id"].dataType.simpleString()

    def table_of(batch: pa.RecordBatch, owner: np.ndarray, cols: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(owner)), *map(pa.array, cols.values())], names=["id", *cols])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in slices(batches, "text", 1000, 1_000_000):
            _, _, _, words, bounds = batch_words(batch.column("text"), powers)
            h, at = text_anchors(words, bounds, p)
            owner = np.searchsorted(bounds, at, "right") - 1
            yield table_of(batch, owner, {"pos": at - bounds[owner], "h": h[at].view(np.int64)})

    def shared(marks: DataFrame) -> DataFrame:
        """(h, kind): the shingles of two or more documents; kind stands for the documents that hold them."""
        held = marks.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("pos").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"))
        # Each h is there once and they are dealt evenly, so a hash of this side spares sorting the far larger other.
        return held.where("lo < hi").select("h", F.xxhash64("lo", "hi", "n", "x").alias("kind")).hint("shuffle_hash")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in slices(batches, "text", 1000, 1_000_000):
            _, _, _, words, bounds = batch_words(batch.column("text"), powers)
            h = _chain(words, width)
            count = np.maximum(np.diff(bounds) - width + 1, 0)
            marked = batch.column("at").flatten()
            pos, was, kinds = (marked.field(k).to_numpy() for k in ("pos", "h", "kind"))
            owner = np.repeat(np.arange(len(count)), batch.column("at").value_lengths().to_numpy())
            # Rows may share an id: only anchors of this text count.
            own = np.flatnonzero(pos < count[owner])
            place = bounds[owner[own]] + pos[own]
            same = h[place].view(np.int64) == was[own]
            place, first = np.unique(place[same], return_index=True)
            own = own[same][first]
            low = bounds[owner[own]]
            place = near_ends(place, kinds[own], low, low + count[owner[own]], len(h), window)
            owner = np.searchsorted(bounds, place, "right") - 1
            yield table_of(batch, owner, {"pos": place - bounds[owner], "h": h[place].view(np.int64)})

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts, parts = [], []
            for at in batch.column("at"):
                pos, kinds = (at.values.field(k).to_numpy() for k in ("pos", "kind"))
                order = np.argsort(pos, kind="stable")
                pos, kinds = pos[order], kinds[order]
                long = [(i, j) for i, j in stretches(pos, width, p.bridge_words) if pos[j] + width - pos[i] >= p.run_words]
                runs = [(int(pos[i]), int(pos[j]) + width) for i, j in long]
                cuts.append([x for ab in runs for x in ab])
                inside = np.concatenate([np.arange(i, j + 1) for i, j in long]) if long else np.zeros(0, np.int64)
                # All holders' stretches at once: holders first, then places, and a border where the holders change.
                inside = inside[np.lexsort((pos[inside], kinds[inside]))]
                q = pos[inside]
                breaks = np.flatnonzero((np.diff(q) > width + p.bridge_words) | (np.diff(kinds[inside]) != 0)) + 1
                ends = zip(np.append(0, breaks), np.append(breaks, len(q)) - 1) if len(q) else ()
                own = {(int(q[i]), int(q[j]) + width) for i, j in ends if q[j] + width - q[i] >= p.least_words}
                parts.append([x for ab in sorted(own.difference(runs)) for x in ab])
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (cuts, parts)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *lists], names=["id", "cuts", "parts"])

    # One shuffle serves the count and the join: both read the same columns.
    dealt = map_arrow(docs, mark, f"id {kind}, pos bigint, h bigint").repartition("h")
    again = dealt.join(shared(dealt), "h").groupBy("id").agg(F.collect_list(F.struct("pos", "h", "kind")).alias("at"))
    again = scratch.write(again, "again")
    near = perhaps_in(docs, "id", again, p.broadcast_bytes).where("perhaps").drop("perhaps").join(again, "id")
    # Places are words, and become bytes where texts are cut: rows of the largest table are short.
    # They are written, so that the shuffled texts are off the disk before places are dealt.
    tested = scratch.write(map_arrow(near, test, f"id {kind}, pos bigint, h bigint"), "tested")
    scratch.drop(again)
    dealt = tested.repartition("h")
    found = dealt.join(shared(dealt), "h").groupBy("id").agg(F.collect_list(F.struct("pos", "kind")).alias("at"))
    cuts = scratch.write(map_arrow(found, join_up, f"id {kind}, cuts array<bigint>, parts array<bigint>").where(F.size("cuts") > 0), "cuts")
    scratch.drop(tested)
    return cuts


def remove_passages(docs: DataFrame, p: Passages = Passages(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated passages cut out of text_col, and columns cut_paragraphs, cut_bytes, cut_spans and has_repeat.

    cut_spans are byte bounds in the original text. The document with the smallest id keeps a passage; has_repeat
    tells of all documents, keepers too, that hold a passage which another document holds.
    Null and empty texts, and null ids, stay as they are. Rows that share an id are cut alike where their
    paragraphs are equal in number and place. Very long texts are cut into paragraphs like others; an
    empty table stays empty. Columns of docs named like the new ones are replaced.
    """
    scratch = Scratch(docs.sparkSession, "passages")
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    cuts = _runs(texts, p, scratch)
    def with_plan(df: DataFrame, key: str, side: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of df that surely have no row of side (id, ...), and the others with side's columns, null where there is none."""
        # A small side is broadcast at every size of the texts; beyond the bound texts meet it by a shuffle.
        other = broadcast_small(side, p.broadcast_bytes, 64).withColumnRenamed("id", "_of")
        split = perhaps_in(df, key, side, p.broadcast_bytes)
        return split.where("not perhaps").drop("perhaps"), split.where("perhaps").drop("perhaps").join(other, F.col(key) == F.col("_of"), "left").drop("_of")

    without, marked = with_plan(texts, "id", cuts)
    marked = marked.unionByName(without, allowMissingColumns=True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1000, 8_000_000):
            rows = []
            for id_, text, at, own in zip(batch.column("id"), *(batch.column(c).to_pylist() for c in ("text", "cuts", "parts")), strict=True):
                data = text.encode()
                for no, (a, b) in enumerate(paragraphs(data, byte_bounds(data, at), byte_bounds(data, own), p.least_words)):
                    if len(part := data[a:b]) >= 2 * p.least_words - 1 and len(part.split(None, p.least_words)) >= p.least_words:
                        rows.append(({"doc": id_.as_py(), "no": no}, part.decode()))
            ids, parts = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.struct([("doc", batch.column("id").type), ("no", pa.int32())])), pa.array(parts, pa.string())], names=["id", "text"])

    items = scratch.write(map_arrow(marked, cut, f"id struct<doc:{kind},no:int>, text string"), "paragraphs")
    found = near_duplicates(items, p.banding, scratch)
    yields = scratch.write(found.where(F.col("id") != F.col("component")).select("id", "component"), "yields")
    apart = F.col("id.doc") != F.col("component.doc")
    own = F.when(~apart, F.col("component.no") + 1).otherwise(0)
    lost = yields.select(F.col("id.doc").alias("id"), F.expr("shiftleft(cast(id.no as bigint), 32)").bitwiseOR(own.cast("bigint")).alias("code"), F.lit(None).cast("int").alias("no"), apart.alias("apart"))
    stays = yields.select("component", apart.alias("apart")).groupBy("component").agg(F.max("apart").alias("apart"))
    stays = stays.select(F.col("component.doc").alias("id"), F.lit(None).cast("bigint").alias("code"), F.col("component.no").alias("no"), "apart")
    gone = lost.unionByName(stays).groupBy("id").agg(F.collect_set("code").alias("gone"), F.collect_set("no").alias("held"), F.max("apart").alias("apart"))
    gone = scratch.write(gone.where(F.col("apart") | (F.size("gone") > 0)), "gone")
    scratch.drop(items)
    made = ("cut_paragraphs", "cut_bytes", "cut_spans", "has_repeat")
    names = [c for c in docs.columns if c not in made]
    plan = scratch.write(broadcast_small(gone, p.broadcast_bytes, 128).join(cuts, "id", "left"), "plan")
    out = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("_key"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(names) if c != text_col])
    without, out = with_plan(out, "_key", plan)
    out = out.drop("_key")
    carried = [c for c in out.columns if c.startswith("_c")]

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches, "_text", 1000, 4_000_000):
            texts, counts, sizes, bounds = [], [], [], []
            for t, at, more, drop, stay in zip(*(batch.column(c).to_pylist() for c in ("_text", "cuts", "parts", "gone", "held")), strict=True):
                spans = []
                if t is not None and drop:
                    data = t.encode()
                    tried = paragraphs(data, byte_bounds(data, at), byte_bounds(data, more), p.least_words)
                    # Rows may share an id: numbers beyond this text's own are another's.
                    drop, stay = [c for c in drop if c >> 32 < len(tried) and (c & 0xFFFFFFFF) <= len(tried)], [i for i in stay if i < len(tried)]
                    spans = cut_bounds(tried, drop, stay)
                    edges = [0, *[x for ab in spans for x in ab], len(data)]
                    t = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])).decode()
                texts.append(t)
                counts.append(len(spans))
                sizes.append(sum(b - a for a, b in spans))
                bounds.append([{"start": a, "end": b} for a, b in spans])
            cols = [*[batch.column(c) for c in carried], pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(sizes, pa.int64()), pa.array(bounds, span), batch.column("apart")]
            yield pa.RecordBatch.from_arrays(cols, names=[*carried, "_new", *made])

    schema = ", ".join([f"{c} {out.schema[c].dataType.simpleString()}" for c in carried] + ["_new string, cut_paragraphs int, cut_bytes bigint, cut_spans array<struct<start:bigint,end:bigint>>, has_repeat boolean"])
    out = map_arrow(out, rebuild, schema)
    # What has no plan needs no rebuilding.
    none = [F.col("_text").cast("string").alias("_new"), F.lit(0).alias("cut_paragraphs"), F.lit(0).cast("bigint").alias("cut_bytes"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("cut_spans"), F.lit(None).cast("boolean").alias("has_repeat")]
    out = out.unionByName(without.select(*carried, *none))
    cols = [F.col("_new" if c == text_col else f"_c{i}").alias(c) for i, c in enumerate(names)]
    return out.select(*cols, *made[:3], F.coalesce("has_repeat", F.lit(False)).alias("has_repeat"))
