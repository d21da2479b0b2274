"""Language identification by rank-order n-gram profiles (out-of-place distance).

A profile is a list of the most frequent letter n-grams (1 to 3 letters, words padded with a space) in
order of frequency. A document's own profile is compared with each language's: an n-gram costs the
difference of its two ranks, or the profile length where the language lacks it; the least sum wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import hashed_share, map_arrow, slices, text_bytes

UNDETERMINED = "und"
_SPACE = 32


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    out = np.full(0x110000, _SPACE, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (s := chr(c)).isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@dataclass(frozen=True)
class Profiles:
    """For each language the rank of each of its n-grams; keys are packed code points."""

    languages: tuple[str, ...]
    keys: tuple[np.ndarray, ...]
    ranks: tuple[np.ndarray, ...]
    depth: int


class GramCounter:
    """Counts n-grams of many texts at once; long texts are counted in pieces."""

    piece = 1 << 20

    def __init__(self):
        self.table = _letters()

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, packed n-gram, count), ordered by text and n-gram."""
        buffer, offsets = text_bytes(texts)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        group, owners, size = [], [], 0
        for i in range(len(offsets) - 1):
            chars = np.frombuffer(str(buffer[offsets[i] : offsets[i + 1]], "utf-8", "replace").encode("utf-32-le"), np.uint32)
            for at in range(0, len(chars), self.piece):
                # One character of overlap at the front and two behind let each n-gram start be counted once.
                group.append((chars, at, min(len(chars), at + self.piece)))
                owners.append(i)
                size += min(self.piece, len(chars) - at)
                if size >= self.piece or len(group) == 511:
                    parts.append(self._count(group, owners))
                    group, owners, size = [], [], 0
        if group:
            parts.append(self._count(group, owners))
        if not parts:
            return (np.zeros(0, np.int64),) * 3
        doc, key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((key, doc))
        doc, key, n = doc[order], key[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))) if len(doc) else np.zeros(0, np.int64)
        return doc[first], key[first], np.add.reduceat(n, first) if len(first) else n

    def _count(self, group: list, owners: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        padded, starts, who = [], [], []
        pad = np.full(1, _SPACE, np.uint32)
        for g, (chars, lo, hi) in enumerate(group):
            a, b = max(0, lo - 1), min(len(chars), hi + 2)
            front = lo == 0
            body = self.table[chars[a:b]]
            tail = pad if b == len(chars) else pad[:0]
            x = np.concatenate((pad, body, tail, pad) if front else (body, tail, pad))
            # Starts counted here: positions of chars lo .. hi-1, and the padding before the first.
            n = hi - lo + 1
            first = 0 if front else 1
            ok = np.zeros(len(x), bool)
            ok[first : min(len(x) - 1, first + n)] = True
            if not front:
                ok[first + n - 1 :] = False
            padded.append(x)
            starts.append(ok)
            who.append(np.full(len(x), g, np.int64))
        x, ok, who = np.concatenate(padded), np.concatenate(starts), np.concatenate(who)
        alphabet, code = np.unique(x, return_inverse=True)
        code = code.astype(np.int64) + 1
        is_letter = x != _SPACE
        far = np.int64(1) << np.int64(18)
        one = code
        two, three = np.zeros_like(code), np.zeros_like(code)
        two[:-1] = code[:-1] * far + code[1:]
        three[:-2] = (code[:-2] * far + code[1:-1]) * far + code[2:]
        sel1 = np.flatnonzero(ok & is_letter)
        sel2 = np.flatnonzero(ok[:-1] & (is_letter[:-1] | is_letter[1:]) & (who[:-1] == who[1:]))
        sel3 = np.flatnonzero(ok[:-2] & is_letter[1:-1] & (who[:-2] == who[2:]))
        keys = np.concatenate((who[sel1] << 54 | one[sel1], who[sel2] << 54 | two[sel2], who[sel3] << 54 | three[sel3]))
        keys.sort()
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(keys)))
        keys = keys[first]
        doc = np.array(owners, np.int64)[keys >> 54]
        rest = keys & ((np.int64(1) << 54) - 1)
        wide = np.append(0, alphabet.astype(np.int64))
        a, b, c = rest >> 36, (rest >> 18) & (far - 1), rest & (far - 1)
        packed = (wide[a] << 42) | (wide[b] << 21) | wide[c]
        return doc, packed, n


def _top(doc: np.ndarray, key: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's most frequent n-grams with ranks from 0; ties go to the smaller packed n-gram."""
    order = np.lexsort((key, -n, doc))
    doc, key = doc[order], key[order]
    starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
    rank = np.arange(len(doc)) - np.repeat(starts, np.diff(np.append(starts, len(doc))))
    near = rank < depth
    return doc[near], key[near], rank[near]


def classify(texts: pa.Array, profiles: Profiles, counter: GramCounter) -> tuple[np.ndarray, np.ndarray]:
    """Index of the best language of each text (-1: no letter) and a confidence in 0..1."""
    doc, key, rank = _top(*counter.counts(texts), profiles.depth)
    size = np.bincount(doc, minlength=len(texts))
    cost = np.empty((len(profiles.languages), len(texts)))
    for j, (known, place) in enumerate(zip(profiles.keys, profiles.ranks, strict=True)):
        if len(known):
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            off = np.where(known[at] == key, np.abs(place[at] - rank), profiles.depth)
        else:
            off = np.full(len(key), profiles.depth)
        cost[j] = np.bincount(doc, off, minlength=len(texts))
    best = np.where(size > 0, cost.argmin(0), -1)
    ordered = np.sort(cost, axis=0)
    rival = ordered[1] if len(cost) > 1 else size * float(profiles.depth)
    # 1/2 where two languages are as near, 1 where the best one fits without any cost.
    score = np.where(size > 0, rival / np.maximum(ordered[0] + rival, 1e-9), 0.0)
    return best, score


def learn_profiles(labelled: DataFrame, depth: int = 400, sample: int = 20_000, lang_col: str = "lang", text_col: str = "text") -> Profiles:
    """Profiles from labelled rows (lang_col, text_col); null languages and texts are left out.

    sample bounds the expected number of rows learnt from for each language: where a language has more,
    rows are taken by a hash of their text. Only languages x 16 x depth counts reach the driver.
    """
    labelled = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Profiles((), (), (), depth)
    known = [F.when(F.col("lang") == k, hashed_share(F.xxhash64("text"), sample, n)) for k, n in sizes.items()]
    chosen = labelled.where(F.coalesce(*known))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = GramCounter()
        for batch in slices(batches, "text", 2000, 8_000_000):
            lang = np.array(batch.column("lang").to_pylist(), object)
            doc, key, n = counter.counts(batch.column("text"))
            for name in sorted(set(lang)):
                mine = np.flatnonzero(lang[doc] == name) if len(doc) else doc
                keys, at = np.unique(key[mine], return_inverse=True)
                sums = np.bincount(at, n[mine], minlength=len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(sums)], names=["lang", "gram", "n"])

    counts = map_arrow(chosen, count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    slot = F.pmod(F.xxhash64("gram"), F.lit(16))
    # Each slot's most frequent n-grams hold the language's. A ranked window keeps depth rows of each slot in every
    # task before anything moves.
    ranked = Window.partitionBy("lang", "slot").orderBy(F.desc("n"), "gram")
    rows = counts.withColumn("slot", slot).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= depth).collect()
    languages = tuple(sorted(sizes))
    keys, ranks = [], []
    for name in languages:
        best = sorted((-r["n"], r["gram"]) for r in rows if r["lang"] == name)[:depth]
        grams = np.array([g for _, g in best], np.int64)
        order = np.argsort(grams)
        keys.append(grams[order])
        ranks.append(order.astype(np.int64))
    return Profiles(languages, tuple(keys), tuple(ranks), depth)


def identify_languages(docs: DataFrame, profiles: Profiles, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns in keep with lang_pred and score.

    Null text, or text without a letter: lang_pred 'und', score 0. Ties go to the language first in
    alphabetical order. No profile learnt at all: 'und'. Repeated rows give repeated rows, an empty
    table an empty one; texts are read whole, whatever their length; other columns are not read.
    Columns in keep that are named lang_pred or score are replaced.
    """
    keep = tuple(c for c in keep if c not in ("lang_pred", "score"))
    made = [F.col(text_col).alias("_text"), *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)]]
    kept = [(f"_keep{i}", docs.schema[c].dataType.simpleString()) for i, c in enumerate(keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = GramCounter()
        names = [*profiles.languages, UNDETERMINED]
        for batch in slices(batches, "_text", 2000, 8_000_000):
            if profiles.languages:
                best, score = classify(batch.column("_text"), profiles, counter)
            else:
                best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            cols = [batch.column(n) for n, _ in kept] + [pa.array([names[i] for i in best], pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*[n for n, _ in kept], "lang_pred", "score"])

    out = map_arrow(docs.select(*made), run, ", ".join(f"{n} {t}" for n, t in kept) + ", lang_pred string, score double")
    return out.select(*[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")
