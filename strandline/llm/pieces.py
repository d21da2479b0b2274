"""SentencePiece encoding that keeps, for every piece, its byte span in the original text.

Normalisation is ours: the longest prefix found in the model's compiled character map is replaced, and
each normalised byte records the source byte it came from. The library then segments text that needs no
more normalisation, and the pieces' lengths project every piece back to source bytes.

Where no vocabulary piece holds a word mark after another character, no merge can cross the start of a
word, so words are segmented one by one and remembered; other vocabularies are given whole texts.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from strandline.llm.common import map_arrow, slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class CharMap:
    """Longest-prefix lookup in a compiled character map: a double-array trie and a string pool."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{n // 4}I", blob, 4) if n else ()
        self.pool = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at a byte of data, and its replacement."""
        if not self.units:
            return None
        step = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        node, best = step(self.units[0]), None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= step(unit)
            if unit >> 8 & 1:
                best = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if best is None:
            return None
        length, value = best
        return length, self.pool[value : self.pool.index(b"\0", value)]


@dataclass(frozen=True)
class Encoded:
    """ids, and the source bytes at which each piece starts and ends."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


class Encoder:
    """One model's encoder; made once for each Python worker."""

    def __init__(self, model: bytes, remembered: int = 1 << 18):
        spec = model_pb2.ModelProto()
        spec.ParseFromString(model)
        self.norm = spec.normalizer_spec
        if spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models with the word mark as a suffix are not supported")
        self.dummy, self.squeeze = self.norm.add_dummy_prefix, self.norm.remove_extra_whitespaces
        self.mark = MARK if self.norm.escape_whitespaces else " "
        self.own = sorted((p.piece.encode() for p in spec.pieces if p.type == USER_DEFINED), key=len, reverse=True)
        self.chars = CharMap(self.norm.precompiled_charsmap)
        self.identity = not (self.chars.units or self.squeeze or self.own) and self.norm.escape_whitespaces
        said = [p.piece for p in spec.pieces if p.type in (NORMAL, USER_DEFINED, UNUSED)]
        # A lone word mark must be a piece, too: unknown characters next to each other become one.
        self.by_word = self.identity and self.dummy and MARK in said and not any(MARK in x.lstrip(MARK) for x in said)
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == UNKNOWN)
        self.is_byte = np.array([p.type == BYTE for p in spec.pieces])
        self.length = np.array([1 if p.type == BYTE else len(p.piece.encode()) for p in spec.pieces], np.int64)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.norm.precompiled_charsmap, self.norm.add_dummy_prefix, self.norm.remove_extra_whitespaces = b"", False, False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.remembered = remembered
        self.forget()

    def forget(self) -> None:
        """Words without their first mark, numbered; for each its source bytes, ids and their normalised lengths."""
        self.words: dict[str, int] = {}
        self.size, self.first, self.count = (np.zeros(0, np.int64) for _ in range(3))
        self.ids, self.length_of, self.reach = (np.zeros(0, np.int64) for _ in range(3))

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text and, for each of its bytes and its end, the source byte."""
        data = text.encode()
        if not data:
            return "", np.zeros(1, np.int64)
        if self.identity:
            raw = np.frombuffer(data, np.uint8)
            place = np.repeat(np.arange(len(raw)), np.where(raw == 32, 3, 1))
            lead = [0] * (3 * self.dummy)
            return MARK * self.dummy + text.replace(" ", MARK), np.concatenate((lead, place, [len(raw)])).astype(np.int64)
        out, place, at = bytearray(), [], 0
        mark = self.mark.encode()
        if self.squeeze:
            while at < len(data) and (part := self._prefix(data, at))[1] == b" ":
                at += part[0]
            if at == len(data):
                return "", np.array([at], np.int64)
        if self.dummy:
            out += mark
            place += [at] * len(mark)
        after_space = self.squeeze
        while at < len(data):
            length, part = self._prefix(data, at)
            if after_space:
                part = part.lstrip(b" ")
            if part:
                shown = part.replace(b" ", mark)
                out += shown
                place += [at] * len(shown)
                after_space = part.endswith(b" ")
            at += length
            after_space = after_space and self.squeeze
        place.append(at)
        while self.squeeze and out.endswith(mark):
            del out[-len(mark) :]
            del place[len(out) + 1 :]
        return out.decode(), np.array(place, np.int64)

    def _prefix(self, data: bytes, at: int) -> tuple[int, bytes]:
        for symbol in self.own:
            if data.startswith(symbol, at):
                return len(symbol), symbol
        if found := self.chars.longest(data, at):
            return found
        first = data[at]
        n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return n, data[at : at + n]

    def _segment(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and byte lengths of the pieces of all parts of normalised text, and each part's number of pieces."""
        found = self.bare.encode(parts, num_threads=1)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum()))
        lengths, ends = self.length[ids], np.cumsum(counts)
        # How long unknown text is only the library's own account of it tells.
        for i in np.unique(np.searchsorted(ends, np.flatnonzero(ids == self.unknown), side="right")):
            pieces = self.bare.encode(parts[i], return_type="proto").pieces
            lengths[ends[i] - counts[i] : ends[i]] = [1 if self.is_byte[p.id] else len(p.surface.encode()) for p in pieces]
        return ids, lengths, counts

    def _learn(self, new: list[str]) -> None:
        """Segments words that are not remembered yet."""
        ids, lengths, counts = self._segment([MARK + w for w in new])
        bounds, reach = np.cumsum(counts), np.cumsum(lengths)
        reach -= np.repeat(np.append(0, reach[bounds[:-1] - 1]), counts)
        add = lambda old, x: np.concatenate((old, x))
        self.words.update(zip(new, range(len(self.words), len(self.words) + len(new))))
        self.first = add(self.first, len(self.ids) + bounds - counts)
        self.size = add(self.size, np.fromiter((len(w.encode()) for w in new), np.int64, len(new)))
        self.count, self.ids, self.length_of = add(self.count, counts), add(self.ids, ids), add(self.length_of, lengths)
        # In the source a word's mark of three bytes is one space.
        self.reach = add(self.reach, np.maximum(reach - 2, 0))

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The number of each word."""
        at = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        lacking = np.flatnonzero(at < 0)
        if len(lacking):
            new = list(dict.fromkeys([words[i] for i in lacking]))
            if len(self.words) + len(new) > self.remembered and self.words:
                self.forget()
                return self._numbers(words)
            self._learn(new)
            at[lacking] = [self.words[words[i]] for i in lacking]
        return at

    def _pieces_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ids, length_of and reach of the pieces of words, and each word's number of pieces."""
        counts = self.count[at]
        return np.arange(counts.sum()) + np.repeat(self.first[at] - np.cumsum(counts) + counts, counts), counts

    def _plain(self, texts: list[str]) -> Iterator[Encoded]:
        """Texts whose words are set apart by one space each."""
        split = [t.split(" ") for t in texts]
        numbers = self._numbers(list(chain.from_iterable(split)))
        upto = 0
        for words in split:
            at = numbers[upto : upto + len(words)]
            upto += len(words)
            piece, counts = self._pieces_of(at)
            # A word's span starts at its space; the first word has none.
            start = np.cumsum(self.size[at] + 1) - self.size[at] - 2
            start[0] = -1
            ends = np.maximum(np.repeat(start, counts) + self.reach[piece], 0)
            yield Encoded(self.ids[piece], np.append(0, ends[:-1]), ends)

    def _any(self, text: str) -> Encoded:
        shown, place = self.normalise(text)
        if not shown:
            return Encoded(*[np.zeros(0, np.int64)] * 3)
        if self.by_word:
            at = self._numbers([w[1:] for w in re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", shown)])
            piece, _ = self._pieces_of(at)
            ids, lengths = self.ids[piece], self.length_of[piece]
        else:
            ids, lengths, _ = self._segment([shown])
        bounds = np.append(0, np.cumsum(lengths))
        return Encoded(ids, place[bounds[:-1]], place[bounds[1:]])

    def encode(self, texts: list[str]) -> list[Encoded]:
        plain = [self.by_word and t != "" and MARK not in t and "  " not in t and not t.startswith(" ") for t in texts]
        # All of them at once: what other texts add may make words forgotten whose numbers are still in use.
        fast = iter(list(self._plain([t for t, ok in zip(texts, plain, strict=True) if ok])))
        return [next(fast) if ok else self._any(t) for t, ok in zip(texts, plain, strict=True)]


def _sha(data) -> str:
    return hashlib.sha256(data).hexdigest()


#: Column -> (Spark type, function of one text's result, its ids as a list and its decoded text).
OUTPUTS = {
    "ids": ("array<int>", lambda x, ids, decoded: x.ids),
    "starts": ("array<bigint>", lambda x, ids, decoded: x.starts),
    "ends": ("array<bigint>", lambda x, ids, decoded: x.ends),
    "n_tokens": ("bigint", lambda x, ids, decoded: len(ids)),
    "decoded": ("string", lambda x, ids, decoded: decoded),
    "ids_sha256": ("string", lambda x, ids, decoded: _sha(",".join(map(str, ids)).encode())),
    "decoded_sha256": ("string", lambda x, ids, decoded: _sha(decoded.encode())),
    "spans_sha256": ("string", lambda x, ids, decoded: _sha(np.stack((x.starts, x.ends)).astype("<i8").tobytes())),
    "span_bytes": ("bigint", lambda x, ids, decoded: int((x.ends - x.starts).sum())),
}
_ARROW = {"array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "bigint": pa.int64(), "string": pa.string()}


def encode_pieces(docs: DataFrame, model_path: str, columns: tuple[str, ...] = ("ids", "starts", "ends"), text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encodes whole texts; returns the columns in keep and those asked for of OUTPUTS.

    starts and ends are byte offsets of each piece in the UTF-8 of the original text; together they tile it.
    Null text counts as empty: no ids, empty decoded text. Very long texts are segmented word by word.
    Repeated rows give repeated rows; an empty table gives an empty one. Columns not in keep are not read;
    a name both in keep and in columns is refused.
    The model travels to the executors as a broadcast of its bytes (a vocabulary file, fixed in size).
    """
    if both := set(keep) & set(columns):
        raise ValueError(f"kept and made columns share names: {sorted(both)}")
    with open(model_path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    made = [F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)]]
    kept = [(f"_keep{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    schema = ", ".join([f"{n} {t.simpleString()}" for n, t in kept] + [f"_out{i} {OUTPUTS[c][0]}" for i, c in enumerate(columns)])
    decodes = not {"decoded", "decoded_sha256"}.isdisjoint(columns)
    makers = [(OUTPUTS[c][1], _ARROW[OUTPUTS[c][0]]) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for batch in slices(batches, "_text", 512, 4_000_000):
            got = encoder.encode(batch.column("_text").to_pylist())
            ids = [x.ids.tolist() for x in got]
            decoded = encoder.whole.decode(ids, num_threads=1) if decodes else [""] * len(got)
            cols = [batch.column(n) for n, _ in kept] + [pa.array(map(make, got, ids, decoded), t) for make, t in makers]
            yield pa.RecordBatch.from_arrays(cols, names=[n for n, _ in kept] + [f"_out{i}" for i in range(len(columns))])

    out = map_arrow(docs.select(*made), run, schema)
    return out.select(*[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"_out{i}").alias(c) for i, c in enumerate(columns)])


def decode_pieces(tokens: DataFrame, model_path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Decodes arrays of ids into column decoded; a null array gives an empty text.

    Rows repeat as they do in tokens, an empty table stays empty; keep can't name decoded.
    """
    if "decoded" in keep:
        raise ValueError("a kept column is named decoded")
    with open(model_path, "rb") as file:
        model = tokens.sparkSession.sparkContext.broadcast(file.read())
    kept = ", ".join(f"{c} {tokens.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = sentencepiece.SentencePieceProcessor(model_proto=model.value)
        for batch in batches:
            texts = library.decode([ids or [] for ids in batch.column("_ids").to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string())], names=[*keep, "decoded"])

    return map_arrow(tokens.select(F.col(ids_col).alias("_ids"), *keep), run, f"{kept}, decoded string")
