"""Word shingle sets of texts as sorted 64-bit hashes, computed on whole Arrow buffers with numpy.

Words are runs of bytes outside \\x20 and \\x09-\\x0D; A-Z are lower-cased, nothing else is changed.
A word's hash is a polynomial over random 64-bit byte values, modulo 2**64, then mixed with its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from strandline.llm.common import text_bytes

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
for _c in range(65, 91):
    _BYTE[_c] = _BYTE[_c + 32]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


def word_edges(data: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in a byte buffer; gap tells of each byte whether it parts words."""
    space = np.concatenate(([True], gap[data], [True]))
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, powers: Powers, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in a byte buffer, and its hash; gap tells of each byte whether it parts words."""
    starts, ends = word_edges(data, gap)
    up, down = powers.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    raw = (total[ends] - total[starts]) * down[starts]
    return starts, ends, mix(raw + (ends - starts).astype(np.uint64))


def batch_words(texts: pa.Array, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts, joined by single spaces: start of each text, start, end and hash of each word, first word of each text.

    Starts are bytes of the joined texts, and a text's own once its start is taken off; null is an empty text.
    """
    buffer, offsets = text_bytes(texts)
    data, offsets = np.frombuffer(buffer, np.uint8), np.array(offsets, np.int64)
    n = len(offsets) - 1
    # A text border is also a word border: one space stands between texts.
    at = offsets - offsets[0] + np.arange(n + 1)
    joined = np.full(at[-1] + 1, 32, np.uint8)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    joined[:-1][inside] = data[offsets[0] : offsets[-1]]
    starts, ends, words = word_hashes(joined, powers)
    return at, starts, ends, words, np.searchsorted(starts, at)


def shingle_sets(texts: pa.Array, width: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in one array, and the offsets of each text's own.

    A text with fewer than width words, but one at least, has one shingle, the whole word sequence;
    a text without words, or null, has none.
    """
    _, _, _, words, bounds = batch_words(texts, powers)
    n = len(bounds) - 1
    counts = np.diff(bounds)
    acc = _chain(words, width)
    owner = np.repeat(np.arange(n), counts)
    whole = np.arange(len(acc)) + width <= bounds[1:][owner[: len(acc)]]
    acc, owner = acc[whole], owner[: len(acc)][whole]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        one = mix(_chain(words[bounds[i] : bounds[i + 1]], counts[i]) + np.uint64(0xA5A5A5A5))
        place = np.searchsorted(owner, i)
        acc, owner = np.insert(acc, place, one), np.insert(owner, place, i)
    ends = np.searchsorted(owner, np.arange(n + 1))
    for i in range(n):
        acc[ends[i] : ends[i + 1]].sort()
    new = np.ones(len(acc), bool)
    new[1:] = (acc[1:] != acc[:-1]) | (owner[1:] != owner[:-1])
    return acc[new], np.searchsorted(owner[new], np.arange(n + 1))


def _chain(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of width words; none where there are fewer."""
    n = max(0, len(words) - width + 1)
    acc = words[:n].copy()
    for k in range(1, width):
        acc = mix(acc * np.uint64(0xD6E8FEB86659FD93) + words[k : n + k])
    return acc
