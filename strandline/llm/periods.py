"""Periodic runs of words: partition refinement by equal factors, smaller halves first.

1. Two positions are of one class at length k when the k words that begin at them are equal. The classes at k + 1 follow
   from those at k: positions whose followers fell into different classes part. Of the parts of a class all but the
   largest are looked at again, so a position moves a logarithmic number of times; all texts of a batch step together.
2. Neighbouring members of a class at distance k, the length, are a square: k words, and the same again. Squares that
   begin at neighbouring words make a run of period k, its smallest one, as a shorter one would put members in between.
3. A run of four periods needs three members of a class no farther apart than a quarter of the text. What has fewer
   or farther ones goes, and with it what precedes it, at the next length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import map_arrow, slices

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


@dataclass(frozen=True)
class Periods:
    """A run counts with at least least_words words and `exponent` times its period; the pruning needs 4 or more."""

    least_words: int = 6
    exponent: int = 4
    batch_bytes: int = 8_000_000

    def __post_init__(self):
        if self.exponent < 4:
            raise ValueError("exponent must be 4 or more")


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each start, sizes of them."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Refinement:
    """Classes of the positions of several texts; kind -1 is a position that no run that counts can need any more.

    The members of a class stand together in `member` and are linked in the order of the text by `after` and `before`.
    """

    def __init__(self, kind: np.ndarray, limit: np.ndarray, text: np.ndarray):
        n = len(kind)
        self.kind, self.limit = kind, limit
        self.after, self.before, self.flag = np.full(n, -1), np.full(n, -1), np.zeros(n, bool)
        live = np.flatnonzero(kind >= 0)
        order = np.sort(kind[live] << 32 | live)
        self.member = order & 0xFFFFFFFF
        self.place = np.zeros(n, np.int64)
        self.place[self.member] = np.arange(len(live))
        of = order >> 32
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
        self.kinds = len(first)
        self.start, self.size = np.zeros(n + self.kinds, np.int64), np.zeros(n + self.kinds, np.int64)
        self.start[: self.kinds], self.size[: self.kinds] = first, np.diff(np.append(first, len(of)))
        kind[self.member] = np.repeat(np.arange(self.kinds), self.size[: self.kinds])
        self._link(self.member, np.append(of[1:] == of[:-1], False) if len(of) else np.zeros(0, bool))
        self.gone = np.flatnonzero(kind < 0)
        self.gone = np.concatenate((self.gone, self._prune(self.member, np.arange(self.kinds))))
        # At length 0 a text is one class: of its classes the largest isn't looked at.
        sizes, texts = self.size[: self.kinds], text[self.member[first]]
        by_size = np.lexsort((sizes, texts))
        rest = by_size[: max(0, len(by_size) - 1)][texts[by_size][1:] == texts[by_size][:-1]]
        self.small = self.member[_ranges(first[rest], sizes[rest])]

    def _link(self, members: np.ndarray, chained: np.ndarray) -> None:
        """Members in order; chained tells of each whether the next one follows it in its class."""
        if len(members):
            follows = np.append(members[1:], -1)
            self.after[members] = np.where(chained, follows, -1)
            self.before[members] = np.where(np.append(False, chained[:-1]), np.append(-1, members[:-1]), -1)

    def _take_out(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Takes positions, by class and place in the text, out of their classes: those classes, how many of each, the
        room they leave in `member`, and the members whose neighbours have changed."""
        kind = self.kind[x]
        chained = self.after[x[:-1]] == x[1:]
        before, after = self.before[x[np.append(True, ~chained)]], self.after[x[np.append(~chained, True)]]
        has, had = before >= 0, after >= 0
        self.after[before[has]] = after[has]
        self.before[after[had]] = before[had]
        first = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
        kinds, many = kind[first], np.diff(np.append(first, len(x)))
        end = self.start[kinds] + self.size[kinds]
        room = _ranges(end - many, many)
        at, last = self.place[x], self.member[room]
        self.flag[x] = True
        stay = last[~self.flag[last]]
        self.flag[x] = False
        holes = at[at < np.repeat(end - many, many)]
        self.member[holes] = stay
        self.place[stay] = holes
        self.size[kinds] -= many
        return kinds, many, room, np.concatenate((before[has], after[had]))

    def _prune(self, changed: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Drops changed positions without a neighbour in reach and classes of fewer than three members."""
        changed = changed[self.kind[changed] >= 0]
        limit, after, before = self.limit[changed], self.after[changed], self.before[changed]
        far = changed[((after < 0) | (after - changed > limit)) & ((before < 0) | (changed - before > limit))]
        if len(far):
            far = np.unique(far)
            far = far[np.argsort(self.kind[far], kind="stable")]
            more, *_ = self._take_out(far)
            self.kind[far] = -1
            kinds = np.concatenate((kinds, more))
        few = np.unique(kinds[(self.size[kinds] > 0) & (self.size[kinds] < 3)])
        rest = self.member[_ranges(self.start[few], self.size[few])]
        self.kind[rest] = -1
        self.size[few] = 0
        return np.concatenate((far, rest))

    def step(self) -> np.ndarray:
        """Goes to the next length. The positions whose next neighbour may have changed."""
        lost = self.gone - 1
        lost = np.sort(lost[lost >= 0])
        lost = lost[self.kind[lost] >= 0]
        changed, kinds = [], []
        # What ends at this length still parts those before it.
        small = np.sort(self.small[(self.small > 0) & (self.kind[self.small] >= 0)])
        by = self.kind[small]
        if len(lost):
            lost = lost[np.argsort(self.kind[lost], kind="stable")]
            some, _, _, touched = self._take_out(lost)
            self.kind[lost] = -1
            changed.append(touched)
            kinds.append(some)
        live = self.kind[small - 1] >= 0
        x, by = small[live] - 1, by[live]
        self.small = np.zeros(0, np.int64)
        if len(x):
            order = np.argsort(self.kind[x], kind="stable")
            x, by = x[order], by[order]
            parents, many, room, touched = self._take_out(x)
            order = np.argsort(np.repeat(np.arange(len(parents)), many) * (self.kinds + 1) + by, kind="stable")
            x, by = x[order], by[order]
            old = self.kind[x]
            first = np.flatnonzero(np.append(True, (old[1:] != old[:-1]) | (by[1:] != by[:-1])))
            size, parent = np.diff(np.append(first, len(x))), old[first]
            # The largest part keeps the class's number where no member stays, and is not looked at again.
            head = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
            parts = np.diff(np.append(head, len(parent)))
            most, rest = np.repeat(np.maximum.reduceat(size, head), parts), np.repeat(self.size[parents], parts)
            largest = np.zeros(len(size), bool)
            top = np.flatnonzero(size == most)
            largest[top[np.append(True, parent[top][1:] != parent[top][:-1])]] = True
            keeps = largest & (rest == 0)
            number = parent.copy()
            number[~keeps] = self.kinds + np.arange((~keeps).sum())
            self.kinds += int((~keeps).sum())
            self.start[number], self.size[number] = room[first], size
            self.member[room], self.place[x] = x, room
            self.kind[x] = np.repeat(number, size)
            edge = np.zeros(len(x), bool)
            edge[np.append(first[1:], len(x)) - 1] = True
            self._link(x, ~edge)
            big = largest & (size > rest)
            left = parent[big & (rest > 0)]
            self.small = np.concatenate((x[np.repeat(~big, size)], self.member[_ranges(self.start[left], self.size[left])]))
            changed += [x, touched]
            kinds += [parents, number]
        none = np.zeros(0, np.int64)
        changed = np.concatenate(changed) if changed else none
        self.gone = np.concatenate((lost, self._prune(changed, np.concatenate(kinds) if kinds else none)))
        return changed[self.kind[changed] >= 0]


def word_runs(ids: list[np.ndarray], p: Periods) -> tuple[np.ndarray, np.ndarray]:
    """Runs (start, length, period) of each text's words, given as numbers, by start and period; and each text's first run."""
    sizes = np.array([len(x) for x in ids], np.int64)
    base = np.cumsum(sizes + 1) - (sizes + 1)
    most = np.where(sizes >= p.least_words, sizes // p.exponent, 0)
    # One dead position parts the texts; numbers of different texts differ.
    kind, of_text, numbers = np.full(int((sizes + 1).sum()), -1), np.repeat(np.arange(len(ids)), sizes + 1), 0
    for x, at in zip(ids, base.tolist()):
        if len(x) >= p.least_words:
            kind[at : at + len(x)] = x + numbers
            numbers += int(x.max()) + 1
    limit = most[of_text]
    parts = Refinement(kind, limit, of_text)
    by_limit = np.argsort(most, kind="stable")
    ended, found, size, until = int(np.searchsorted(most[by_limit], 1)), [], 1, 0
    due: dict[int, list[np.ndarray]] = defaultdict(list)
    while size <= int(most.max(initial=0)):
        if size >= until:  # the next lengths' candidates at once; later changes are added to them
            due.clear()
            until = max(size + 64, size + size // 2)
            live = np.flatnonzero(kind >= 0)
            _schedule(due, live[parts.after[live] >= 0], parts.after, limit, size, until)
        if size in due:
            at = np.unique(np.concatenate(due.pop(size)))
            at = at[(kind[at] >= 0) & (parts.after[at] - at == size)]
            if len(at):
                breaks = np.flatnonzero(np.diff(at) > 1) + 1
                start, end = at[np.append(0, breaks)], at[np.append(breaks, len(at)) - 1]
                length = end - start + 2 * size
                long = length >= max(p.least_words, p.exponent * size)
                found.append(np.column_stack((start[long], length[long], np.full(long.sum(), size))))
        while ended < len(ids) and most[by_limit[ended]] <= size:
            i = by_limit[ended]
            kind[base[i] : base[i] + sizes[i]] = -1
            ended += 1
        if ended == len(ids) or not len(parts.gone) + len(parts.small):
            break
        changed = parts.step()
        size += 1
        _schedule(due, changed[parts.after[changed] >= 0], parts.after, limit, size, until)
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    owner = of_text[runs[:, 0]]
    runs[:, 0] -= base[owner]
    return runs, np.searchsorted(owner, np.arange(len(ids) + 1))


def _schedule(due: dict[int, list[np.ndarray]], at: np.ndarray, after: np.ndarray, limit: np.ndarray, low: int, high: int) -> None:
    """Puts down positions under the distance to their next neighbour, where it is within [low, high) and the text's limit."""
    gap = after[at] - at
    take = (gap >= low) & (gap < high) & (gap <= limit[at])
    at, gap = at[take], gap[take]
    if len(at):
        order = np.argsort(gap, kind="stable")
        at, gap = at[order], gap[order]
        first = np.flatnonzero(np.append(True, gap[1:] != gap[:-1]))
        for a, b in zip(first.tolist(), np.append(first[1:], len(at)).tolist()):
            due[int(gap[a])].append(at[a:b])


def covered(runs: np.ndarray, n: int) -> np.ndarray | None:
    """Which of n words stand in a run after its first period; None where none does."""
    if not len(runs):
        return None
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(steps[:n]) > 0


def _collapse(p: Periods, order: Callable[[object, int], np.ndarray | None] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 10_000, p.batch_bytes):
            texts, numbers = [], []
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                words = (text or "").encode().split()  # bytes: only \x20 and \x09-\x0D part words
                index: dict[bytes, int] = {}
                ids = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
                if order is not None and len(words) and (taken := order(key, len(words))) is not None:
                    words, ids = [words[i] for i in taken.tolist()], ids[taken]
                texts.append(words)
                numbers.append(ids)
            runs, first = word_runs(numbers, p)
            out = []
            for i, words in enumerate(texts):
                drop = covered(runs[first[i] : first[i + 1]], len(words))
                out.append(b" ".join(words if drop is None else compress(words, (~drop).tolist())))
            rows = pa.StructArray.from_arrays([pa.array(runs[:, k].copy()) for k in range(3)], fields=list(RUN))
            rows = pa.ListArray.from_arrays(pa.array(first, pa.int32()), rows)
            cols = [batch.column("id"), pa.array([len(w) for w in texts], pa.int64()), rows, pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n_words", "runs", "collapsed"])

    return run


def collapse_runs(docs: DataFrame, p: Periods = Periods(), order: Callable[[object, int], np.ndarray | None] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, runs, collapsed), one row per input row: every maximal run of words, and the text with one period of each.

    runs: array of (start, length, period) by start and period, word numbers from 0; period is the run's smallest.
    collapsed: the words, joined by one space, that no run contains after its first period words.
    order: given an id and a number of words, the numbers of the words to read in turn, or None for the text's own.

    * Null, empty or word-less text: no run, collapsed is empty. A null id is passed on, to `order`, too.
    * Repeated rows get a row each. Empty table: empty result. Other columns, whatever their names, are not read.
    * Very long texts are read whole. A text that repeats itself throughout takes as many steps as a quarter of its words;
      its memory is bounded by a fixed number of values a word.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    items = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return map_arrow(items, _collapse(p, order), schema).withColumnRenamed("id", id_col)
