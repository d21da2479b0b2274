"""Text quality by a generalised additive model with pairwise interactions.

Boosting visits the features in a cycle; each visit fits one shallow tree to the current gradient over
that feature's bins and adds it, damped, to the feature's lookup table. Then the strongest pairs get
tables of two dimensions the same way. A score is a sum of table entries, looked up by bin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import hashed_share, map_arrow, slices

FEATURES = (
    "log_chars", "log_words", "word_length", "upper_share", "digit_share", "symbol_share", "punctuation_share", "pipes_per_word",
    "bangs_per_word", "distinct_words", "repeated_lines", "space_share", "log_line_length", "wide_share", "same_as_previous", "longest_word",
)
_UPPER, _LOWER, _DIGIT = (bytes(range(*r)) for r in ((65, 91), (97, 123), (48, 58)))
_PUNCTUATION, _SYMBOL, _SPACE = b".,;:!?'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~", b" \t\n\r\x0b\x0c"
_WIDE = bytes(range(128, 256))


def features(text: str | None) -> list[float]:
    """One number for each of FEATURES; null counts as empty, an empty text has zeros."""
    data = (text or "").encode()
    n = max(1, len(data))
    share = lambda cls: (len(data) - len(data.translate(None, cls))) / n
    words = data.split()
    lines = [x for x in data.split(b"\n") if x]
    upper, lower = share(_UPPER), share(_LOWER)
    m = max(1, len(words))
    return [
        np.log1p(len(data)), np.log1p(len(words)), sum(map(len, words)) / m, upper / max(upper + lower, 1e-9), share(_DIGIT), share(_SYMBOL),
        share(_PUNCTUATION), data.count(b"|") / m, data.count(b"!!") / m, len(set(words)) / m, 1 - len(set(lines)) / max(1, len(lines)), share(_SPACE),
        np.log1p(len(data) / max(1, len(lines))), share(_WIDE), sum(a == b for a, b in zip(words, words[1:])) / m, max(map(len, words), default=0),
    ]


@dataclass(frozen=True)
class Model:
    base: float
    cuts: tuple[np.ndarray, ...]
    tables: tuple[np.ndarray, ...]
    coarse: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int], ...]
    pair_tables: tuple[np.ndarray, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        total = np.full(len(x), self.base)
        for j, (cuts, values) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += values[np.searchsorted(cuts, x[:, j], side="right")]
        for (a, b), values in zip(self.pairs, self.pair_tables, strict=True):
            total += values[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-total))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _split(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram; place 0 where none helps."""
    gl, hl = g.cumsum()[:-1], h.cumsum()[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    gain[(hl < least) | (hr < least)] = 0
    if not len(gain) or gain.max() <= 0:
        return 0.0, 0
    return float(gain.max()), int(gain.argmax()) + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float, least: float) -> np.ndarray:
    """Leaf values over bins of a tree of the given depth."""
    _, at = _split(g, h, ridge, least) if depth else (0, 0)
    if not at:
        return np.full(len(g), -g.sum() / (h.sum() + ridge))
    return np.concatenate((_tree(g[:at], h[:at], depth - 1, ridge, least), _tree(g[at:], h[at:], depth - 1, ridge, least)))


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, np.ndarray]:
    """Gain and leaf values of a tree that cuts one axis, then each part along the other."""
    best = (0.0, np.zeros_like(g))
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for at in range(1, len(gg)):
            gain, out = 0.0, np.empty_like(gg)
            for part in (slice(0, at), slice(at, None)):
                g1, h1 = gg[part].sum(0), hh[part].sum(0)
                more, _ = _split(g1, h1, ridge, least)
                gain += more + g1.sum() ** 2 / (h1.sum() + ridge)
                out[part] = _tree(g1, h1, 1, ridge, least)
            gain -= g.sum() ** 2 / (h.sum() + ridge)
            if gain > best[0]:
                best = gain, (out.T if flip else out).copy()
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 32, coarse_bins: int = 8, n_pairs: int = 4, pair_rounds: int = 30, ridge: float = 1.0, least: float = 2.0) -> Model:
    """Fits tables to labels 0/1. Without rows, or with one class only, the tables stay at zero."""
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    d = x.shape[1]
    cuts = [_cuts(x[:, j], bins) if len(x) else np.zeros(0) for j in range(d)]
    coarse = [_cuts(x[:, j], coarse_bins) if len(x) else np.zeros(0) for j in range(d)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    if not 0 < y.sum() < len(y):
        return Model(base, tuple(cuts), tuple(tables), tuple(coarse), (), ())
    at = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]
    total = np.full(len(y), base)
    for _ in range(rounds):
        for j in range(d):
            p = 1 / (1 + np.exp(-total))
            g, h = np.bincount(at[j], p - y, len(tables[j])), np.bincount(at[j], p * (1 - p), len(tables[j]))
            step = rate * _tree(g, h, 2, ridge, least)
            tables[j] += step
            total += step[at[j]]
    # Centred tables: each feature's mean effect is in the base.
    for j in range(d):
        mean = tables[j][at[j]].mean()
        tables[j] -= mean
        base += float(mean)
    place = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(coarse)]

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        shape = len(coarse[a]) + 1, len(coarse[b]) + 1
        cell = place[a] * shape[1] + place[b]
        return np.bincount(cell, p - y, shape[0] * shape[1]).reshape(shape), np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape), cell

    gains = sorted(((-_pair_tree(*grid(a, b)[:2], ridge, least)[0], (a, b)) for a, b in combinations(range(d), 2)))
    pairs = [ab for gain, ab in gains[:n_pairs] if gain < 0]
    pair_tables = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in pairs]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(pairs):
            g, h, cell = grid(a, b)
            step = rate * _pair_tree(g, h, ridge, least)[1]
            pair_tables[k] += step
            total += step.ravel()[cell]
    return Model(base, tuple(cuts), tuple(tables), tuple(coarse), tuple(pairs), tuple(pair_tables))


def learn_quality(docs: DataFrame, labels: DataFrame, sample: int = 20_000, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", **options) -> Model:
    """Fits the model to labelled documents; labels has (id_col, label_col).

    sample bounds the expected number of labels learnt from; beyond it they are taken by a hash of
    their id. Null ids, labels and labels of unknown documents are left out. The sample alone is
    broadcast, and its features alone reach the driver.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y is not null")
    n = known.count()
    known = known.where(hashed_share(F.xxhash64("_id", F.lit(7)), sample, n))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(known), "_id").select(F.col("_y"), "_text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 1000, 8_000_000):
            x = [features(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_y"), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    got = map_arrow(rows, measure, "y int, x array<double>").toArrow()
    # A fixed order makes the fit the same whatever the partitions were.
    x = got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(got), len(FEATURES))
    y = got["y"].to_numpy().astype(float)
    order = np.lexsort((*x.T[::-1], y))
    return fit(x[order], y[order], **options)


def score_quality(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """docs with the columns score (0..1) and predicted (1 where score >= threshold).

    Null and empty texts are scored too; very long ones are scored whole, one at a time; repeated rows score
    alike; an empty table stays empty. Columns of docs named score or predicted are replaced.
    """
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    rows = docs.select(F.col(text_col).alias("_text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(names) if c != text_col])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + ["_score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 1000, 4_000_000):
            x = np.array([features(t.as_py()) for t in batch.column("_text")], float).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], names=[*batch.schema.names, "_score"])

    out = map_arrow(rows, run, schema)
    cols = [F.col("_text" if c == text_col else f"_c{i}").alias(c) for i, c in enumerate(names)]
    return out.select(*cols, F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))
