"""What near-duplicate linking and passages write and shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strandline.llm.common import Scratch
from strandline.llm.minhash import Banding, _rare_words_pairs, _sets_of, near_duplicates, parity_sketch
from strandline.llm.passages import remove_passages

RNG = np.random.default_rng(31)
WORDS = ["".join(RNG.choice(list("abcdefghijklmnop"), 5)) for _ in range(2000)]


def prose(n, seed):
    return list(np.random.default_rng(seed).choice(WORDS, n))


class Recorder(Scratch):
    """Keeps the plan of each written table."""

    def write(self, df, name, codec="zstd"):
        self.plans = getattr(self, "plans", {})
        self.plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return super().write(df, name, codec)


def test_sets_of_many_ids_are_not_shuffled(spark):
    """All wanted ids have their sets, few others do, and no set or text meets the ids by a shuffle."""
    items = spark.createDataFrame([(i, " ".join(prose(12, i))) for i in range(2000)], "id long, text string")
    scratch = Recorder(spark, "t")
    got = {r["id"]: r["words"] for r in _sets_of(items.where("id % 10 = 0").select("id"), items, Banding(broadcast_bytes=2048), scratch).collect()}
    assert "Exchange" not in scratch.plans["sets"]
    assert set(range(0, 2000, 10)) <= set(got) and len(got) < 200 + 1800 // 12
    assert all(len(w) == 8 for w in got.values())
    # Where the bitmap is too small, the sets meet the ids, and none comes along.
    few = _sets_of(items.where("id % 10 = 0").select("id"), items, Banding(broadcast_bytes=128), scratch)
    assert {r["id"] for r in few.collect()} == set(range(0, 2000, 10))


def test_tested_shingles_are_dealt_without_texts(spark, monkeypatch):
    """The texts' shuffle has ended, and is off the disk, when the shingles are dealt."""
    plans, write = {}, Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name, codec="zstd": (plans.__setitem__(name, df._jdf.queryExecution().optimizedPlan().toString()), write(self, df, name, codec))[1])
    passage = " ".join(prose(70, 1))
    remove_passages(spark.createDataFrame([(1, passage), (2, " ".join(prose(60, 2)) + " " + passage)], "doc_id long, text string")).collect()
    assert "text" not in plans["cuts"] and "text" in plans["tested"]


def test_parity_sketches_of_short_sets_are_short():
    """A sketch's differing bits never outnumber the differing shingles, at either length."""
    rng = np.random.default_rng(3)
    for n, size in ((1, 4), (60, 4), (256, 4), (257, 16), (2000, 16)):
        one = rng.integers(-(1 << 62), 1 << 62, n)
        two = np.append(one[n // 10 :], rng.integers(-(1 << 62), 1 << 62, n // 10))
        a, b = parity_sketch(one), parity_sketch(two)
        assert len(a) == size == len(b) and int(np.bitwise_count((a ^ b).view(np.uint64)).sum()) <= 2 * (n // 10)


def test_rarest_shingles_find_links_between_short_and_long_sketches(spark):
    """Around the size where sketches get longer, every pair at the threshold is among those found."""
    words = prose(400, 40)
    rows = [(i, " ".join([*words[3 * i : 3 * i + 245 + i], *prose(6, 50 + i)])) for i in range(24)]
    items = spark.createDataFrame(rows, "id long, text string")
    sets = {i: set(zip(t.split(), t.split()[1:])) for i, t in rows}
    want = {(i, j) for i in sets for j in sets if i > j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    found = _rare_words_pairs(items.select("id", F.col("id").alias("component")), items, Banding(width=2), Scratch(spark, "t"))
    assert any(len(sets[i]) > 256 >= len(sets[j]) or len(sets[j]) > 256 >= len(sets[i]) for i, j in want)
    assert want <= {(r["u"], r["v"]) for r in found.collect()}


def test_rarest_shingles_make_few_pairs_of_a_group_below_the_threshold(spark):
    """Near copies that miss the threshold by little are told by where their shared shingles stand; no link is lost."""
    base = prose(130, 70)
    rows = [(i, " ".join(base + [f"x{i}y{k}" for k in range(18 if i < 110 else 10)])) for i in range(120)]
    items = spark.createDataFrame(rows, "id long, text string")
    sets = {i: set(zip(t.split(), t.split()[1:])) for i, t in rows}
    want = {(i, j) for i in sets for j in sets if i > j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    found = _rare_words_pairs(items.select("id", F.col("id").alias("component")), items, Banding(width=2), Scratch(spark, "t"))
    found = {(r["u"], r["v"]) for r in found.collect()}
    assert want and want <= found and len(found) < len(want) + 120


def test_items_without_copies_or_links_are_not_shuffled_whole(spark, monkeypatch):
    """Band keys meet the spare copies, and heads their component, without a shuffle of all of them."""
    plans, write = {}, Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name, codec="zstd": (plans.__setitem__(name, df._jdf.queryExecution().optimizedPlan().toString()), write(self, df, name, codec))[1])
    base = prose(130, 70)
    rows = [(i, " ".join(base + [f"x{i}y{k}" for k in range(18)])) for i in range(40)] + [(40, " ".join(prose(50, 5))), (41, " ".join(prose(50, 5)))]
    found = near_duplicates(spark.createDataFrame(rows, "id long, text string"), Banding(width=2), Scratch(spark, "t"))
    assert {r["id"]: r["component"] for r in found.collect()} == {i: min(i, 40) for i in range(42)}
    assert "reps" not in plans and plans["keyed"].count("LeftAnti") >= 1 and "Union" in plans["keyed"]
    assert plans["heads"].index("Generate posexplode") < plans["heads"].index("Join")
