"""Conversation repair, periodic runs and SimHash on small tables: brute force and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction
from itertools import product

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandline.llm import queries
from strandline.llm.conversations import Repair, Solver, repair_conversations
from strandline.llm.periods import Periods, collapse_runs, word_runs
from strandline.llm.simhash import Balls, codes, masks, simhash_dedup

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


# ---- conversation repair -------------------------------------------------------------------------------------------


def all_repairs(rows, inserts):
    """Every (cost, audit, repaired rows) of rows (role, text, fault) that gives (s?(ua)+)?, with up to `inserts` inserts a gap."""

    def go(i, roles, out, cost, audit):
        if i == len(rows):
            for n in range(inserts + 1):
                for new in product(("user", "assistant"), repeat=n):
                    whole = roles + "".join(x[0] for x in new)
                    if re.fullmatch("(s?(ua)+)?", whole):
                        yield cost + 2 * n, audit + "I" * n, out + [(x, "") for x in new]
            return
        role, text, fault = rows[i]
        for n in range(inserts + 1):
            for new in product(("user", "assistant"), repeat=n):
                head, put, paid = roles + "".join(x[0] for x in new), out + [(x, "") for x in new], cost + 2 * n
                yield from go(i + 1, head, put, paid + 3, audit + "I" * n + "D")
                if fault not in ("blank", "duplicate"):
                    extra = fault == "truncated"
                    yield from go(i + 1, head + (role[:1] or "?"), [*put, (role, text)], paid + extra, audit + "I" * n + "K")
                    for other in ("user", "assistant"):
                        yield from go(i + 1, head + other[0], [*put, (other, text)], paid + 2 + extra, audit + "I" * n + "R")

    return go(0, "", [], 0, "")


def repaired_plainly(rows, repairs=lambda rows: min(all_repairs(rows, 2), key=lambda x: x[:2])):
    """The contract's values for one conversation's rows (turn, role, text), in order."""
    seen, marked = set(), []
    for _, role, text in rows:
        words = SPACE.findall(text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1][-1] not in ".!?" else ""
        seen.add((role, text))
        marked.append((role, text, fault))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    cost, audit, left = repairs(marked)
    tally = [sum(f == k for _, _, f in marked) for k in ("blank", "duplicate", "truncated")]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *tally, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest())


def in_order(rows):
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.sha256(x[2].encode()).digest()))


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def by_conversation(df):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_repair_equals_brute_force(spark):
    rng, rows = random.Random(5), []
    for conv in range(150):
        for turn in range(rng.randint(0, 4)):
            rows.append((conv, turn * rng.randint(1, 2), rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["Yes.", "Yes.", "No", " \n", "Ok!", ""])))
    got = by_conversation(repair_conversations(spark.createDataFrame(rows, TURNS)))
    convs = {c for c, *_ in rows}
    assert set(got) == convs
    for c in convs:
        assert got[c] == repaired_plainly(in_order([x[1:] for x in rows if x[0] == c])), c


def forward(rows):
    """Least cost and audit by a table from the last row on, for conversations of any length."""
    step = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    need = ["user", "user", "assistant", "user"]
    best = [(0, "", []), (4, "II", [("user", ""), ("assistant", "")]), (2, "I", [("assistant", "")]), (0, "", [])]
    for role, text, fault in reversed(rows):
        own = []
        for s in range(4):
            options = [(best[s][0] + 3, "D" + best[s][1], best[s][2])]
            if fault not in ("blank", "duplicate"):
                t = fault == "truncated"
                if role[:1] in step[s]:
                    c, a, left = best[step[s][role[:1]]]
                    options.append((c + t, "K" + a, [(role, text), *left]))
                c, a, left = best[step[s][need[s][0]]]
                options.append((c + 2 + t, "R" + a, [(need[s], text), *left]))
            own.append(min(options, key=lambda x: x[:2]))
        for _ in range(3):
            own = [min(own[s], (own[to := step[s][need[s][0]]][0] + 2, "I" + own[to][1], [(need[s], ""), *own[to][2]]), key=lambda x: x[:2]) for s in range(4)]
        best = own
    return best[0]


@pytest.mark.parametrize("piece", [256, 3, 1])
def test_repair_of_long_conversations_in_pieces(spark, piece):
    rng, rows = random.Random(piece), []
    for conv, n in ((1, 700), (2, 40), (3, 3), (4, 90)):
        for turn in range(n):
            text = rng.choice(["Yes.", "No", "", "a.", "b!"]) + ("" if rng.random() < 0.2 else f" {turn}" + rng.choice(["", "."]))
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system"]), text))
    rows += [(2, 5, "user", "Again.")] * 30
    got = by_conversation(repair_conversations(spark.createDataFrame(rows, TURNS).repartition(4), Repair(piece_rows=piece)))
    for c in (1, 2, 3, 4):
        assert got[c] == repaired_plainly(in_order([x[1:] for x in rows if x[0] == c]), forward)


def test_repair_odd_rows(spark):
    rows = [(1, None, None, None), (1, 3, "user", "Hi."), (1, 3, "user", "Hi."), (None, 1, "user", "x" * 2_000_000), (None, 2, "assistant", "Ok."), (7, None, "user", "a."), (7, None, "assistant", "b.")]
    df = spark.createDataFrame(rows, TURNS).withColumn("conv", F.lit(1)).withColumn("row", F.lit(2)).withColumn("letter", F.lit("q"))
    got = by_conversation(repair_conversations(df))
    assert got[1] == repaired_plainly([(None, " ", " "), (3, "user", "Hi."), (3, "user", "Hi.")])
    assert got[None] == repaired_plainly([(1, "user", "x" * 2_000_000), (2, "assistant", "Ok.")])
    assert got[7][0] == 0 and got[7] == repaired_plainly(in_order([(None, "user", "a."), (None, "assistant", "b.")]))
    assert repair_conversations(spark.createDataFrame([], TURNS)).collect() == []
    none = by_conversation(repair_conversations(spark.createDataFrame([(1, 1, "user", "a.", 0), (2, 4, "user", "a.", 2)], TURNS + ", n int"), copies_col="n"))
    assert none[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert none[2] == repaired_plainly([(4, "user", "a."), (4, "user", "a.")])


def test_repair_solver_shares_no_wrong_memo():
    one = Solver(Repair())
    for signature in ("u", "sU", "ua", "0a", "uuaa", "xX4"):
        assert [one.solve(signature, s, None) for s in range(4)] == [Solver(Repair()).solve(signature, s, None) for s in range(4)]


def test_conversation_query_equals_the_contract(spark):
    rows = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        own = rows.setdefault(r["conv_id"], [])
        h = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        role, text = "user" if h == 4 else r["role"], "" if h == 1 else re.sub("[.!?]", "", r["text"]) if h == 2 else r["text"]
        own += [(r["turn"], role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    got = by_conversation(queries.op11_conversation_repair(spark, SF))
    assert set(got) == set(rows)
    for c, own in rows.items():
        assert got[c] == repaired_plainly(in_order(own), forward), c


# ---- periodic runs -------------------------------------------------------------------------------------------------


def runs_plainly(w, least=6, exponent=4):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def repetitive(rng):
    words = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 60))]
    for _ in range(rng.randint(0, 3)):
        part = [rng.randrange(3) for _ in range(rng.randint(1, 9))]
        at = rng.randint(0, len(words))
        words[at:at] = part * rng.randint(1, 8) + part[: rng.randint(0, len(part))]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(2)
    for _ in range(250):
        texts = [repetitive(rng) for _ in range(rng.randint(1, 10))]
        runs, first = word_runs([np.unique(np.array(t, np.int64), return_inverse=True)[1] for t in texts], Periods())
        for i, t in enumerate(texts):
            assert [tuple(x) for x in runs[first[i] : first[i + 1]].tolist()] == runs_plainly(t), t


def collapsed_plainly(words):
    runs = runs_plainly(words)
    return runs, " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def test_collapse_odd_rows(spark):
    texts = [None, "", " \t\n", "a a a a a", "a a a a a a", "a a " * 9, "x y " * 6 + "tail", "A a " * 4, "z " * 30_000, "a b c " * 7000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "q q q q q q q"), (4, "a a a a a a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("id", F.lit(2))
    got = collapse_runs(df).collect()
    assert len(got) == len(rows)
    for doc, text in rows[:8] + rows[10:]:
        runs, left = collapsed_plainly(SPACE.findall(text or ""))
        assert any(r["doc_id"] == doc and [tuple(x) for x in r["runs"]] == runs and r["collapsed"] == left for r in got), (doc, text)
    long = {r["doc_id"]: r for r in got if r["doc_id"] in (8, 9)}
    assert [tuple(x) for x in long[8]["runs"]] == [(0, 30_000, 1)] and long[8]["collapsed"] == "z"
    assert [tuple(x) for x in long[9]["runs"]] == [(0, 21_000, 3)] and long[9]["collapsed"] == "a b c"
    assert collapse_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_runs_query_equals_the_contract(spark):
    got = {r["doc_id"]: r for r in queries.op12_word_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc, text in docs:
        words = SPACE.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc).encode())
        if h % 10 == 0 and n:
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs, left = collapsed_plainly(words)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None,) * 3
        r = got[doc]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(left.encode()).hexdigest()


# ---- SimHash -------------------------------------------------------------------------------------------------------


def print_plainly(text):
    words = SPACE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def linked_plainly(prints, radius=4):
    """The smallest id reachable of each id in {id: fingerprint}."""
    up = {i: i for i in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_masks_and_linear_codes():
    m = masks(2)
    assert len(m) == len(set(m.tolist())) == Balls().variants == 2081 and max(int(x).bit_count() for x in m) == 2
    x, y = np.random.default_rng(1).integers(0, 2**63, (2, 50), dtype=np.uint64)
    assert (codes(x ^ y, 9) == codes(x, 9) ^ codes(y, 9)).all()


@pytest.mark.parametrize("balls", [Balls(), Balls(passes=2, bucket_rows=4000, chunk=7)])
def test_simhash_equals_brute_force(spark, balls):
    rng, rows = random.Random(4), []
    for i in range(60):
        words = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(rng.randint(30, 90))]
        rows.append((10 * i, " ".join(words)))
        for k in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = "new"
            rows.append((10 * i + k + 1, "\t".join(words).upper() if k % 2 else " ".join(words)))
    got = {r["doc_id"]: r for r in simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string"), balls).collect()}
    prints = {i: print_plainly(t) for i, t in rows}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in got.items()} == linked_plainly(prints)
    assert len({r["component_id"] for r in got.values()}) < len(rows) - 20


def test_simhash_links_at_the_radius_and_not_beyond(spark):
    base = 0x0123456789ABCDEF
    rng = random.Random(9)
    prints = {0: base}
    for i, bits in enumerate([1, 2, 3, 4, 4, 4, 5, 5, 6], 1):
        prints[i] = base
        for k in rng.sample(range(64), bits):
            prints[i] ^= 1 << k
    from strandline.llm.common import Scratch
    from strandline.llm.components import components
    from strandline.llm.simhash import ball_links

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints.values()], "fp long").distinct()
    scratch = Scratch(spark, "test")
    found = {r["node"]: r["component"] for r in components(ball_links(df, Balls(), scratch), scratch).collect()}
    want = linked_plainly(prints)
    for a in prints:
        for b in prints:
            x, y = signed(prints[a]), signed(prints[b])
            assert (want[a] == want[b]) == (found.get(x, x) == found.get(y, y))


def test_simhash_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (None, "one two"), (None, "quite alone here"), (4, "One two"), (6, "w " * 300_000), (7, "W " * 300_001)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("id", F.lit(1))
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash_dedup(df).collect()]
    assert sorted(got, key=str) == sorted([(i, f"{print_plainly(t if len(t or '') < 99 else t[:8]):016x}", c) for (i, t), c in zip(rows, [1, 1, 1, 4, 4, 4, None, 4, 6, 6])], key=str)
    assert got and [r for r in got if r[0] == 1][0][1] == "0" * 16
    assert simhash_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_simhash_makes_each_link_once_whatever_the_buckets():
    import pyarrow as pa

    from strandline.llm.simhash import _emit, _meet

    rng, balls, bits = random.Random(5), Balls(least_buckets=64), (3, 6)
    prints = {0: 0x0F1E2D3C4B5A6978}
    while len(prints) < 250:  # near copies of near copies, and strangers
        x = prints[rng.randrange(len(prints))] if rng.random() < 0.9 else rng.getrandbits(64)
        for k in rng.sample(range(12), rng.randint(1, 4)):
            x ^= 1 << k
        if x not in prints.values():
            prints[len(prints)] = x
    dealt = pa.RecordBatch.from_arrays([pa.array(np.array(list(prints.values()), np.uint64).view(np.int64))], names=["fp"])
    links = []
    for turn in range(balls.passes):
        for made in _emit(balls, turn, *bits)([dealt]):
            for i in range(made.num_rows):  # each bucket in a task of its own
                for found in _meet(balls, turn, *bits)([made.slice(i, 1)]):
                    links += zip(*(found.column(c).to_numpy().view(np.uint64).tolist() for c in ("u", "v")))
    assert len(links) == len(set(links)) < 20 * len(prints)
    assert all((u ^ v).bit_count() <= 4 for u, v in links)
    at = {p: i for i, p in prints.items()}
    comp = dict(zip(prints, prints))
    for _ in prints:
        for u, v in links:
            comp[at[u]] = comp[at[v]] = min(comp[at[u]], comp[at[v]])
    assert comp == linked_plainly(prints)
