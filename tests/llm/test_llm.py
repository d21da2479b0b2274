"""The ten operators on small tables: brute force, round trips, held-out accuracy, odd rows."""

from __future__ import annotations

import hashlib
import io
import random
import re
import textwrap
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from strandline.llm import queries
from strandline.llm.common import Scratch
from strandline.llm.components import components
from strandline.llm.language import identify_languages, learn_profiles
from strandline.llm.licenses import TEMPLATES, scan_licenses, wording_difference, words_of
from strandline.llm.media import Chunking, media_columns
from strandline.llm.minhash import Banding, minhash_dedup
from strandline.llm.mixing import Mix, mix_sources
from strandline.llm.passages import Passages, byte_bounds, near_ends, remove_passages, text_anchors
from strandline.llm.pieces import Encoder, decode_pieces, encode_pieces
from strandline.llm.quality import learn_quality, score_quality
from strandline.llm.shingles import Powers, batch_words, shingle_sets
from strandline.llm.topk import Search, top_k
from strandline.llm.warc import Archiving, read_warc, warc_round_trip, write_warc

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = np.random.default_rng(11)
WORDS = ["".join(RNG.choice(list("abcdefghijklmnop"), 5)) for _ in range(3000)]


def prose(n: int, seed: int) -> list[str]:
    return list(np.random.default_rng(seed).choice(WORDS, n))


def documents(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def test_language_held_out(spark):
    got = queries.op1_language_profiles(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    row = got.join(docs, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert row[1] > 100 and row[0] > 0.97 and 0 <= row[2] <= row[3] <= 1


def test_language_odd_rows(spark):
    rows = [("en", "the cat sat on the mat and the dog"), ("fr", "le chat est sur le tapis avec les chiens"), (None, "x"), ("en", None)]
    profiles = learn_profiles(documents(spark, rows, "lang string, text string"))
    assert profiles.languages == ("en", "fr")
    odd = documents(spark, [(1, None), (2, ""), (3, "12 34 !"), (4, "the dog " * 200_000), (None, "le tapis")])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify_languages(odd, profiles).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "en" and got[None][0] == "fr"
    assert identify_languages(odd.limit(0), profiles).count() == 0


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
    rows = [(1, "Some text.\n" + mit + ", including use.\nMore."), (2, "A licence to print money is not a statement."), (3, None), (4, ""), (5, "Licensed under the Apache License, Version 2.0."), (5, "Licensed under the Apache License, Version 2.0.")]
    got = sorted((r["doc_id"], tuple(r["licenses"])) for r in scan_licenses(documents(spark, rows)).collect())
    assert got == [(1, ("MIT",)), (2, ()), (3, ()), (4, ()), (5, ("Apache-2.0",)), (5, ("Apache-2.0",))]


def test_licenses_over_line_ends_and_side_by_side(spark):
    wrap = lambda text, mark: "\n".join(mark + line for line in textwrap.wrap(text, 72 - len(mark)))
    long = {k: max(v, key=len) for k, v in TEMPLATES.items()}
    rows = [(i, "int x;\n" + wrap(long[k], mark) + "\nint y;") for i, (k, mark) in enumerate(((k, m) for k in ("MIT", "GPL-3.0", "BSD-3-Clause", "Apache-2.0") for m in ("", " * ", "// ", "# ")))]
    gpl2 = wrap(long["GPL-3.0"].replace("version 3", "version 2"), "# ")
    rows += [(50, "Released under the MIT License. Licensed under the Apache License, Version 2.0."), (51, wrap(long["MIT"], "# ") + "\n#\n" + wrap(long["BSD-3-Clause"], "# ")), (52, gpl2)]
    got = {r["doc_id"]: r["licenses"] for r in scan_licenses(documents(spark, rows)).collect()}
    assert [got[i] for i in range(16)] == [[k] for k in ("MIT", "GPL-3.0", "BSD-3-Clause", "Apache-2.0") for _ in range(4)]
    assert got[50] == ["Apache-2.0", "MIT"] and got[51] == ["BSD-3-Clause", "MIT"] and got[52] == []


def test_licenses_equal_brute_force(spark):
    """Every template, with words changed, against its exact wording over the whole text; templates of users; odd rows."""
    own = {"House": ["All of this text may be passed on by anyone who keeps this line with it."], "Other": ["Nobody may sell copies of the tables without asking first."]}
    rng, rows = np.random.default_rng(9), []
    for texts in own.values():
        for changes in range(7):
            words = texts[0].split()
            for at in rng.choice(len(words), changes, replace=False):
                words[at] = "zzz"
            rows.append((len(rows), " ".join([*prose(40, len(rows)), *words, *prose(40, 100 + len(rows))])))
    rows += [(len(rows), " ".join(prose(9000, 7)) + " " + own["House"][0]), (None, own["Other"][0])]
    docs = documents(spark, rows).withColumn("id", F.lit("x")).withColumn("licenses", F.lit("y"))
    got = {r["doc_id"]: r["licenses"] for r in scan_licenses(docs, own).collect()}
    for i, text in rows:
        want = sorted(n for n, t in own.items() if wording_difference(words_of(text), words_of(t[0])) <= 0.2)
        assert got[i] == want
    assert sum(map(len, got.values())) >= 6 and scan_licenses(docs.limit(0), own).count() == 0


def test_components_equal_brute_force(spark):
    """A long chain, a star, cycles, repeated and empty edges."""
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (200, 201), (300, 300), (None, 5), (7, None)]
    scratch = Scratch(spark, "t")
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long"), scratch).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "u long, v long"), scratch).count() == 0


def test_has_repeat_tells_keepers(spark):
    passage = " ".join(prose(70, 1))
    rows = [(1, " ".join(prose(60, 2)) + " " + passage), (2, passage + " " + " ".join(prose(60, 3))), (3, " ".join(prose(90, 4))), (2, passage + " " + " ".join(prose(60, 3)))]
    got = [(r["doc_id"], r["has_repeat"], r["cut_paragraphs"] > 0) for r in remove_passages(documents(spark, rows).withColumn("cut_bytes", F.lit("x")).withColumn("gone", F.lit(1))).collect()]
    assert sorted(got) == [(1, True, False), (2, True, True), (2, True, True), (3, False, False)]


def test_quality_held_out(spark):
    got = queries.op3_quality_tables(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    row = got.join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert row[1] > 10 and row[0] > 0.9


def test_quality_odd_rows(spark):
    docs = documents(spark, [(1, None), (2, ""), (3, "good words here"), (3, "good words here")], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (9, 0), (None, 1), (1, None)], "doc_id long, quality int")
    got = score_quality(docs.withColumn("score", F.lit("x")), learn_quality(docs, labels)).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got) and got[0]["score"] == got[1]["score"]


def test_media(spark):
    shared = " ".join(prose(3000, 1))
    rows = [(1, shared), (2, "y" * 700 + shared + "z"), (3, None), (4, ""), (5, shared), (6, "é" * 288), (None, "n"), (1, shared)]
    got = media_columns(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, text in rows:
        data = (text or "").encode()
        payload = data + b"\xff" * ((max(1, -(-len(data) // 576)) * 576) - len(data))
        r = by_id[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert by_id[1]["media_sha256"] == by_id[5]["media_sha256"] and by_id[3]["feature"] == by_id[4]["feature"]
    assert media_columns(documents(spark, rows).limit(0), Chunking()).count() == 0


def test_pieces(spark):
    texts = ["", None, " a  b ", "naïve 日本語 😀 \x00 tab\tnl\n", "▁ mark", "the " * 5000, "ｆｕｌｌ Ⅳ", "<s> </s> <unk>"]
    library = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL)
    got = encode_pieces(documents(spark, list(enumerate(texts))), queries.MODEL, ("ids", "starts", "ends", "n_tokens", "ids_sha256", "decoded_sha256"))
    for r in got.collect():
        text = texts[r["doc_id"]] or ""
        ids = library.encode(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        if ids:
            assert r["ends"][-1] == len(text.encode()) and r["starts"][1:] == r["ends"][:-1]
    back = {r["doc_id"]: r["decoded"] for r in decode_pieces(got, queries.MODEL).collect()}
    assert back[5] == library.decode(library.encode(texts[5]))


def test_pieces_with_a_short_memory():
    """Words are forgotten while texts of all kinds are under way."""
    with open(queries.MODEL, "rb") as file:
        encoder = Encoder(file.read(), remembered=40)
    rng = np.random.default_rng(5)
    texts = [" ".join(prose(int(rng.integers(1, 30)), i)).replace(" ", "  " if i % 3 == 0 else " ") for i in range(60)]
    assert [x.ids.tolist() for x in encoder.encode(texts)] == encoder.whole.encode(texts)


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
@pytest.mark.parametrize("fallback", [True, False])
def test_pieces_through_a_character_map(kind, fallback):
    """Ids, decoded texts and byte spans are the library's own, with and without unknown characters."""
    rng = random.Random(3)
    words = "The ﬁrst ﬂat ofﬁce № 5 ｆｕｌｌ Ⅳ naïve café Ångström 日本語 テスト ｶﾞ ㌔ ½ ² plain words over and again the cat sat on mat ﬃ ™ ℃".split()
    texts, model = [" ".join(rng.sample(words, 6)) for _ in range(300)], io.BytesIO()
    sentencepiece.SentencePieceTrainer.train(sentence_iterator=iter(texts), model_writer=model, vocab_size=400 if fallback else 140, model_type=kind, byte_fallback=fallback, normalization_rule_name="nmt_nfkc", hard_vocab_limit=False, minloglevel=2, character_coverage=0.98)
    encoder = Encoder(model.getvalue())
    texts = [*texts[:80], "", "  a  b ", "ｆｕｌｌ ﬁ zzz Ω≈ç√ 😀😀 q", "▁x", "　wide nbsp\t tab", "é ñ"]
    for text, got in zip(texts, encoder.encode(texts), strict=True):
        want = encoder.whole.encode(text, return_type="proto")
        assert not encoder.identity and got.ids.tolist() == [p.id for p in want.pieces]
        assert list(zip(got.starts.tolist(), got.ends.tolist(), strict=True)) == [(p.begin, p.end) for p in want.pieces]


def test_pieces_odd_tables(spark):
    docs = documents(spark, [(1, "a b"), (1, "a b"), (None, "c")])
    got = encode_pieces(docs, queries.MODEL, ("n_tokens",))
    assert sorted(str(r["doc_id"]) for r in got.collect()) == ["1", "1", "None"]
    assert encode_pieces(docs.limit(0), queries.MODEL).count() == 0
    with pytest.raises(ValueError):
        encode_pieces(docs.withColumn("ids", F.lit(1)), queries.MODEL, ("ids",), keep=("ids",))


def test_warc(spark):
    big = "b" * 700_000
    rows = [(3, "http://x", big), (1, None, big), (2, "u\r\nv", None), (4, "u", "short"), (5, "u", "short"), (6, "u", "é" * 80), (7, "u", "é" * 80)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc_round_trip(pages, Archiving(chunk=64 << 10)).collect()}
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {1: ("response", None), 2: ("response", None), 3: ("revisit", 1), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("revisit", 6)}
    chunks = read_warc(spark, write_warc(pages, Scratch(spark, "t"), Archiving(chunk=64 << 10)), with_data=True).where("page_id = 1").orderBy("chunk_no").collect()
    assert len(chunks) > 1 and b"".join(bytes(c["data"]) for c in chunks) == big.encode()
    assert warc_round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("m", [Mix(repeats=1.5, block_tokens=100), Mix(repeats=None, entropy=1.4, block_tokens=100)])
def test_mixing(spark, m):
    rows = [(i, " ".join(prose(10, i)), "a" if i < 150 else "b" if i < 190 else None) for i in range(200)] + [(200, None, "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(docs, m).toPandas()
    tokens = got.groupby(got.source.fillna("null")).n_tokens.sum()
    assert abs(tokens.sum() - 2000) <= 40
    if m.repeats:
        assert tokens["null"] <= 100 * 1.5 + 10 and tokens["null"] > 100 * 1.3
    else:
        p = tokens[tokens > 0] / tokens.sum()
        assert abs(-(p * np.log2(p)).sum() - 1.4) < 0.05
    assert (got.doc_id == 200).sum() == 1 and not got.duplicated(["doc_id", "epoch"]).any()


def test_passages(spark):
    passage = " ".join(prose(70, 1)) + "."
    clean = [(100 + i, " ".join(prose(120, 50 + i)) + ".\n" + " ".join(prose(60, 90 + i)) + ".") for i in range(20)]
    rows = [(1, "Alpha line.\n" + passage + "\nOmega."), (2, " ".join(prose(40, 2)) + ". " + passage + " " + " ".join(prose(40, 3)) + "."), (3, None), (4, ""), (5, passage), *clean]
    got = {r["doc_id"]: r for r in remove_passages(documents(spark, rows)).collect()}
    assert got[1]["text"] == rows[0][1] and passage not in got[2]["text"] and got[5]["text"].strip() == ""
    assert rows[1][1][:200] == got[2]["text"][:200] and got[3]["text"] is None and got[4]["text"] == ""
    assert all(got[i]["text"] == t and got[i]["cut_bytes"] == 0 for i, t in clean)
    assert remove_passages(documents(spark, rows).limit(0)).count() == 0


def test_passages_without_sentence_borders(spark):
    """Words run on before and behind; short sentences stand between; one word is changed."""
    words = prose(60, 400)
    plain = " ".join(words)
    short = " ".join(w + "." if i % 9 in (0, 2) else w for i, w in enumerate(prose(60, 401)))
    changed = " ".join([*words[:30], "zzz", *words[31:]])
    host = lambda part, seed: " ".join(prose(70, seed)) + " " + part + " " + " ".join(prose(70, seed + 1))
    rows = [(1, host(plain, 410)), (2, host(plain, 420)), (3, host(short, 430)), (4, host(short, 440)), (5, host(changed, 450)), (6, host(" ".join(prose(60, 402)), 460))]
    got = {r["doc_id"]: r for r in remove_passages(documents(spark, rows)).collect()}
    assert all(got[i]["text"] == rows[i - 1][1] for i in (1, 3, 6))
    for i, part in ((2, plain), (4, short), (5, changed)):
        assert got[i]["text"] == rows[i - 1][1].replace(part, "")
        assert [rows[i - 1][1][a:b] for a, b in got[i]["cut_spans"]] == [part]


def test_neighbouring_passages_of_different_holders(spark):
    """Two passages, or a passage and a common sentence, side by side in one line."""
    one, two, three = (" ".join(prose(n, 800 + n)) for n in (60, 61, 62))
    common = " ".join(prose(12, 903)) + "."
    host = lambda part, seed: " ".join(prose(70, seed)) + " " + part + " " + " ".join(prose(70, seed + 1))
    rows = [(1, host(one, 510)), (2, host(two, 520)), (3, host(one + " " + two, 530)), (4, host(three + " " + common, 540)), (5, host(three, 550)), *[(10 + i, host(common, 560 + 10 * i)) for i in range(5)]]
    got = {r["doc_id"]: r for r in remove_passages(documents(spark, rows)).collect()}
    assert got[3]["text"] == rows[2][1].replace(one, "").replace(two, "")
    assert got[5]["text"] == rows[4][1].replace(three, "")
    assert all(r["text"] == dict(rows)[i] for i, r in got.items() if i not in (3, 5))


def sets(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    rng, rows = np.random.default_rng(7), [(0, None), (1, ""), (2, "One"), (3, "one"), (4, " \n")]
    for base in range(6):
        words = prose(80 + 40 * base, base)
        for _ in range(14):
            changed = list(words)
            for at in rng.integers(0, len(words), int(rng.integers(0, 10))):
                changed[at] = WORDS[int(rng.integers(0, 3000))]
            rows.append((len(rows), " ".join(changed).upper() if rng.random() < 0.2 else " ".join(changed)))
    rows.append((len(rows), rows[10][1]))
    full = {i: sets(t, width) for i, t in rows}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations([i for i, s in full.items() if s], 2):
        if 100 * len(full[a] & full[b]) >= 80 * len(full[a] | full[b]):
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    got = {r["doc_id"]: r for r in minhash_dedup(documents(spark, rows), Banding(width=width)).collect()}
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in full.items()}
    assert {i: r["component_id"] for i, r in got.items()} == {i: find(i) for i, _ in rows}
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_null_ids_are_linked_with_nothing(spark):
    text = " ".join(prose(50, 700))
    got = minhash_dedup(documents(spark, [(1, text), (2, text), (None, text), (None, text)])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == [("1", "1", True), ("2", "1", False), ("None", "None", True), ("None", "None", True)]


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8)) * rng.uniform(0.1, 3, (400, 1))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(400, None), (420, [float("nan")] * 8), (440, [None] * 8), (None, [1.0] * 8)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), Search(block=64, query_block=7)).toPandas()
    v = np.floor(64 * x).astype(np.int64)
    for q in range(0, 400, 20):
        scores = v @ v[q]
        want = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert [(-s, i) for s, i in zip(mine.score, mine.vec_id, strict=True)] == want and list(mine["rank"]) == list(range(1, 21))
    assert set(got.query_id) == set(range(0, 400, 20))


def test_pipeline_keeps_columns_and_drops_copies(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality", "near_dedup", "substring_dedup", "mixing", "encoding"]
    text = " ".join(prose(200, 1))
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (2, text + " more", "en", "s", 1), (3, " ".join(prose(200, 2)), "fr", None, 1)], DOCS).withColumn("component", F.lit(1))
    got = p.near_dedup(spark, docs, SF)
    assert got.columns == p.COLUMNS and sorted(r["doc_id"] for r in got.collect()) == [1, 3]


@pytest.mark.parametrize("width", [2, 5])
def test_shingle_sets_of_a_batch(width):
    """Each text's set is the one it has alone, and as large as that of its word tuples."""
    texts = [None, "", " \n", "One", "one two", "a b a b a b a b", "A b\tc d e f", "x " * 500, "a b c d e", "é ü ß", None]
    flat, ends = shingle_sets(pa.array(texts), width, Powers())
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        want = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
        alone, _ = shingle_sets(pa.array([text], pa.string()), width, Powers())
        assert ends[i + 1] - ends[i] == len(want) == len(alone)
        assert (flat[ends[i] : ends[i + 1]] == alone).all()


def test_anchors_of_a_batch():
    """Each text's words, places and anchors are those it has alone; every window of its own has its least shingle."""
    p, texts = Passages(), ["", " ".join(prose(90, 1)), None, " ".join(prose(19, 2)), " ".join(prose(20, 3)), "é " + "\n".join(prose(50, 1)), "a", " ".join(["x"] * 60), " "]
    begin, start, end, words, bounds = batch_words(pa.array(texts), Powers())
    h, at = text_anchors(words, bounds, p)
    window = p.stretch_words - p.shingle_words + 1
    for i, text in enumerate(texts):
        lo, hi, data = bounds[i], bounds[i + 1], (text or "").encode()
        assert [data[a:b].decode() for a, b in zip(start[lo:hi] - begin[i], end[lo:hi] - begin[i], strict=True)] == (text or "").split()
        own = h[lo : max(lo, hi - p.shingle_words + 1)]
        want = {int(k + j) for k in range(len(own) - window + 1) for j in np.flatnonzero(own[k : k + window] == own[k : k + window].min())}
        assert {int(x - lo) for x in at if lo <= x < hi} == want


def test_places_near_ends_stay_in_their_text():
    at, kind = np.array([3, 5, 12, 14]), np.array([1, 1, 1, 1])
    first, last = np.array([0, 0, 8, 8]), np.array([8, 8, 17, 17])
    assert near_ends(at, kind, first, last, 20, 4).tolist() == [0, 1, 2, 3, 5, 6, 7, 8, 9, 10, 11, 12, 14, 15, 16]


def test_passages_of_rows_that_share_an_id_part_no_character(spark):
    shared = " ".join(f"common{i}" for i in range(80))
    other = " ".join("é" * (3 + i % 4) + str(i) for i in range(120))  # byte 3, where the first row's passage begins, is inside a character
    rows = [(1, "xx " + shared), (1, other), (2, shared + " end")]
    got = [(r["doc_id"], r["text"], r["has_repeat"]) for r in remove_passages(documents(spark, rows)).collect()]
    first, second = sorted(t for i, t, _ in got if i == 1)
    assert first == "xx " + shared and second and set(second.split()) <= set(other.split())
    assert ["common" in t for i, t, _ in got if i == 2] == [False]


def test_word_bounds_become_bytes():
    data = "  één twee\tdrie\n".encode()
    assert byte_bounds(data, [0, 1, 1, 3]) == [2, 7, 8, 17]
    assert byte_bounds(data, [2, 9, 7, 9]) == [13, len(data), len(data), len(data)]
    assert byte_bounds(b"", [0, 3]) == [0, 0] and byte_bounds(data, None) == byte_bounds(data, []) == []
