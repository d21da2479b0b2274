"""Stages of the corpus pipeline on odd rows, and helpers they share."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from strandline.llm.common import broadcast_small, hashed_share
from strandline.llm.language import identify_languages, learn_profiles
from strandline.llm.minhash import minhash_dedup
from strandline.llm.mixing import Mix, mix_sources
from strandline.llm.quality import learn_quality, score_quality

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = np.random.default_rng(21)
WORDS = ["".join(RNG.choice(list("abcdefghijklmnop"), 5)) for _ in range(2000)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS).withColumn("component_id", F.lit(7)).withColumn("score", F.lit("x")).withColumn("cut_bytes", F.lit(3))


def odd(spark):
    long = "\n".join(prose(60, 100 + i) for i in range(300))
    return docs(spark, [(1, None, "a"), (2, "", "a"), (3, prose(50, 1), None), (3, prose(50, 1), None), (3, prose(60, 2), "b"), (None, prose(50, 3), "b"), (4, long, "b"), (5, " \n ", "a")])


@pytest.mark.parametrize("stage", ["quality", "near_dedup", "substring_dedup", "mixing"])
def test_stage_of_odd_rows_and_of_none(spark, stage):
    run = dict(P.STAGES)[stage]
    given = odd(spark)
    out = run(spark, given, SF)
    assert out.columns == P.COLUMNS
    assert {r["doc_id"] for r in out.select("doc_id").collect()} <= {1, 2, 3, 4, 5, None}
    none = run(spark, given.where("false"), SF)
    assert none.columns == P.COLUMNS and none.collect() == []


def test_near_dedup_tells_rows_of_one_id_apart(spark):
    w, v = prose(60, 5), prose(60, 6)
    given = docs(spark, [(1, w, "a"), (2, w, "a"), (2, v, "a"), (None, v, "a"), (9, None, "a"), (9, "", "a")])
    got = [(r["doc_id"], r["text"]) for r in P.near_dedup(spark, given, SF).collect()]
    assert sorted(got, key=str) == sorted([(1, w), (2, v), (None, v), (9, None), (9, "")], key=str)


def test_near_dedup_keeps_equal_rows_of_one_id(spark):
    w = prose(60, 7)
    got = P.near_dedup(spark, docs(spark, [(1, w, "a"), (1, w, "a"), (2, w, "b")]), SF).collect()
    assert [r["doc_id"] for r in got] == [1, 1]


def test_text_hash_comes_with_each_row(spark):
    given = docs(spark, [(1, "a b", "s"), (1, "c d", "s"), (2, None, "s")])
    rows = minhash_dedup(given, with_hash=True).join(given.select("text", F.xxhash64("text").alias("text_hash")), "text_hash")
    assert rows.count() == 3


def test_substring_stage_follows_its_text(spark):
    shared = prose(70, 8)
    given = docs(spark, [(1, prose(40, 9) + "\n" + shared, "a"), (2, prose(40, 10) + "\n" + shared, "a"), (3, shared, "a")])
    got = {r["doc_id"]: r for r in P.substring_dedup(spark, given, SF).collect()}
    assert set(got) == {1, 2} and shared in got[1]["text"] and shared not in got[2]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_encoding_has_a_row_for_each_row(spark):
    given = docs(spark, [(1, None, None), (2, "", "a"), (2, "Hello there", "a"), (None, "x", "a"), (4, "word " * 50_000, "a")])
    got = P.encoding(spark, given, SF)
    assert got.count() == 5 and {"doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(got.columns)
    assert P.encoding(spark, given.where("false"), SF).collect() == []


def test_clashing_columns_are_replaced_or_left_out(spark):
    given = docs(spark, [(i, prose(30, i), "ab"[i % 2]) for i in range(20)])
    mixed = mix_sources(given.withColumn("epoch", F.lit(9)).withColumn("block", F.lit(9)), Mix(), payload=("text", "epoch", "block", "block_rank", "n_tokens"))
    assert sorted(mixed.columns) == sorted(set(mixed.columns)) and {r["epoch"] for r in mixed.select("epoch").collect()} <= {0, 1, 2}
    named = identify_languages(given, learn_profiles(given), keep=("doc_id", "score", "lang_pred"))
    assert named.columns == ["doc_id", "lang_pred", "score"] and named.schema["score"].dataType.typeName() == "double"


def test_shares_never_fall_to_zero(spark):
    df = spark.range(100_000).select(F.xxhash64("id").alias("h"))
    assert df.where(hashed_share(F.col("h"), 20_000, 20_000)).count() == 100_000
    assert abs(df.where(hashed_share(F.col("h"), 1, 10)).count() - 10_000) < 600
    huge = df.agg(F.max(hashed_share(F.lit(0).cast("long"), 20_000, 10**14)).alias("least")).first()
    assert huge["least"] and (1 << 63) * 20_000 // 10**14 > 10**9


def test_broadcast_counts_long_arrays(spark):
    wide = spark.range(10).select("id", F.sequence(F.lit(1), F.lit(10_000)).alias("x"), F.lit(None).cast("array<bigint>").alias("y"))
    assert broadcast_small(wide, 100_000) is wide and broadcast_small(wide, 10_000_000) is not wide
    assert broadcast_small(wide.where("false"), 10) is not None


def test_quality_of_an_empty_table_and_a_very_long_text(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    model = learn_quality(docs(spark, [(i, prose(20 + 30 * (i % 2), i), "a") for i in range(20)]), labels)
    got = score_quality(docs(spark, [(1, "word " * 300_000, "a"), (2, None, "a")]).drop("score"), model).collect()
    assert len(got) == 2 and all(0 <= r["score"] <= 1 for r in got)
    assert score_quality(docs(spark, [(1, "a", "a")]).where("false"), model).collect() == []


def test_mixing_of_empty_tables_ties_and_repeated_ids(spark):
    assert mix_sources(docs(spark, [(1, "a", "a")]).where("false")).collect() == []
    same = mix_sources(docs(spark, [(1, "a b", "a"), (1, "a b", "a"), (2, "a b", "b"), (3, "a b", "b")]), Mix(budget=1.0, repeats=1.0))
    assert sorted(r["doc_id"] for r in same.collect()) == [1, 1, 2, 3]
