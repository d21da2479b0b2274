"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import crc32_mod, table
from strandline.llm.conversations import repair_conversations
from strandline.llm.language import identify_languages, learn_profiles
from strandline.llm.licenses import scan_licenses
from strandline.llm.media import media_columns
from strandline.llm.minhash import Banding, minhash_dedup
from strandline.llm.mixing import Mix, mix_sources
from strandline.llm.oracles import CONVERSATION_SQL, RUNS_SQL
from strandline.llm.passages import remove_passages
from strandline.llm.periods import collapse_runs
from strandline.llm.pieces import encode_pieces
from strandline.llm.quality import learn_quality, score_quality
from strandline.llm.simhash import simhash_dedup
from strandline.llm.topk import top_k
from strandline.llm.warc import warc_round_trip

#: The tokenizer file is a parameter of the operator; the queries use the installed public one.
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(crc32_mod("doc_id", 4) == 2, F.lit(False)))
    profiles = learn_profiles(docs.where(~F.col("held_out")).select("lang", "text"))
    return identify_languages(docs.select("doc_id", "held_out", "text"), profiles, keep=("doc_id", "held_out"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op3_quality_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc32_mod("doc_id", 5) != 0).select("doc_id", "quality")
    scored = score_quality(docs, learn_quality(docs, labels))
    return scored.select("doc_id", F.coalesce(crc32_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op4_chunked_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))


def op5_piece_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("n_tokens", "ids_sha256", "decoded_sha256", "span_bytes", "spans_sha256")
    return encode_pieces(table(spark, sf_dir, "documents"), MODEL, columns)


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), Mix(budget=1.0, repeats=1.25))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_passages(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "text", "cut_paragraphs", "cut_bytes", "cut_spans", "has_repeat")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(table(spark, sf_dir, "documents"), Banding(width=2))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with the damage of the contract; copies tells how often in a row each row stands."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    text = F.when(h == 1, "").when(h == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    return turns.select("conv_id", "turn", F.when(h == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("copies"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")), copies_col="copies")


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """The order of words that the contract plants into a tenth of the documents; a null id has none."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10:
        return None
    g, i = h // 10, np.arange(n)
    a = g % n
    return np.where(i >= a, a + (i - a) % (1 + (n - a) // (3 + g % 8)), i)


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse_runs(table(spark, sf_dir, "documents"), order=planted_order)
    longer = lambda best, x: F.when(x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best)
    lines = F.transform("runs", lambda x: F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")))
    found = found.withColumn("best", F.aggregate("runs", F.get("runs", F.lit(0)), longer))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_profiles": op1_language_profiles,
    "op2_license_scan": op2_license_scan,
    "op3_quality_tables": op3_quality_tables,
    "op4_chunked_media": op4_chunked_media,
    "op5_piece_spans": op5_piece_spans,
    "op6_warc_round_trip": op6_warc_round_trip,
    "op7_source_mixing": op7_source_mixing,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_word_runs": op12_word_runs,
    "op13_simhash_balls": op13_simhash_balls,
}

#: DuckDB counterparts, where SQL can say what the operator computes.
ORACLE_SQL: dict[str, str] = {
    "op11_conversation_repair": CONVERSATION_SQL,
    "op12_word_runs": RUNS_SQL,
    "op6_warc_round_trip": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (
            SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first_id <> page_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)
    """,
    "op10_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
}
