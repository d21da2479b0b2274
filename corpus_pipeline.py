"""A corpus pipeline: quality filter, near-dedup, substring dedup, source mixing, token round trip.

All stages read the columns of COLUMNS by name and leave others, whatever their names, behind. An empty table gives an
empty result with the same columns; texts of any length pass whole; rows that repeat each other are judged alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import Scratch, broadcast_small
from strandline.llm.minhash import Banding, minhash_dedup
from strandline.llm.mixing import Mix, mix_sources
from strandline.llm.passages import remove_passages
from strandline.llm.pieces import encode_pieces
from strandline.llm.quality import learn_quality, score_quality
from strandline.llm.queries import MODEL

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No SQL counterpart: learnt tables, hashed permutations and a tokenizer are not expressible in it.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of the documents at hand.

    Null and empty texts are scored like others. Null ids have no label, and are scored. A score equal to the threshold is
    accepted. Without any label every row has the same score, 0.5, and stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return score_quality(docs.select(*COLUMNS), learn_quality(docs, labels)).where("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by five-word shingles: that with the smallest id.

    Null and word-less texts, and rows with a null id, are in no group and stay. Rows that share an id are told apart by
    their texts: one goes only if its own text has a near-duplicate that stays. Equal rows with one id stay together.
    """
    docs = docs.select(*COLUMNS)
    gone = minhash_dedup(docs, Banding(width=5), with_hash=True).where("not kept").select("doc_id", "text_hash").distinct()
    gone = broadcast_small(Scratch(spark, "pipeline").write(gone, "gone"), 16 << 20, 32)
    return docs.withColumn("text_hash", F.xxhash64("text")).join(gone, ["doc_id", "text_hash"], "left_anti").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out; documents of which nothing is left go. n_chars follows the text.

    Null and empty texts and rows with a null id stay as they are. The smallest id keeps a passage; rows that share an id are
    cut alike.
    """
    cut = remove_passages(docs.select(*COLUMNS))
    left = (F.col("cut_bytes") == 0) | (F.length(F.trim("text")) > 0)
    return cut.where(left).withColumn("n_chars", F.when(F.col("cut_bytes") == 0, F.col("n_chars")).otherwise(F.length("text"))).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; no source is repeated more than a quarter over.

    A null source is a source; null and empty texts have no tokens and go with their block; equal rows are taken alike.
    """
    return mix_sources(docs, Mix(budget=1.0, repeats=1.25), payload=("text", "lang", "n_chars")).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids, of the decoded text and of the pieces' spans, a row for each row.

    A null text is encoded as an empty one; null ids and sources are passed on.
    """
    return encode_pieces(docs, MODEL, ("n_tokens", "ids_sha256", "decoded_sha256", "span_bytes", "spans_sha256"), keep=("doc_id", "source"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("encoding", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet in the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
