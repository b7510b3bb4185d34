"""A corpus pipeline: each stage takes what the one before it kept. run() applies all stages to the documents of a folder."""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.operators.parse import dealt
from timberline.llm import bpe, common, jaccard_rtree, langid, line_ledger, tiling

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go; the others carry the language that was found.

    Null and empty texts, and ones without a letter, go; repeated rows are judged each; null ids stay; very long texts are read whole.
    """
    return langid.tell(docs.select(*COLUMNS))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more hold go; the documents stay, if with empty texts. A null text becomes an empty one; each row counts as a document."""
    docs = docs.select(*COLUMNS)
    done = line_ledger.dedup(docs, threshold=10)
    return done.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more. Null and empty texts are like nothing; null ids stay."""
    return jaccard_rtree.keep_one(docs, 5, 80).select(*COLUMNS)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none; null ids stay."""
    return tiling.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, n_tokens, ids_sha256, decoded_sha256) of each document; a null text is an empty one."""
    return bpe.digests(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN, keep=("lang",))


STAGES = [("language ID", language), ("line dedup", lines), ("near copies", near_copies), ("decontamination", leaks), ("byte-level BPE", tokens)]

#: No SQL for language ID, tiling and the merges; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), "stage")
    return docs
