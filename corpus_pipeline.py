"""The corpus pipeline: each stage calls one training-data operator and its decisions take effect.

Toxic documents go, of equal texts and of near-duplicates one document stays, the sources are mixed to
target weights (documents repeat as often as the mix takes them), and the mix is encoded and decoded.

A stage's rows are saved before the next one reads them, so a stage begins by dropping the tables that those before it
left in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from glosswork.llm.common import cleared, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier lets pass. Null and empty texts are scored as well; null languages take the global threshold; an empty table stays empty."""
    cleared(docs)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that of the largest doc_id (null is smallest); null texts are empty ones. Of wholly equal rows one stays."""
    cleared(docs)
    return exact_dedup.drop_duplicates(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates, that of the smallest doc_id; texts without words are like no other, so all of them stay. Rows that share an id are told apart by their texts."""
    cleared(docs)
    return near_dedup.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, twice at most; null is a source of its own, the last; rows of one id, source and text share their copies."""
    cleared(docs)
    return mixing.mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32) and the SHA-256 of the text that they decode to, of each document of the mix."""
    cleared(docs)
    return bpe.encode_documents(docs, bpe.default_tokenizer()).select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

# A trained classifier and sketches are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another; each result is written as Parquet in the shared folder and read again, and goes when the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
