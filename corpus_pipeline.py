"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

language ID (rejects texts of unknown language), exact dedup, n-gram Jaccard join (one document of each
group stays; five words, similarity 0.8), benchmark decontamination, byte-level BPE. Every stage works on
all rows its predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablescope.llm import byte_bpe, decontaminate, exact_dedup, jaccard_join, language_id
from tablescope.llm.common import prepare, read
from tablescope.session import checkpoint_folder


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is unknown (null text, or no letter) go."""
    prepare(spark)
    return language_id.keep_identified(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays (the largest doc_id)."""
    return exact_dedup.keep_one(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked documents stays (the smallest doc_id)."""
    return jaccard_join.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def tokenize_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded bytes."""
    prepare(spark)
    return byte_bpe.token_digests(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_dedup_stage),
    ("jaccard_join", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("byte_bpe", tokenize_stage),
]

#: The classifier and the tokenizer are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    root = checkpoint_folder(spark, "pipeline")  # deleted with the checkpoint tables
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}-{name}")
        docs = spark.read.parquet(f"{root}/{k}-{name}")
    return docs
