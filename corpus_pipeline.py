"""From raw documents to tokens: rules, near-dedup, decontamination, masking, encoding.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the
last return the columns of documents. run() writes each stage's rows to the shared
folder and reads them back, so a lost executor costs at most the stage it works on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import bpe, decontaminate, pii, quality_rules, simhash
from riskloom.session import materialise, tidy

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines leave the texts; documents that fail the rules or are depleted go."""
    return quality_rules.filter_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays."""
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes the name of its kind."""
    return pii.mask_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids."""
    return bpe.encode_documents(docs, VOCABULARY, public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", apply_rules),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("byte_bpe", encode),
]

#: Fingerprint links and merges are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        tidy(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
