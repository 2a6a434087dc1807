"""Cleaning a corpus: stages of the training-data operators, each written as Parquet and read by the next.

A stage takes (spark, docs, sf_dir) and works on all documents that the stage before kept. All but the last return the
columns of ``documents``: quality rules drop what a rule rejects; of near-duplicates the smallest doc_id stays; personal
data become their kind in brackets and revealing terms go; the mix repeats, drops and cuts documents to the sources'
targets; the last stage gives ``doc_id, n_tokens, ids_sha256, decoded_sha256`` per document of the mix, where a
document that the mix repeats has a row for each time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wordloom.bounds import shared_dir
from wordloom.llm import bpe, mixing, pii, quality, simhash
from wordloom.llm.queries import bpe_digest, vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.without_near_duplicates(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitized(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = vocabulary("word_bpe_49k.json")
    return bpe_digest(bpe.round_trip(docs, path))


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("personal data", personal_data_stage),
    ("mixing", mixing_stage),
    ("BPE", encoding_stage),
]

# Fingerprints, groups of near-duplicates and the merge rules are beyond SQL; tests/llm holds the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn on the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
