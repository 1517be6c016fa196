"""A corpus pipeline of the text operators; each stage works on what the stage before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from shelfledger.llm import bpe, decontam, line_dedup, quality, simhash
from shelfledger.llm.common import free_name, ready, shared_folder, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go."""
    ready(spark)
    return quality.keep_accepted(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of two or more lines and lines of 50 or more words that stand earlier in the table go; every document stays."""
    return line_dedup.drop_repeated_runs(docs, words=50)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose fingerprints of 3-word shingles are 3 bits or fewer apart the one of the least id stays."""
    ready(spark)
    return simhash.keep_one(docs, simhash.near_groups(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    ready(spark)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids, its text decoded from them."""
    ready(spark)
    return bpe.round_trip(docs, free_name(docs, "ids"))


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", tokens),
]

#: SQL can express neither the model nor the fingerprints and the token ids; the tests hold brute force against run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
    return docs
