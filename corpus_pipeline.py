"""From raw documents to token ids: quality rules, near-dedup, secret redaction, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a frame; `run` writes it as Parquet and reads it
again as the next one's docs, so that a stage starts from files and a lost executor costs a task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import mixing, pieces, quality, secret_scan, simhash
from cairn.llm.common import shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of the current policy go."""
    return quality.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.drop_duplicates(docs)


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by the name of their rule."""
    return secret_scan.redact(docs)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn to the target weights of their sources, again where epochs repeat; the last of a source is cut at its budget."""
    return mixing.mix_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every drawn document."""
    return pieces.encode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("secret scan", redaction),
    ("mixing to weights", mixing_to_weights),
    ("sentencepiece encoding", encoding),
]

#: SimHash groups, random-access automata and merges can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{i}")
        docs = spark.read.parquet(f"{where}/{i}")
    return docs
