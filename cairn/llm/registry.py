"""The queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import ann, brown, mixing, pieces, quality, secret_scan, sharding, simhash, toxicity, warc
from cairn.llm.common import table


def op1_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.reassembled_pages(table(spark, sf_dir, "pages"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.findings(table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 is a query, against all."""
    v = table(spark, sf_dir, "embeddings")
    return ann.neighbours(v, v.where("vec_id % 50 = 0"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.duplicates(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    return quality.apply_policy(quality.apply_policy(rows, "v1"), "v2")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ablations(quality.ledger(table(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OPERATORS = [
    op1_warc_segments,
    op2_secret_scan,
    op3_nearest_neighbours,
    op4_simhash_near_dedup,
    op5_sentencepiece,
    op6_sharding,
    op7_mixing,
    op8_lm_scoring,
    op9_toxicity,
    op10_quality_rules,
    quality_ablations,
    pipeline,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_segments": warc.OP1_SQL,
        "op2_secret_scan": secret_scan.OP2_SQL,
        "op7_mixing": mixing.OP7_SQL,
        "op10_quality_rules": quality.OP10_SQL,
        "quality_ablations": quality.ABLATION_SQL,
    }
