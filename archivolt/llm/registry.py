"""Queries of the ten operators and of the pipeline, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .base import table
from .decontaminate import decontaminate
from .id_files import id_files
from .line_dedup import line_dedup
from .near_dedup import near_dedup
from .pii import pii
from .piece_codec import piece_digests
from .quality_crf import quality
from .quality_rules import quality_rules
from .shards import shard
from .sql import ORACLE
from .tokens import token_counts


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents", spread=True), public_tokenizers.path("byte_bpe_50k.json"))


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents", spread=True), public_tokenizers.path("piece_bpe_32k.model"))


def op3_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents", spread=True), percent=85)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents", spread=True))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "labels"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "benchmark"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents", spread=True))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(table(spark, sf_dir, "documents", spread=True))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_token_counts, op2_piece_codec, op3_id_files, op4_near_dedup, op5_line_dedup, op6_quality, op7_shards, op8_decontaminate, op9_quality_rules, op10_pii, pipeline)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
