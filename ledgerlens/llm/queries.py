"""The corpus operators as queries over a folder of tables, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm.common import documents
from ledgerlens.llm.decontaminate import leaks
from ledgerlens.llm.jaccard import jaccard_groups
from ledgerlens.llm.language import languages
from ledgerlens.llm.lines import LINES_SQL, LONG, removed_lines
from ledgerlens.llm.mixing import MIX_SQL, mix
from ledgerlens.llm.quality import quality
from ledgerlens.llm.sharding import shard
from ledgerlens.llm.substrings import removed_bytes, removed_words
from ledgerlens.llm.tokens import token_counts


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark, documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op2_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_lines(spark, documents(spark, sf_dir), long=LONG)


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, documents(spark, sf_dir))


def op5_repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_words(spark, documents(spark, sf_dir))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark, documents(spark, sf_dir))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark, documents(spark, sf_dir))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(spark, documents(spark, sf_dir))


def op9_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_bytes(spark, documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark, documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_repeated_lines, op3_benchmark_leaks, op4_mix, op5_repeated_words, op6_jaccard_join, op7_shards, op8_language, op9_repeated_bytes, op10_quality_rules)}


def oracle_sql() -> dict[str, str]:
    return {"op2_repeated_lines": LINES_SQL, "op4_mix": MIX_SQL}
