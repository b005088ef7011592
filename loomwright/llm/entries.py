"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontam import find_leaks
from .html_extract import extract_pages
from .mixing import mix_report, mix_sql
from .neardup import near_duplicates
from .quality import quality_report, quality_sql
from .sharding import ShardTree, shard_rows
from .substring import remove_repeats
from .suffix_dedup import remove_repeated_bytes
from .tokens import count_tokens
from .url_filter import judge, judge_sql

Query = Callable[[SparkSession, str], DataFrame]


def op1_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), ShardTree.uniform(2, 2, 2))


def op2_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents"), texts=False)


def op3_html_consensus_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op4_fixed_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), texts=False)


def op5_simhash_small_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_texts", "audited_recall")


def op6_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op7_line_first_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


def op8_water_filling_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op9_bpe_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    ops = [op1_hash_tree_shards, op2_prefix_free_parsing, op3_html_consensus_paths, op4_fixed_block_anchors, op5_simhash_small_world, op6_host_reputation, op7_line_first_quality, op8_water_filling_mix, op9_bpe_token_counts, op10_simhash_windows]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op6_host_reputation": judge_sql(), "op7_line_first_quality": quality_sql(), "op8_water_filling_mix": mix_sql()}
