"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from motifmill.llm import ann, decontaminate, licences, mixing, near_dedup, negatives, prefix_trie, quality, simhash, substring_dedup, suffix_dedup, tokens, url_filter
from motifmill.plans.storage import bounded_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_suffixes(_table(spark, sf_dir, "documents"), length=200)


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), labelled=_table(spark, sf_dir, "labels"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.dedup_near(_table(spark, sf_dir, "documents"), percent=85)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"), window=20)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), steps=None)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(_table(spark, sf_dir, "embeddings"), relabel="if(id % 7 = 0, (label + 1) % 10, label)")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(_table(spark, sf_dir, "conversations"))


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.dedup_simhash(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_nearest_neighbours, op2_suffix_dedup, op3_licences, op4_token_counts, op5_decontamination, op6_quality, op7_near_dedup, op8_substring_dedup, op9_mixing, op10_url_filter, op11_hard_negatives, op12_conversation_trie, op13_simhash_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": suffix_dedup.SUFFIX_SQL, "op7_near_dedup": near_dedup.NEAR_SQL, "op8_substring_dedup": substring_dedup.SUBSTRING_SQL, "op9_mixing": mixing.MIX_SQL, "op10_url_filter": url_filter.URL_SQL, "op11_hard_negatives": negatives.NEGATIVES_SQL, "op12_conversation_trie": prefix_trie.TRIE_SQL, "op13_simhash_dedup": simhash.SIMHASH_SQL}
