"""From raw documents to a training mix: five stages, each one of the corpus operators.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it kept
and returns the columns of documents; the last one adds how often the mix takes a row.
Further columns pass through whatever their names, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifmill.llm import decontaminate, mixing, near_dedup, quality, substring_dedup
from motifmill.plans.storage import bounded_batches, discard, materialize


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go, and with them null, empty and blank texts; equal texts stay or go alike, null and repeated ids do not matter."""
    bounded_batches(spark)
    return quality.keep_good(docs, labelled=spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group that shares 80 % of its five-word shingles: the one with the smallest id, nulls first; of repeated rows one; null and empty texts all."""
    bounded_batches(spark)
    return near_dedup.keep_one_of_each(docs, percent=80, words=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 and more words stay where they occur first and are cut elsewhere; all rows stay, null texts as empty ones, n_chars as long as what is left."""
    bounded_batches(spark)
    cut = substring_dedup.cut_repeats(docs, window=20)
    if "n_chars" in cut.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(cut.schema["n_chars"].dataType))
    return cut


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, within its budget of edits, go; null and empty texts hold none, repeated rows stay or go alike."""
    bounded_batches(spark)
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: mix_copies says how often a document is taken, the others go, and with them texts without words; a null source is one, repeated rows are taken alike."""
    return mixing.mix_rows(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

#: Not expressible in SQL: tests/llm/test_pipeline.py holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)  # only what a stage has written
    return STAGES[-1][1](spark, docs, sf_dir)
