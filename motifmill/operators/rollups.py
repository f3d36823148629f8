"""Counts of k-mers rolled up over the columns of the texts that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifmill.operators.suffix import positions


def kmer_counts_by(texts: DataFrame, groups: DataFrame, dims: list[str], k: int = 2) -> DataFrame:
    """dims, kmer, n: how often each k-mer occurs in the texts (contig_id, seq) of a group (contig_id, dims).

    Places are summed up to one row for a contig and k-mer before the groups are joined, so
    neither the join nor what follows grows with the texts' length.
    """
    own = positions(texts, k).where(~F.col("head").contains("$") & (F.length("head") == k)).groupBy("contig_id", F.col("head").alias("kmer")).agg(F.count(F.lit(1)).alias("n"))
    return own.join(groups.select("contig_id", *dims), "contig_id").groupBy(*dims, "kmer").agg(F.sum("n").alias("n"))


def rolled_up(counts: DataFrame, dims: list[str], every: bool = False) -> DataFrame:
    """dims, level, n: totals over the leading columns of ``dims``, or over every subset of them (``every``).

    level tells a total from a group whose own value is null: a bit for each column of
    ``dims``, the first one highest, set where the column is summed over. counts: dims, n,
    grouped already, so that the rows that Spark repeats for each level are few.
    """
    grouped = counts.cube(*dims) if every else counts.rollup(*dims)
    return grouped.agg(F.grouping_id().cast("int").alias("level"), F.sum("n").alias("n"))
