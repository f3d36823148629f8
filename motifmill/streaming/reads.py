"""Streams of reads against a fixed reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifmill.operators import search
from motifmill.operators.rank_search import RankBins
from motifmill.plans.storage import materialize, temporary


def seed_table(texts: DataFrame, k: int = 12) -> DataFrame:
    """seed, n: every k-mer of the texts and how often it occurs; written once, joined by every batch."""
    parts = search.chunks(texts, k, "contig_id", "seq")
    last = F.least(F.lit(search.chunk_size(k)), F.length("part") - k + 1)
    windows = parts.where(F.length("part") >= k).select("part", F.explode(F.sequence(F.lit(1), last)).alias("p"))
    return materialize(windows.groupBy(F.substring("part", F.col("p"), F.lit(k)).alias("seed")).agg(F.count(F.lit(1)).alias("n")), "seed-table")


def screen(reads: DataFrame, seeds: DataFrame, k: int = 12) -> DataFrame:
    """read_id, q, seeds_found: a stateless stream-static join on the read's first k symbols; 0 means that the read occurs nowhere."""
    return reads.withColumn("seed", F.substring("q", 1, k)).join(seeds, "seed", "left").select("read_id", "q", F.coalesce("n", F.lit(0)).alias("seeds_found"))


def count_stream(reads: DataFrame, texts: DataFrame | RankBins, path: str, checkpoint: str, longest: int = search.SAMPLED - 1):
    """Start a query that counts every micro-batch exactly and appends (read_id, q, n, batch) as Parquet.

    texts: the reference, or bins that were built (or loaded) for it, which every batch
    searches as they are. A reference is cut once, for reads of up to ``longest``
    symbols, and once more if others come that are below search.SAMPLED symbols; longer ones
    need no cut. What a batch writes on its way goes when the batch is written.
    Batches are independent: no state is kept, and a batch that is run again
    overwrites its own folder.
    """
    held = texts if isinstance(texts, RankBins) else search.Texts(texts)
    if isinstance(held, search.Texts):
        held.chunks(min(longest, search.SAMPLED - 1))

    def one(batch: DataFrame, number: int) -> None:
        if isinstance(held, search.Texts):
            most = batch.where(F.length("q") < search.SAMPLED).agg(F.max(F.length("q"))).first()[0] or 0
            if most > held.longest:
                held.chunks(search.SAMPLED - 1)
        with temporary():
            counts = held.count(batch) if isinstance(held, RankBins) else search.count_matches(held, batch)
            counts.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return reads.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
