"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifmill.plans.storage import discard, materialize


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(uid, comp) of every end of ``links`` (a, b): comp is the smallest uid that can be reached.

    Alternating large-star and small-star rounds: every node hands its neighbours to
    its smallest neighbour, until only stars around the smallest nodes are left.
    Minima are aggregates with a partial step and the hand-over is an equi-join that
    AQE can split, so a node with very many neighbours does not meet them in one
    task. Each round is written out; nothing comes to the driver but a checksum.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = _mark(edges)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        done = edges
        edges = materialize(small.where("u <> v").distinct(), "small-star")
        discard(done)
        discard(large)
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"links did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("uid"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("uid"), F.col("v").alias("comp")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
