"""Run metrics, consistency checks and read-set statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from motifmill.plans.storage import small_side
from motifmill.sources.sequences import global_index


def quotient(x: Column, y: Column) -> Column:
    """x / y as floating point has it: infinite, or no number for 0 / 0, where y is 0, which Spark takes for an error."""
    x, y = x.cast("double"), y.cast("double")
    return F.when(y != 0, x / y).when(y == 0, F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).when(x == 0, F.lit(float("nan"))).otherwise(x))


def run_metrics(runs: DataFrame, *, group: str, order: list[str], run: str, secs: str) -> DataFrame:
    """Per group, without its first run (the warm-up): runs, least, mean and most seconds, the first run with the least and the most, spread.

    spread is the population standard deviation in percent of the mean. One sum with
    partial aggregation: the warm-up is found by an aggregate, not by numbering runs.
    """
    key = F.struct(*order)
    first = runs.groupBy(group).agg(F.min(key).alias("warm_up"))
    rest = runs.join(small_side(first), group).where(key != F.col("warm_up"))
    out = rest.groupBy(group).agg(
        F.count(F.lit(1)).alias("runs"),
        F.min(secs).alias("least"),
        F.avg(secs).alias("mean"),
        F.max(secs).alias("most"),
        F.min(F.struct(secs, *order, F.col(run).alias("_which")))["_which"].alias("least_run"),
        F.min(F.struct((-F.col(secs)).alias("s"), *order, F.col(run).alias("_which")))["_which"].alias("most_run"),
        F.stddev_pop(secs).alias("sd"),
    )
    return out.select(group, "runs", F.round("least", 6).alias("least"), F.round("mean", 6).alias("mean"), F.round("most", 6).alias("most"), "least_run", "most_run", F.round(quotient(100 * F.col("sd"), F.col("mean")), 4).alias("spread"))


def throughput(runs: DataFrame, *, group: str, order: list[str], secs: str, ops: str) -> DataFrame:
    """Per group: agree (did all runs do the same operations?), raw (all operations by all seconds), best and mean (one run's operations by the least and the mean seconds, without the first run).

    In thousands of millions a second; infinite for no seconds. Runs that disagree have no rates: null.
    """
    key = F.struct(*order)
    every = runs.groupBy(group).agg((F.min(ops) == F.max(ops)).alias("agree"), F.min(key).alias("warm_up"), F.max(ops).alias("ops"), quotient(F.sum(ops), F.sum(secs)).alias("all"))
    rest = runs.join(small_side(every.select(group, "warm_up")), group).where(key != F.col("warm_up")).groupBy(group).agg(F.min(secs).alias("least"), F.avg(secs).alias("mean_secs"))
    rate = lambda x: F.when(F.col("agree"), F.round(x / 1e9, 9))
    return every.join(rest, group, "left").select(group, "agree", rate(F.col("all")).alias("raw"), rate(quotient(F.col("ops"), F.col("least"))).alias("best"), rate(quotient(F.col("ops"), F.col("mean_secs"))).alias("mean"))


def all_equal(runs: DataFrame, group: str, value: str) -> DataFrame:
    """Does every run of a group give the same value?"""
    return runs.groupBy(group).agg((F.min(value) == F.max(value)).alias("consistent"))


def counter_means(samples: DataFrame, counter: str, value: str) -> DataFrame:
    """Whole-number mean of each counter."""
    return samples.groupBy(counter).agg(F.expr(f"sum({value}) div count({value})").alias("mean"))


def per_thousand(samples: DataFrame, counter: str, value: str, part: str, whole: str) -> DataFrame:
    """ratio: a thousand times the whole-number mean of one counter by that of another, such as branch misses per thousand instructions; null without samples of both."""
    mean = lambda name: F.expr(f"sum(if({counter} = '{name}', {value}, null)) div count(if({counter} = '{name}', {value}, null))")
    return samples.agg(F.round(1000 * mean(part) / mean(whole), 6).alias("ratio"))


def ntile_blocks(df: DataFrame, order: str, tiles: int) -> DataFrame:
    """NTILE over the whole order from global row numbers: the first rows % tiles blocks get one row more."""
    numbered = global_index(df.select(order), [order], "row")
    n = numbered.count()
    q, r = divmod(n, tiles)
    cut = r * (q + 1)
    row = F.col("row")
    return numbered.select(order, (F.when(row < cut, F.floor(row / (q + 1))).otherwise(r + F.floor((row - cut) / max(q, 1))) + 1).cast("int").alias("block"))


def written_counts(counts: DataFrame, path: str) -> dict[str, int]:
    """Write counts (read_id, q, n) and say, from the same job, how many reads and symbols it saw and how many occurrences it counted: n_reads, bases, total."""
    seen = Observation("counts")
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    watched = counts.observe(seen, F.count(F.lit(1)).alias("n_reads"), whole(F.length("q")).alias("bases"), whole("n").alias("total"))
    watched.write.mode("overwrite").parquet(path)
    return seen.get
