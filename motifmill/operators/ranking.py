"""Ranks and running totals over groups of any size: no group has to fit one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifmill.plans.storage import materialize

#: Values of the ordering column that one range of a running total stands for.
FAN = 1024


def running(df: DataFrame, keys: list[str], at: str, value: str, name: str, how: Callable[[Column], Column] = F.sum, *, inclusive: bool = False, fan: int = FAN) -> DataFrame:
    """``df`` with the sum (or least, greatest value: ``how``) of ``value`` over the rows of its keys that come before by ``at``, or up to it.

    Two levels: a key's rows are cut into ranges of ``fan`` values of ``at`` (an integer),
    which are summed up first; totals of the ranges before are joined to each range,
    which alone is a window. The largest task holds a range's rows, or one row for
    each range of a key. Null where nothing comes before.
    """
    ranged = df.withColumn("_range", F.expr(f"`{at}` div {fan}"))
    totals = ranged.groupBy(*keys, "_range").agg(how(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "_range", how("_total").over(before).alias("_carry"))
    inside = Window.partitionBy(*keys, "_range").orderBy(at).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    both = ranged.join(carried, [*keys, "_range"]).withColumn("_own", how(value).over(inside))
    # an aggregate of the two that passes over nulls
    met = {F.sum: F.coalesce(F.col("_own") + F.col("_carry"), "_own", "_carry"), F.min: F.least("_own", "_carry"), F.max: F.greatest("_own", "_carry")}[how]
    return both.withColumn(name, met).drop("_range", "_carry", "_own")


def ranked(rows: DataFrame, outer: list[str], inner: list[str], tie: list[str], keep: list[str]) -> DataFrame:
    """``keep`` columns, rank (rows of the same ``outer`` with smaller ``inner``) and tied (does another row share both?) of every row.

    Rows are range-partitioned and sorted by all of the columns, ``tie`` last, so a group
    of equal keys spreads over as many partitions as it needs. One pass gives every
    row its place inside its partition; what a partition's first groups have in the
    partitions before it is known from two rows of each. Keys must not be null.
    """
    names = [*(f"o{k}" for k in range(len(outer))), *(f"i{k}" for k in range(len(inner))), *(f"k{k}" for k in range(len(keep)))]
    sorted_ = rows.orderBy(*outer, *inner, *tie).select(*outer, *inner, *keep).toDF(*names)
    n_outer, n_keys = len(outer), len(outer) + len(inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        held: pa.RecordBatch | None = None  # the last row, whose next one is not known yet
        lo = lg = 0
        same_before = False

        def out(batch: pa.RecordBatch, los: np.ndarray, lgs: np.ndarray, ties: np.ndarray, first: int, edges: list[int]) -> pa.RecordBatch:
            n = batch.num_rows
            keys = [None] * n
            for k in edges:
                key = [c[k].as_py() for c in batch.columns[:n_keys]]
                keys[k] = pickle.dumps((key[:n_outer], key[n_outer:]))
            return pa.RecordBatch.from_arrays([*batch.columns[n_keys:], pa.array(np.full(n, part, np.int32)), pa.array(np.arange(first, first + n)), pa.array(los), pa.array(lgs), pa.array(ties), pa.array(keys, pa.binary())], [*names[n_keys:], "part", "at", "lo", "lg", "tied", "edge"])

        for batch in batches:
            if not batch.num_rows:
                continue
            had = held is not None
            whole = pa.Table.from_batches([held, batch] if had else [batch]).combine_chunks().to_batches()[0]
            n = whole.num_rows
            apart = [np.asarray(pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False), bool) if n > 1 else np.zeros(0, bool) for c in whole.columns[:n_keys]]
            new_outer = np.logical_or.reduce(apart[:n_outer], axis=0) if n_outer else np.zeros(n - 1, bool)
            new_inner = np.logical_or.reduce([new_outer, *apart[n_outer:]], axis=0)
            place = np.arange(seen, seen + n)
            los = np.maximum.accumulate(np.append(lo, np.where(new_outer, place[1:], 0)))
            lgs = np.maximum.accumulate(np.append(lg, np.where(new_inner, place[1:], 0)))
            ties = np.append(same_before, ~new_inner)
            ties[:-1] |= ~new_inner
            if n > 1:
                yield out(whole.slice(0, n - 1), los[:-1], lgs[:-1], ties[:-1], seen, [0] if seen == 0 else [])
            held, seen, lo, lg = whole.slice(n - 1, 1), seen + n - 1, int(los[-1]), int(lgs[-1])
            same_before = bool(~new_inner[-1]) if n > 1 else same_before
        if held is not None:
            yield out(held, np.array([lo]), np.array([lg]), np.array([same_before]), seen, [0])

    kinds = {f.name: f.dataType.simpleString() for f in sorted_.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in names[n_keys:]) + ", part int, at long, lo long, lg long, tied boolean, edge binary"
    held = materialize(sorted_.mapInArrow(run, schema), "ranked")
    parts = _carries([(r.part, r.at, r.lo, r.lg, *pickle.loads(r.edge)) for r in held.where("edge is not null").select("part", "at", "lo", "lg", "edge").collect()])  # two rows a partition
    carried = rows.sparkSession.createDataFrame(parts, "part int, carry long, carry_rank long, last long, after boolean")
    met = held.join(F.broadcast(carried), "part")  # one row a partition
    leads = (F.col("lg") == 0) & F.col("carry_rank").isNotNull()
    rank = F.when(leads, F.col("carry_rank")).when(F.col("lo") == 0, F.col("lg") + F.col("carry")).otherwise(F.col("lg") - F.col("lo"))
    tied = F.col("tied") | leads | ((F.col("lg") == F.col("last")) & F.col("after"))
    return met.select(*[F.col(f"k{k}").alias(c) for k, c in enumerate(keep)], rank.alias("rank"), tied.alias("tied"))


def _carries(edges: list[tuple]) -> list[tuple]:
    """(part, rows of its first outer group before it, rank of its first inner group if that began before it, place of its last inner group, does that go on behind it?)."""
    by_part: dict[int, list[tuple]] = {}
    for e in edges:
        by_part.setdefault(e[0], []).append(e)
    out: list[list] = []
    before = None  # outer and inner key of the last row so far, rows of that outer group, rank of that inner one
    for part in sorted(by_part):
        (_, _, _, _, outer, inner), (_, at, lo, lg, last_outer, last_inner) = min(by_part[part], key=lambda e: e[1]), max(by_part[part], key=lambda e: e[1])
        goes_on = before is not None and before[0] == outer
        same = goes_on and before[1] == inner
        carry, rank = before[2] if goes_on else 0, before[3] if same else None
        if out:
            out[-1][4] = same
        out.append([part, carry, rank, lg, False])
        now = rank if lg == 0 and same else lg + carry if lo == 0 else lg - lo
        before = (last_outer, last_inner, carry + at + 1 if lo == 0 else at + 1 - lo, now)
    return [tuple(o) for o in out]
