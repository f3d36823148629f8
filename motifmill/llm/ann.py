"""Nearest neighbours by cross-polytope hashing.

A table rotates unit vectors with random sign flips and fast Hadamard transforms,
three times in turn, and assigns each to the signed axis it lies nearest to. A
bucket is that axis, or the axes of ``depth`` such rotations together. Every vector is
indexed in every table. A query looks into the ``probes`` buckets of each table
whose axes it is nearest to, and all candidates found are ranked by their exact
cosine on the original vectors.

Equal vectors are equally near to anything, so of each vector the k + 1 smallest ids
are candidates enough, and queries with equal vectors are asked once: a vector that a
third of all rows hold costs as much as one that k + 1 hold. Codes are made once and
written; buckets are counted by them. Only buckets that a query looks into are
dealt out, large ones in blocks of rows and of queries, both by a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motifmill.llm import textscan as ts
from motifmill.plans.storage import discard, materialize, small_side

TABLES, ROUNDS = 8, 3
#: Probes of a table by depth, and rows of a mean bucket from which on a table is one level deeper.
PROBES, DEEPER = (14, 200, 2000), 1 << 16
#: Rows and queries of a block.
BLOCK, ASKED = 4096, 1024
_SLACK = 1e-9
_RUN = 4096


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the columns, whose length is a power of two, scaled to keep lengths."""
    width, h = len(x), 1
    while h < width:
        y = x.reshape(width // (2 * h), 2, h, -1)
        x = np.stack([y[:, 0] + y[:, 1], y[:, 0] - y[:, 1]], 1).reshape(width, -1)
        h *= 2
    return x * x.dtype.type(width**-0.5)


def _rotated(unit: np.ndarray, table: int, level: int) -> np.ndarray:
    """Pseudo-random rotation of the rows, padded to a power of two, as columns."""
    width = 1 << max(0, unit.shape[1] - 1).bit_length()
    x = np.zeros((width, len(unit)), unit.dtype)
    x[: unit.shape[1]] = unit.T
    for r in range(ROUNDS):
        seed = np.uint64(((table * 64 + level) * 64 + r + 1) << 32)
        signs = np.where(ts.mix(np.arange(width, dtype=np.uint64) + seed) >> np.uint64(63), -1.0, 1.0).astype(unit.dtype)
        x = hadamard(x * signs[:, None])
    return x


def rotations(unit: np.ndarray, table: int, level: int) -> np.ndarray:
    """Rotated rows on signed axes in columns (+0, -0, +1, -1, ...)."""
    x = _rotated(unit, table, level).T
    return np.stack([x, -x], 2).reshape(len(x), -1)


def own_bucket(unit: np.ndarray, table: int, depth: int) -> np.ndarray:
    """The best bucket of every row."""
    code = np.zeros(len(unit), np.int64)
    for lo in range(0, len(unit), _RUN):
        for level in range(depth):
            x = _rotated(unit[lo : lo + _RUN], table, level)
            axis = np.abs(x).argmax(axis=0)
            own = 2 * axis + (x[axis, np.arange(x.shape[1])] < 0)
            code[lo : lo + _RUN] = code[lo : lo + _RUN] * (2 * len(x)) + own
    return code


def buckets(unit: np.ndarray, table: int, depth: int, probes: int) -> np.ndarray:
    """The ``probes`` best buckets of every row, nearest first."""
    score, code = np.zeros((len(unit), 1), unit.dtype), np.zeros((len(unit), 1), np.int64)
    for level in range(depth):
        axes = rotations(unit, table, level)
        take = min(probes, axes.shape[1])
        best = np.argsort(-axes, axis=1, kind="stable")[:, :take]
        score = (score[:, :, None] + np.take_along_axis(axes, best, 1)[:, None, :]).reshape(len(unit), -1)
        code = (code[:, :, None] * axes.shape[1] + best[:, None, :]).reshape(len(unit), -1)
        keep = np.argsort(-score, axis=1, kind="stable")[:, :probes]
        score, code = np.take_along_axis(score, keep, 1), np.take_along_axis(code, keep, 1)
    return code


def _valid(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors as doubles) by dimension, without those that take no part."""
    ids, column = batch.column(0), batch.column(1)
    here = np.flatnonzero(~(np.asarray(ids.is_null()) | np.asarray(column.is_null())))
    if not len(here):
        return
    column = column.take(pa.array(here))
    ids = ids.take(pa.array(here)).to_numpy(zero_copy_only=False)
    sizes = np.asarray(column.value_lengths())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes)
    for d in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == d)
        x = values[(ends[rows] - d)[:, None] + np.arange(d)]
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        if good.any():
            yield ids[rows][good], x[good]


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors scaled by powers of two, which changes no digit of a cosine, and their lengths."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x, np.sqrt((x * x).sum(axis=1))


def _units(x: np.ndarray) -> np.ndarray:
    scaled, length = _scaled(x)
    return (scaled / length[:, None]).astype(np.float32)


def _packed(kind: str):
    """Arrow function: id, vector -> dim, id, vec (the components' bytes), each pair of a batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in _valid(batch):
                raw = [v.tobytes() for v in x.astype(kind)]
                pairs = dict.fromkeys(zip(ids.tolist(), raw, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), x.shape[1]), pa.int32()), pa.array([i for i, _ in pairs], pa.int64()), pa.array([v for _, v in pairs], pa.binary())], ["dim", "id", "vec"])

    return run


def _coded(kind: str, codes_of):
    """Arrow function: dim, id, vec -> the same and codes (a row's buckets, ``probes`` of each table after the other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                for lo in range(0, part.num_rows, _RUN):
                    own = part.slice(lo, _RUN)
                    codes = codes_of(_units(_vectors(own.column(2), int(d), kind)))
                    ends = pa.array(np.arange(len(codes) + 1) * codes.shape[1], pa.int32())
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.ListArray.from_arrays(ends, pa.array(codes.ravel(), pa.int64()))], ["dim", "id", "vec", "codes"])

    return run


def _vectors(column: pa.Array | pa.ChunkedArray, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.float64)


def _nearest(k: int, kind: str):
    """Rows and queries of one block -> each query's k best there, exactly ranked."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        none = pa.table({"query": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not rows.num_rows or not asked.num_rows:
            return none
        dim = int(rows.column("dim")[0].as_py())
        read = lambda t: (t.column("id").to_numpy(), *_scaled(_vectors(t.column("vec"), dim, kind)))
        ids, x, length = read(rows)
        unit = x / length[:, None]
        out = []
        for lo in range(0, asked.num_rows, 512):
            qid, q, qlength = read(asked.slice(lo, 512))
            near = (q / qlength[:, None]) @ unit.T
            take = min(len(ids), k + 8)
            best = np.argpartition(-near, take - 1, axis=1)[:, :take]
            rough = np.take_along_axis(near, best, 1)
            kth = -np.sort(-rough, axis=1)[:, min(k, take) - 1]
            for i in range(len(qid)):
                # among equals the order of the matrix product says nothing: all within the slack are ranked exactly
                pick = best[i] if rough[i].min() < kth[i] - _SLACK else np.flatnonzero(near[i] >= kth[i] - _SLACK)
                score = (x[pick] * q[i]).sum(axis=1) / (length[pick] * qlength[i])
                top = np.lexsort((ids[pick], -score))[:k]
                out.append((np.full(len(top), qid[i]), ids[pick][top], score[top]))
        qid, vid, score = (np.concatenate(v) for v in zip(*out, strict=True))
        return pa.table({"query": pa.array(qid, pa.int64()), "vec_id": pa.array(vid, pa.int64()), "score": pa.array(score, pa.float64())})

    return run


def depth_for(rows: int, dim: int) -> int:
    """Levels of a table, so that the mean bucket has at most DEEPER rows."""
    axes, depth = 2 << max(0, dim - 1).bit_length(), 1
    while depth < len(PROBES) and rows > DEEPER * axes**depth:
        depth += 1
    return depth


def nearest(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = 5, tables: int = TABLES, probes: int | None = None, depth: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: of each row whose id is divisible by ``every`` the k nearest other rows found.

    Nearness is the cosine in double precision on the original vectors, ties go to
    the smaller id. Rows with a null id, and vectors that are null, empty, zero or
    hold null or non-finite components, take no part; vectors of different length do
    not meet. Rows that share an id count as one candidate with the best of their
    scores, and as one query. A query that finds fewer than k looks into every bucket
    of the first table, so that small tables give all candidates. An empty table gives
    no rows; other columns, whatever their names, are not read. ``depth`` and ``probes``
    go by the number of different vectors, if not given.
    """
    kind = "<f4" if vectors.schema[vec_col].dataType.elementType.simpleString() == "float" else "<f8"
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    packed = materialize(base.mapInArrow(_packed(kind), "dim int, id long, vec binary"), "vectors")
    # of equal vectors the k + 1 smallest ids; as a limit by group most go before the shuffle
    place = F.dense_rank().over(Window.partitionBy("dim", "vec").orderBy("id"))
    rows = packed.withColumn("place", place).where(F.col("place") <= k + 1).drop("place").distinct()
    queries = packed.where(F.col("id") % every == 0)
    sizes = {r[0]: r[1] for r in packed.groupBy("dim").agg(F.approx_count_distinct("vec").alias("n")).collect()}  # one row a length of vectors
    if depth is None:
        depth = depth_for(max(sizes.values(), default=0), max(sizes, default=1))
    probes = PROBES[depth - 1] if probes is None else probes
    coded = "dim int, id long, vec binary, codes array<long>"
    index = materialize(rows.mapInArrow(_coded(kind, lambda x: np.stack([own_bucket(x, t, depth) for t in range(tables)], 1)), coded), "index-codes")
    heads = queries.groupBy("dim", "vec").agg(F.min("id").alias("id")).select("dim", "id", "vec")
    asked = materialize(heads.mapInArrow(_coded(kind, lambda x: np.concatenate([buckets(x, t, depth, probes) for t in range(tables)], 1)), coded), "query-codes")
    key = ["dim", "tbl", "bucket"]
    entries = index.select("dim", "id", "vec", F.posexplode("codes").alias("tbl", "bucket"))
    width = F.size("codes") / tables  # short vectors have fewer axes than probes
    questions = asked.select("dim", "id", "vec", width.alias("width"), F.posexplode("codes").alias("at", "bucket")).select("dim", "id", "vec", F.floor(F.col("at") / F.col("width")).cast("int").alias("tbl"), "bucket")
    held = entries.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))

    def look(questions: DataFrame, entries: DataFrame, label: str) -> DataFrame:
        wanted = questions.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("asking"))
        blocks = materialize(held.join(wanted, key).select(*key, "asking", F.ceil(F.col("n") / BLOCK).cast("int").alias("pieces")), "bucket-blocks")
        deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
        data = entries.join(small_side(blocks), key).withColumn("i", deal("pieces")).withColumn("j", every("asking")).select(*key, "i", "j", "id", "vec")
        other = blocks.toDF(*(f"q_{c}" for c in blocks.columns))  # a cogroup needs column identities of its own on each side
        sent = questions.toDF("q_dim", "id", "vec", "q_tbl", "q_bucket").join(small_side(other), [f"q_{c}" for c in key]).withColumn("q_j", deal("q_asking")).withColumn("q_i", every("q_pieces"))
        found = data.groupBy(*key, "i", "j").cogroup(sent.groupBy(*(f"q_{c}" for c in key), "q_i", "q_j")).applyInArrow(_nearest(k + 1, kind), "query long, vec_id long, score double")
        return materialize(found.groupBy("query", "vec_id").agg(F.max("score").alias("score")), label)

    found = look(questions, entries, "neighbours")
    few = asked.join(found.groupBy(F.col("query").alias("id")).agg(F.count(F.lit(1)).alias("n")), "id", "left").where(F.coalesce("n", F.lit(0)) <= k).select("dim", "id", "vec")
    few = materialize(few, "short-queries")
    if not few.isEmpty():
        # every bucket of the first table, as the counts list them
        first = materialize(held.where("tbl = 0").select("dim", "tbl", "bucket"), "first-table")
        everywhere = few.join(small_side(first), "dim").select("dim", "id", "vec", "tbl", "bucket")
        more = look(everywhere, entries.where("tbl = 0"), "more-neighbours")
        found = materialize(found.unionByName(more).groupBy("query", "vec_id").agg(F.max("score").alias("score")), "all-neighbours")
    # every query with a vector of this length and these components gets what was found for the first one
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = materialize(found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place"), "best-neighbours")
    discard(found)
    owner = queries.select("dim", "vec", F.col("id").alias("query_id")).distinct().join(heads.withColumnRenamed("id", "query"), ["dim", "vec"]).select("query_id", "query")
    all_found = owner.join(top, "query").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return all_found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_nearest(ids: np.ndarray, x: np.ndarray, every: int = 50, k: int = 5) -> dict[int, list[tuple[int, float]]]:
    """Brute force over valid vectors in memory, to measure recall against."""
    x, length = _scaled(x)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = (x * x[i]).sum(axis=1) / (length * length[i])
        score[ids == ids[i]] = -np.inf
        top = np.lexsort((ids, -score))[:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in top if score[j] > -np.inf]
    return out
