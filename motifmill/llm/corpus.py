"""What the operators on whole corpora share: row keys, parts of the corpus, packed messages.

Facts about windows of text number far more than documents. They travel as packed
byte blocks, one per flush of a producer and hash bucket, instead of as rows of their
own, dealt by a uniform hash. Answers go back to the documents in the same way, by
part. Buckets and parts grow with the input, and so does what a producer holds
before it flushes, up to a fixed bound (``flush_at``): a block has some kilobytes while
there are up to 16 384 parts, 64 GB of stored input; beyond, blocks get smaller.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motifmill.llm import textscan as ts
from motifmill.plans.storage import bucket_count, materialize

U64 = np.uint64
#: Stored input that one part or bucket stands for.
PART_BYTES = 4 << 20


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: bool = False) -> tuple[DataFrame, bool]:
    """(uid, doc_id, text and, if asked for, the row itself as columns c0, c1, ...; is uid the id?).

    uid is a unique bigint that sorts as the id. Unique integer ids serve as they
    are. Otherwise (null, repeated or other ids) rows are numbered in the order of
    (id, nulls first; hash of the text; place in the input, so that a range of equal
    rows spreads over partitions): rows that share an id are documents of their own.
    A null text is empty.
    """
    held = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)] if rows else []
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *held)
    if isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        n, different = docs.select(F.col(id_col).alias("i")).agg(F.count(F.lit(1)), F.count_distinct("i")).first()
        if n == different:
            return base.withColumn("uid", F.col("doc_id").cast("long")), True
    placed = base.withColumn("place", F.monotonically_increasing_id())
    ordered = placed.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "place").drop("place")
    return materialize(ordered.withColumn("uid", F.monotonically_increasing_id()), "uids"), False


def part_count(docs: DataFrame) -> int:
    return bucket_count(docs, PART_BYTES)


def in_parts(docs: DataFrame, parts: int) -> DataFrame:
    return docs.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(parts)).cast("int"))


def part_of(uid: np.ndarray, parts: int) -> np.ndarray:
    """As in_parts() has it."""
    return np.mod(ts.xxhash64_long(uid), parts)


def flush_at(parts: int, least: int, each: int, most: int) -> int:
    """Entries that a producer holds before it flushes: ``each`` for every part, within bounds."""
    return min(most, max(least, parts * each))


BLOCKS = "at int, kind int, payload binary"


_libc = ctypes.CDLL(None)


def release() -> None:
    """Give the memory of the group just done back to the system; a worker lives on with many others beside it."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def blocks(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    release()
    at, kind, payload = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())], ["at", "kind", "payload"])


def pack(fields: dict[str, np.ndarray]) -> bytes:
    """Columns of one length, one after the other; ascending columns as differences, which compress well."""
    n = len(next(iter(fields.values())))
    return np.int64(n).tobytes() + b"".join(np.ascontiguousarray(x).tobytes() for x in fields.values())


def unpack(payloads: list[bytes], kinds: dict[str, str]) -> dict[str, np.ndarray]:
    out: dict[str, list[np.ndarray]] = {k: [] for k in kinds}
    for raw in payloads:
        n, at = int(np.frombuffer(raw, np.int64, 1)[0]), 8
        for k, kind in kinds.items():
            x = np.frombuffer(raw, kind, n, at)
            out[k].append(x)
            at += x.nbytes
    return {k: np.concatenate(v) if v else np.zeros(0, kinds[k]) for k, v in out.items()}


def split_by(key: np.ndarray, parts: int, fields: dict[str, np.ndarray]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """(key, rows of that key in their order) for keys 0 to parts - 1 that occur."""
    order = np.argsort(key.astype(np.uint16) if parts <= 1 << 16 else key, kind="stable")
    cuts = np.searchsorted(key[order], np.arange(parts + 1))
    moved = {k: v[order] for k, v in fields.items()}
    for i in np.flatnonzero(np.diff(cuts)):
        yield int(i), {k: v[cuts[i] : cuts[i + 1]] for k, v in moved.items()}


def payloads(table: pa.Table, kind: int) -> list[bytes]:
    kinds = table.column("kind").to_numpy()
    column = table.column("payload")
    return [column[int(i)].as_py() for i in np.flatnonzero(kinds == kind)]


def long_to_bytes6(h: np.ndarray) -> np.ndarray:
    """The low 48 bits, 6 bytes each."""
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :6]


def bytes6_to_long(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(U64).ravel()


def group_in_arrow(df: DataFrame, fn, schema: str, key: str = "at") -> DataFrame:
    """fn(table) for all blocks of a key."""
    return df.groupBy(key).applyInArrow(fn, schema)


def doc_table(table: pa.Table) -> tuple[np.ndarray, pa.Array]:
    text = table.column("text")
    return table.column("uid").to_numpy(), text.combine_chunks() if text.num_chunks != 1 else text.chunk(0)


def as_array(column: pa.ChunkedArray, kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays([c.cast(kind) for c in column.chunks]) if column.num_chunks else pa.array([], kind)
