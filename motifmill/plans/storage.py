"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Frees the shuffle files of a write as soon as that write has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch on its way to a Python worker, whose memory it multiplies.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)
#: Rows, and bytes of their values, up to which a dimension side may be broadcast; larger sides are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 16 << 20
#: A size estimate from which on Catalyst knows nothing.
UNKNOWN_BYTES = 1 << 50

_made: list[tuple[SparkSession, str]] = []
_tables: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local folder stands in for it only where driver and executors are one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="motifmill-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches small: rows may hold very long texts."""
    sizes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils
    now = sizes.byteStringAsBytes(str(spark.conf.get(BATCH[0])))
    if now <= 0 or now > BATCH[1]:
        spark.conf.set(*BATCH)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor loses no part of the table, and the
    shuffle files behind it can go as soon as it is written.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, label: str) -> str:
    """A path of one's own in the shared folder, deleted like the tables that ``materialize`` makes."""
    path = f"{shared_dir(spark)}/motifmill/{uuid.uuid4().hex}-{label}"
    _made.append((spark, path))
    return path


def bucketed(df: DataFrame, label: str, columns: list[str], buckets: int) -> DataFrame:
    """Write ``df`` as a table in the shared folder whose rows are dealt into buckets by ``columns`` and sorted by them: joins on just these columns do not shuffle it again."""
    spark = df.sparkSession
    path = scratch(spark, label)
    name = f"motifmill_{uuid.uuid4().hex}"
    # a task writes one bucket, else each task writes a file for every bucket
    df.repartition(buckets, *columns).write.format("parquet").bucketBy(buckets, *columns).sortBy(*columns).option("path", path).saveAsTable(name)
    _tables.append((spark, name))
    return spark.table(name)


def discard(df: DataFrame) -> None:
    """Delete a table made by ``materialize`` that no later plan reads."""
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        for made in [m for m in _made if path.endswith(m[1].split(":", 1)[-1].lstrip("/"))]:
            _delete(*made)
            _made.remove(made)


@contextmanager
def temporary() -> Iterator[None]:
    """Tables that ``materialize`` makes inside go at the end: for work whose result is written or collected inside."""
    before = len(_made)
    try:
        yield
    finally:
        for made in _made[before:]:
            _delete(*made)
        del _made[before:]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clear() -> None:
    for spark, name in _tables:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # noqa: BLE001, S112  the session may have ended
            continue
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001, S112  the session may have ended; the files are only temporary
            continue


def file_state(df: DataFrame) -> tuple[tuple[str, int, int], ...]:
    """Names, sizes and modification times of the files that ``df`` reads, by Spark's file system; no job runs."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(out)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a materialised dimension for broadcast if its counted rows and bytes allow it; else leave the join to shuffle."""
    return F.broadcast(df) if is_small(df, rows, size) else df


def counted_side(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """As ``small_side``, but a larger side is not broadcast whatever Catalyst estimates."""
    return F.broadcast(df) if is_small(df, rows, size) else shuffled_side(df)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Do the counted rows and bytes of ``df`` allow a broadcast?"""
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()
    return n <= rows and total <= size


def shuffled_side(df: DataFrame) -> DataFrame:
    """Mark a side of a join that must not be broadcast: Catalyst takes a written table's compressed bytes for its size, which in the driver is many times that."""
    return df.hint("merge")


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row's strings and binaries, and 16 for each column and each element of an array."""
    wide = [F.octet_length(F.col(f"`{f.name}`")) for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    arrays = [f for f in df.schema if isinstance(f.dataType, T.ArrayType)]
    wide += [F.greatest(F.size(F.col(f"`{f.name}`")), F.lit(0)) * 16 for f in arrays]
    wide += [F.octet_length(F.array_join(f"`{f.name}`", "")) for f in arrays if isinstance(f.dataType.elementType, T.StringType)]
    return sum((F.coalesce(c, F.lit(0)) for c in wide), F.lit(16 * len(df.columns)).cast("long"))


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df``, for which no job runs; where it knows nothing (it then says exabytes), the rows' bytes are summed."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < UNKNOWN_BYTES else df.agg(F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()[0]


def bucket_count(df: DataFrame, bytes_each: int, least: int = 16) -> int:
    """Power of two so that a hash bucket of ``df`` stands for at most ``bytes_each`` of the stored input, however large that is."""
    need = max(1, -(-input_bytes(df) // bytes_each))
    return max(least, 1 << (need - 1).bit_length())
