"""FASTA as a data source: ``spark.read.format("fasta").load(path)`` after ``register(spark)``.

Files are read in byte ranges, a task for each, or for many where they are small; a record belongs to the range in which
its header begins, and is read on beyond the range's end. A task holds one record and a
block of its file at a time. Paths are what pyarrow's file systems open (local and
shared folders, HDFS, object stores), a file, a folder or a pattern; for a store that only
Spark's own readers reach, use ``sequences.read_fasta``.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, of a block that is read at a time, and of the records of one batch.
RANGE_BYTES, BLOCK_BYTES, BATCH_BYTES = 64 << 20, 1 << 20, 4 << 20
#: Bytes that a task reads if its ranges are smaller, and what opening a file counts as.
TASK_BYTES, OPEN_BYTES = 1 << 20, 1 << 14
SCHEMA = "path string, offset long, header string, q string"
_ARROW = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("header", pa.string()), ("q", pa.string())])


@dataclass
class ByteRanges(InputPartition):
    """(path, start, end) of the ranges that one task reads."""

    ranges: list[tuple[str, int, int]]


def _opened(path: str):
    """(file system, the path as it names it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """Path and size of what a path names; hidden files of a folder are none of it."""
    from pyarrow import fs

    system, name = _opened(path)
    folder, _, pattern = name.rpartition("/")
    if any(c in pattern for c in "*?["):
        found = [i for i in system.get_file_info(fs.FileSelector(folder)) if fnmatch.fnmatch(i.base_name, pattern)]
    else:
        found = [system.get_file_info(name)]
        if found[0].type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if found[0].type == fs.FileType.Directory:
            found = [i for i in system.get_file_info(fs.FileSelector(name, recursive=True)) if not i.base_name.startswith((".", "_"))]
    scheme = path[: path.index(name)] if name in path else ""
    return sorted((scheme + i.path, i.size) for i in found if i.type == fs.FileType.File)


def _lines(file, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its end) from ``at`` on, where a line begins; ``size`` bytes are read at a time."""
    held: list[bytes] = []  # of a line that goes over blocks
    begin = at
    file.seek(at)
    while block := file.read(size):
        lo = 0
        while (hi := block.find(b"\n", lo)) >= 0:
            yield begin, b"".join([*held, block[lo:hi]])
            held, begin, lo = [], at + hi + 1, hi + 1
        held.append(block[lo:])
        at += len(block)
    if any(held):
        yield begin, b"".join(held)


def records(file, start: int, end: int) -> Iterator[tuple[int, str, str | None]]:
    """(offset, header, symbols or None) of the records whose header begins from ``start`` to ``end`` - 1; headers are lines that begin with '>'."""
    at, size = start, min(BLOCK_BYTES, max(end - start, 1 << 12))  # a small range reads little beyond its end
    if start:  # a line that begins before the range is the range before's
        at = next((o + len(line) + 1 for o, line in _lines(file, start - 1, size)), start)
    header: tuple[int, str] | None = None
    parts: list[bytes] = []
    whole = lambda: (*header, "".join(b"".join(parts).decode("utf-8", "replace").split()) or None)
    for offset, line in _lines(file, at, size):
        if line.startswith(b">"):
            if header is not None:
                yield whole()
            header, parts = None, []
            if offset >= end:
                return
            header = offset, line[1:].rstrip(b"\r").decode("utf-8", "replace")
        elif header is not None:
            parts.append(line)
        elif offset >= end:
            return
    if header is not None:
        yield whole()


class FastaReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[ByteRanges]:
        """Ranges of TASK_BYTES in all, or one larger range, are a task: tasks do not grow in number as ranges get small."""
        tasks: list[list[tuple[str, int, int]]] = [[]]
        held = 0
        for path, size in _files(self.path):
            held += OPEN_BYTES
            for lo in range(0, size, self.range_bytes):
                one = path, lo, min(lo + self.range_bytes, size)
                if tasks[-1] and held + one[2] - lo > TASK_BYTES:
                    tasks.append([])
                    held = OPEN_BYTES
                tasks[-1].append(one)
                held += one[2] - lo
        return [ByteRanges(t) for t in tasks]

    def read(self, partition: ByteRanges) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for path, ranges in groupby(partition.ranges, key=lambda r: r[0]):
            system, name = _opened(path)
            with system.open_input_file(name) as file:
                for _, start, end in ranges:
                    for offset, header, q in records(file, start, end):
                        rows.append((path, offset, header, q))
                        held += len(header) + len(q or "")
                        if held >= BATCH_BYTES:
                            yield _batch(rows)
                            rows, held = [], 0
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


class FastaSource(DataSource):
    """Options: ``rangeBytes``. Columns: path, offset (of the header in its file), header, q (null for a record without symbols)."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastaReader:
        if not self.options.get("path"):
            raise ValueError("fasta: a path is needed")
        size = int(self.options.get("rangeBytes", RANGE_BYTES))
        if size < 1:
            raise ValueError("rangeBytes must be positive")
        return FastaReader(self.options["path"], size)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastaSource)
