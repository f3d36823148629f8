"""Backward search of reads in contigs that are sorted where the reads meet them: no rank table is written, and no step shuffles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifmill.operators.index import changes
from motifmill.operators.suffix import DEALT, WHOLE, text_order
from motifmill.plans.storage import bounded_batches, counted_side, materialize

#: Reads of a contig from which on they are dealt to several tasks, each of which sorts the contig.
ASKED = 1 << 20


def count_in_contigs(texts: DataFrame, reads: DataFrame) -> DataFrame:
    """contig_id, read_id, n of every read in the contig that it names, of fewer than WHOLE symbols: null for null and empty reads, 0 where no contig is named.

    texts: contig_id, seq; reads: contig_id, read_id, q. Texts and reads are shuffled once and go by in the order of
    contigs, a contig in front of its reads. Contigs of one id are searched each for itself, as a join would.
    """
    spark = texts.sparkSession
    bounded_batches(spark)
    total = texts.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // DEALT))
    often = materialize(reads.groupBy("contig_id").agg(F.ceil(F.count(F.lit(1)) / ASKED).alias("parts")).where("parts > 1 and contig_id is not null"), "asked-often")
    part = F.lit(0).cast("long")
    texts, reads = texts.withColumn("part", part), reads.withColumn("part", part)
    if not often.isEmpty():  # few: each stands for ASKED reads
        often = counted_side(often)
        parts = F.coalesce("parts", F.lit(1).cast("long"))
        texts = texts.join(often, "contig_id", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        reads = reads.join(often, "contig_id", "left").withColumn("part", F.pmod(F.xxhash64("read_id", "q"), parts))
    kind = reads.schema["read_id"].dataType.simpleString()
    rows = texts.select("contig_id", "part", F.lit(False).alias("asked"), F.lit(None).cast(kind).alias("read_id"), F.coalesce("seq", F.lit("")).alias("text"))
    rows = rows.unionByName(reads.select("contig_id", "part", F.lit(True).alias("asked"), "read_id", F.col("q").alias("text")))
    # reads that name no contig need none beside them
    spread = F.when(F.col("contig_id").isNull(), F.xxhash64("read_id", "text")).otherwise(F.xxhash64("contig_id", "part"))
    dealt = rows.withColumn("_spread", spread).repartition(tasks, "_spread").sortWithinPartitions("contig_id", "part", "asked").drop("_spread")
    ids = rows.schema["contig_id"].dataType.simpleString()
    return dealt.mapInArrow(_counted, f"contig_id {ids}, read_id {kind}, n long")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """contig_id, part, asked, read_id, text, by contig and part, contigs in front of their reads -> contig_id, read_id, n; contigs of WHOLE symbols in all, or one, at a time."""
    held = None  # the contig whose reads may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        number = np.cumsum(changes(rows.column(0)) | changes(rows.column(1))) - 1
        asked = rows.column(2).to_numpy(zero_copy_only=False)
        size = np.where(asked, 0, pc.fill_null(pc.utf8_length(rows.column(4)), 0).to_numpy(zero_copy_only=False))
        begin = np.append(np.flatnonzero(np.append(True, number[1:] != number[:-1])), len(number))
        before = np.append(0, np.cumsum(size))[begin]  # symbols in front of a contig
        first = 0
        while first < len(begin) - 1:
            last = max(first + 1, int(np.searchsorted(before, before[first] + WHOLE, "right")) - 1)
            lo, hi = begin[first], begin[last]
            if asked[lo:hi].any():
                yield _answered(rows.slice(lo, hi - lo), number[lo:hi] - first, asked[lo:hi])
            first = last
        open_ = np.flatnonzero(~asked[begin[-2] :]) + begin[-2]
        held = rows.take(pa.array(open_)) if len(open_) else None


def _points(texts: pa.Array) -> np.ndarray:
    return np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)


def _answered(rows: pa.RecordBatch, number: np.ndarray, asked: np.ndarray) -> pa.RecordBatch:
    """contig_id, read_id, n of the reads among rows of whole contigs; a contig that no read names is not sorted."""
    reads = np.flatnonzero(asked)
    named = np.zeros(number[-1] + 1, bool)
    named[number[reads]] = True
    known = ~np.asarray(pc.is_null(rows.column(0)).to_numpy(zero_copy_only=False))
    texts = np.flatnonzero(~asked & known & named[number])
    # a read is asked of each contig of its id, or of none
    first, end = (np.searchsorted(number[texts], number[reads], side) for side in ("left", "right"))
    many = np.maximum(end - first, 1)
    which = np.repeat(np.arange(len(reads)), many)
    text = np.where((end > first)[which], np.repeat(first - np.cumsum(many) + many, many) + np.arange(len(which)), -1)
    q = rows.column(4).take(pa.array(reads[which]))
    empty = pc.fill_null(pc.equal(q, ""), True).to_numpy(zero_copy_only=False)
    n = np.zeros(len(which), np.int64)
    open_ = np.flatnonzero((text >= 0) & ~empty)
    if len(open_) and len(texts):
        n[open_] = search(rows.column(4).take(pa.array(texts)), q.take(pa.array(open_)), text[open_])
    at = pa.array(reads[which])
    return pa.RecordBatch.from_arrays([rows.column(0).take(at), rows.column(3).take(at), pa.array(n, pa.int64(), mask=empty)], ["contig_id", "read_id", "n"])


def search(texts: pa.Array, reads: pa.Array, text: np.ndarray) -> np.ndarray:
    """How often each read, of one symbol or more, occurs in the text of its number.

    Suffixes are sorted by text and by as many symbols as the longest read has. A row of a suffix stands for its text, its
    first symbol and the row of the suffix behind that, the empty one first of its text; in this order the rows that a read's
    last symbols begin are found, then those of one symbol more, and so on: a step is two ranks.
    """
    size, length = (pc.utf8_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (texts, reads))
    points, letters = _points(texts), _points(reads)
    rows = len(points)
    if not rows:
        return np.zeros(len(reads), np.int64)
    seen = np.zeros(int(points.max()) + 2, np.int64)
    seen[points] = 1
    kinds = int(seen.sum()) + 1
    codes = np.cumsum(seen) * seen  # from 1; 0 is what no text holds
    begin, end = np.cumsum(size) - size, np.cumsum(size)
    of = np.repeat(np.arange(len(size)), size)
    order = text_order(points, size, int(length.max()))
    rank = np.empty(rows, np.int64)
    rank[order] = np.arange(rows)
    behind = np.append(rank[1:], 0) + 1
    behind[end[size > 0] - 1] = begin[size > 0]  # the empty suffix
    steps = np.sort((of * kinds + codes[points]) * (rows + 2) + behind)
    lo, hi, going, last = begin[text], end[text] + 1, np.arange(len(reads)), np.cumsum(length) - 1
    read_codes = codes[np.minimum(letters, len(codes) - 1)]
    n = np.zeros(len(reads), np.int64)
    for step in range(int(length.max())):
        key = (text[going] * kinds + read_codes[last[going] - step]) * (rows + 2)
        lo, hi = (np.searchsorted(steps, key + bound) for bound in (lo, hi))
        done = length[going] == step + 1
        n[going[done]] = (hi - lo)[done]
        left = ~done & (lo < hi)
        going, lo, hi = going[left], lo[left] + 1, hi[left] + 1
        if not len(going):
            break
    return n
