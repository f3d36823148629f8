"""Counting distinct patterns in texts without a row for each place: many packed ones, and few ones of any symbols."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifmill.operators.cutting import pieces
from motifmill.plans.storage import bounded_batches, materialize

#: First symbols by which places and patterns are dealt, and bits of a packed window.
LEAD, PACKED = 8, 62
#: Places of a piece, of what a task packs at a time, and those that a bucket stands for.
PIECE, PACK, BUCKET = 1 << 16, 1 << 21, 1 << 22
#: Bytes of a seed, and bits of the table that most places are turned away by.
SEED, SIEVE = 8, 20
_MIX = 0x9E3779B97F4A7C15


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(_points(batch.column(0).to_pylist())).astype(np.int32))], ["kind"])


def _codes(kinds: list[int]) -> np.ndarray:
    """Code of every code point: from 1, and 0 for what no pattern holds."""
    table = np.zeros(0x110001, np.uint8)
    table[kinds] = np.arange(1, len(kinds) + 1)
    return table


def _windows(codes: np.ndarray, bits: int, length: int) -> np.ndarray:
    """The ``length`` codes from every place on, packed; zeros behind the last one. Windows of 1, 2, 4, ... codes are put together."""
    n, now, power, out, held = len(codes), codes.astype(np.int64), 1, np.zeros(len(codes), np.int64), 0
    ahead = lambda x, k: np.append(x[k:], np.zeros(min(k, n), np.int64))
    while True:
        if length & power:
            out = out << (power * bits) | ahead(now, held)
            held += power
        if held == length:
            return out
        now = now << (power * bits) | ahead(now, power)
        power *= 2


def _bucket(lead: np.ndarray, buckets: int) -> np.ndarray:
    return ((lead.astype(np.uint64) * np.uint64(_MIX)) >> np.uint64(32)).astype(np.int64) % buckets


def _dealt(kinds: list[int], bits: int, longest: int, buckets: int) -> Callable:
    """Arrow function: part of pieces -> bucket, codes, many: the different windows that begin in each bucket, ascending, and how often; PACK symbols at a time."""

    def packed(parts: list[str]) -> pa.RecordBatch:
        size = np.array([len(p) for p in parts], np.int64)
        begin = np.cumsum(size + 1) - size - 1
        codes = table[_points([p + "\0" for p in parts])]
        codes[begin + size] = 0  # no window goes on behind a piece's end
        own = np.zeros(len(codes) + 1, np.int8)
        own[begin] += 1
        own[begin + np.minimum(size, PIECE)] -= 1
        apart = np.append(np.cumsum(codes == 0), np.full(LEAD, len(codes) + 1))  # what begins in the last places is too short
        at = np.flatnonzero((np.cumsum(own[:-1], dtype=np.int8) > 0) & (apart[LEAD - 1 : LEAD - 1 + len(codes)] == apart[: len(codes)]) & (codes > 0))
        keys = np.sort(_windows(codes, bits, longest)[at])
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        many = np.diff(np.append(first, len(keys))).astype("<i4")
        keys = keys[first]
        bucket = _bucket(keys >> (bits * (longest - LEAD)), buckets)
        order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
        bucket, keys, many = bucket[order], keys[order], many[order]
        lo = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
        hi = np.append(lo[1:], len(bucket)).astype(np.int64)
        rows = [(keys[a:b].astype("<i8").tobytes(), many[a:b].tobytes()) for a, b in zip(lo, hi, strict=True)] if len(lo) else []
        return pa.RecordBatch.from_arrays([pa.array(bucket[lo], pa.int64()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "codes", "many"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in chain.from_iterable(batch.column(0).to_pylist() for batch in batches):
            held.append(part)
            size += len(part)
            if size >= PACK:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    table = _codes(kinds)
    return run


def _asked(kinds: list[int], bits: int, longest: int, buckets: int) -> Callable:
    """Arrow function: q -> q, bucket, lo, hi: the packed windows that begin with a pattern."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            size = np.array([len(t) for t in texts], np.int64)
            codes = table[_points([t + "\0" * (longest - len(t)) for t in texts])].reshape(len(texts), longest)
            codes[np.arange(longest) >= size[:, None]] = 0
            lo = np.zeros(len(texts), np.int64)
            for k in range(longest):
                lo = lo << bits | codes[:, k]
            hi = lo + (np.int64(1) << (bits * (longest - size)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_bucket(lo >> (bits * (longest - LEAD)), buckets)), pa.array(lo), pa.array(hi)], ["q", "bucket", "lo", "hi"])

    table = _codes(kinds)
    return run


def _met(places: pa.Table, asked: pa.Table) -> pa.Table:
    """A bucket's windows and patterns -> q, n of those that occur."""
    lo, hi = (asked.column(c).to_numpy() for c in ("lo", "hi"))
    keys = np.concatenate([np.frombuffer(b.as_buffer(), "<i8") for b in places.column("codes")] or [np.zeros(0, np.int64)])
    many = np.concatenate([np.frombuffer(b.as_buffer(), "<i4") for b in places.column("many")] or [np.zeros(0, np.int32)])
    order = np.argsort(keys)
    keys, before = keys[order], np.append(0, np.cumsum(many[order], dtype=np.int64))
    n = before[np.searchsorted(keys, hi)] - before[np.searchsorted(keys, lo)]
    some = pa.array(np.flatnonzero(n))
    return pa.table({"q": asked.column("q").combine_chunks().cast(pa.string()).take(some), "n": pa.array(n[n > 0], pa.int64())})


def count_many(texts: DataFrame, patterns: DataFrame, *, id_col: str, text_col: str, longest_text: int | None = None) -> DataFrame | None:
    """q, n of those of any number of distinct patterns of LEAD symbols or more that occur; None where their alphabet and length do not fit one packed number.

    Each place's next symbols are a number. Tasks sort those of their texts, and places and patterns
    are dealt by a hash of their first LEAD symbols, so a pattern's occurrences are an interval of one
    bucket: work and what is shuffled, some 10 bytes a place, grow with texts and patterns, not with their product.
    Equal windows of a task are one; a bucket that is large all the same is cut into parts, which its patterns all meet.
    """
    bounded_batches(texts.sparkSession)
    longest = patterns.agg(F.max(F.length("q"))).first()[0]
    most = (1 << (PACKED // longest)) - 1  # kinds that a code has room for
    kinds = sorted(r[0] for r in patterns.select("q").mapInArrow(_kinds, "kind int").distinct().limit(most + 1).collect()) if most else [0]
    if len(kinds) > most or kinds[0] == 0:
        return None
    bits = len(kinds).bit_length()
    total = texts.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()[0]
    buckets = max(1, -(-total // BUCKET))
    cut = pieces(texts, id_col, text_col, PIECE, longest - 1, longest_text).select("part")
    dealt = materialize(cut.mapInArrow(_dealt(kinds, bits, longest, buckets), "bucket long, codes binary, many binary"), "dealt-places")
    sizes = dealt.groupBy("bucket").agg(F.ceil(F.sum(F.octet_length("codes")) / (16 * BUCKET)).alias("parts"))  # a row a bucket
    asked = patterns.select("q").mapInArrow(_asked(kinds, bits, longest, buckets), "q string, bucket long, lo long, hi long")
    asked = asked.join(F.broadcast(sizes), "bucket").select("q", "lo", "hi", F.col("bucket").alias("q_bucket"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("q_part"))
    placed = dealt.join(F.broadcast(sizes), "bucket").select("bucket", F.pmod(F.xxhash64("codes"), F.col("parts")).alias("part"), "codes", "many")
    found = placed.groupBy("bucket", "part").cogroup(asked.groupBy("q_bucket", "q_part")).applyInArrow(_met, "q string, n long")
    return found.groupBy("q").agg(F.sum("n").alias("n"))


def count_few(texts: DataFrame, patterns: DataFrame, *, id_col: str, text_col: str, longest_text: int | None = None) -> DataFrame:
    """q, n of those of a few distinct patterns of SEED symbols or more that occur. Every task gets all patterns, so they must be few enough to be broadcast, and no longer than a piece.

    Texts are searched as UTF-8, in which a symbol begins nowhere but where one does: the eight bytes from every place on are
    looked up among the patterns' first eight, and where these stand the patterns are compared in words of eight bytes.
    """
    bounded_batches(texts.sparkSession)
    asked = [r[0] for r in patterns.select("q").collect()]  # few, as a broadcast would hold them
    longest = max((len(q) for q in asked), default=1)
    cut = pieces(texts, id_col, text_col, PIECE, longest - 1, longest_text).select("part")
    return cut.mapInArrow(_looked_up(asked), "q string, n long").groupBy("q").agg(F.sum("n").alias("n"))


def _looked_up(asked: list[str]) -> Callable:
    """Arrow function: part of pieces -> q, n."""
    word = np.dtype("<u8")

    def sieved(seed: np.ndarray) -> np.ndarray:
        return (seed * np.uint64(_MIX)) >> np.uint64(64 - SIEVE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        octets = [q.encode() for q in asked]
        size = np.array([len(o) for o in octets], np.int64)
        begin = np.cumsum(size) - size
        every = np.frombuffer(b"".join(octets) + b"\0" * SEED, np.uint8)
        words = lambda flat: np.ndarray(len(flat) - SEED + 1, word, flat, strides=(1,))  # noqa: E731  unaligned
        wanted = words(every)
        order = np.argsort(wanted[begin])
        seeds, first, sharing = np.unique(wanted[begin][order], return_index=True, return_counts=True)
        sieve = np.zeros(1 << SIEVE, bool)
        sieve[sieved(seeds)] = True
        counts = np.zeros(len(asked), np.int64)
        for batch in batches:
            part = batch.column(0).cast(pa.large_string())
            ends = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
            if not len(part) or ends[-1] - ends[0] < SEED:
                continue
            flat = np.append(np.frombuffer(part.buffers()[2], np.uint8)[ends[0] : ends[-1]], np.zeros(SEED, np.uint8))
            ends = ends - ends[0]
            own = ends[1:].copy()  # where the places end that belong to a piece
            for row in np.flatnonzero(np.diff(ends) > PIECE):
                symbols = np.flatnonzero((flat[ends[row] : ends[row + 1]] & 0xC0) != 0x80)
                own[row] = ends[row] + symbols[PIECE] if len(symbols) > PIECE else ends[row + 1]
            held = words(flat)
            for lo in range(0, len(held), PACK):
                now = held[lo : lo + PACK]
                at = np.flatnonzero(sieve[sieved(now)])
                seed = np.minimum(np.searchsorted(seeds, now[at]), len(seeds) - 1)
                same = seeds[seed] == now[at]
                at, seed = at[same] + lo, seed[same]
                row = np.searchsorted(ends, at, "right") - 1
                inside = row < len(own)
                at, seed, row = at[inside], seed[inside], row[inside]
                mine = at < own[row]
                at, seed, row = at[mine], seed[mine], row[mine]
                # a row for each pattern that shares the seed
                many = sharing[seed]
                nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                which, at, end = order[np.repeat(first[seed], many) + nth], np.repeat(at, many), np.repeat(ends[row + 1], many)
                fits = at + size[which] <= end
                which, at = which[fits], at[fits]
                step = SEED
                while len(open_ := np.flatnonzero(size[which] > step)):
                    # the last word of a pattern overlaps the one before
                    off = np.minimum(step, size[which[open_]] - SEED)
                    unlike = open_[held[at[open_] + off] != wanted[begin[which[open_]] + off]]
                    which, at = np.delete(which, unlike), np.delete(at, unlike)
                    step += SEED
                counts += np.bincount(which, minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([asked[k] for k in some], pa.string()), pa.array(counts[some])], ["q", "n"])

    return run
