"""The rank index of a collection: cumulative pair counts, sampled ranks, bitmaps, k-mer intervals."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motifmill.functions.encode import ALPHABET, is_coded, symbol_code
from motifmill.operators import suffix
from motifmill.operators.ranking import FAN, running
from motifmill.plans.storage import bounded_batches, bucket_count, bucketed, counted_side, materialize, shuffled_side
from motifmill.sources.sequences import input_key

D = 64
#: Rows that one entry of the single symbols' ranks stands for.
RANGE = 512
#: Symbols in a piece of a dump.
DUMP = 1 << 16
#: Stored bytes of a rank table that one bucket stands for.
BUCKET_BYTES = 64 << 20
#: Contigs whose bare ids may be broadcast, and rows of a table of some rows a contig that may be.
IDS, ENTRIES = 1 << 20, 1 << 18
TABLES = ("meta", "bwt", "c_table", "firsts", "occ", "lut", "symbols", "places")


def meta_table(genome: DataFrame) -> DataFrame:
    """contig_id, len (rows of the suffix array), last (code of the last symbol, null if empty or none of ACGT), others (does it hold other symbols?)."""
    return genome.select("contig_id", (F.length("seq") + 1).cast("long").alias("len"), symbol_code(F.substring("seq", -1, 1)).alias("last"), (~is_coded(F.col("seq"))).alias("others"))


def pair_counts(bwt: DataFrame) -> DataFrame:
    return bwt.where("sym2 is not null").groupBy("contig_id", "sym2").agg(F.count(F.lit(1)).alias("n"))


def beginnings(bwt: DataFrame) -> DataFrame:
    """contig_id, begin, n: how many suffixes of T$ begin with two symbols; at most the square of the alphabet's size a contig."""
    return bwt.groupBy("contig_id", F.substring("head", 1, 2).alias("begin")).agg(F.count(F.lit(1)).alias("n"))


def c_table(meta: DataFrame, begins: DataFrame) -> DataFrame:
    """contig_id, sym2 (0 to 16), n, c_before: suffixes that begin with the pair, and those that come before; symbols outside ACGT have their place among them.

    A contig is one row until the last join is done, which is by shuffle: rows of few bytes are many under a broadcast's limit of written bytes.
    """
    of = lambda hit: F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).cast("long")
    begin = F.col("begin")
    each = [F.struct(F.lit(k).alias("sym2"), of(begin == pair).alias("n"), of(begin < pair).alias("c_before")) for k, pair in enumerate(a + b for a in ALPHABET for b in ALPHABET)]
    met = begins.groupBy("contig_id").agg(F.array(*each).alias("pairs")).join(shuffled_side(meta.select("contig_id", "len")), "contig_id")
    end = F.array(F.struct(F.lit(16).alias("sym2"), F.lit(0).cast("long").alias("n"), F.col("len").alias("c_before")))
    return met.select("contig_id", F.explode(F.concat("pairs", end)).alias("e")).select("contig_id", "e.sym2", "e.n", "e.c_before")


def firsts_table(meta: DataFrame, begins: DataFrame) -> DataFrame:
    """contig_id, x, lo, hi: the rows of the suffixes that begin with each symbol of ACGT."""
    of = lambda hit: F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).cast("long")
    begin = F.col("begin")
    each = [F.struct(F.lit(k).alias("x"), of(begin < c).alias("lo"), of(begin.startswith(c)).alias("n")) for k, c in enumerate(ALPHABET)]
    met = begins.groupBy("contig_id").agg(F.array(*each).alias("symbols")).join(shuffled_side(meta.select("contig_id")), "contig_id", "left_semi")
    return met.select("contig_id", F.explode("symbols").alias("e")).select("contig_id", "e.x", "e.lo", (F.col("e.lo") + F.col("e.n")).alias("hi"))


def occ_blocks(bwt: DataFrame, meta: DataFrame, d: int = D) -> DataFrame:
    """contig_id, blk, sym2, before (occurrences in the blocks before), bitmap (row offset 0 is the top bit of d).

    A block is one row with the bitmaps of all pairs until its running sums are known, which go in
    two levels: no task holds more of a contig than a range of its blocks, or one row for each range.
    """
    if not 1 <= d <= 64:
        raise ValueError("d must be from 1 to 64")
    # the row behind a contig's last one makes the block in which it lies, which may hold no other
    rows = bwt.select("contig_id", "i", "sym2").unionByName(meta.where("len is not null").select("contig_id", F.col("len").alias("i"), F.lit(None).cast("int").alias("sym2")))
    bit = F.expr(f"shiftleft(1L, {d - 1} - cast(i % {d} as int))")
    maps, counts = [f"m{k}" for k in range(16)], [f"n{k}" for k in range(16)]
    blocks = rows.groupBy("contig_id", F.expr(f"i div {d}").alias("blk")).agg(*[F.coalesce(F.bit_or(F.when(F.col("sym2") == k, bit)), F.lit(0).cast("long")).alias(m) for k, m in enumerate(maps)])
    ranged = blocks.withColumn("_range", F.expr(f"blk div {FAN}"))
    before = Window.partitionBy("contig_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("contig_id", "_range").agg(*[F.sum(F.bit_count(m)).alias(n) for m, n in zip(maps, counts, strict=True)])
    # what the first range of a contig carries is nothing: only long contigs have others
    carried = totals.select("contig_id", "_range", F.array(*[F.sum(n).over(before) for n in counts]).alias("_carry")).where("_range > 0")
    inside = Window.partitionBy("contig_id", "_range").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.select("*", *[F.coalesce(F.sum(F.bit_count(m)).over(inside), F.lit(0)).alias(n) for m, n in zip(maps, counts, strict=True)]).join(carried, ["contig_id", "_range"], "left")
    each = [F.struct(F.lit(k).alias("sym2"), (F.col(n) + F.coalesce(F.col("_carry")[k], F.lit(0))).alias("before"), F.col(m).alias("bitmap")) for k, (m, n) in enumerate(zip(maps, counts, strict=True))]
    return summed.select("contig_id", "blk", F.explode(F.array(*each)).alias("e")).select("contig_id", "blk", "e.sym2", "e.before", "e.bitmap")


def symbols_table(meta: DataFrame, begins: DataFrame) -> DataFrame:
    """contig_id, symbol, lo, hi: the rows of the suffixes that begin with each symbol, in contigs that hold others than ACGT; a row for each symbol of a contig. The end marker's own suffix, the first of those with '$', is none of them."""
    firsts = begins.join(shuffled_side(meta.where("others").select("contig_id")), "contig_id", "left_semi").groupBy("contig_id", F.substring("begin", 1, 1).alias("symbol")).agg(F.sum("n").alias("n"))
    before = Window.partitionBy("contig_id").orderBy("symbol").rowsBetween(Window.unboundedPreceding, -1)
    lo = F.coalesce(F.sum("n").over(before), F.lit(0))
    return firsts.select("contig_id", "symbol", (lo + F.when(F.col("symbol") == "$", 1).otherwise(0)).alias("lo"), (lo + F.col("n")).alias("hi"))


def places_table(bwt: DataFrame, meta: DataFrame, symbols: DataFrame) -> DataFrame:
    """contig_id, symbol, rng, before, offsets: rows that a symbol stands in front of (the end marker is none), by ranges of RANGE rows, and how many there are in the ranges before; in contigs that hold others than ACGT."""
    held = counted_side(meta.where("others").select("contig_id"), rows=IDS)
    rows = bwt.where("pos > 0").join(held, "contig_id", "left_semi").groupBy("contig_id", F.col("b0").alias("symbol"), F.floor(F.col("i") / RANGE).alias("rng")).agg(F.sort_array(F.collect_list((F.col("i") % RANGE).cast("int"))).alias("offsets"))
    frame = symbols.select("contig_id", "symbol").join(shuffled_side(meta.select("contig_id", "len")), "contig_id").select("contig_id", "symbol", F.explode(F.expr(f"sequence(0L, len div {RANGE})")).alias("rng"))
    dense = frame.join(rows, ["contig_id", "symbol", "rng"], "left").withColumn("offsets", F.coalesce("offsets", F.array().cast("array<int>"))).withColumn("n", F.size("offsets").cast("long"))
    return running(dense, ["contig_id", "symbol"], "rng", "n", "before").select("contig_id", "symbol", "rng", F.coalesce("before", F.lit(0)).alias("before"), "offsets")


def rank_of(before: Column, bitmap: Column, row: Column, d: int = D) -> Column:
    """Occurrences in rows before ``row``, which lies in the block of (before, bitmap)."""
    off = (row % d).cast("int")
    return before + F.when(off == 0, 0).otherwise(F.bit_count(F.call_function("shiftrightunsigned", bitmap, F.lit(d) - off)))


def lut(suffixes: DataFrame, ks: tuple[int, ...] = (5, 6)) -> DataFrame:
    """contig_id, k, kmer, code, lo, hi: half-open row interval of every k-mer over ACGT that occurs, from one pass. Input: contig_id, i, head.

    Rows that stand together and share contig and k-mer are one interval before anything is shuffled, and
    a contig's intervals go as arrays; rows in any other order give more intervals, but the same table.
    """
    bounded_batches(suffixes.sparkSession)
    ids = suffixes.schema["contig_id"].dataType.simpleString()
    arrays = ("kmers", "los", "his")
    met = suffixes.select("contig_id", F.col("i").cast("long").alias("i"), "head").mapInArrow(_kmer_runs(ks), f"contig_id {ids}, kmers array<int>, los array<long>, his array<long>")
    # dealt by contig, so that no row for each k-mer is shuffled
    each = met.repartition("contig_id").select("contig_id", F.explode(F.arrays_zip(*arrays)).alias("e")).select("contig_id", *[f"e.{c}" for c in arrays])
    rows = each.groupBy("contig_id", "kmers").agg(F.min("los").alias("lo"), F.max("his").alias("hi"))
    of = lambda value: reduce(lambda rest, k: F.when(F.col("kmers").between(4**k, 2 * 4**k - 1), value(k)).otherwise(rest), ks, F.lit(None))
    symbol = lambda back: F.substring(F.lit(ALPHABET), F.shiftright("kmers", 2 * back).bitwiseAND(3) + 1, F.lit(1))
    kmer = of(lambda k: F.concat(*[symbol(back) for back in reversed(range(k))]))
    return rows.select("contig_id", of(F.lit).alias("k"), kmer.alias("kmer"), of(lambda k: F.col("kmers").cast("long") - 4**k).alias("code"), "lo", "hi")


def _kmer_runs(ks: tuple[int, ...]):
    """Arrow function: contig_id, i, head -> contig_id, kmers (4^k and the code), los, his: a row for each run of rows of a contig, with the interval of each run of a k-mer in it."""
    digits = np.full(256, -1, np.int32)
    digits[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
    most = max(ks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, i = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            offsets, octets = _octets(batch.column(2))
            # a symbol of several bytes has none of ACGT, so up to the first such symbol bytes are symbols
            place = offsets[:-1, None] + np.arange(most)
            codes = np.where(place < offsets[1:, None], digits[np.append(octets, np.zeros(most, np.uint8))[place]], -1)
            apart = changes(ids)
            found = []
            for k in ks:
                kmer = np.where((codes[:, :k] >= 0).all(axis=1), 4**k + codes[:, :k] @ 4 ** np.arange(k - 1, -1, -1), 0)
                first = np.flatnonzero(apart | np.append(True, kmer[1:] != kmer[:-1]))
                lo, hi = np.minimum.reduceat(i, first), np.maximum.reduceat(i, first) + 1
                held = kmer[first] > 0
                found.append((first[held], kmer[first][held], lo[held], hi[held]))
            at, kmers, los, his = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(at, kind="stable")
            begins = np.flatnonzero(apart)
            bounds = np.append(np.searchsorted(at[order], begins), len(order)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x[order], kind)) for x, kind in ((kmers, pa.int32()), (los, pa.int64()), (his, pa.int64()))]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(begins)), *lists], ["contig_id", "kmers", "los", "his"])

    return run


def changes(column: pa.Array) -> np.ndarray:
    """Does a row differ from the one before? The first does; nulls are alike."""
    now, last = column.slice(1), column.slice(0, len(column) - 1)
    differs = pc.or_(pc.fill_null(pc.not_equal(now, last), False), pc.xor(pc.is_null(now), pc.is_null(last)))
    return np.append(True, np.asarray(differs.to_numpy(zero_copy_only=False), bool))


def _octets(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of the strings and of their end, bytes) of an array without nulls."""
    _, offsets, octets = strings.buffers()
    return np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + len(strings) + 1], np.frombuffer(octets or b"", np.uint8)


def dumped(bwt: DataFrame, size: int = DUMP) -> DataFrame:
    """contig_id, piece, b0, b1: the two columns of the transform as strings of ``size`` symbols each, the last one shorter. No row or group grows with a contig.

    Rows that stand together in rank order are joined before anything is shuffled; rows in any other order give shorter parts, but the same pieces.
    """
    bounded_batches(bwt.sparkSession)
    ids = bwt.schema["contig_id"].dataType.simpleString()
    parts = bwt.select("contig_id", F.expr(f"i div {size}").alias("piece"), (F.col("i") % size).cast("long").alias("at"), "b0", "b1").mapInArrow(_piece_parts, f"contig_id {ids}, piece long, at long, b0 string, b1 string")
    rows = parts.groupBy("contig_id", "piece").agg(F.sort_array(F.collect_list(F.struct("at", "b0", "b1"))).alias("r"))
    return rows.select("contig_id", "piece", *[F.array_join(f"r.{c}", "").alias(c) for c in ("b0", "b1")])


def _piece_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """contig_id, piece, at, b0, b1 -> the same, the symbols of rows of one piece that follow each other in one row, at the first one's place."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.column(2).to_numpy(zero_copy_only=False)
        apart = changes(batch.column(0)) | changes(batch.column(1)) | np.append(True, at[1:] != at[:-1] + 1)
        first = np.flatnonzero(apart)
        joined = []
        for column in batch.columns[3:]:
            offsets, octets = _octets(column)
            joined.append(pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(offsets[first], offsets[-1]).astype(np.int32)), pa.py_buffer(octets)))
        yield pa.RecordBatch.from_arrays([*[c.take(pa.array(first)) for c in batch.columns[:3]], *joined], batch.schema.names)


class Index:
    """Tables of an index, by the names of TABLES: a table, or what makes it, which is called when the table is first asked for."""

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]):
        if set(tables) != set(TABLES):
            raise TypeError(f"an index has the tables {', '.join(TABLES)}")
        self._tables, self._dealt = tables, False

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        if callable(made := self._tables[name]):
            self._tables[name] = made()
        return self._tables[name]

    @classmethod
    def build(cls, genome: DataFrame, d: int = D, ks: tuple[int, ...] = (5, 6), suffixes: DataFrame | None = None) -> Index:
        """The suffixes are sorted once (or given as sorted and written), with the symbols that all tables need at their side. Any symbols may occur; pairs and k-mers are those of ACGT."""
        if max(ks) > suffix.HEAD:
            raise ValueError(f"k-mers of at most {suffix.HEAD} symbols")
        meta = materialize(meta_table(genome), "index-meta")
        bwt = suffix.bwt(suffix.sorted_suffixes(genome) if suffixes is None else suffixes)
        begins = cache(lambda: materialize(beginnings(bwt), "index-beginnings"))
        made = {
            "c_table": lambda: c_table(meta, begins()),
            "firsts": lambda: firsts_table(meta, begins()),
            "occ": lambda: occ_blocks(bwt, meta, d),
            "lut": lambda: lut(bwt, ks),
            "symbols": lambda: symbols_table(meta, begins()),
        }
        index = cls(meta=meta, bwt=bwt, places=lambda: materialize(places_table(bwt, meta, index.symbols), "index-places"), **{name: partial(_written, make, name) for name, make in made.items()})
        return index

    def save(self, path: str) -> None:
        for name in TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(**{name: spark.read.parquet(f"{path}/{name}") for name in TABLES})

    def bucketed(self, buckets: int | None = None) -> Index:
        """The same index, its rank tables dealt into buckets by the keys of a search step: for many or large searches, whose steps then shuffle only the reads."""
        if self._dealt:
            return self
        deal = lambda table, label, keys: bucketed(table, label, keys, buckets or bucket_count(table, BUCKET_BYTES))
        dealt = {
            "occ": lambda: deal(self.occ.withColumnRenamed("blk", "b"), "index-occ", ["contig_id", "sym2", "b"]).withColumnRenamed("b", "blk"),
            "places": lambda: deal(self.places, "index-places", ["contig_id", "symbol", "rng"]),
        }
        out = Index(**{name: dealt.get(name, partial(getattr, self, name)) for name in TABLES})
        out._dealt = True
        return out

    def extended(self, genome: DataFrame) -> Index:
        """With the contigs of ``genome``, which alone are sorted: every table is keyed by contig, so the result is what a build of all gives. A contig_id that the index has already is an error."""
        if not (twice := self.meta.join(genome.select("contig_id"), "contig_id", "left_semi").limit(1)).isEmpty():
            raise ValueError(f"the index has contig {twice.first()[0]} already")
        more = Index.build(genome)
        both = lambda name: getattr(self, name).unionByName(getattr(more, name))
        return Index(**{name: partial(both, name) for name in TABLES})

    @staticmethod
    def append(genome: DataFrame, path: str) -> None:
        """Add contigs to a saved index: only their rows are built and written."""
        if not (twice := Index.load(genome.sparkSession, path).meta.join(genome.select("contig_id"), "contig_id", "left_semi").limit(1)).isEmpty():
            raise ValueError(f"the index has contig {twice.first()[0]} already")
        more = Index.build(genome)
        for name in TABLES:
            getattr(more, name).write.mode("append").parquet(f"{path}/{name}")

    def summary(self) -> DataFrame:
        """contig_id, rows, blocks, pairs, kinds, entries: rows of the suffix array, blocks of the rank table, pairs counted in it, pairs that occur and k-mers that have an interval."""
        # each block has a row for each pair; rows of a contig meet by shuffle, however few bytes they have
        blocks = self.occ.groupBy("contig_id").agg(F.count_if(F.col("sym2") == 0).alias("blocks"), F.sum(F.bit_count("bitmap")).alias("pairs"))
        kinds = self.c_table.where("sym2 < 16 and n > 0").groupBy("contig_id").agg(F.count(F.lit(1)).alias("kinds"))
        entries = self.lut.groupBy("contig_id").agg(F.count(F.lit(1)).alias("entries"))
        out = reduce(lambda all_, more: all_.join(shuffled_side(more), "contig_id", "left"), (blocks, kinds, entries), self.meta)
        return out.select("contig_id", F.col("len").alias("rows"), "blocks", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pairs", "kinds", "entries")])


def _written(make: Callable[[], DataFrame], name: str) -> DataFrame:
    return materialize(make(), f"index-{name}")


_built: dict[tuple, Index] = {}
_sorted: dict[tuple, DataFrame] = {}


def suffixes_of(genome: DataFrame, sf_dir: str) -> DataFrame:
    """The sorted suffixes of a data directory's derived reference, written once a session and state of its files."""
    key = input_key(genome.sparkSession, sf_dir)
    if key not in _sorted:
        _sorted[key] = suffix.sorted_suffixes(genome)
    return _sorted[key]


def index_of(genome: DataFrame, sf_dir: str) -> Index:
    """The index of a data directory's derived reference, built once a session and state of its files."""
    key = input_key(genome.sparkSession, sf_dir)
    if key not in _built:
        _built[key] = Index.build(genome, suffixes=suffixes_of(genome, sf_dir))
    return _built[key]
