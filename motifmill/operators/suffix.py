"""Suffix arrays and k-step Burrows-Wheeler columns of collections of texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motifmill.functions.encode import pair_code
from motifmill.operators.cutting import pieces
from motifmill.operators.ranking import ranked, running
from motifmill.plans.storage import bounded_batches, materialize, small_side

#: Symbols that the first sort looks at, and those that stay with a sorted suffix.
FIRST, HEAD = 32, 6
#: Tied suffixes in all, up to which they are broadcast and ordered in windows.
FEW = 1 << 17
CHUNK = 256
#: Symbols of a contig up to which one task sorts it, together with others of as many in all; of the contigs that a task is dealt; suffixes of one batch.
WHOLE, DEALT, BATCH = 1 << 20, 1 << 22, 1 << 16


def _cut(genome: DataFrame, reach: int, before: int) -> DataFrame:
    """id, base, part: T$, with ``before`` = 2 behind the two symbols that stand in front of it cyclically, in chunks of CHUNK places."""
    end = F.lit("$")
    text = F.concat("seq", end)
    if before:  # in front of the first place stands the end marker, and in front of that the last symbol
        text = F.concat(F.when(F.length("seq") > 0, F.substring("seq", -1, 1)).otherwise(end), end, text)
    return pieces(genome.select("contig_id", text.alias("seq")), "contig_id", "seq", CHUNK, reach + before - 1)


def _placed(cut: DataFrame, before: int, *more: str) -> DataFrame:
    """A row for every place p (from 1) of a chunk; the last ``before`` places of the longer text are none of T$."""
    last = F.least(F.lit(CHUNK), F.length("part") - before)
    return cut.where(F.length("part") > before).select(F.col("id").alias("contig_id"), "base", "part", *more, F.explode(F.sequence(F.lit(1), last)).alias("p"))


def positions(genome: DataFrame, reach: int, before: int = 0) -> DataFrame:
    """contig_id, pos, head: every place of T$ with the ``reach`` symbols from there on; with ``before`` = 2 also those two before, cyclically, as front."""
    out = _placed(_cut(genome, reach, before), before).select("contig_id", (F.col("base") + F.col("p") - 1).alias("pos"), F.substring("part", F.col("p") + before, F.lit(reach)).alias("head"), F.substring("part", F.col("p"), F.lit(before)).alias("front"))
    return out if before else out.drop("front")


def _far_ends(cut: DataFrame, before: int, behind: int) -> DataFrame:
    """id, base, far, far_symbol: where the run that begins in front of the chunk behind this one and goes on in it ends, and the symbol there.

    Only chunks that begin with a run as long as the overlap count. Where a whole chunk
    is one symbol, the run ends where that of the next chunk does: a running minimum
    from the text's end, over ranges of chunks.
    """
    rest = F.substring("part", before + 1, CHUNK + behind)  # the last place of the chunk in front begins at most so far on
    lead = F.length(rest) - F.length(F.ltrim(rest, F.substring("part", before + 1, 1)))
    marks = cut.select("id", "base", "part", lead.alias("lead")).where(F.col("lead") >= behind - before)
    ends = F.when(F.col("lead") < CHUNK + behind - before, F.struct((F.col("base") + before + F.col("lead")).alias("far"), F.substring("part", F.col("lead") + before + 1, F.lit(1)).alias("far_symbol")))
    marks = marks.select("id", "base", (-F.col("base") / CHUNK).cast("long").alias("back"), ends.alias("ends"))
    marks = running(materialize(marks, "long-runs"), ["id"], "back", "ends", "run", F.min, inclusive=True)
    return marks.select("id", (F.col("base") - CHUNK).alias("base"), "run.*").where("base >= 0")


def _heads(genome: DataFrame) -> DataFrame:
    """contig_id, pos, front, head, side, turn, reach: the keys of the first sort.

    The first FIRST symbols, and where these are a run of one symbol c the whole run, r
    symbols: of two suffixes that begin with runs of c, one whose run is followed by
    a smaller symbol (side 0) comes before one whose run is followed by a larger one
    (side 1); on side 0 the shorter run comes first, on side 1 the longer one. Suffixes
    that are equal by these share ``reach`` symbols.
    """
    before, behind = 2, FIRST + 1
    plain = F.when(F.octet_length("part") == F.length("part"), F.col("part").cast("binary"))
    cut = _cut(genome, FIRST, before)
    cut = cut.select("id", "base", "part", plain.alias("raw"), F.regexp_like("part", F.lit(f"(?s)(.)\\1{{{FIRST - 1}}}")).alias("runs"))
    columns = ["contig_id", "pos", "front", "head"]
    none = [F.lit(0).alias("side"), F.lit(0).cast("long").alias("turn"), F.lit(FIRST).cast("long").alias("reach")]
    even = _with_head(_placed(cut.where("not runs"), before, "raw"), before).select(*columns, *none)
    # only chunks that hold a run, which are few in most texts, are looked at place by place
    cut = cut.where("runs")
    cut = cut.join(small_side(materialize(_far_ends(cut, before, behind), "run-ends")), ["id", "base"], "left")
    ids = cut.schema["id"].dataType.simpleString()
    turned = cut.select("id", "base", "part", "raw", "far", "far_symbol").mapInArrow(_turns(before), f"contig_id {ids}, base long, part string, raw binary, turns array<long>")
    placed = turned.select("contig_id", "base", "part", "raw", F.posexplode("turns").alias("p", "turn")).withColumn("p", F.col("p") + 1)
    reach = F.when(F.col("turn") == 0, FIRST).otherwise(F.abs("turn")).cast("long")
    return even.unionByName(_with_head(placed, before).select(*columns, (F.col("turn") < 0).cast("int").alias("side"), "turn", reach.alias("reach")))


def _turns(before: int):
    """Arrow function: id, base, part, raw, far, far_symbol of chunks -> contig_id, base, part, raw, turns: for each place the length of the run that begins there, negative before a larger symbol, 0 below FIRST."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, base, far, far_symbol = (batch.column(k).to_pylist() for k in (2, 1, 4, 5))
            points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.int64)
            size = np.array([len(p) for p in parts], np.int64)
            stop = np.cumsum(size)
            last = np.zeros(len(points), bool)
            last[stop - 1] = True
            change = np.flatnonzero(last | np.append(points[1:] != points[:-1], True)) + 1
            places = np.clip(size - before, 0, CHUNK)
            chunk = np.repeat(np.arange(len(parts)), places)
            at = (stop - size)[chunk] + before + np.arange(len(chunk)) - np.repeat(np.cumsum(places) - places, places)
            end = change[np.searchsorted(change, at, "right")]
            length, inside = end - at, end < stop[chunk]
            following = np.where(inside, points[np.minimum(end, len(points) - 1)], -1)
            beyond = ~inside & np.array([f is not None for f in far], bool)[chunk]
            run_end = np.array([f or 0 for f in far], np.int64)[chunk] - np.array(base, np.int64)[chunk] - (at - (stop - size)[chunk])
            length = np.where(beyond, run_end, length)
            following = np.where(beyond, np.array([ord(f) if f else -1 for f in far_symbol], np.int64)[chunk], following)
            turn = np.where(length < FIRST, 0, np.where(following > points[at], -length, length))
            turns = pa.ListArray.from_arrays(np.append(0, np.cumsum(places)).astype(np.int32), pa.array(turn))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], turns], ["contig_id", "base", "part", "raw", "turns"])

    return run


def _with_head(placed: DataFrame, before: int) -> DataFrame:
    """A place with its first symbols, and those before it; one-byte texts are cut as bytes, whose places need no counting."""
    part = lambda at, n: F.when(F.col("raw").isNotNull(), F.substring("raw", at, F.lit(n)).cast("string")).otherwise(F.substring("part", at, F.lit(n)))
    return placed.withColumn("pos", F.col("base") + F.col("p") - 1).withColumn("front", part(F.col("p"), before)).withColumn("head", part(F.col("p") + before, FIRST))


def text_order(points: np.ndarray, size: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Places of texts, which stand behind each other and have ``size`` symbols each, by text and then by suffix; a suffix that ends first comes first.

    Prefix doubling: a key is the text's number and as many symbols as have room beside
    it, then only what is still tied is sorted by the rank as far on as it agrees. depth: suffixes that share so many symbols may stay tied, in any order.
    """
    n = len(points)
    seen = np.zeros(int(points.max()) + 1, np.int64)
    seen[points] = 1
    codes = np.cumsum(seen)[points]  # from 1; 0 is the end
    bits = int(codes.max()).bit_length()
    width = max(1, min((62 - (len(size) - 1).bit_length()) // bits, depth or 62))
    left = np.repeat(np.cumsum(size), size) - np.arange(n)
    key = np.repeat(np.arange(len(size)), size)
    padded = np.append(codes, np.zeros(width, np.int64))
    for k in range(width):
        key = key << bits | np.where(left > k, padded[k : k + n], 0)
    order = np.argsort(key)
    at = np.arange(n)  # places in the order that are still tied
    key = key[order]
    rank = np.empty(n, np.int64)
    while len(at) and not (depth and width >= depth):
        new = np.append(True, key[1:] != key[:-1])
        rank[order[at]] = np.maximum.accumulate(np.where(new, at, 0))
        at = at[~new | ~np.append(new[1:], True)]
        tied = order[at]
        ahead = np.where(left[tied] > width, rank[np.minimum(tied + width, n - 1)] + 1, 0)
        key = rank[tied] * (n + 1) + ahead
        turned = np.argsort(key)
        order[at], key = tied[turned], key[turned]
        width *= 2
    return order


def _strings(points: np.ndarray, many: np.ndarray) -> pa.Array:
    """A string of each row's first ``many`` code points."""
    flat = points[np.arange(points.shape[1]) < many[:, None]]
    octets = np.cumsum(1 + (flat > 0x7F).astype(np.int64) + (flat > 0x7FF) + (flat > 0xFFFF))
    offsets = np.append(0, octets)[np.append(0, np.cumsum(many))].astype(np.int32)
    return pa.StringArray.from_buffers(len(many), pa.py_buffer(offsets), pa.py_buffer(flat.astype("<u4").tobytes().decode("utf-32-le").encode()))


def _sorted_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """contig_id, seq -> contig_id, i, pos, front, head, sorted; contigs of WHOLE symbols in all, or one, at a time."""
    for batch in batches:
        sizes = pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        first = 0
        while first < len(sizes):
            many = max(1, int(np.searchsorted(np.cumsum(sizes[first:]), WHOLE, "right")))
            size, ids = sizes[first : first + many], batch.column(0).slice(first, many)
            points = np.frombuffer("".join(t + "$" for t in batch.column(1).slice(first, many).to_pylist()).encode("utf-32-le"), np.uint32)
            first += many
            order = text_order(points, size)
            begin = np.cumsum(size) - size
            text = np.repeat(np.arange(many), size)  # of a place, and of its rank
            for lo in range(0, len(order), BATCH):
                now, of = order[lo : lo + BATCH], text[lo : lo + BATCH]
                pos = now - begin[of]
                front = points[np.stack([begin[of] + (pos - k) % size[of] for k in (2, 1)], axis=1)]
                head = points[np.minimum(now[:, None] + np.arange(HEAD), len(points) - 1)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), pa.array(np.arange(lo, lo + len(now)) - begin[of]), pa.array(pos), _strings(front, np.full(len(now), 2)), _strings(head, np.minimum(size[of] - pos, HEAD))], ["contig_id", "i", "pos", "front", "head"])


def sorted_suffixes(genome: DataFrame) -> DataFrame:
    """contig_id, i, pos, front, head: rank i of the suffix of T$ from pos, 0-based, by contig, with its first HEAD symbols and the two before it, written.

    Ranks are of a contig. A contig of up to WHOLE symbols, the end marker among them, is sorted in the
    task that reads it, so that only texts are shuffled, and no suffix of theirs; longer ones are sorted by ranges of all tasks.
    """
    whole = F.length("seq") < WHOLE
    bounded_batches(genome.sparkSession)
    total, longer = genome.agg(F.coalesce(F.sum(F.length("seq") + 1), F.lit(0)), F.coalesce(F.max(~whole), F.lit(False))).first()
    tasks = max(genome.sparkSession.sparkContext.defaultParallelism, -(-total // DEALT))
    ids = genome.schema["contig_id"].dataType.simpleString()
    out = genome.where(whole).select("contig_id", "seq").repartition(tasks, "contig_id").mapInArrow(_sorted_texts, f"contig_id {ids}, i long, pos long, front string, head string")
    return materialize(out.unionByName(_sorted_by_ranges(genome.where(~whole))) if longer else out, "suffixes")


def _sorted_by_ranges(genome: DataFrame) -> DataFrame:
    """As ``sorted_suffixes``, for contigs of any size.

    Prefix doubling that works only on what is still tied. The first sort is by 32
    symbols, or by whole runs of one symbol where these are longer. After that a group
    of equal ranks is ordered by the ranks as far on as its members are known to agree,
    which is a length of the group's own; only tied suffixes are sorted and written
    again, and only the ranks that they ask for are joined. Every sort is by
    ranges of the whole table: neither a contig nor a group has to fit one task. Only when no more
    than FEW suffixes are left in all, which are counted, are groups windows.
    """
    heads = _heads(genome).withColumn("begin", F.substring("head", 1, HEAD))
    columns = ["contig_id", "pos", "front", "begin", "reach"]
    rounds = [ranked(heads, ["contig_id"], ["head", "side", "turn"], ["pos"], columns).withColumnRenamed("rank", "i")]
    while n := (tied := rounds[-1].where("tied").withColumn("ahead", F.col("pos") + F.col("reach"))).count():
        asked = tied.select("contig_id", F.col("ahead").alias("pos")).distinct()
        few = n <= FEW  # two numbers a row
        asked = F.broadcast(asked) if few else small_side(materialize(asked, "suffix-asked"))
        known = reduce(DataFrame.unionByName, [t.where("not tied") for t in rounds[:-1]] + [rounds[-1]]).select("contig_id", "pos", "i", "reach")
        met = known.join(asked, ["contig_id", "pos"], "left_semi").select("contig_id", F.col("pos").alias("ahead"), F.col("i").alias("next"), F.col("reach").alias("more"))
        again = tied.join(F.broadcast(met) if few else met, ["contig_id", "ahead"], "left").withColumn("next", F.coalesce("next", F.lit(-1).cast("long"))).withColumn("reach", F.col("reach") + F.coalesce("more", F.lit(0).cast("long")))
        if few:
            group = Window.partitionBy("contig_id", "i")
            again = again.withColumn("rank", F.rank().over(group.orderBy("next")) - 1).withColumn("tied", F.count(F.lit(1)).over(Window.partitionBy("contig_id", "i", "next")) > 1)
            rounds.append(materialize(again.select(*columns, (F.col("i") + F.col("rank")).alias("i"), "tied"), "suffix-ranks"))
        else:
            again = ranked(again, ["contig_id", "i"], ["next"], ["pos"], [*columns, "i"])
            rounds.append(again.select(*columns, (F.col("i") + F.col("rank")).alias("i"), "tied"))
    return reduce(DataFrame.unionByName, [t.where("not tied") for t in rounds]).select("contig_id", "i", "pos", "front", F.col("begin").alias("head"))


def suffix_array(genome: DataFrame) -> DataFrame:
    """contig_id, i, pos: rank i of the suffix of T$ from pos, 0-based, by contig."""
    return sorted_suffixes(genome).select("contig_id", "i", "pos")


def bwt(suffixes: DataFrame) -> DataFrame:
    """contig_id, i, pos, b1, b0, sym2, head: the two symbols before each suffix, cyclically, and their pair code (null where either is none of ACGT). suffixes: as sorted."""
    b1, b0 = F.substring("front", 1, 1), F.substring("front", 2, 1)
    return suffixes.select("contig_id", "i", "pos", b1.alias("b1"), b0.alias("b0"), pair_code(b1, b0).alias("sym2"), "head")
