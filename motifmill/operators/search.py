"""Counting and locating reads: seed joins, and backward search over the rank index."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifmill.functions.encode import is_coded, pair_code, symbol_code
from motifmill.operators.bulk_count import PIECE, count_few, count_many
from motifmill.operators.contig_search import count_in_contigs
from motifmill.operators.cutting import most_bytes, pieces
from motifmill.operators.index import ENTRIES, RANGE, D, Index, rank_of
from motifmill.operators.rank_search import RankBins
from motifmill.operators.suffix import WHOLE
from motifmill.plans.storage import BROADCAST_ROWS, counted_side, discard, is_small, materialize, shuffled_side, small_side

#: Places in a chunk of a text, where patterns are short and where they are long: a substring's cost grows with its distance from the chunk's beginning.
CHUNKS = (64, 256)
#: Patterns of at least so many symbols are found by sampled places, with seeds of SAMPLED_SEED symbols, and compared in pieces of VERIFIED places.
SAMPLED, SAMPLED_SEED, VERIFIED = 48, 16, 1 << 14
#: Reads of at least so many symbols are found by seeds of that length; shorter ones by themselves.
SEEDS = (12, 8)
#: Rows of the suffix array in a bin of a range join.
BINNED = 256
#: Steps of a backward search whose ended reads stay tables of their own.
FOLD = 16
#: Patterns of middle length from which on places are dealt by their first symbols.
MANY = 4096
#: Reads of at most so many symbols are counted from the texts' k-mers of that length.
SHORT = 7
#: Reads of one pattern in a row, and places of a task, where every occurrence is listed: a task writes its places times the reads that stand there.
NAMED, LISTED = 4096, 1 << 18


def _seed(length: int) -> int:
    return next((k for k in SEEDS if length >= k), length)


def chunk_size(longest: int) -> int:
    return CHUNKS[longest > CHUNKS[0]]


def chunks(texts: DataFrame, longest: int, id_col: str, text_col: str) -> DataFrame:
    """id, base, part: overlapping pieces; a match belongs to the piece in which it starts."""
    return pieces(texts, id_col, text_col, chunk_size(longest), longest - 1)


def _lengths(patterns: DataFrame) -> list[int]:
    return [r[0] for r in patterns.select(F.length("q").alias("n")).where("n > 0").distinct().collect()]  # a few integers


def _short_counts(texts: DataFrame, patterns: DataFrame, lengths: list[int], id_col: str, text_col: str) -> DataFrame:
    """q, n of patterns of at most SHORT symbols: each place's next symbols are summed up to counted k-mers, whose number the alphabet bounds."""
    k = max(lengths)
    parts = chunks(texts, k, id_col, text_col)
    heads = parts.select("part", F.explode(F.sequence(F.lit(1), F.least(F.lit(chunk_size(k)), F.length("part")))).alias("p")).select(F.substring("part", F.col("p"), F.lit(k)).alias("head"))
    counted = heads.groupBy("head").agg(F.count(F.lit(1)).alias("n"))
    fits = counted.select("n", F.explode(F.array(*[F.when(F.length("head") >= m, F.substring("head", 1, m)) for m in sorted(lengths)])).alias("q")).where("q is not null")
    return fits.join(small_side(patterns), "q").groupBy("q").agg(F.sum("n").alias("n"))


class Texts:
    """Reference texts, and their chunks for patterns of up to ``longest`` symbols, cut and written when first asked for."""

    def __init__(self, texts: DataFrame, id_col: str = "contig_id", text_col: str = "seq"):
        self.texts, self.id_col, self.text_col = texts, id_col, text_col
        self.longest, self._held, self._most, self._bins = 0, None, None, None

    def most_bytes(self) -> int:
        if self._most is None:
            self._most = most_bytes(self.texts, self.text_col)
        return self._most

    def chunks(self, longest: int) -> tuple[DataFrame, int]:
        """(chunks, the number of symbols that each holds behind its last place and that place): a wider cut serves shorter patterns."""
        if longest > self.longest or self._held is None:
            if self._held is not None:
                discard(self._held)
            self.longest = longest
            self._held = materialize(pieces(self.texts, self.id_col, self.text_col, chunk_size(longest), longest - 1, self.most_bytes()), "chunks")
        return self._held, self.longest


    def has_bins(self, longest: int) -> bool:
        return self._bins is not None and self._bins.longest >= longest

    def bins(self, longest: int, keep: bool = False) -> RankBins:
        """The texts sorted in bins, for patterns of up to ``longest`` symbols; kept ones serve what asks for no longer patterns."""
        if self.has_bins(longest):
            return self._bins
        built = RankBins.build(self.texts, longest, id_col=self.id_col, text_col=self.text_col)
        if keep:
            self._bins = built
        return built


def _tier(length: int) -> int:
    """Tiers of patterns by length: from SAMPLED, twice that, four times that, ... symbols on."""
    return (length // SAMPLED).bit_length()


def _sampled(held: Texts, patterns: DataFrame, tiers: dict[int, tuple[int, int]]) -> DataFrame:
    """id, pos, q of places where patterns may occur, tier by tier (its shortest and longest pattern) from every w-th place of the texts.

    A pattern that occurs covers w = shortest - k + 1 places with k symbols behind each
    inside it, one of which is sampled. So the k-mers of a pattern's first w places
    are joined with the sampled ones: texts give a row for w places, patterns w rows each.
    """
    k = SAMPLED_SEED
    samples, asked = [], []
    for tier, (least, most) in tiers.items():
        w = least - k + 1
        name = F.lit(tier).alias("tier")
        samples.append(pieces(held.texts, held.id_col, held.text_col, w, k - 1, held.most_bytes()).where(F.length("part") >= k).select(name, "id", F.col("base").alias("s"), F.substring("part", 1, k).alias("seed")))
        asked.append(patterns.where(F.length("q").between(least, most)).select(name, "q", F.explode(F.sequence(F.lit(0), F.lit(w - 1))).alias("o")).select("tier", "q", "o", F.substring("q", F.col("o") + 1, F.lit(k)).alias("seed")))
    side = small_side(materialize(reduce(DataFrame.unionByName, asked), "pattern-seeds"))
    return reduce(DataFrame.unionByName, samples).join(side, ["tier", "seed"]).select("id", "q", (F.col("s") - F.col("o")).alias("pos")).where("pos >= 0")


def _whole(held: Texts, placed: DataFrame, longest: int) -> DataFrame:
    """Those of the places where the whole pattern stands. Texts are cut into long pieces, few of which are asked for."""
    placed = placed.withColumn("base", F.col("pos") - F.col("pos") % VERIFIED).withColumn("p", (F.col("pos") - F.col("base") + 1).cast("int"))
    parts = pieces(held.texts, held.id_col, held.text_col, VERIFIED, longest - 1, held.most_bytes())
    met = parts.join(small_side(materialize(placed, "places")), ["id", "base"])
    return met.where(F.substring("part", F.col("p"), F.length("q")) == F.col("q")).select("id", "pos", "q")


def _matches(held: Texts, patterns: DataFrame, carried: tuple[str, ...] = (), places: int | None = None) -> DataFrame | None:
    """id, pos (from 0), q for every occurrence of every distinct pattern, overlaps included, with the pattern's ``carried`` columns, for each of its rows.

    Patterns fall into tiers by length, each with a join of its own. Short ones: between
    the windows of the chunks and the patterns' beginnings, one for each seed length,
    then the whole pattern is compared. From SAMPLED symbols on: by sampled places, the
    further apart the longer a tier's patterns are; the places of all tiers are compared
    in one pass. Patterns are broadcast if their counted rows and bytes allow it; else
    windows and patterns are shuffled, but nothing that was found by the short ones. places: the texts are dealt out anew so that a task has about so many.
    """
    lengths = _lengths(patterns)
    out = []
    short, long = [n for n in lengths if n < SAMPLED], [n for n in lengths if n >= SAMPLED]
    if short:
        parts, reach = held.chunks(max(short))
        size = chunk_size(reach)
        if places:
            parts = parts.repartition(max(1, parts.count() * size // places), "id", "base")
    for k in sorted({_seed(n) for n in short}):
        tier = [n for n in short if _seed(n) == k]
        asked = patterns.where(F.length("q").isin(tier)).select("q", *carried, F.substring("q", 1, k).alias("seed"))
        last = F.least(F.lit(size), F.length("part") - k + 1)
        windows = parts.where(F.length("part") >= k).select("id", "base", "part", F.explode(F.sequence(F.lit(1), last)).alias("p"))
        heads = windows.select("id", (F.col("base") + F.col("p") - 1).alias("pos"), F.substring("part", F.col("p"), F.lit(max(tier))).alias("head"))
        hit = heads.withColumn("seed", F.substring("head", 1, k)).join(counted_side(asked), "seed")
        if max(tier) > k:
            hit = hit.where(F.col("head").startswith(F.col("q")))
        out.append(hit.select("id", "pos", "q", *carried))
    if long:
        tiers = {t: (min(of), max(of)) for t in sorted({_tier(n) for n in long}) if (of := [n for n in long if _tier(n) == t])}
        asked = patterns.where(F.length("q") >= SAMPLED)
        found = _whole(held, _sampled(held, asked.select("q").distinct() if carried else asked, tiers), max(long))
        out.append(found.join(counted_side(asked), "q").select("id", "pos", "q", *carried) if carried else found)
    return reduce(DataFrame.unionByName, out) if out else None


def _held(texts: DataFrame | Texts, id_col: str, text_col: str) -> Texts:
    return texts if isinstance(texts, Texts) else Texts(texts, id_col, text_col)


def locate(texts: DataFrame | Texts, reads: DataFrame, *, id_col: str = "contig_id", text_col: str = "seq") -> DataFrame:
    """read_id, <id_col>, pos of every occurrence of every read.

    Equal reads are one pattern, which goes with their ids, NAMED or so a row, into the joins that find it.
    So the rows of the result, as many as places times reads, are made last, where they are written: none is shuffled.
    """
    known = reads.select("read_id", "q").where(F.length("q") > 0)
    copies = materialize(known.groupBy("q").agg(F.count(F.lit(1)).alias("n")), "patterns")
    row = F.pmod(F.xxhash64("read_id"), F.ceil(F.col("n") / NAMED)).alias("row")
    ids = F.transform(F.collect_list(F.struct("read_id")), lambda x: x.read_id).alias("read_ids")  # null ids stay
    named = materialize(known.join(counted_side(copies), "q").groupBy("q", row).agg(ids).drop("row"), "named-patterns")
    found = _matches(_held(texts, id_col, text_col), named, ("read_ids",), LISTED)
    if found is None:
        return reads.sparkSession.createDataFrame([], f"read_id long, {id_col} long, pos long")
    return found.select(F.explode("read_ids").alias("read_id"), F.col("id").alias(id_col), "pos")


def count_matches(texts: DataFrame | Texts, reads: DataFrame, *, id_col: str = "contig_id", text_col: str = "seq") -> DataFrame:
    """read_id, q, n: exact overlapping occurrences over all texts. 0 for absent reads, null for null and empty ones.

    Patterns of over SHORT symbols that may be broadcast are looked up by every task. More than MANY
    of middle length are counted in buckets of packed windows, whose work grows with texts and patterns,
    or, where their alphabet is too large to pack and they may not be broadcast, in sorted bins of the texts.
    """
    patterns = materialize(reads.select("q").where(F.length("q") > 0).distinct(), "patterns")
    empty = F.when(F.length("q") > 0, F.lit(0).cast("long"))
    lengths = _lengths(patterns)
    short, middle = [n for n in lengths if n <= SHORT], [n for n in lengths if SHORT < n < SAMPLED]
    held = _held(texts, id_col, text_col)
    between = F.length("q").between(SHORT + 1, SAMPLED - 1)
    counts = []
    rest, left = patterns.where(F.length("q") > SHORT), [n for n in lengths if n > SHORT]
    names = {"id_col": held.id_col, "text_col": held.text_col}
    if middle:
        many, binned = patterns.where(between).count(), held.has_bins(max(middle))
        dealt = None if binned or many <= MANY else count_many(held.texts, patterns.where(between), longest_text=held.most_bytes(), **names)
        if dealt is None and (binned or many > BROADCAST_ROWS):
            asked = patterns.where(between).select(F.lit(0).alias("read_id"), "q")
            dealt = held.bins(max(middle)).count(asked).where("n > 0").select("q", "n")
        if dealt is not None:
            counts.append(dealt)
            rest, left = patterns.where(F.length("q") >= SAMPLED), [n for n in left if n >= SAMPLED]
    if left and max(left) <= PIECE >> 4 and is_small(rest, BROADCAST_ROWS):
        counts.append(count_few(held.texts, rest, longest_text=held.most_bytes(), **names))
    elif left:
        counts.append(_matches(held, rest).groupBy("q").agg(F.count(F.lit(1)).alias("n")))
    if short:
        counts.append(_short_counts(held.texts, patterns.where(F.length("q") <= SHORT), short, held.id_col, held.text_col))
    if not counts:
        return reads.select("read_id", "q", empty.alias("n"))
    counts = reduce(DataFrame.unionByName, counts)
    return reads.join(counts, "q", "left").select("read_id", "q", F.coalesce("n", empty).alias("n"))


def mapped(texts: DataFrame, reads: DataFrame, present: bool = True) -> DataFrame:
    """Reads that occur (or do not), as a semi (anti) join with the patterns found; null and empty reads do not occur."""
    patterns = materialize(reads.select("q").where(F.length("q") > 0).distinct(), "patterns")
    counted = count_matches(texts, patterns.withColumn("read_id", F.lit(0)))
    found = materialize(counted.where("n > 0").select("q"), "found")
    return reads.join(small_side(found), "q", "left_semi" if present else "left_anti").select("read_id", "q")


def shortest_unmatched(texts: DataFrame, reads: DataFrame) -> DataFrame:
    """read_id, q, k: the shortest beginning of every read that occurs nowhere; null where the whole read occurs, or is null or empty.

    A beginning of a beginning that occurs occurs too, so each round asks for the middle
    one of the lengths that are left: rounds grow with the logarithm of the longest
    read, and every round is one count of distinct patterns over the same chunks, or over the same bins where patterns are many.
    """
    held = Texts(texts)
    asks = reads.where(F.length("q") > SHORT).agg(F.count_distinct("q"), F.max(F.length("q"))).first()
    if asks[0] > BROADCAST_ROWS:
        held.bins(min(asks[1], SAMPLED - 1), keep=True)
    known = materialize(reads.where(F.length("q") > 0).select("q").distinct().select("q", F.lit(0).alias("lo"), (F.length("q") + 1).alias("hi")), "prefixes")
    while not (open_ := known.where("hi - lo > 1")).isEmpty():
        middle = F.expr("(lo + hi) div 2").cast("int")
        asked = open_.select("q", "lo", "hi", middle.alias("m")).withColumn("part", F.substring("q", F.lit(1), F.col("m")))
        counts = count_matches(held, asked.select(F.col("part").alias("q")).distinct().withColumn("read_id", F.lit(0))).select(F.col("q").alias("part"), "n")
        moved = asked.join(counts, "part").select("q", F.when(F.col("n") > 0, F.col("m")).otherwise(F.col("lo")).alias("lo"), F.when(F.col("n") > 0, F.col("hi")).otherwise(F.col("m")).alias("hi"))
        known = materialize(known.where("hi - lo <= 1").unionByName(moved), "prefixes")
    return reads.join(known, "q", "left").select("read_id", "q", F.when(F.col("hi") <= F.length("q"), F.col("hi")).alias("k"))


def backward_search(index: Index, reads: DataFrame, d: int = D) -> DataFrame:
    """contig_id, read_id, n of every read in the contig that it names.

    reads: contig_id, read_id, q. Reads of ACGT go two symbols a step from the end, over
    the pairs' ranks; reads that hold other symbols one symbol a step, over the ranks of
    single symbols, which the index has for contigs that hold others too. Intervals
    are exact at the end marker and at block ends. Null and empty reads give null, reads
    that name no contig 0. More reads than may be broadcast search rank tables in buckets, else each step would shuffle these.
    """
    found = intervals(index, reads, d).select("contig_id", "read_id", (F.col("hi") - F.col("lo")).alias("n"))
    return reads.join(shuffled_side(found), ["contig_id", "read_id"], "left").select("contig_id", "read_id", F.when(F.length("q") > 0, F.coalesce("n", F.lit(0))).alias("n"))


def backward_search_of(texts: DataFrame, reads: DataFrame, d: int = D) -> DataFrame:
    """As ``backward_search``, where no index is kept: contigs of fewer than WHOLE symbols are sorted in the task that their reads go to, longer ones have an index built."""
    longer = materialize(texts.where(F.length("seq") >= WHOLE).select("contig_id").distinct(), "long-contigs")
    if longer.isEmpty():
        return count_in_contigs(texts, reads)
    side = counted_side(longer)
    of = lambda df, how: df.join(side, "contig_id", how)
    found = backward_search(Index.build(of(texts, "left_semi"), d), of(reads, "left_semi"), d)
    return count_in_contigs(of(texts, "left_anti"), of(reads, "left_anti")).unionByName(found)


def intervals(index: Index, reads: DataFrame, d: int = D) -> DataFrame:
    """contig_id, read_id, lo, hi: the rows of the suffix array that begin with the read, of every read that occurs in the contig that it names."""
    known = reads.where(F.length("q") > 0)
    if known.count() > BROADCAST_ROWS:
        index = index.bucketed()
    pure = is_coded(F.col("q"))
    return _by_pairs(index, known.where(pure), d).unionByName(_by_symbols(index, known.where(~pure)))


def locate_by_index(index: Index, reads: DataFrame, d: int = D) -> DataFrame:
    """contig_id, read_id, pos (from 0) of every occurrence of every read in the contig that it names; only the index is read.

    A range join of intervals with the rows of the suffix array: rows lie in bins of
    BINNED, and an interval asks each bin that it touches. So what is joined is what is
    found, and at most two bins beside it, however wide an interval is.
    """
    bins = F.expr(f"sequence(lo div {BINNED}, (hi - 1) div {BINNED})")
    asked = counted_side(materialize(intervals(index, reads, d).withColumn("bin", F.explode(bins)), "asked-bins"))
    rows = index.bwt.select("contig_id", "i", "pos", F.expr(f"i div {BINNED}").alias("bin"))
    return rows.join(asked, ["contig_id", "bin"]).where("i >= lo and i < hi").select("contig_id", "read_id", "pos")


def _symbol(at) -> Column:
    return F.substring("q", at, F.lit(1))


def _steps(state: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """contig_id, read_id, lo, hi of intervals (with q, left) after ``step`` was taken until no symbols are left; each step is written out, so the plan stays short. Reads whose interval is empty drop out of the joins."""
    ends = []
    state = materialize(state, "search")
    while True:
        ends.append(state.where("left = 0 and lo < hi"))
        going = state.where("left > 0 and lo < hi")
        if going.isEmpty():
            break
        if len(ends) == FOLD:  # one table stands for what many steps have ended
            ends = [materialize(reduce(DataFrame.unionByName, ends), "search-ends")]
        state = materialize(step(going).select("contig_id", "read_id", "q", "left", "lo", "hi"), "search")
    return reduce(DataFrame.unionByName, ends).select("contig_id", "read_id", "lo", "hi")


def _by_pairs(index: Index, reads: DataFrame, d: int) -> DataFrame:
    """Two symbols a step: each is two equi-joins on (contig, block, pair)."""
    pair = lambda at: pair_code(_symbol(at), _symbol(at + 1))
    begin = reads.withColumn("left", F.length("q") - F.when(F.length("q") % 2 == 0, 2).otherwise(1))
    pairs = counted_side(index.c_table.where("sym2 < 16").select("contig_id", "sym2", "c_before", "n"), rows=ENTRIES)
    even = begin.where(F.length("q") % 2 == 0).withColumn("sym2", pair(F.length("q") - 1)).join(pairs, ["contig_id", "sym2"]).select("contig_id", "read_id", "q", "left", F.col("c_before").alias("lo"), (F.col("c_before") + F.col("n")).alias("hi"))
    odd = begin.where(F.length("q") % 2 == 1).withColumn("x", symbol_code(_symbol(F.length("q")))).join(counted_side(index.firsts, rows=ENTRIES), ["contig_id", "x"]).select("contig_id", "read_id", "q", "left", "lo", "hi")
    starts = pairs.drop("n")
    blocks = shuffled_side(index.occ.select("contig_id", "sym2", F.col("blk").alias("b"), "before", "bitmap"))

    def step(going: DataFrame) -> DataFrame:
        out = going.withColumn("sym2", pair(F.col("left") - 1)).join(starts, ["contig_id", "sym2"])
        for side in ("lo", "hi"):
            out = out.withColumn("b", F.floor(F.col(side) / d)).join(blocks, ["contig_id", "sym2", "b"]).withColumn(side, F.col("c_before") + rank_of(F.col("before"), F.col("bitmap"), F.col(side), d)).drop("b", "before", "bitmap")
        return out.withColumn("left", F.col("left") - 2)

    return _steps(even.unionByName(odd), step)


def _by_symbols(index: Index, reads: DataFrame) -> DataFrame:
    """One symbol a step: each is two equi-joins on (contig, symbol, range of rows)."""
    firsts = counted_side(index.symbols.select("contig_id", "symbol", F.col("lo").alias("first"), F.col("hi").alias("end")), rows=ENTRIES)
    ranges = shuffled_side(index.places.select("contig_id", "symbol", F.col("rng").alias("b"), "before", "offsets"))
    begin = reads.withColumn("symbol", _symbol(F.length("q"))).join(firsts, ["contig_id", "symbol"]).select("contig_id", "read_id", "q", (F.length("q") - 1).alias("left"), F.col("first").alias("lo"), F.col("end").alias("hi"))

    def step(going: DataFrame) -> DataFrame:
        out = going.withColumn("symbol", _symbol(F.col("left"))).join(firsts, ["contig_id", "symbol"])
        for side in ("lo", "hi"):
            inside = F.size(F.filter("offsets", lambda x: x < F.col(side) % RANGE))  # noqa: B023  built at once
            out = out.withColumn("b", F.floor(F.col(side) / RANGE)).join(ranges, ["contig_id", "symbol", "b"]).withColumn(side, F.col("first") + F.col("before") + inside).drop("b", "before", "offsets")
        return out.withColumn("left", F.col("left") - 1)

    return _steps(begin, step)
