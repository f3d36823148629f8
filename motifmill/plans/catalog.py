"""Registered queries of the sequence engine, each with the SQL that says the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifmill.functions import encode as en
from motifmill.operators import index as ix
from motifmill.operators import metrics, rollups, search, suffix
from motifmill.operators.cutting import pieces
from motifmill.operators.rank_search import RankBins
from motifmill.operators.rank_search import rank_counts as count_by_ranks
from motifmill.plans.storage import materialize, scratch
from motifmill.sources.fasta_source import register
from motifmill.sources.sequences import genome, genome_with_unknowns, read_fasta, reads_of, write_fasta

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: The derived tables: contigs are the texts' letters A, C, G and T; a read is a piece of its contig.
_BASE = """genome AS (SELECT doc_id AS contig_id, regexp_replace(translate(coalesce(text, ''), 'acgt', 'ACGT'), '[^ACGT]', '', 'g') AS seq FROM documents),
reads AS (SELECT contig_id AS read_id, substr(seq, 1 + (contig_id * 7919) % greatest(length(seq), 1), 7 + contig_id % 14) AS q FROM genome WHERE length(seq) > 0)"""
_SA = """pos AS (SELECT contig_id, seq || '$' AS t, unnest(range(0, length(seq) + 1)) AS pos FROM genome),
sa AS (SELECT contig_id, t, pos, row_number() OVER (PARTITION BY contig_id ORDER BY substr(t, pos + 1)) - 1 AS i FROM pos)"""
_BWT = """bwt0 AS (SELECT contig_id, i, pos,
  substr(t, CASE WHEN pos <= 1 THEN length(t) - 1 + pos ELSE pos - 1 END, 1) AS b1, substr(t, CASE WHEN pos = 0 THEN length(t) ELSE pos END, 1) AS b0 FROM sa),
bwt AS (SELECT contig_id, i, pos, CASE WHEN b1 = '' THEN '$' ELSE b1 END AS b1, b0, CASE WHEN b1 <> '$' AND b1 <> '' AND b0 <> '$' THEN (4 * (instr('ACGT', b1) - 1) + instr('ACGT', b0) - 1)::INTEGER END AS sym2 FROM bwt0)"""
_COUNT = """counts AS (SELECT q, sum(n)::BIGINT AS n FROM (
  SELECT r.q, count(*) AS n FROM (SELECT DISTINCT q FROM {reads} WHERE length(q) >= 7) r JOIN (
    SELECT substr(seq, p, 7) AS seed, seq, p FROM (SELECT seq, unnest(range(1, length(seq) - 5)) AS p FROM genome)) w
    ON w.seed = substr(r.q, 1, 7) AND substr(w.seq, w.p, length(r.q)) = r.q GROUP BY r.q
  UNION ALL SELECT r.q, count(*) FROM (SELECT DISTINCT q, length(q) AS k FROM {reads} WHERE length(q) < 7) r JOIN (
    SELECT seq, unnest(range(1, length(seq) + 1)) AS p FROM genome) w ON substr(w.seq, w.p, r.k) = r.q GROUP BY r.q) GROUP BY q)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def with_base(*parts: str) -> str:
    """A statement over the derived tables; the last part may go on with common tables of its own."""
    *ctes, last = parts
    more = ",\n" if re.match(r"\w+ AS \(", last) else "\n"
    return "WITH " + ",\n".join([_BASE, *ctes]) + more + last


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads_of(genome(spark, sf_dir))


@query(with_base("SELECT contig_id, seq, length(seq)::INTEGER AS len FROM genome"))
def reference_scan(spark, sf_dir):
    return genome(spark, sf_dir).select("contig_id", "seq", F.length("seq").alias("len"))


@query(with_base("SELECT read_id, q, length(q)::INTEGER AS len FROM reads"))
def reads_scan(spark, sf_dir):
    return _reads(spark, sf_dir).select("read_id", "q", F.length("q").alias("len"))


@query(with_base("SELECT count(*) AS n_reads, sum(length(q))::BIGINT AS bases, round(avg(length(q)), 6) AS mean_len FROM reads"))
def reads_profile(spark, sf_dir):
    return _reads(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_reads"), F.sum(F.length("q")).alias("bases"), F.round(F.avg(F.length("q")), 6).alias("mean_len"))


@query(with_base("SELECT sym, count(*) AS n FROM (SELECT unnest(string_split(seq, '')) AS sym FROM genome) WHERE sym <> '' GROUP BY sym"))
def base_composition(spark, sf_dir):
    """Counted by length differences: no row for each base."""
    sums = genome(spark, sf_dir).agg(*[F.sum(en.count_symbol(F.col("seq"), s)).alias(s) for s in en.ALPHABET])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(s).alias("sym"), F.coalesce(F.col(s), F.lit(0)).alias("n")) for s in en.ALPHABET])).alias("e")).select("e.sym", "e.n").where("n > 0")


@query(with_base("""syms AS (SELECT DISTINCT sym FROM (SELECT unnest(string_split(seq, '')) AS sym FROM genome) WHERE sym <> '')
SELECT sym, (row_number() OVER (ORDER BY sym) - 1)::INTEGER AS code, (SELECT ceil(log2(count(*)))::INTEGER FROM syms) AS bits FROM syms"""))
def alphabet_stats(spark, sf_dir):
    """Distinct symbols meet per contig first; the ranking sees the alphabet only."""
    syms = genome(spark, sf_dir).select(F.explode(F.array_distinct(F.split("seq", ""))).alias("sym")).where("sym <> ''").distinct()
    ordered = syms.agg(F.sort_array(F.collect_list("sym")).alias("all"))
    return ordered.select(F.posexplode("all").alias("code", "sym"), en.bits_per_symbol(F.size("all")).alias("bits")).select("sym", F.col("code").cast("int"), "bits")


@query(with_base("SELECT contig_id, translate(seq, 'ACGT', '0123') AS codes FROM genome"))
def encode_symbols(spark, sf_dir):
    return genome(spark, sf_dir).select("contig_id", en.code_digits(F.col("seq")).alias("codes"))


@query(with_base("""SELECT read_id, p::INTEGER AS p, (4 * (instr('ACGT', substr(q, p, 1)) - 1) + instr('ACGT', substr(q, p + 1, 1)) - 1)::INTEGER AS sym2
FROM (SELECT read_id, q, unnest(range(1, length(q))) AS p FROM reads)"""))
def pair_encode(spark, sf_dir):
    pairs = _reads(spark, sf_dir).where("length(q) > 1").select("read_id", "q", F.explode(F.sequence(F.lit(1), F.length("q") - 1)).alias("p"))
    return pairs.select("read_id", "p", (4 * en.symbol_code(F.substring("q", F.col("p"), F.lit(1))) + en.symbol_code(F.substring("q", F.col("p") + 1, F.lit(1)))).alias("sym2"))


_KMER_SQL = """ends AS (SELECT read_id, CASE WHEN length(q) % 2 = 0 THEN 6 ELSE 5 END AS k, q FROM reads),
kmers AS (SELECT read_id, k, substr(q, length(q) - k + 1, k) AS kmer FROM ends WHERE length(q) >= k),
coded AS (SELECT *, (list_sum(list_transform(range(1, k + 1), lambda j: (instr('ACGT', substr(kmer, j, 1)) - 1) * (4 ** (k - j)))))::BIGINT AS code FROM kmers)"""


def _seeds(spark, sf_dir):
    ends = _reads(spark, sf_dir).withColumn("k", F.when(F.length("q") % 2 == 0, 6).otherwise(5)).where("length(q) >= k")
    return ends.select("read_id", "k", F.substring("q", F.length("q") - F.col("k") + 1, F.col("k")).alias("kmer"))


@query(with_base(_KMER_SQL, "SELECT read_id, k, kmer, code FROM coded"))
def kmer_encode(spark, sf_dir):
    return _seeds(spark, sf_dir).withColumn("code", en.kmer_code(F.col("kmer")))


@query(with_base(_KMER_SQL, "SELECT read_id, code, kmer FROM coded"))
def kmer_decode(spark, sf_dir):
    coded = _seeds(spark, sf_dir).withColumn("code", en.kmer_code(F.col("kmer")))
    return coded.select("read_id", "code", F.when(F.col("k") == 6, en.kmer_text(F.col("code"), 6)).otherwise(en.kmer_text(F.col("code"), 5)).alias("kmer"))


@query(with_base("""every AS (SELECT k, code, (SELECT string_agg(substr('ACGT', ((code // (4 ** (k - j))::BIGINT) % 4 + 1)::BIGINT, 1), '' ORDER BY j) FROM range(1, k + 1) t(j)) AS kmer
FROM (SELECT 5 AS k, unnest(range(0, 1024)) AS code UNION ALL SELECT 6, unnest(range(0, 4096)))),
met AS (SELECT substr(seq, p, k) AS kmer, count(*) AS n FROM (SELECT seq, k, unnest(range(1, length(seq) - k + 2)) AS p FROM genome CROSS JOIN (VALUES (5), (6)) v(k)) GROUP BY 1)
SELECT k, code, kmer, coalesce(n, 0) AS n FROM every LEFT JOIN met USING (kmer)"""))
def kmer_universe(spark, sf_dir):
    """Every k-mer of five and six symbols, and how often the texts hold it: the alphabet bounds both sides of the join."""
    parts = [spark.range(4**k).select(F.lit(k).alias("k"), F.col("id").alias("code"), en.kmer_text(F.col("id"), k).alias("kmer")) for k in (5, 6)]
    met = [_kmers(genome(spark, sf_dir), k).groupBy("kmer").agg(F.count(F.lit(1)).alias("n")) for k in (5, 6)]
    return parts[0].unionByName(parts[1]).join(met[0].unionByName(met[1]), "kmer", "left").select("k", "code", "kmer", F.coalesce("n", F.lit(0)).alias("n"))


@query(with_base("""SELECT contig_id, w AS word_no, sum((instr('ACGT', substr(seq, (w * 16 + j)::BIGINT, 1)) - 1)::BIGINT * (4 ** (16 - j))::BIGINT)::BIGINT AS word
FROM (SELECT contig_id, seq, w, unnest(range(1, 17)) AS j FROM (SELECT contig_id, seq, unnest(range(0, (length(seq) + 15) // 16)) AS w FROM genome))
WHERE w * 16 + j <= length(seq) GROUP BY contig_id, w"""))
def bitpack_words(spark, sf_dir):
    """16 symbols in 32 bits, the first one in the highest bits, the last word filled with zeros."""
    words = suffix_chunks(genome(spark, sf_dir), 16)
    return words.select("contig_id", "word_no", F.conv(F.rpad(en.code_digits(F.col("part")), 16, "0"), 4, 10).cast("long").alias("word"))


def suffix_chunks(texts: DataFrame, size: int) -> DataFrame:
    """contig_id, word_no, part: non-overlapping pieces."""
    return pieces(texts, "contig_id", "seq", size, 0).select(F.col("id").alias("contig_id"), F.expr(f"base div {size}").alias("word_no"), "part")


@query(with_base("SELECT contig_id, list_aggregate(list_transform(string_split(seq, ''), lambda c: (instr('ACGT', c) - 1)::VARCHAR), 'string_agg', '') AS codes FROM genome WHERE seq <> ''"))
def bitunpack_words(spark, sf_dir):
    """The packed words taken apart again, symbol by symbol; a contig's words are put together in their order."""
    texts = genome(spark, sf_dir)
    words = bitpack_words(spark, sf_dir).join(texts.select("contig_id", F.length("seq").alias("n")), "contig_id")
    codes = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: en.packed_symbol(F.col("word"), j).cast("string"))
    left = F.least(F.lit(16), F.col("n") - F.col("word_no") * 16).cast("int")
    held = words.select("contig_id", "word_no", F.array_join(F.slice(codes, F.lit(1), left), "").alias("codes"))
    rows = held.groupBy("contig_id").agg(F.sort_array(F.collect_list(F.struct("word_no", "codes"))).alias("r"))
    return rows.select("contig_id", F.concat_ws("", F.transform("r", lambda x: x.codes)).alias("codes"))


@query(with_base("""SELECT contig_id, p AS piece, translate(substr(seq, p * 256 + 1, 256), 'ACGT', '0123') AS codes
FROM (SELECT contig_id, seq, unnest(range(0, (length(seq) + 255) // 256)) AS p FROM genome)"""))
def bitunpack_pieces(spark, sf_dir):
    """The packed words taken apart again in pieces of 256 symbols, so that no row or group grows with a contig."""
    return en.unpacked(bitpack_words(spark, sf_dir), genome(spark, sf_dir).select("contig_id", F.length("seq").alias("n")), 256)


@query(with_base("""SELECT contig_id, length(seq)::BIGINT + 1 AS n_rows, 2 AS bits, ((length(seq) + 1) * 2 + 7) // 8 AS packed_bytes,
round((length(seq) + 1) / (((length(seq) + 1) * 2 + 7) // 8)::DOUBLE, 6) AS ratio FROM genome"""))
def compression_ratio(spark, sf_dir):
    n = F.length("seq").cast("long") + 1
    packed = en.ceil_div(n * 2, F.lit(8))
    return genome(spark, sf_dir).select("contig_id", n.alias("n_rows"), F.lit(2).alias("bits"), packed.alias("packed_bytes"), F.round(n / packed.cast("double"), 6).alias("ratio"))


@query(with_base(_SA, "SELECT contig_id, i, pos FROM sa"))
def suffix_array(spark, sf_dir):
    return ix.suffixes_of(genome(spark, sf_dir), sf_dir).select("contig_id", "i", "pos")


def _index(spark, sf_dir) -> ix.Index:
    return ix.index_of(genome(spark, sf_dir), sf_dir)


@query(with_base(_SA, _BWT, "SELECT contig_id, i, b1, b0, sym2 FROM bwt"))
def bwt(spark, sf_dir):
    return _index(spark, sf_dir).bwt.select("contig_id", "i", "b1", "b0", "sym2")


@query(with_base(_SA, _BWT, "SELECT contig_id, string_agg(b0, '' ORDER BY i) AS b0, string_agg(b1, '' ORDER BY i) AS b1 FROM bwt GROUP BY contig_id"))
def bwt_string(spark, sf_dir):
    """One string a contig: as long as the contig itself, joined from pieces."""
    rows = ix.dumped(_index(spark, sf_dir).bwt).groupBy("contig_id").agg(F.sort_array(F.collect_list(F.struct("piece", "b0", "b1"))).alias("r"))
    return rows.select("contig_id", *[F.array_join(f"r.{c}", "").alias(c) for c in ("b0", "b1")])


@query(with_base(_SA, _BWT, "SELECT contig_id, i // 256 AS piece, string_agg(b0, '' ORDER BY i) AS b0, string_agg(b1, '' ORDER BY i) AS b1 FROM bwt GROUP BY ALL"))
def bwt_pieces(spark, sf_dir):
    """The transform's columns as strings of 256 symbols."""
    return ix.dumped(_index(spark, sf_dir).bwt, 256)


_PAIRS = "pairs AS (SELECT contig_id, sym2, count(*) AS n FROM bwt WHERE sym2 IS NOT NULL GROUP BY contig_id, sym2)"


@query(with_base(_SA, _BWT, _PAIRS, "SELECT contig_id, sym2, n FROM pairs"))
def pair_counts(spark, sf_dir):
    return ix.pair_counts(_index(spark, sf_dir).bwt)


_C = """ends AS (SELECT contig_id, CASE WHEN seq <> '' THEN instr('ACGT', right(seq, 1)) - 1 END AS last FROM genome),
c AS (SELECT e.contig_id, s.sym2::INTEGER AS sym2, coalesce(p.n, 0) AS n, (1 + coalesce(sum(p.n) OVER (PARTITION BY e.contig_id ORDER BY s.sym2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  + CASE WHEN s.sym2 >= 4 * last THEN 1 ELSE 0 END)::BIGINT AS c_before
  FROM ends e CROSS JOIN range(0, 17) s(sym2) LEFT JOIN pairs p ON p.contig_id = e.contig_id AND p.sym2 = s.sym2)"""


@query(with_base(_SA, _BWT, _PAIRS, _C, "SELECT contig_id, sym2, n, c_before FROM c"))
def c_table(spark, sf_dir):
    return _index(spark, sf_dir).c_table


_OCC = """frame AS (SELECT contig_id, blk, s.sym2::INTEGER AS sym2 FROM (SELECT contig_id, unnest(range(0, (length(seq) + 1) // 64 + 1)) AS blk FROM genome) CROSS JOIN range(0, 16) s(sym2)),
inblk AS (SELECT contig_id, i // 64 AS blk, sym2, count(*) AS n, sum(CASE WHEN i % 64 < 32 THEN 1::BIGINT << (31 - i % 64) ELSE 0 END)::BIGINT AS hi, sum(CASE WHEN i % 64 >= 32 THEN 1::BIGINT << (63 - i % 64) ELSE 0 END)::BIGINT AS lo
  FROM bwt WHERE sym2 IS NOT NULL GROUP BY ALL)"""


@query(with_base(_SA, _BWT, _OCC, """SELECT f.contig_id, f.blk, f.sym2, coalesce(sum(b.n) OVER (PARTITION BY f.contig_id, f.sym2 ORDER BY f.blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
FROM frame f LEFT JOIN inblk b USING (contig_id, blk, sym2)"""))
def occ_sampled(spark, sf_dir):
    return _index(spark, sf_dir).occ.select("contig_id", "blk", "sym2", "before")


@query(with_base(_SA, _BWT, _OCC, "SELECT contig_id, blk, sym2, n::INTEGER AS n_set, hi AS high_half, lo AS low_half FROM inblk"))
def occ_bitmap(spark, sf_dir):
    """The 64-bit maps in halves of 32 bits, where any bit is set."""
    halves = _index(spark, sf_dir).occ.where("bitmap <> 0")
    return halves.select("contig_id", "blk", "sym2", F.bit_count("bitmap").alias("n_set"), F.call_function("shiftrightunsigned", "bitmap", F.lit(32)).alias("high_half"), F.col("bitmap").bitwiseAND(F.lit((1 << 32) - 1)).alias("low_half"))


@query(with_base(_SA, _BWT, """asked AS (SELECT contig_id, (contig_id * 7919) % (length(seq) + 2) AS row_no, (contig_id % 16)::INTEGER AS sym2 FROM genome)
SELECT a.contig_id, a.row_no, a.sym2, count(b.i) AS rank FROM asked a LEFT JOIN bwt b ON b.contig_id = a.contig_id AND b.sym2 = a.sym2 AND b.i < a.row_no GROUP BY ALL"""))
def rank_query(spark, sf_dir):
    """Rank of one pair at one row of every contig, from the sampled counter and the bitmap's upper bits."""
    asked = genome(spark, sf_dir).select("contig_id", (F.col("contig_id") * 7919 % (F.length("seq") + 2)).alias("row_no"), (F.col("contig_id") % 16).cast("int").alias("sym2"))
    found = asked.withColumn("blk", F.expr("row_no div 64")).join(_index(spark, sf_dir).occ, ["contig_id", "blk", "sym2"])
    return found.select("contig_id", "row_no", "sym2", ix.rank_of(F.col("before"), F.col("bitmap"), F.col("row_no")).alias("rank"))


_LUT = """lut AS (SELECT contig_id, k::INTEGER AS k, substr(t, pos + 1, k) AS kmer, min(i) AS lo, max(i) + 1 AS hi FROM sa CROSS JOIN (VALUES (5), (6)) v(k)
  WHERE pos + k < length(t) GROUP BY ALL)"""


@query(with_base(_SA, _LUT, "SELECT contig_id, k, kmer, lo, hi FROM lut"))
def lut_build(spark, sf_dir):
    return _index(spark, sf_dir).lut.select("contig_id", "k", "kmer", "lo", "hi")


@query(with_base(_SA, _LUT, _KMER_SQL, "SELECT read_id, r.k, r.kmer, count(l.lo) AS n_contigs, coalesce(sum(l.hi - l.lo), 0)::BIGINT AS width FROM kmers r LEFT JOIN lut l ON l.k = r.k AND l.kmer = r.kmer GROUP BY ALL"))
def lut_seed(spark, sf_dir):
    """Widths of the start intervals of every read, over all contigs; intervals are summed by k-mer before the join."""
    sums = _index(spark, sf_dir).lut.groupBy("k", "kmer").agg(F.count(F.lit(1)).alias("n_contigs"), F.sum(F.col("hi") - F.col("lo")).alias("width"))
    return _seeds(spark, sf_dir).join(sums, ["k", "kmer"], "left").select("read_id", "k", "kmer", F.coalesce("n_contigs", F.lit(0)).alias("n_contigs"), F.coalesce("width", F.lit(0)).alias("width"))


@query(with_base("""SELECT r.read_id AS contig_id, r.read_id, (SELECT count(*) FROM range(1, length(g.seq) + 1) t(p) WHERE substr(g.seq, p, length(r.q)) = r.q) AS n
FROM reads r JOIN genome g ON g.contig_id = r.read_id"""))
def backward_search(spark, sf_dir):
    """Each read in its own contig, by backward search over the rank index."""
    return search.backward_search(_index(spark, sf_dir), _reads(spark, sf_dir).withColumn("contig_id", F.col("read_id")))


@query(with_base("""SELECT r.read_id AS contig_id, r.read_id, (SELECT count(*) FROM range(1, length(g.seq) + 1) t(p) WHERE substr(g.seq, p, length(r.q)) = r.q) AS n
FROM (SELECT read_id, reverse(q) AS q FROM reads) r JOIN genome g ON g.contig_id = r.read_id"""))
def backward_search_bucketed(spark, sf_dir):
    """Reads turned round, each in its own contig, over rank tables in buckets that no step shuffles."""
    reads = _reads(spark, sf_dir).select(F.col("read_id").alias("contig_id"), "read_id", F.reverse("q").alias("q"))
    return search.backward_search(_index(spark, sf_dir).bucketed(), reads)


@query(with_base(_COUNT.format(reads="reads"), "SELECT read_id, r.q, coalesce(n, 0) AS n FROM reads r LEFT JOIN counts USING (q)"))
def count_matches(spark, sf_dir):
    return search.count_matches(genome(spark, sf_dir), _reads(spark, sf_dir))


@query(with_base(_COUNT.format(reads="reads"), "SELECT coalesce(sum(n), 0)::BIGINT AS total FROM reads r LEFT JOIN counts USING (q)"))
def total_occurrences(spark, sf_dir):
    return search.count_matches(genome(spark, sf_dir), _reads(spark, sf_dir)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


_BACK = "back AS (SELECT read_id, reverse(q) AS q FROM reads)"


@query(with_base(_BACK, _COUNT.format(reads="back"), "SELECT read_id, q FROM back WHERE q IN (SELECT q FROM counts)"))
def reads_mapped(spark, sf_dir):
    """Reads turned round, so that some are absent: those that occur."""
    return search.mapped(genome(spark, sf_dir), _reads(spark, sf_dir).withColumn("q", F.reverse("q")))


@query(with_base(_BACK, _COUNT.format(reads="back"), "SELECT read_id, q FROM back WHERE q NOT IN (SELECT q FROM counts)"))
def reads_unmapped(spark, sf_dir):
    return search.mapped(genome(spark, sf_dir), _reads(spark, sf_dir).withColumn("q", F.reverse("q")), present=False)


@query(with_base("""w AS (SELECT contig_id, seq, unnest(range(1, length(seq) + 1)) AS p FROM genome)
SELECT r.read_id, w.contig_id, w.p - 1 AS pos FROM reads r JOIN w ON substr(w.seq, w.p, 7) = substr(r.q, 1, 7) AND substr(w.seq, w.p, length(r.q)) = r.q WHERE length(r.q) >= 7
UNION ALL SELECT r.read_id, w.contig_id, w.p - 1 FROM (SELECT * FROM reads WHERE length(q) < 7) r JOIN w ON substr(w.seq, w.p, length(r.q)) = r.q"""))
def locate(spark, sf_dir):
    """Where every read occurs: contig and offset."""
    return search.locate(genome(spark, sf_dir), _reads(spark, sf_dir))


@query(with_base("""SELECT g.contig_id, r.read_id, unnest(list_filter(range(1, length(g.seq) - length(r.q) + 2), lambda p: substr(g.seq, p, length(r.q)) = r.q)) - 1 AS pos
FROM reads r JOIN genome g ON g.contig_id = r.read_id"""))
def locate_by_index(spark, sf_dir):
    """Where every read occurs in its own contig, from the rank index and the suffix array alone."""
    return search.locate_by_index(_index(spark, sf_dir), _reads(spark, sf_dir).withColumn("contig_id", F.col("read_id")))


@query(with_base("SELECT read_id, ntile(8) OVER (ORDER BY read_id)::INTEGER AS block FROM reads"))
def read_partitions(spark, sf_dir):
    return metrics.ntile_blocks(_reads(spark, sf_dir), "read_id", 8)


@query(with_base("SELECT sum(2 * length(q))::BIGINT AS lf_ops, sum(2 * length(q) * 5)::BIGINT AS lf_ops_of_5_runs FROM reads"))
def lf_ops(spark, sf_dir):
    """Rank steps of one pass over the reads and of five: two interval bounds a symbol."""
    n = F.sum(2 * F.length("q"))
    return _reads(spark, sf_dir).agg(n.alias("lf_ops"), (n * 5).alias("lf_ops_of_5_runs"))


def _runs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "event_id", "value")


@query("""WITH first AS (SELECT event_type, min((ts, event_id)) AS f FROM events GROUP BY event_type),
rest AS (SELECT e.* FROM events e JOIN first f ON f.event_type = e.event_type AND (e.ts, e.event_id) <> f.f)
SELECT event_type, count(*) AS runs, round(min(value), 6) AS least, round(avg(value), 6) AS mean, round(max(value), 6) AS most, arg_min(event_id, (value, ts, event_id)) AS least_run,
arg_min(event_id, (-value, ts, event_id)) AS most_run, round(100 * stddev_pop(value) / avg(value), 4) AS spread FROM rest GROUP BY event_type""")
def run_metrics(spark, sf_dir):
    return metrics.run_metrics(_runs(spark, sf_dir), group="event_type", order=["ts", "event_id"], run="event_id", secs="value")


@query("""WITH runs AS (SELECT *, CASE WHEN event_type = 'view' THEN user_id ELSE length(event_type) * 1000000000 END AS ops FROM events),
every AS (SELECT event_type, min(ops) = max(ops) AS agree, min((ts, event_id)) AS f, max(ops) AS ops, sum(ops)::DOUBLE / sum(value) AS overall FROM runs GROUP BY event_type),
rest AS (SELECT r.event_type, min(value) AS least, avg(value) AS mean_secs FROM runs r JOIN every e ON e.event_type = r.event_type AND (r.ts, r.event_id) <> e.f GROUP BY r.event_type)
SELECT event_type, agree, CASE WHEN agree THEN round(overall / 1e9, 9) END AS raw, CASE WHEN agree THEN round(ops / least / 1e9, 9) END AS best, CASE WHEN agree THEN round(ops / mean_secs / 1e9, 9) END AS mean
FROM every LEFT JOIN rest USING (event_type)""")
def throughput(spark, sf_dir):
    """Rates of runs that agree in their operations; one group's do not."""
    runs = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ops", F.expr("if(event_type = 'view', user_id, length(event_type) * 1000000000L)"))
    return metrics.throughput(runs, group="event_type", order=["ts", "event_id"], secs="value", ops="ops")


@query("""SELECT round(1000 * ((sum(user_id) FILTER (WHERE event_type = 'error')) // (count(user_id) FILTER (WHERE event_type = 'error')))::DOUBLE
  / ((sum(user_id) FILTER (WHERE event_type = 'click')) // (count(user_id) FILTER (WHERE event_type = 'click'))), 6) AS ratio FROM events""")
def counter_ratio(spark, sf_dir):
    return metrics.per_thousand(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "user_id"), "event_type", "user_id", "error", "click")


@query("SELECT event_type, min(value) = max(value) AS consistent FROM events GROUP BY event_type")
def runs_consistent(spark, sf_dir):
    return metrics.all_equal(_runs(spark, sf_dir), "event_type", "value")


@query("SELECT event_type, (sum(user_id) // count(user_id))::BIGINT AS mean FROM events GROUP BY event_type")
def counter_avg(spark, sf_dir):
    return metrics.counter_means(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "user_id"), "event_type", "user_id")


@query(with_base(_SA, _BWT, _PAIRS, _C, """SELECT 'bwt' AS name, count(*) AS n_rows, sum(i * 31 + pos * 7 + coalesce(sym2, 99))::BIGINT AS checksum FROM bwt
UNION ALL SELECT 'c_table', count(*), sum(sym2 * 31 + c_before * 7 + n)::BIGINT FROM c"""))
def index_roundtrip(spark, sf_dir):
    """The index written, read back and summed up."""
    path = scratch(spark, "index")
    _index(spark, sf_dir).save(path)
    return _checksums(ix.Index.load(spark, path))


def _checksums(back: ix.Index) -> DataFrame:
    rows = back.bwt.agg(F.lit("bwt").alias("name"), F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("i") * 31 + F.col("pos") * 7 + F.coalesce("sym2", F.lit(99))).alias("checksum"))
    return rows.unionByName(back.c_table.agg(F.lit("c_table").alias("name"), F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("sym2") * 31 + F.col("c_before") * 7 + F.col("n")).alias("checksum")))


@query(with_base(_SA, _BWT, _PAIRS, _C, """SELECT 'bwt' AS name, count(*) AS n_rows, sum(i * 31 + pos * 7 + coalesce(sym2, 99))::BIGINT AS checksum FROM bwt
UNION ALL SELECT 'c_table', count(*), sum(sym2 * 31 + c_before * 7 + n)::BIGINT FROM c"""))
def index_extended(spark, sf_dir):
    """An index of some contigs, saved, to which the others are added later without sorting the first ones again."""
    texts = genome(spark, sf_dir)
    path = scratch(spark, "index-extended")
    ix.Index.build(texts.where("contig_id % 3 > 0")).save(path)
    ix.Index.append(texts.where("contig_id % 3 = 0"), path)
    return _checksums(ix.Index.load(spark, path))


@query(with_base(_SA, _BWT, _PAIRS, """lut AS (SELECT contig_id, k::INTEGER AS k, substr(t, pos + 1, k) AS kmer FROM sa CROSS JOIN (VALUES (5), (6)) v(k) WHERE pos + k < length(t) GROUP BY ALL)
SELECT g.contig_id, length(g.seq)::BIGINT + 1 AS rows, (length(g.seq) + 1) // 64 + 1 AS blocks, coalesce(p.pairs, 0)::BIGINT AS pairs, coalesce(p.kinds, 0)::BIGINT AS kinds, coalesce(l.entries, 0)::BIGINT AS entries FROM genome g
LEFT JOIN (SELECT contig_id, sum(n) AS pairs, count(*) AS kinds FROM pairs GROUP BY contig_id) p USING (contig_id) LEFT JOIN (SELECT contig_id, count(*) AS entries FROM lut GROUP BY contig_id) l USING (contig_id)"""))
def index_summary(spark, sf_dir):
    return _index(spark, sf_dir).summary()


#: Contigs with the letter N for unknown symbols; reads of them that hold none, and one that does.
_UNKNOWN = """unknown AS (SELECT doc_id AS contig_id, regexp_replace(translate(coalesce(text, ''), 'acgtn', 'ACGTN'), '[^ACGTN]', '', 'g') AS seq FROM documents),
asked AS (SELECT contig_id, contig_id * 2 + w AS read_id, CASE w WHEN 0 THEN replace(substr(seq, 1 + (contig_id * 31) % greatest(length(seq), 1), 9), 'N', '') ELSE substr(seq, 1 + (contig_id * 17) % greatest(length(seq), 1), 1 + contig_id % 4) END AS q
  FROM unknown CROSS JOIN (VALUES (0), (1)) v(w) WHERE seq <> '')"""


def _unknown(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    texts = materialize(genome_with_unknowns(spark.read.parquet(f"{sf_dir}/documents.parquet")), "unknown")
    at = lambda k: (1 + F.col("contig_id") * k % F.greatest(F.length("seq"), F.lit(1))).cast("int")
    reads = texts.where("seq <> ''").select("contig_id", F.posexplode(F.array(F.replace(F.substring("seq", at(31), F.lit(9)), F.lit("N"), F.lit("")), F.substring("seq", at(17), (1 + F.col("contig_id") % 4).cast("int")))).alias("w", "q"))
    return texts, reads.select("contig_id", (F.col("contig_id") * 2 + F.col("w")).alias("read_id"), "q")


@query("WITH " + _UNKNOWN + """ SELECT a.contig_id, a.read_id, CASE WHEN a.q = '' THEN NULL ELSE (SELECT count(*) FROM range(1, length(u.seq) + 1) t(p) WHERE substr(u.seq, p, length(a.q)) = a.q) END AS n
FROM asked a JOIN unknown u USING (contig_id)""")
def backward_search_unknown(spark, sf_dir):
    """Backward search in contigs that hold unknown symbols, reads that hold one among them."""
    texts, reads = _unknown(spark, sf_dir)
    return search.backward_search_of(texts, reads)


#: Contigs as they stand, small and capital letters apart, and two reads of each.
_MIXED = """mixed AS (SELECT doc_id AS contig_id, regexp_replace(coalesce(text, ''), '[^ACGTNacgtn]', '', 'g') AS seq FROM documents),
asked AS (SELECT contig_id, contig_id * 2 + w AS read_id, substr(seq, 1 + (contig_id * (CASE w WHEN 0 THEN 31 ELSE 17 END)) % greatest(length(seq), 1), 1 + (contig_id + w) % 11) AS q
  FROM mixed CROSS JOIN (VALUES (0), (1)) v(w) WHERE seq <> '')"""


def _mixed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = materialize(docs.select(F.col("doc_id").alias("contig_id"), F.regexp_replace(F.coalesce("text", F.lit("")), "[^ACGTNacgtn]+", "").alias("seq")), "mixed")
    begin = (1 + F.col("contig_id") * F.when(F.col("w") == 0, 31).otherwise(17) % F.greatest(F.length("seq"), F.lit(1))).cast("int")
    reads = texts.where("seq <> ''").withColumn("w", F.explode(F.array(F.lit(0), F.lit(1))))
    return texts, reads.select("contig_id", (F.col("contig_id") * 2 + F.col("w")).alias("read_id"), F.substring("seq", begin, (1 + (F.col("contig_id") + F.col("w")) % 11).cast("int")).alias("q"))


@query("WITH " + _MIXED + """ SELECT a.contig_id, a.read_id, (SELECT count(*) FROM range(1, length(u.seq) + 1) t(p) WHERE substr(u.seq, p, length(a.q)) = a.q) AS n
FROM asked a JOIN mixed u USING (contig_id)""")
def backward_search_mixed(spark, sf_dir):
    """Backward search for reads of small and capital letters and N, each in its own contig."""
    texts, reads = _mixed(spark, sf_dir)
    return search.backward_search_of(texts, reads)


@query("WITH " + _MIXED + """, w AS (SELECT seq, unnest(range(1, length(seq) + 1)) AS p FROM mixed), kinds AS (SELECT DISTINCT q, length(q) AS k FROM asked),
counts AS (SELECT r.q, count(*) AS n FROM (SELECT k, substr(seq, p, k) AS s FROM w CROSS JOIN (SELECT DISTINCT k FROM kinds)) x JOIN kinds r ON r.k = x.k AND r.q = x.s GROUP BY r.q)
SELECT read_id, q, coalesce(n, 0) AS n FROM asked LEFT JOIN counts USING (q)""")
def rank_counts_saved(spark, sf_dir):
    """Reads of any letters in all contigs, by rank searches over bins that were written and loaded again."""
    texts, reads = _mixed(spark, sf_dir)
    path = scratch(spark, "bins")
    RankBins.build(texts, 32).save(path)
    return RankBins.load(spark, path).count(materialize(reads.select("read_id", "q"), "mixed-reads"))


@query("WITH " + _UNKNOWN + """, pos AS (SELECT contig_id, seq || '$' AS t, unnest(range(0, length(seq) + 1)) AS pos FROM unknown),
begins AS (SELECT contig_id, substr(t, pos + 1, 2) AS b FROM pos), codes AS (SELECT s AS sym2, substr('ACGT', (s // 4 + 1)::BIGINT, 1) || substr('ACGT', (s % 4 + 1)::BIGINT, 1) AS pair FROM range(0, 16) t(s))
SELECT u.contig_id, c.sym2::INTEGER AS sym2, count(*) FILTER (WHERE b = pair) AS n, count(*) FILTER (WHERE b < pair) AS c_before FROM unknown u CROSS JOIN codes c JOIN begins g ON g.contig_id = u.contig_id GROUP BY ALL
UNION ALL SELECT contig_id, 16, 0, length(seq) + 1 FROM unknown""")
def c_table_unknown(spark, sf_dir):
    texts, _ = _unknown(spark, sf_dir)
    begins = suffix.positions(texts, 2).groupBy("contig_id", F.col("head").alias("begin")).agg(F.count(F.lit(1)).alias("n"))
    return ix.c_table(ix.meta_table(texts), begins)


@query(with_base("SELECT 'r' || read_id || ' a->b>c' AS header, q, length(q)::INTEGER AS len FROM reads"))
def fasta_roundtrip(spark, sf_dir):
    """Reads written as FASTA files, with headers that hold '>', and read again; sequences span lines of 7 symbols."""
    path = scratch(spark, "fasta")
    lines = F.regexp_replace("q", "(.{7})(?=.)", "$1\n")
    write_fasta(_reads(spark, sf_dir).select("read_id", F.concat(F.lit("r"), "read_id", F.lit(" a->b>c")).alias("header"), lines.alias("q")), path)
    return read_fasta(spark, path).select("header", "q", "len")


@query(with_base("SELECT 's' || read_id || ' x>y' AS header, q, length(q)::INTEGER AS len FROM reads"))
def fasta_source(spark, sf_dir):
    """Reads written as FASTA files and read by the data source in ranges of two kilobytes, whose ends cut records."""
    path = scratch(spark, "fasta-source")
    lines = F.regexp_replace("q", "(.{5})(?=.)", "$1\n")
    write_fasta(_reads(spark, sf_dir).select("read_id", F.concat(F.lit("s"), "read_id", F.lit(" x>y")).alias("header"), lines.alias("q")), path)
    register(spark)
    return spark.read.format("fasta").option("rangeBytes", 2048).load(path).select("header", "q", F.length("q").alias("len"))


@query("""WITH letters AS (SELECT unnest(string_split(text, '')) AS c FROM documents WHERE text <> '')
SELECT upper(c) AS sym, count(*) AS n, count(*) FILTER (WHERE c = upper(c)) AS exact FROM letters WHERE upper(c) IN ('A', 'C', 'G', 'T') GROUP BY ALL""")
def folded_composition(spark, sf_dir):
    """Symbols of the raw texts, blind to case and not."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    sums = docs.agg(*[F.sum(en.count_symbol(en.folded(F.col("text"), how), s)).alias(s + (how or "")) for s in en.ALPHABET for how in ("upper", None)])
    rows = [F.struct(F.lit(s).alias("sym"), F.coalesce(F.col(s + "upper"), F.lit(0)).alias("n"), F.coalesce(F.col(s), F.lit(0)).alias("exact")) for s in en.ALPHABET]
    return sums.select(F.explode(F.array(*rows)).alias("e")).select("e.sym", "e.n", "e.exact").where("n > 0")


@query(with_base(_COUNT.format(reads="reads"), "SELECT read_id, r.q, coalesce(n, 0) AS n FROM reads r LEFT JOIN counts USING (q)"))
def rank_counts(spark, sf_dir):
    """What count_matches gives, by rank searches in step over indexes in memory."""
    return count_by_ranks(genome(spark, sf_dir), _reads(spark, sf_dir))


@query(with_base("""back AS (SELECT read_id, reverse(q) AS q FROM reads),
starts AS (SELECT read_id, q, unnest(range(1, length(q) + 1)) AS k FROM back),
kinds AS (SELECT DISTINCT substr(seq, p, k) AS s FROM (SELECT seq, unnest(range(1, length(seq) + 1)) AS p FROM genome) CROSS JOIN range(1, 21) t(k) WHERE p + k - 1 <= length(seq))
SELECT b.read_id, b.q, min(x.k)::INTEGER AS k FROM back b LEFT JOIN (SELECT * FROM starts WHERE substr(q, 1, k) NOT IN (SELECT s FROM kinds)) x ON x.read_id = b.read_id GROUP BY b.read_id, b.q"""))
def shortest_unmatched(spark, sf_dir):
    """Reads turned round: their shortest beginning that no contig holds."""
    return search.shortest_unmatched(genome(spark, sf_dir), _reads(spark, sf_dir).withColumn("q", F.reverse("q")))


@query("""SELECT item_id, coalesce(sum(n), 0)::BIGINT AS n FROM (SELECT b.item_id,
  CASE WHEN contains(d.text, b.text) THEN len(list_filter(range(1, length(d.text) - length(b.text) + 2), lambda p: substr(d.text, p, length(b.text)) = b.text)) ELSE 0 END AS n
  FROM benchmark b CROSS JOIN documents d WHERE b.text <> '') GROUP BY item_id""")
def passage_count(spark, sf_dir):
    """Exact occurrences of benchmark passages in the raw texts: the same engine over any alphabet."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("text <> ''").select(F.col("item_id").alias("read_id"), F.col("text").alias("q"))
    return search.count_matches(docs, items, id_col="doc_id", text_col="text").select(F.col("read_id").alias("item_id"), "n")


@query("""WITH items AS (SELECT item_id, substr(text, 1, 8 + (item_id * 37 % 393)::INTEGER) AS q FROM benchmark WHERE text <> '')
SELECT item_id, length(q)::INTEGER AS len, coalesce(sum(n), 0)::BIGINT AS n FROM (SELECT b.item_id, b.q,
  CASE WHEN contains(d.text, b.q) THEN len(list_filter(range(1, length(d.text) - length(b.q) + 2), lambda p: substr(d.text, p, length(b.q)) = b.q)) ELSE 0 END AS n
  FROM items b CROSS JOIN documents d) GROUP BY item_id, q""")
def mixed_passages(spark, sf_dir):
    """Passages of 8 to 400 symbols in the raw texts, counted together: each falls into the tier of its length."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("text <> ''").select(F.col("item_id").alias("read_id"), F.substring("text", F.lit(1), (8 + F.col("item_id") * 37 % 393).cast("int")).alias("q"))
    return search.count_matches(docs, items, id_col="doc_id", text_col="text").select(F.col("read_id").alias("item_id"), F.length("q").alias("len"), "n")


def _kmers(texts: DataFrame, k: int) -> DataFrame:
    return suffix.positions(texts, k).where(~F.col("head").contains("$") & (F.length("head") == k)).select("contig_id", F.col("head").alias("kmer"))


@query(with_base("""SELECT kmer, count(*) AS n FROM (SELECT substr(seq, p, 6) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - 4)) AS p FROM genome))
GROUP BY kmer ORDER BY n DESC, kmer LIMIT 20"""))
def top_kmers(spark, sf_dir):
    """The 20 most frequent 6-mers: a report."""
    return _kmers(genome(spark, sf_dir), 6).groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kmer").limit(20)


_GROUPED = """k AS (SELECT source, lang, substr(seq, p, 2) AS kmer FROM (SELECT contig_id, seq, unnest(range(1, length(seq))) AS p FROM genome) JOIN documents ON doc_id = contig_id)
SELECT source, lang, kmer, grouping(source, lang, kmer)::INTEGER AS level, count(*) AS n FROM k GROUP BY """


def _pairs_by(spark, sf_dir) -> DataFrame:
    groups = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("contig_id"), "source", "lang")
    return rollups.kmer_counts_by(genome(spark, sf_dir), groups, ["source", "lang"])


@query(with_base(_GROUPED + "ROLLUP (source, lang, kmer)"))
def pair_rollup(spark, sf_dir):
    """How often each pair of symbols stands in the texts of each source and language, with totals by source and language, by source, and of all."""
    return rollups.rolled_up(_pairs_by(spark, sf_dir), ["source", "lang", "kmer"])


@query(with_base(_GROUPED + "CUBE (source, lang, kmer)"))
def pair_cube(spark, sf_dir):
    """The same with totals over every choice of the three."""
    return rollups.rolled_up(_pairs_by(spark, sf_dir), ["source", "lang", "kmer"], every=True)


@query(with_base(_COUNT.format(reads="reads"), "SELECT count(*) AS n_reads, coalesce(sum(length(r.q)), 0)::BIGINT AS bases, coalesce(sum(n), 0)::BIGINT AS total FROM reads r LEFT JOIN counts USING (q)"))
def observed_counters(spark, sf_dir):
    """Reads, symbols and occurrences, observed while the job that counts writes its rows."""
    seen = metrics.written_counts(search.count_matches(genome(spark, sf_dir), _reads(spark, sf_dir)), scratch(spark, "observed"))
    return spark.createDataFrame([(seen["n_reads"], seen["bases"], seen["total"])], "n_reads long, bases long, total long")


@query(with_base("""k AS (SELECT DISTINCT lang, substr(seq, p, 6) AS kmer FROM (SELECT lang, seq, unnest(range(1, length(seq) - 4)) AS p FROM genome JOIN documents ON doc_id = contig_id))
SELECT kmer FROM k WHERE lang = 'en' INTERSECT SELECT kmer FROM k WHERE lang = 'de'"""))
def kmer_intersect(spark, sf_dir):
    """6-mers that English and German texts share."""
    langs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("contig_id"), "lang").where("lang in ('en', 'de')")
    # languages meet texts, not places: a row for each place is many times what its estimate says, by which a side is broadcast
    texts = genome(spark, sf_dir).join(langs, "contig_id")
    of = lambda lang: _kmers(texts.where(F.col("lang") == lang), 6).select(F.lit(lang).alias("lang"), "kmer")
    kinds = materialize(of("en").unionByName(of("de")).distinct(), "kmers-by-lang")
    return kinds.where("lang = 'en'").select("kmer").intersect(kinds.where("lang = 'de'").select("kmer"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
