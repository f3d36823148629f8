"""The sequence engine against naive counting and known facts."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from motifmill.functions import encode as en
from motifmill.operators import bulk_count, contig_search, cutting, metrics, rank_search, ranking, rollups, search, suffix
from motifmill.operators import index as ix
from motifmill.plans import catalog, storage
from motifmill.plans.storage import BROADCAST_ROWS, materialize
from motifmill.sources import fasta_source
from motifmill.sources import sequences as sq

D1 = "CCGGAGCCCAGC"
D2 = ("ACGTTGCATT" * 7)[:63]
TEXTS = {0: "GATTACA", 1: "AAAA", 2: D1, 3: D2, 4: "", 5: "C", 6: "T" * 130, 7: "ACGT" * 40 + "GATTACA" * 20}


def naive(text, q):
    return sum(text.startswith(q, i) for i in range(len(text))) if q else None


def texts_of(spark, texts):
    return spark.createDataFrame(list(texts.items()), "contig_id long, seq string")


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(7)
    more = {100 + i: "".join(rng.choice("ACGT"[: rng.randint(1, 4)]) for _ in range(rng.choice([1, 5, 62, 63, 64, 127, 300, 700]))) for i in range(12)}
    return TEXTS | more


@pytest.fixture(scope="module")
def index(spark, texts):
    return ix.Index.build(texts_of(spark, texts).repartition(3))


def test_suffix_array_and_transform(spark, texts, index):
    got = {}
    for r in index.bwt.collect():
        got.setdefault(r.contig_id, {})[r.i] = r
    for c, t in texts.items():
        s = t + "$"
        order = sorted(range(len(s)), key=lambda p: s[p:])
        rows = [got[c][i] for i in range(len(s))]
        assert [r.pos for r in rows] == order
        assert [r.b0 for r in rows] == [s[p - 1] for p in order]
        assert [r.b1 for r in rows] == [s[(p - 2) % len(s)] for p in order]
        assert {r.pos for r in rows if r.sym2 is None} == ({0, 1} if t else {0})


def test_dumps_in_pieces(spark, texts, index):
    """Pieces, put one behind the other, are the whole columns and the whole texts, at sizes that contigs fill exactly and do not."""
    for size in (1, 64, 1 << 16):
        for column in ("b0", "b1"):
            whole, got = {}, {}
            for r in index.bwt.orderBy("contig_id", "i").collect():
                whole[r.contig_id] = whole.get(r.contig_id, "") + r[column]
            for r in ix.dumped(index.bwt, size).orderBy("contig_id", "piece").collect():
                assert len(r.b0) == len(r.b1) == min(size, len(texts[r.contig_id]) + 1 - size * r.piece)
                got[r.contig_id] = got.get(r.contig_id, "") + r[column]
            assert got == whole
    words = [(c, w, int(t[16 * w : 16 * w + 16].translate(str.maketrans("ACGT", "0123")).ljust(16, "0"), 4)) for c, t in texts.items() for w in range(-(-len(t) // 16))]
    packed = spark.createDataFrame(words, "contig_id long, word_no long, word long").repartition(5)
    lengths = spark.createDataFrame([(c, len(t)) for c, t in texts.items()], "contig_id long, n int")
    for size in (16, 64, 1 << 16):
        got = {}
        for r in en.unpacked(packed, lengths, size).orderBy("contig_id", "piece").collect():
            got[r.contig_id] = got.get(r.contig_id, "") + r.codes
        assert got == {c: t.translate(str.maketrans("ACGT", "0123")) for c, t in texts.items() if t}
    assert en.unpacked(packed.limit(0), lengths, 16).count() == ix.dumped(index.bwt.limit(0)).count() == 0
    with pytest.raises(ValueError, match="multiple of 16"):
        en.unpacked(packed, lengths, 24)


def test_known_facts(index):
    rows = sorted((r.i, r.pos, r.b0, r.b1) for r in index.bwt.where("contig_id = 0").collect())
    assert [r[1] for r in rows] == [7, 6, 4, 1, 5, 0, 3, 2]
    assert "".join(r[2] for r in rows) == "ACTGA$TA" and "".join(r[3] for r in rows) == "CAT$TAAG"
    c = [r.c_before for r in index.c_table.where("contig_id = 0").orderBy("sym2").collect()]
    assert c == [2, 2, 3, 3, 4, 5, 5, 5, 5, 6, 6, 6, 6, 7, 7, 7, 8]


def test_invariants(texts, index):
    last = {r.contig_id: r.c_before for r in index.c_table.where("sym2 = 16").collect()}
    assert all(last[c] == len(t) + 1 for c, t in texts.items() if t)
    widths = {(r.contig_id, r.k): r.w for r in index.lut.groupBy("contig_id", "k").agg(F.sum(F.col("hi") - F.col("lo")).alias("w")).collect()}
    assert all(widths.get((c, k), 0) == max(0, len(t) - k + 1) for c, t in texts.items() for k in (5, 6))
    bits = {r.contig_id: r.b for r in index.occ.groupBy("contig_id").agg(F.sum(F.bit_count("bitmap")).alias("b")).collect()}
    assert all(bits[c] == max(0, len(t) - 1) for c, t in texts.items())


def reads_for(texts):
    rng = random.Random(3)
    rows = [(c, q) for c in (2, 3) for q in ("GCCCAGA", "GCCCAGAT", "GCCCAGC", "GAGCCCA", "GTTGCATT", "GTTGCAT", "CATTACGTT", "TGCATTACGTT", "TGCATTACG")]
    for c, t in texts.items():
        rows += [(c, t), (c, t[:1]), (c, t[-2:]), (c, t + "A"), (c, "ACG"), (c, "N"), (c, "acg"), (c, "$"), (c, ""), (c, None)]
        rows += [(c, t[a : a + n]) for a, n in ((rng.randrange(max(1, len(t))), rng.randint(1, 40)) for _ in range(6))]
        rows += [(c, "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 8)))) for _ in range(4)]
    return [(c, i, q) for i, (c, q) in enumerate(rows)]


def test_backward_search_is_exact(spark, texts, index):
    """Also where a read's end meets the end marker, and where rows fill whole blocks."""
    rows = [r for r in reads_for(texts) if len(r[2] or "") <= 40]
    got = {r.read_id: r.n for r in search.backward_search(index, spark.createDataFrame(rows, "contig_id long, read_id long, q string")).collect()}
    assert got == {i: naive(texts[c], q) for c, i, q in rows}


def test_seed_join_counts_and_locates(spark, texts):
    rows = reads_for(texts)
    reads = spark.createDataFrame([(i, q) for _, i, q in rows], "read_id long, q string")
    counts = {r.read_id: r.n for r in search.count_matches(texts_of(spark, texts), reads).collect()}
    want = {i: None if not q else sum(naive(t, q) for t in texts.values()) for _, i, q in rows}
    assert counts == want
    found = {}
    for r in search.locate(texts_of(spark, texts), reads).collect():
        found.setdefault(r.read_id, []).append((r.contig_id, r.pos))
    assert all(sorted(found.get(i, [])) == sorted((c, p) for c, t in texts.items() for p in range(len(t)) if q and t.startswith(q, p)) for _, i, q in rows)
    mapped = {r.read_id for r in search.mapped(texts_of(spark, texts), reads).collect()}
    assert mapped == {i for i, n in want.items() if n}
    missing = {r.read_id for r in search.mapped(texts_of(spark, texts), reads.where("q is not null"), present=False).collect()}
    assert missing == {i for _, i, q in rows if q is not None and not want[i]}


def test_empty_tables(spark):
    none = texts_of(spark, {0: "A"}).limit(0)
    reads = spark.createDataFrame([(1, "ACGT"), (2, "")], "read_id long, q string")
    assert {r.read_id: r.n for r in search.count_matches(none, reads).collect()} == {1: 0, 2: None}
    assert search.count_matches(none, reads.limit(0)).count() == 0
    assert suffix.suffix_array(none).count() == 0


def test_index_round_trip(spark, index, tmp_path):
    index.save(str(tmp_path / "index"))
    back = ix.Index.load(spark, str(tmp_path / "index"))
    for name in ix.TABLES:
        assert sorted(map(repr, getattr(back, name).collect())) == sorted(map(repr, getattr(index, name).collect()))


def test_files(spark, tmp_path):
    (tmp_path / "ref.txt").write_text("GATTACA\r\n")
    assert [tuple(r) for r in sq.read_reference(spark, str(tmp_path / "ref.txt")).collect()] == [(0, "GATTACA")]
    (tmp_path / "reads.fa").write_text(">one\nGATT\nACA\n>two x\r\nAC\r\n>empty\n")
    got = sorted(tuple(r) for r in sq.read_fasta(spark, str(tmp_path / "reads.fa")).collect())
    assert got == [(0, "one", "GATTACA", 7), (1, "two x", "AC", 2), (2, "empty", None, 0)]
    sq.write_fasta(sq.read_fasta(spark, str(tmp_path / "reads.fa")), str(tmp_path / "out"))
    assert sorted(r.q or "" for r in sq.read_fasta(spark, str(tmp_path / "out")).collect()) == ["", "AC", "GATTACA"]


def test_ntile_blocks(spark):
    for n, tiles in ((10, 3), (8, 8), (3, 8), (100, 7)):
        got = sorted((r.x, r.block) for r in metrics.ntile_blocks(spark.range(n).select((F.col("id") * 3).alias("x")).repartition(4), "x", tiles).collect())
        q, r = divmod(n, tiles)
        want = [b + 1 for b in range(tiles) for _ in range(q + (b < r))]
        assert [b for _, b in got] == want


def test_run_metrics(spark):
    runs = spark.createDataFrame([("a", 0, 9.0), ("a", 1, 2.0), ("a", 2, 4.0), ("a", 3, 2.0), ("b", 0, 1.0)], "g string, run int, secs double")
    got = {r.g: r for r in metrics.run_metrics(runs, group="g", order=["run"], run="run", secs="secs").collect()}
    assert set(got) == {"a"} and (got["a"].least, got["a"].most, got["a"].least_run, got["a"].most_run) == (2.0, 4.0, 1, 2)
    assert got["a"].spread == pytest.approx(35.3553, abs=1e-3)


def test_rewritten_documents(spark, tmp_path):
    """Derived tables follow the documents at a path; while those stay, they are not built again."""
    queries, path = catalog.queries(), str(tmp_path)

    def write(text):
        spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(f"{path}/documents.parquet")

    write("GATTACA")
    first = ix.index_of(sq.genome(spark, path), path)
    assert queries["bwt_string"](spark, path).first().b0 == "ACTGA$TA"
    assert ix.index_of(sq.genome(spark, path), path) is first
    write("AAAA")
    assert queries["reference_scan"](spark, path).first().seq == "AAAA"
    assert queries["bwt_string"](spark, path).first().b0 == "AAAA$"


UNKNOWN = {0: "ACGNTACGTNNGTT", 1: "NNNN", 2: "acgtACGTn", 3: "GATTACAN", 4: "NGATTACA", 5: "XYZ!A CA$A#CG", 6: "éACGé", 7: "ACGT" * 30 + "N" * 70 + "ACGT" * 30, 8: "A", 9: "", 20: "T" * 700, 21: "GATTACA" * 90}


@pytest.fixture(scope="module")
def unknown(spark):
    return ix.Index.build(texts_of(spark, UNKNOWN))


def test_other_symbols(spark, unknown):
    """Texts with symbols outside ACGT, of few and of many kinds: counts, transform and cumulative counts."""
    texts, index = texts_of(spark, UNKNOWN), unknown
    queries = ["GT", "ACG", "T", "GTT", "TACGT", "A", "CA", "ACGTACGTA", "GATTACA", "C", "ACGA"]
    others = ["N", "NG", "NNN", "GNNT", "acg", "tACG", "é", "éAC", "Gé", "!A C", "$", "A$", "$A", "A$A", "G$", "N$", "$G", "CNA", "x"]
    rows = [(c, 100 * c + k, q) for c in UNKNOWN for k, q in enumerate(queries + others)] + [(99, 9900, "N"), (99, 9901, "A"), (0, 9902, ""), (0, 9903, None)]
    got = {r.read_id: r.n for r in search.backward_search(index, spark.createDataFrame(rows, "contig_id long, read_id long, q string")).collect()}
    assert got == {i: naive(UNKNOWN.get(c, ""), q) for c, i, q in rows}
    reads = spark.createDataFrame([(k, q) for k, q in enumerate([*queries, "N", "NN", "é", "acg", "$A", "NACGT"])], "read_id long, q string")
    want = {r.read_id: sum(naive(t, r.q) for t in UNKNOWN.values()) for r in reads.collect()}
    assert {r.read_id: r.n for r in search.count_matches(texts, reads).collect()} == want
    assert {r.read_id: r.n for r in rank_search.rank_counts(texts, reads).collect()} == want
    for r in index.bwt.collect():
        s = UNKNOWN[r.contig_id] + "$"
        assert (r.b0, r.b1) == (s[r.pos - 1], s[(r.pos - 2) % len(s)])
        assert r.sym2 == (4 * "ACGT".index(r.b1) + "ACGT".index(r.b0) if r.b0 in "ACGT" and r.b1 in "ACGT" else None)
    assert not [k for k in index.lut.collect() if set(k.kmer) - set("ACGT")]


def test_codes_of_unknown_symbols(spark):
    got = spark.createDataFrame([("ACGT",), ("ACN",), ("acg",), ("",), (None,)], "s string").select(en.kmer_code(F.col("s")).alias("k"), en.code_digits(F.col("s")).alias("d"), en.folded(F.col("s"), "upper").alias("u")).collect()
    assert [r.k for r in got] == [27, None, None, None, None] and [r.d for r in got] == ["0123", None, None, "", None] and got[2].u == "ACG"
    with pytest.raises(ValueError):
        en.folded(F.col("s"), "lower")


def test_rank_search_of_many_bins(spark, texts, monkeypatch):
    """Small bins, pieces and blocks: matches across pieces are counted once."""
    for name, value in (("BIN", 300), ("PIECE", 50), ("READS", 40)):
        monkeypatch.setattr(rank_search, name, value)
    rows = reads_for(texts)
    reads = spark.createDataFrame([(i, q) for _, i, q in rows], "read_id long, q string")
    got = {r.read_id: r.n for r in rank_search.rank_counts(texts_of(spark, texts), reads).collect()}
    assert got == {i: None if not q else sum(naive(t, q) for t in texts.values()) for _, i, q in rows}


def test_shortest_unmatched(spark, texts):
    rows = [(i, q) for _, i, q in reads_for(texts)]
    got = {r.read_id: r.k for r in search.shortest_unmatched(texts_of(spark, texts), spark.createDataFrame(rows, "read_id long, q string")).collect()}
    assert got == {i: next((k for k in range(1, len(q or "") + 1) if not any(q[:k] in t for t in texts.values())), None) for i, q in rows}


def test_long_texts(spark, monkeypatch):
    """Pieces of every level, of one-byte symbols and of others; long patterns by sampled places."""
    rng = random.Random(1)
    long = "".join(rng.choice("ACGT") for _ in range(100_000))
    texts = {0: long, 1: "é" + long[:40_000], 2: long[70_000:], 3: long[500:700] * 3}
    monkeypatch.setattr(cutting, "LEVELS", (30_000, 1000))
    monkeypatch.setattr(cutting, "SPREAD", 50_000)
    for size, behind in ((7, 5), (256, 300), (5000, 0)):
        got = {}
        for r in cutting.pieces(texts_of(spark, texts), "contig_id", "seq", size, behind).collect():
            got.setdefault(r.id, {})[r.base] = r.part
        for c, t in texts.items():
            bases = sorted(got[c])
            assert bases == list(range(0, len(t), size))
            assert all(p == t[b : b + len(p)] and len(p) >= min(len(t) - b, behind + 1) for b, p in got[c].items())
    patterns = [long[a : a + n] for a, n in ((0, 60), (99_900, 100), (29_990, 48), (999, 90), (70_000, 500), (500, 200), (510, 300))] + ["A" * 60, long[500:700] * 2]
    reads = spark.createDataFrame(list(enumerate(patterns)), "read_id long, q string")
    want = {i: sum(naive(t, q) for t in texts.values()) for i, q in enumerate(patterns)}
    assert {r.read_id: r.n for r in search.count_matches(texts_of(spark, texts), reads).collect()} == want
    found = {(r.read_id, r.contig_id, r.pos) for r in search.locate(texts_of(spark, texts), reads).collect()}
    assert found == {(i, c, p) for i, q in enumerate(patterns) for c, t in texts.items() for p in range(len(t)) if t.startswith(q, p)}
    order = [r.pos for r in suffix.suffix_array(texts_of(spark, {3: texts[3], 4: "A" * 3000})).where("contig_id = 3").orderBy("i").collect()]
    s = texts[3] + "$"
    assert order == sorted(range(len(s)), key=lambda p: s[p:])


def test_fasta_of_any_kind(spark, tmp_path):
    """'>' inside headers and lines, CRLF, text before the first header, records without sequence; references with several records."""
    (tmp_path / "a.fa").write_text(">r1 geneA->geneB\nAC\nGT\n>r2>x\n\n>r3\r\nGA>T\r\nTA\r\n>\nTT\n")
    (tmp_path / "b.fa").write_text("lost\nlines\n>b1\nACGT\n")
    (tmp_path / "c.fa").write_text("\n>c1\nnacgt")
    got = [tuple(r) for r in sq.read_fasta(spark, f"{tmp_path}/*.fa").orderBy("read_id").collect()]
    assert got == [(0, "r1 geneA->geneB", "ACGT", 4), (1, "r2>x", None, 0), (2, "r3", "GA>TTA", 6), (3, "", "TT", 2), (4, "b1", "ACGT", 4), (5, "c1", "nacgt", 5)]
    bad = sorted((r.path.rsplit("/", 1)[1], r.header, r.q, r.reason) for r in sq.rejected_fasta(spark, f"{tmp_path}/*.fa").collect())
    assert bad == [("a.fa", "r2>x", None, "no sequence"), ("b.fa", None, "lostlines", "no header")]
    assert [tuple(r) for r in sq.read_reference(spark, f"{tmp_path}/a.fa").orderBy("contig_id").collect()] == [(0, "ACGT"), (1, ""), (2, "GA>TTA"), (3, "TT")]
    assert sq.read_reference(spark, f"{tmp_path}/c.fa", fasta=True, normalize="upper").first().seq == "NACGT"


def test_throughput(spark):
    runs = spark.createDataFrame([("a", 0, 9.0, 10**9), ("a", 1, 2.0, 10**9), ("a", 2, 4.0, 10**9), ("b", 0, 1.0, 5), ("b", 1, 1.0, 6), ("c", 0, 2.0, 10**9)], "g string, run int, secs double, lf long")
    got = {r.g: (r.agree, r.raw, r.best, r.mean) for r in metrics.throughput(runs, group="g", order=["run"], secs="secs", ops="lf").collect()}
    assert got == {"a": (True, 0.2, 0.5, pytest.approx(1 / 3)), "b": (False, None, None, None), "c": (True, 0.5, None, None)}


def test_ranks_and_running_totals_of_large_groups(spark):
    """Groups that spread over several partitions, of one row, of equal keys only."""
    rng = random.Random(9)
    rows = [(0, 5, k) for k in range(3000)] + [(1, rng.randrange(4), 3000 + k) for k in range(3000)] + [(c, rng.randrange(90), 6000 + c) for c in range(2, 400)] + [(500, k, 7000 + k) for k in range(2000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g long, v long, u long").repartition(5)
    sizes, of = {}, {}
    for g, v, u in rows:
        sizes.setdefault(g, []).append(v)
        of[u] = (g, v)
    less = {g: {v: sum(x < v for x in vs) for v in set(vs)} for g, vs in sizes.items()}
    got = {r.u: (r["rank"], r.tied) for r in ranking.ranked(df, ["g"], ["v"], ["u"], ["u"]).collect()}
    assert got == {u: (less[g][v], sizes[g].count(v) > 1) for u, (g, v) in of.items()}
    alone = spark.createDataFrame([(1, 2, 3)], "g long, v long, u long")
    assert [tuple(r) for r in ranking.ranked(alone, ["g"], ["v"], ["u"], ["u"]).collect()] == [(3, 0, False)]
    assert ranking.ranked(alone.limit(0), ["g"], ["v"], ["u"], ["u"]).count() == 0
    for inclusive, how, plain in ((False, F.sum, sum), (True, F.sum, sum), (True, F.min, min), (False, F.max, max)):
        out = ranking.running(df, ["g"], "u", "v", "x", how, inclusive=inclusive, fan=100)
        for r in out.where("u % 97 = 0").collect():
            before = [v for u, (g, v) in of.items() if g == r.g and (u < r.u or inclusive and u == r.u)]
            assert r.x == (plain(before) if before else None)


def in_order(texts):
    return {(c, i): p for c, t in texts.items() for i, p in enumerate(sorted(range(len(t) + 1), key=lambda p: (t + "$")[p:]))}


@pytest.mark.parametrize("few", [suffix.FEW, 0])
def test_suffixes_of_runs(spark, monkeypatch, few):
    """Runs before smaller and larger symbols, at a text's ends, across chunks at every offset; periods; equal runs that only what follows tells apart."""
    monkeypatch.setattr(suffix, "FEW", few)
    rng = random.Random(4)
    texts = {0: "A" * 700 + "C" + "A" * 700, 1: "N" * 2000, 2: "AT" * 1000 + "A", 3: "$" * 60 + "A" + "$" * 45, 4: "!" * 700 + "A", 5: "G" * 32, 6: "G" * 33 + "A", 7: ("C" * 40 + "A" + "C" * 40 + "T") * 12, 8: "é" * 400 + "A" + "é" * 300, 9: "ACG" * 300 + "N" * 900 + "ACG" * 300}
    for k in range(24):
        texts[100 + k] = "".join(rng.choice("ACGT") for _ in range(235 + k)) + rng.choice("ACGT") * rng.choice([31, 32, 33, 34, 255, 256, 257, 289, 300, 560]) + rng.choice(["", "A", "T" * 40 + "C"])
    for k in range(6):
        texts[200 + k] = "".join(rng.choice("AC") * rng.choice([1, 2, 33, 40, 290]) for _ in range(30))
    got = {(r.contig_id, r.i): r.pos for r in suffix.suffix_array(texts_of(spark, texts).repartition(3)).collect()}
    assert got == in_order(texts)


def test_one_long_run_is_no_group(spark):
    """A run of 200 000 symbols costs about what other symbols do: no round of doublings, and the rows of its group spread."""
    rng = random.Random(6)
    side = "".join(rng.choice("ACGT") for _ in range(30_000))
    text = side + "N" * 200_000 + side[:20_000]
    rows = suffix.suffix_array(texts_of(spark, {0: text})).collect()
    pos = [r.pos for r in sorted(rows, key=lambda r: r.i)]
    assert sorted(pos) == list(range(len(text) + 1))
    s = text + "$"
    place = np.empty(len(s), np.int64)
    place[pos] = np.arange(len(s))
    after = np.append(place[1:], -1)
    key = [(s[p], after[p]) for p in pos]
    assert key == sorted(key)  # first symbols ascend, and where they are equal the ranks of what follows


def test_running_counts_of_one_large_contig(spark):
    """16 million rows of one contig: what a task holds is a range of blocks."""
    n = 16 << 20
    rows = spark.range(n).select(F.lit(7).cast("long").alias("contig_id"), F.col("id").alias("i"), F.when(F.col("id") % 1_000_003 != 0, F.pmod(F.xxhash64("id"), F.lit(16))).cast("int").alias("sym2"))
    meta = spark.createDataFrame([(7, n, None, True)], "contig_id long, len long, last int, others boolean")
    occ = ix.occ_blocks(rows, meta)
    asked = [0, 1, 1023, 1024, 1025, 77_777, n // 64 - 1, n // 64]
    got = {(r.blk, r.sym2): r.before for r in occ.where(F.col("blk").isin(asked)).collect()}
    want = rows.where("sym2 is not null").groupBy("sym2").agg(*[F.count(F.when(F.col("i") < b * 64, 1)).alias(f"b{b}") for b in asked]).collect()
    assert got == {(b, r.sym2): r[f"b{b}"] for r in want for b in asked} and len(got) == 16 * len(asked)
    plan = occ._jdf.queryExecution().executedPlan().toString()
    assert "_range" in plan and "SinglePartition" not in plan


def test_rank_bins_of_any_alphabet(spark, tmp_path, monkeypatch):
    """More than 250 symbols in texts and reads, bins written and loaded again, reads in several steps."""
    monkeypatch.setattr(rank_search, "BIN", 3000)
    rng = random.Random(2)
    kinds = [chr(0x4E00 + k) for k in range(400)] + list("acgtN ") + ["\U0001F600", "\x00", chr(0x10FFFE)]
    texts = {k: "".join(rng.choice(kinds[: rng.choice([3, 60, 409])]) for _ in range(rng.choice([0, 5, 900, 2500]))) for k in range(12)}
    texts[50] = "".join(kinds)
    reads = [t[a : a + n] for t in texts.values() for a, n in ((rng.randrange(len(t) + 1), rng.randint(1, 6)) for _ in range(30))] + ["zzz", "", None, *kinds, "".join(kinds)[:40]]
    df = spark.createDataFrame(list(enumerate(reads)), "read_id long, q string")
    bins = rank_search.RankBins.build(texts_of(spark, texts), 40)
    bins.save(str(tmp_path / "bins"))
    back = rank_search.RankBins.load(spark, str(tmp_path / "bins"))
    want = {i: None if not q else sum(naive(t, q) for t in texts.values()) for i, q in enumerate(reads)}
    assert {r.read_id: r.n for r in back.count(df).collect()} == want and back.longest == 40
    with pytest.raises(ValueError, match="up to 40"):
        back.count(spark.createDataFrame([(0, "a" * 41)], "read_id long, q string"))
    none = rank_search.RankBins.build(texts_of(spark, {0: "A"}).limit(0), 5)
    assert {r.n for r in none.count(df.where("q = 'zzz'")).collect()} == {0}


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    for kinds, n in ((1, 5), (2, 64), (5, 1000), (300, 4097)):
        codes = rng.integers(0, kinds, n)
        matrix = rank_search.WaveletMatrix.of(codes)
        c, row = rng.integers(0, kinds, 200), rng.integers(0, n + 1, 200)
        got = matrix.place(c, row) - matrix.place(c, np.zeros(200, np.int64))
        assert got.tolist() == [int((codes[:r] == k).sum()) for k, r in zip(c, row, strict=True)]


def test_patterns_of_all_lengths(spark):
    """Short and long patterns together: each tier by itself."""
    rng = random.Random(11)
    text = "".join(rng.choice("ab c") for _ in range(40_000))
    texts = {0: text, 1: text[500:9000], 2: "é" + text[:3000], 3: ""}
    patterns = [text[a : a + n] for n in (1, 3, 7, 8, 12, 20, 47, 48, 60, 95, 96, 130, 191, 192, 384, 400, 800) for a in (0, 777, 2990, 16_300, 40_000 - n)] + ["x" * 60, text[:100] + "x"]
    reads = spark.createDataFrame(list(enumerate(patterns)), "read_id long, q string")
    got = {r.read_id: r.n for r in search.count_matches(texts_of(spark, texts), reads).collect()}
    assert got == {i: sum(naive(t, q) for t in texts.values()) for i, q in enumerate(patterns)}


def test_fasta_data_source(spark, tmp_path, monkeypatch):
    """Ranges that end anywhere in a record, blocks that end anywhere in a line."""
    rng = random.Random(3)
    want, text = [], "lost\n"
    for k in range(60):
        q = "".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 1, 7, 60, 400])))
        want.append((len(text), f"r{k} >x{'y' * rng.randrange(9)}", q or None))
        text += f">{want[-1][1]}" + rng.choice(["\n", "\r\n"])
        while q:
            n = rng.randint(1, 90)
            text += q[:n] + rng.choice(["\n", "\r\n", "\n\n"])
            q = q[n:]
    (tmp_path / "a.fa").write_bytes(text.encode())
    for block in (1, 7, 1 << 20):
        monkeypatch.setattr(fasta_source, "BLOCK_BYTES", block)
        for size in (1, 13, 500, 10**6):
            with open(tmp_path / "a.fa", "rb") as file:
                got = [r for lo in range(0, len(text), size) for r in fasta_source.records(file, lo, min(lo + size, len(text)))]
            assert got == want
    (tmp_path / "b.fa").write_text(">only\nAC\nGT")
    (tmp_path / "_hidden").write_text(">no\nA\n")
    fasta_source.register(spark)
    load = lambda path, size=100: [(r.header, r.q) for r in spark.read.format("fasta").option("rangeBytes", size).load(path).collect()]
    both = sorted([(h, q) for _, h, q in want] + [("only", "ACGT")], key=lambda r: r[0])
    assert sorted(load(str(tmp_path)), key=lambda r: r[0]) == both == sorted(load(f"file://{tmp_path}/*.fa"), key=lambda r: r[0])
    assert load(str(tmp_path / "b.fa"), 3) == [("only", "ACGT")]
    (tmp_path / "none").mkdir()
    assert load(str(tmp_path / "none")) == []


def test_located_by_the_index(spark, unknown, monkeypatch):
    """Intervals of any width, over one bin and many, in contigs of all kinds."""
    texts, index = UNKNOWN, unknown
    queries = ["T", "TTTT", "GATTACA", "A", "N", "NG", "acg", "CA", "GTTGCATT", "zz", "", None, "T" * 41]
    rows = [(c, 100 * c + k, q) for c in texts for k, q in enumerate(queries)] + [(77, 1, "A")]
    reads = spark.createDataFrame(rows, "contig_id long, read_id long, q string")
    want = sorted((c, i, p) for c, i, q in rows if q for p in range(len(texts.get(c, ""))) if texts[c].startswith(q, p))
    for binned in (search.BINNED, 7):
        monkeypatch.setattr(search, "BINNED", binned)
        assert sorted((r.contig_id, r.read_id, r.pos) for r in search.locate_by_index(index, reads).collect()) == want


def test_rollups(spark):
    """Groups whose own value is null are told from totals."""
    texts = {0: "AAAC", 1: "ACG", 2: "", 3: "A", 4: "CC"}
    groups = spark.createDataFrame([(0, "x", "u"), (1, None, "u"), (2, "x", "u"), (3, "y", "u"), (4, None, None)], "contig_id long, a string, b string")
    counts = rollups.kmer_counts_by(texts_of(spark, texts), groups, ["a", "b"])
    rolled = {(r.a, r.b, r.kmer, r.level): r.n for r in rollups.rolled_up(counts, ["a", "b", "kmer"]).collect()}
    assert rolled[None, None, None, 7] == 6 and rolled["x", None, None, 3] == 3 and rolled[None, None, None, 3] == 3
    assert rolled[None, "u", None, 1] == 2 and rolled[None, None, None, 1] == 1 and rolled["x", "u", "AA", 0] == 2
    cubed = {(r.a, r.b, r.kmer, r.level): r.n for r in rollups.rolled_up(counts, ["a", "b", "kmer"], every=True).collect()}
    assert rolled.items() <= cubed.items() and cubed[None, None, "AC", 6] == 2 and cubed[None, "u", None, 5] == 5


def test_counts_say_what_they_saw(spark, tmp_path):
    reads = spark.createDataFrame([(0, "ATTA"), (1, None), (2, "GG"), (3, "")], "read_id long, q string")
    counts = search.count_matches(texts_of(spark, {0: "GATTACATTA"}), reads)
    assert metrics.written_counts(counts, str(tmp_path / "out")) == {"n_reads": 4, "bases": 6, "total": 2}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_buckets_are_not_shuffled(spark, unknown):
    """A search step over rank tables in buckets has an exchange on the reads' side only, and finds the same."""
    index = unknown.bucketed(4)
    queries = ["GT", "ACG", "GATTACA", "N", "NG", "acg", "ACGTACGTA"]
    rows = [(c, 100 * c + k, q) for c in UNKNOWN for k, q in enumerate(queries)]
    reads = spark.createDataFrame(rows, "contig_id long, read_id long, q string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {r.read_id: r.n for r in search.backward_search(index, reads).collect()} == {i: naive(UNKNOWN[c], q) for c, i, q in rows}
        blocks = index.occ.select("contig_id", "sym2", F.col("blk").alias("b"), "before")
        asked = spark.range(100).selectExpr("id AS contig_id", "CAST(id % 16 AS INT) AS sym2", "id % 3 AS b")
        plan = asked.join(blocks, ["contig_id", "sym2", "b"])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_contigs_added_later(spark, unknown, tmp_path):
    first, more = {k: t for k, t in UNKNOWN.items() if k < 5}, {k: t for k, t in UNKNOWN.items() if k >= 5}
    index = ix.Index.build(texts_of(spark, first))
    index.save(str(tmp_path / "index"))
    ix.Index.append(texts_of(spark, more), str(tmp_path / "index"))
    saved, held = ix.Index.load(spark, str(tmp_path / "index")), index.extended(texts_of(spark, more))
    for name in ix.TABLES:
        want = sorted(map(repr, getattr(unknown, name).collect()))
        assert want == sorted(map(repr, getattr(saved, name).collect())) == sorted(map(repr, getattr(held, name).collect()))
    with pytest.raises(ValueError, match="contig 3 already"):
        held.extended(texts_of(spark, {3: "A"}))


def test_rates_of_no_seconds(spark):
    """Runs of zero seconds have infinite rates, as in the SQL; no seconds and no operations give no number."""
    rows = [("a", 1, 1, 2.0, 10), ("a", 2, 2, 0.0, 10), ("b", 1, 3, 0.0, 10), ("b", 2, 4, 0.0, 10), ("c", 1, 5, 0.0, 0), ("c", 2, 6, 0.0, 0), ("d", 1, 7, 0.0, 1), ("d", 2, 8, 1.0, 2)]
    runs = spark.createDataFrame(rows, "g string, ts long, id long, secs double, ops long")
    got = {r.g: (r.raw, r.best, r.mean) for r in metrics.throughput(runs, group="g", order=["ts", "id"], secs="secs", ops="ops").collect()}
    inf = float("inf")
    assert got["a"] == (round(10e-9, 9), inf, inf) and got["b"] == (inf,) * 3 and all(x != x for x in got["c"]) and got["d"] == (None,) * 3
    spread = {r.g: r.spread for r in metrics.run_metrics(runs, group="g", order=["ts", "id"], run="id", secs="secs").collect()}
    assert spread["d"] == 0 and spread["b"] != spread["b"]


def test_fasta_of_many_small_ranges_is_few_tasks(tmp_path):
    """Ranges of two kilobytes of a file of two megabytes are three tasks, and each range reads little beyond itself."""
    from motifmill.sources import fasta_source as fs

    lines = [f">r{k}\n{'ACGT' * (k % 40)}\n" for k in range(24_000)]
    (tmp_path / "a.fa").write_text("".join(lines))
    size = (tmp_path / "a.fa").stat().st_size
    reader = fs.FastaReader(str(tmp_path), 2048)
    tasks = reader.partitions()
    assert len(tasks) == 3 and sum(len(t.ranges) for t in tasks) == -(-size // 2048)
    got = [h for t in tasks for b in reader.read(t) for h in b.column("header").to_pylist()]
    assert got == [f"r{k}" for k in range(24_000)]

    class Counted:
        def __init__(self, file):
            self.file, self.read_bytes = file, 0

        def seek(self, at):
            self.file.seek(at)

        def read(self, n):
            self.read_bytes += len(out := self.file.read(n))
            return out

    with open(tmp_path / "a.fa", "rb") as file:
        counted = Counted(file)
        assert list(fs.records(counted, 1 << 20, (1 << 20) + 2048)) and counted.read_bytes < 1 << 16


def test_shared_kmers_join_texts_not_places(spark):
    """Languages meet texts before a text has a row for each place, whose number no estimate knows."""
    plans = []
    keep = catalog.materialize
    try:
        catalog.materialize = lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, label)
        catalog.queries()["kmer_intersect"](spark, "/root/testdata/sf0.001").collect()
    finally:
        catalog.materialize = keep
    deep = lambda line: re.search(r"[A-Za-z]", line).start()
    lines = [line for plan in plans for line in plan.splitlines()]
    joins = [k for k, line in enumerate(lines) if "Join" in line.split("[")[0]]
    assert joins
    for k in joins:
        below = itertools.takewhile(lambda line: deep(line) > deep(lines[k]), lines[k + 1 :])  # noqa: B023
        assert not any("Generate" in line for line in below)


def test_short_contigs_are_sorted_in_their_task(spark, monkeypatch):
    """No suffix of a contig of up to WHOLE symbols is shuffled; the order is that of the sort by ranges, for any symbols, copies of contigs and both sides of the limit."""
    rng = random.Random(11)
    texts = UNKNOWN | {50: "\0A\0", 51: "", 52: "AB" * 400, 53: "AB" * 400, 54: "\U0001F600a" * 9} | {60 + k: "".join(rng.choice("ACGTN$ é"[: rng.randint(1, 8)]) for _ in range(rng.randint(0, 400))) for k in range(40)}

    def columns():
        return sorted(tuple(r) for r in suffix.sorted_suffixes(texts_of(spark, texts).repartition(3)).select("contig_id", "i", "pos", "front", "head").collect())

    with monkeypatch.context() as m:
        m.setattr(suffix, "ranked", None)
        here = columns()
    assert {r[:2]: r[2] for r in here} == in_order(texts)
    for c, _, pos, front, head in here:
        s = texts[c] + "$"
        assert (front, head) == (s[(pos - 2) % len(s)] + s[pos - 1], s[pos : pos + suffix.HEAD])
    for limit in (0, 300):
        monkeypatch.setattr(suffix, "WHOLE", limit)
        assert columns() == here


def test_index_tables_broadcast_no_exploded_side(spark, unknown):
    """Contigs with a row for each pair are many times what their estimate says: they are made behind the joins, which would broadcast them. Tables that nobody asks for are not made."""
    meta, begins = unknown.meta, unknown.meta.select("contig_id", F.lit("AC").alias("begin"), F.lit(1).cast("long").alias("n"))
    for table in (ix.c_table(meta, begins), ix.firsts_table(meta, begins)):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate") < plan.index("Join")
    index = ix.Index.build(texts_of(spark, {0: "ACGT"}))
    assert index.bwt.count() == 5 and callable(index._tables["occ"]) and callable(index._tables["lut"])


def test_many_patterns_are_searched_in_bins(spark, monkeypatch):
    """More patterns than may be broadcast are counted in sorted bins, with shorter and longer ones beside them; none is joined with all places that begin alike."""
    rng = random.Random(12)
    texts = {k: "".join(rng.choice("ACGT" if k % 2 else "Aé") for _ in range(400)) for k in range(12)}
    cut = lambda t: (lambda at, n: t[at : at + n])(rng.randrange(300), rng.choice([1, 3, 7, 8, 11, 12, 20, 47, 48, 90]))
    reads = {k: cut(texts[k % 12]) for k in range(150)} | {200: "ACGTACGTACGTT", 201: "", 202: None, 203: "T" * 60}
    df = spark.createDataFrame(list(reads.items()), "read_id long, q string")
    monkeypatch.setattr(search, "BROADCAST_ROWS", 20)
    joined = []
    keep = search._matches
    monkeypatch.setattr(search, "_matches", lambda held, patterns: joined.extend(r.q for r in patterns.collect()) or keep(held, patterns))
    got = {r.read_id: r.n for r in search.count_matches(texts_of(spark, texts), df).collect()}
    assert got == {i: None if not q else sum(naive(t, q) for t in texts.values()) for i, q in reads.items()}
    assert joined and all(len(q) >= search.SAMPLED for q in joined)
    back = df.select("read_id", F.reverse("q").alias("q")).where("read_id % 3 = 0")
    for r in search.shortest_unmatched(texts_of(spark, texts), back).collect():
        q = r.q or ""
        assert r.k == next((k for k in range(1, len(q) + 1) if not any(q[:k] in t for t in texts.values())), None)
    assert all(len(q) >= search.SAMPLED or len(q) <= search.SHORT for q in joined)


def test_index_tables_of_few_bytes_a_row_are_not_broadcast(spark):
    """F2, F3, F7 to F10: written tables that lie under Catalyst's broadcast limit by their compressed bytes, of more rows than may be broadcast."""
    n = 70_000
    texts = spark.range(n).select(F.col("id").alias("contig_id"), F.when(F.col("id") % 2 == 0, "ACNGT").otherwise("CAGTC").alias("seq"))
    reads = spark.range(n).select(F.col("id").alias("contig_id"), F.col("id").alias("read_id"), F.when(F.col("id") % 2 == 0, "CN").otherwise("AGT").alias("q"))
    index = ix.Index.build(texts)
    for table in (index.c_table, index.firsts):
        assert table.count() > BROADCAST_ROWS
    made = ix.c_table(index.meta, materialize(ix.beginnings(index.bwt), "test-begins"))
    counted, placed = search.backward_search(index, reads), search.locate_by_index(index, reads)
    for df in (made, counted, placed):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert counted.agg(F.sum("n"), F.count("*")).first() == (n, n)
    assert placed.groupBy(F.col("contig_id") % 2, "pos").count().count() == 2


@pytest.mark.parametrize("letters", ["ACGT", "abN$é", "aé中𝄞"])
def test_bulk_counts(spark, monkeypatch, letters):
    """F22 to F24, F26: many packed patterns and few looked-up ones, over piece, task and bucket ends."""
    for name, value in {"PIECE": 64, "PACK": 300, "BUCKET": 200}.items():
        monkeypatch.setattr(bulk_count, name, value)
    rng = random.Random(3)
    texts = ["".join(rng.choice(letters[: rng.randint(1, 4)]) for _ in range(rng.choice([1, 7, 8, 63, 64, 65, 200]))) + rng.choice(["", "x", "\0"]) for _ in range(40)]
    cuts = [t[a : a + rng.randint(8, 15)] for t in texts for a in range(0, len(t), 3)]
    asked = {q for q in cuts + [c[::-1] for c in cuts] if len(q) >= 8 and "\0" not in q}
    want = {q: n for q in asked if (n := sum(naive(t, q) for t in texts))}
    rows = spark.createDataFrame(list(enumerate(texts)), "contig_id long, seq string").repartition(3)
    patterns = spark.createDataFrame([(q,) for q in asked], "q string")
    for count in (bulk_count.count_many, bulk_count.count_few):
        assert {r.q: r.n for r in count(rows, patterns, id_col="contig_id", text_col="seq").collect()} == want
    wide = spark.createDataFrame([("".join(map(chr, range(200, 400))),)], "q string")
    assert bulk_count.count_many(rows, wide, id_col="contig_id", text_col="seq") is None


def test_many_reads_are_counted_without_a_row_for_each_place(spark):
    """F22 to F24, F26: no plan explodes the places of the texts."""
    rng = random.Random(5)
    texts = spark.createDataFrame([(i, "".join(rng.choice("ACGT") for _ in range(3000))) for i in range(8)], "contig_id long, seq string")
    for n in (20, search.MANY + 50):
        reads = spark.range(n).select(F.col("id").alias("read_id"), F.lpad(F.translate(F.conv(F.col("id").cast("string"), 10, 4), "0123", "ACGT"), 9, "A").alias("q"))
        got = search.count_matches(texts, reads)
        held = [r.seq for r in texts.collect()]
        assert {r.q: r.n for r in got.collect()} == {r.q: sum(naive(t, r.q) if r.q in t else 0 for t in held) for r in reads.collect()}
        plan = got._jdf.queryExecution().analyzed().toString()
        assert "mapinarrow" in plan.lower() or "flatmapcogroups" in plan.lower()


def shuffled_rows(df):
    """Rows that each exchange of a plan has written, the query being run for it."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    out = []

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            return walk(node.plan())
        if node.nodeName() == "Exchange":
            out.append(node.metrics().apply("shuffleRecordsWritten").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(plan)
    return out


def test_dumps_and_kmers_shuffle_no_row_for_each_suffix(spark, texts, index):
    """Rows of a contig that stand together are joined in the task that reads them; what a task was given in any other order gives the same tables."""
    suffixes = index.bwt.count()
    pieces = ix.dumped(index.bwt, 256)
    intervals = ix.lut(index.bwt)
    assert suffixes > 2000
    assert max(shuffled_rows(pieces)) < suffixes / 20
    assert max(shuffled_rows(intervals)) < suffixes / 20
    mixed = materialize(index.bwt.orderBy("pos", "contig_id"), "mixed")
    for one, other in ((pieces, ix.dumped(mixed, 256)), (intervals, ix.lut(mixed))):
        assert sorted(map(repr, one.collect())) == sorted(map(repr, other.collect()))


def test_kmers_and_dumps_of_any_symbols(spark):
    """Symbols of several bytes, contigs shorter than a k-mer, null ids: against naive counting."""
    texts = {0: "ACGTACGTé", 1: "éACGTAC", 2: "", None: "ACGTACN", 3: "ACGT\u4e2dACGTAA", 4: "ACGTAC", 5: "ACGTAC"}
    genome = texts_of(spark, texts)
    bwt = suffix.bwt(suffix.sorted_suffixes(genome))
    got = {(r.contig_id, r.k, r.kmer, r.code, r.lo, r.hi) for r in ix.lut(bwt).collect()}
    want, strings = set(), {}
    for c, text in texts.items():
        order = sorted(range(len(text) + 1), key=lambda p: (text + "$")[p:])
        t = text + "$"
        strings[c] = "".join(t[p - 1] for p in order), "".join(t[(p - 2) % len(t)] for p in order)
        for k in (5, 6):
            for kmer in {t[p : p + k] for p in range(len(t) - k) if not set(t[p : p + k]) - set("ACGT")}:
                rows = [i for i, p in enumerate(order) if t.startswith(kmer, p)]
                want.add((c, k, kmer, int("".join(str("ACGT".index(x)) for x in kmer), 4), rows[0], rows[-1] + 1))
    assert got == want
    assert {r.contig_id: (r.b0, r.b1) for r in ix.dumped(bwt).collect()} == strings


def test_summary_broadcasts_no_row_a_contig(spark, index):
    """Rows of few bytes are many under a broadcast's limit."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        made = index.summary()
        made.collect()
        assert "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("small", [True, False])
def test_copies_of_reads_are_listed_without_a_shuffle(spark, monkeypatch, small):
    """Equal reads, null ids among them, go with their pattern into the joins that find it: what is found meets no table again. The same rows where patterns are too many to be broadcast."""
    rng = random.Random(15)
    texts = {i: "".join(rng.choice("AACé") for _ in range(n)) for i, n in enumerate([0, 1, 63, 64, 65, 400])} | {9: "ACGTTGCA" * 30}
    asked = ["A", "AC", "é", "CAA", "ACGTTGC", "ACGTTGCAA", "ACGTTGCAACG", "CAACGTTGCAACGT", ("TGCAACGT" * 8)[:50], ("ACGTTGCA" * 20)[:130], "G" * 60, "GGG", "", None]
    reads = [(i, q) for i, q in enumerate(asked * 3)] + [(i % 3, "A") for i in range(40)] + [(None, "CAA"), (None, "A"), (None, "A")]
    monkeypatch.setattr(search, "NAMED", 4, raising=False)
    monkeypatch.setattr(search, "LISTED", 64, raising=False)
    if not small:
        monkeypatch.setattr(search, "small_side", lambda df: df)
        monkeypatch.setattr(search, "counted_side", storage.shuffled_side)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = search.locate(texts_of(spark, texts), spark.createDataFrame(reads, "read_id long, q string"))
        got = Counter((r.read_id, r.contig_id, r.pos) for r in found.collect())
        assert got == Counter((i, c, p) for i, q in reads if q for c, t in texts.items() for p in range(len(t)) if t.startswith(q, p))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert ("SortMergeJoin" in plan) != small
        assert "Generate explode(read_ids" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["backward_search_mixed", "backward_search_unknown"])
def test_reads_of_own_contigs_are_searched_where_the_contig_is_sorted(spark, tmp_path, monkeypatch, name):
    """no step of a search is a job with two joins on rank tables, and no index is built for one set of reads."""
    docs = [(0, "GATTACA nnn gattaca"), (1, ""), (2, None), (3, "n"), (4, "The cat can not act: AACCGGTTNNacgt" * 20), (5, "éa€c"), (6, "ZZZ")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for owner, what in ((search, "_steps"), (ix.Index, "build")):
        monkeypatch.setattr(owner, what, lambda *a, **k: pytest.fail("an index is built and searched step by step"))
    got = {(r.contig_id, r.read_id): r.n for r in catalog.queries()[name](spark, str(tmp_path)).collect()}
    want = {}
    for i, text in docs:
        seq = re.sub("[^ACGTN]" if "unknown" in name else "[^ACGTNacgtn]", "", (text or "").translate(str.maketrans("acgtn", "ACGTN")) if "unknown" in name else text or "")
        cut = lambda k, n: seq[i * k % len(seq) :][:n]  # noqa: B023, E731
        for w, q in enumerate([] if not seq else [cut(31, 9).replace("N", ""), cut(17, 1 + i % 4)] if "unknown" in name else [cut(31, 1 + i % 11), cut(17, 1 + (i + 1) % 11)]):
            want[i, 2 * i + w] = naive(seq, q)
    assert got == want


@pytest.mark.parametrize("whole", [60, suffix.WHOLE])
def test_contigs_of_any_length_and_reads_of_any_number(spark, monkeypatch, whole):
    """Contigs that the index searches beside those of a task; contigs with so many reads that several tasks have them; batches that end between a contig and its reads; null ids and repeated ones."""
    texts = TEXTS | {100 + c: t for c, t in UNKNOWN.items()} | {300: "A$AB\0CA$", 301: "ab" * 25}
    queries = ["A", "N", "GT", "GATTACA", "ACGTACGTACGTACGT", "T" * 40, "$", "A$", "é", "acg", "x", "\0", "b" + "ab" * 20, "", None]
    rows = [(c, None if k == 2 else 100 * c + k, q) for c in texts for k, q in enumerate(queries)] + [(None, 1, "A"), (None, 2, None), (999, 3, "A"), (999, 4, "")] + [(0, 5, "A")] * 30
    monkeypatch.setattr(search, "WHOLE", whole)
    monkeypatch.setattr(contig_search, "ASKED", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        reads = spark.createDataFrame(rows, "contig_id long, read_id long, q string")
        more = spark.createDataFrame([(None, "AAA")], "contig_id long, seq string")
        got = Counter((r.contig_id, r.read_id, r.n) for r in search.backward_search_of(texts_of(spark, texts).unionByName(more), reads).collect())
        long_ = {c for c, t in texts.items() if len(t) >= whole}
        want = Counter((c, i, naive(texts.get(c, ""), q)) for c, i, q in rows)
        if long_:  # the index names a read by its id, of which there is none here
            got, want = ({k: n for k, n in found.items() if k[1] is not None or k[0] not in long_} for found in (got, want))
        assert got == want
        twice = spark.createDataFrame([(1, "AAA"), (1, "CA"), (2, None)], "contig_id long, seq string")
        asked = spark.createDataFrame([(1, 7, "A"), (2, 8, "A")], "contig_id long, read_id long, q string")
        assert sorted((r.read_id, r.n) for r in contig_search.count_in_contigs(twice, asked).collect()) == [(7, 1), (7, 3), (8, 0)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_contigs_go_by_in_blocks(monkeypatch):
    """Blocks end at contigs, and a contig's reads in later batches find it again."""
    monkeypatch.setattr(contig_search, "WHOLE", 8)
    rng = random.Random(21)
    texts = {c: "".join(rng.choice("AC") for _ in range(rng.choice([0, 1, 5, 8, 20]))) for c in range(30)}
    rows = []
    for c, t in texts.items():
        rows += [(c, 0, False, None, t)] + [(c, 0, True, 100 * c + k, rng.choice(["A", "CA", "AAC", "", None, t or "A"])) for k in range(rng.choice([0, 1, 9]))]
    schema = pa.schema([("contig_id", pa.int64()), ("part", pa.int64()), ("asked", pa.bool_()), ("read_id", pa.int64()), ("text", pa.string())])
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows[lo : lo + 4]], schema) for lo in range(0, len(rows), 4)]
    got = {r["read_id"]: r["n"] for out in contig_search._counted(iter(batches)) for r in out.to_pylist()}
    assert got == {i: naive(texts[c], q) for c, _, asked, i, q in rows if asked}
