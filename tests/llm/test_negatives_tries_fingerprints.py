"""Hard negatives, conversation tries and fingerprints against brute force, on ordinary and on odd tables."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from motifmill.llm import negatives, prefix_trie, queries, simhash
from motifmill.llm import textscan as ts

from . import brute
from .test_text_operators import corpus_rows, in_order, odd_rows, prose, table

DATA = "/root/testdata/sf0.001"


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in data)


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_conversation_trie", "op13_simhash_dedup"])
def test_same_as_sql(spark, name):
    got = queries.queries()[name](spark, DATA)
    duck = duckdb.connect()
    for t in ("embeddings", "conversations", "documents"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(names, want.fetchall())


# fingerprints


def test_xxh64_is_xxh64():
    rng = random.Random(0)
    data = np.frombuffer(rng.randbytes(20000), np.uint8)
    start = np.array([rng.randrange(15000) for _ in range(2000)])
    end = start + np.array([rng.choice([0, 1, 3, 4, 5, 7, 8, 9, 15, 20, 31, 32, 33, 40, 63, 64, 65, 100, 2047, 2048, 3000]) for _ in start])
    for seed in (0, 42):
        assert simhash.xxh64(data, start, end, seed).tolist() == [xxhash.xxh64_intdigest(data[a:b].tobytes(), seed) for a, b in zip(start, end, strict=True)]


def test_fingerprints_of_odd_texts():
    rng = random.Random(2)
    texts = [t for _, t in corpus_rows()] + ["a", "A  b", "\x0b\x0c", "é" * 3000, "x " * 700, prose(rng, 70000), "\u00a0 nbsp is no gap", None, "w" * 5000 + " tail of it all"]
    got = [f for _, _, data, offsets in ts.slices(pa.array(texts)) for f in simhash.fingerprints(data, offsets, 4).tolist()]
    assert got == [brute.fingerprint(t) for t in texts]


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7, 12])
def test_bit_sliced_comparison(radius):
    rng = np.random.default_rng(radius)
    fp = rng.integers(0, 2**63, 700, dtype=np.uint64)
    for k in range(100, 400):  # chains and clusters, and copies
        fp[k] = fp[k - rng.integers(1, 4)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, radius + 3)).astype(np.uint64))
    fp[500:520] = fp[500]
    end = np.repeat([90, 450, 451, 700], [90, 360, 1, 249])
    of = simhash.connected(fp, np.arange(700) + 1, end, radius)
    for lo, hi in ((0, 90), (90, 450), (450, 451), (451, 700)):
        assert of[lo:hi].tolist() == [lo + x for x in brute.linked(fp[lo:hi].tolist(), radius)]


def test_groups_are_not_cut_and_blocks_meet_across():
    """Batches end inside groups; the first block of two asks the second, and nothing asks within it."""
    rng = np.random.default_rng(5)
    fp = rng.integers(0, 2**62, 60, dtype=np.uint64)
    fp[30:] = fp[:30] ^ np.uint64(1 << 63)  # near only across
    key, i, j, own = np.zeros(60, np.int64), np.zeros(60, np.int32), np.ones(60, np.int32), np.repeat([0, 1], 30).astype(np.int32)
    alone = np.full(40, 9, np.int64), np.zeros(40, np.int32), np.zeros(40, np.int32), np.zeros(40, np.int32)
    more = rng.integers(0, 2**62, 40, dtype=np.uint64)
    more[1::2] = more[::2] ^ np.uint64(3)
    whole = [np.concatenate(x) for x in zip((key, i, j, own), alone, strict=True)] + [np.concatenate([fp, more]).view(np.int64)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in whole], ["key", "i", "j", "own", "fp"])
    for size in (7, 60, 100):
        parts = [batch.slice(k, size) for k in range(0, 100, size)]
        got = {tuple(sorted((a, b))) for out in simhash._links(4)(iter(parts)) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)}
        x = whole[4].tolist()
        assert got == {tuple(sorted(p)) for p in [*zip(x[:30], x[30:60], strict=True), *zip(x[60::2], x[61::2], strict=True)]}


@pytest.mark.parametrize("block", [simhash.BLOCK, 3])
def test_documents_are_linked(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(8)
    rows = corpus_rows(seed=3, n=90)
    base = prose(rng, 400).split(" ")
    for k in range(60):  # one large group whose members differ in a word or two
        words = list(base)
        words[rng.randrange(len(words))] = f"w{k}"
        rows.append((len(rows), " ".join(words)))
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.dedup_simhash(table(spark, rows)).collect()}
    want = [brute.fingerprint(t) for _, t in rows]
    assert got == {i: (want[i], c) for i, c in enumerate(brute.linked(want, 4))}
    assert len({c for _, c in got.values()}) < len(rows) - 40


def test_fingerprints_of_odd_tables(spark):
    rows = odd_rows()
    ordered = in_order(spark, rows)
    of = brute.linked([brute.fingerprint(t) for _, t in ordered], 4)
    want = sorted((repr((i, f"{brute.fingerprint(t):016x}", ordered[c][0])) for (i, t), c in zip(ordered, of, strict=True)))
    got = sorted(repr((r.doc_id, r.fingerprint, r.component_id)) for r in simhash.dedup_simhash(table(spark, rows)).collect())
    assert got == want
    assert simhash.dedup_simhash(table(spark, rows).limit(0)).count() == 0


# hard negatives


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 1) for i, v, y in rows], "vec_id long, embedding array<float>, label int, codes string, uid int")


def mined(df):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in negatives.mine(df, relabel="if(id % 7 = 0, (label + 1) % 10, label)").collect())


def f32(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]


@pytest.mark.parametrize(("block", "least"), [(negatives.ROWS, negatives.LEAST_ROWS), (90, 90)])
def test_negatives_in_clusters_and_ties(spark, monkeypatch, block, least):
    monkeypatch.setattr(negatives, "ROWS", block)
    monkeypatch.setattr(negatives, "LEAST_ROWS", least)
    monkeypatch.setattr(negatives, "ANCHORS", 2 if block < 100 else negatives.ANCHORS)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(6, 12))
    rows = [(k, (centre[k % 6] + 0.4 * rng.normal(size=12)).tolist(), int(rng.integers(0, 4))) for k in range(500)]
    hot = rows[200][1]
    rows += [(1000 + k, hot, k % 4) for k in range(150)] + [(100, hot, 1), rows[300], rows[300]]
    rows = f32(rows)
    assert mined(vectors(spark, rows)) == brute.hard_negatives(rows)


def test_negatives_of_odd_rows(spark):
    rows = f32([(0, [1.0, 0.5], 1), (1, [0.9, 0.5], 1), (2, [0.5, 0.2], 2), (3, None, 2), (4, [None, 1.0], 2), (5, [math.nan, 1.0], 2), (6, [math.inf, 1.0], 1), (8, [0.6, 0.3], None), (None, [0.6, 0.3], 2), (100, [], 1), (200, [-1.0, -1.0], 5), (300, [0.0, 0.0], 2), (9, [0.7], 3), (7, [0.3, 0.3], 0), (400, [-3.0, 2.5], 2)])
    assert mined(vectors(spark, rows)) == brute.hard_negatives(rows)
    assert mined(vectors(spark, rows).limit(0)) == []
    assert mined(vectors(spark, [r for r in rows if r[0] and r[0] % 100])) == []
    huge = f32([(0, [1.0, 2.0], 1), (1, [1.0, 2.5], 1), (2, [0.8, 1.6], 2), (3, [1e30, 1.0], 2)])
    assert mined(vectors(spark, huge)) == brute.hard_negatives(huge[:3])


def test_bounds_hold():
    """No exact score is outside of what codes and residual norms say."""
    rng = np.random.default_rng(7)
    x = (256 * rng.normal(size=(3000, 16))).astype(np.int64)
    books = negatives.fit(x[:500])
    codes, left = negatives.encode(x, books)
    rows = pa.table({"uid": np.arange(3000), "id": np.arange(3000), "label": np.zeros(3000, np.int64), "x": pa.array([r.tobytes() for r in x.astype(np.int32)]), "codes": pa.array([r.tobytes() for r in codes]), "left": left})
    block = negatives._Block(rows, books)
    near = block.approximate(x[:40])
    for a in range(40):
        exact, reach = x @ x[a], block.reach(x[a])
        assert (np.abs(exact - near[:, a]) <= reach).all()
        got, score = block.best(x[a], np.arange(3000), near[:, a] + reach, 10)
        order = np.lexsort((np.arange(3000), -exact))[:10]
        assert got.tolist() == order.tolist() and score.tolist() == exact[order].tolist()
    assert np.median(left) < 0.1 * np.median((x.astype(float) ** 2).sum(axis=1))


# tries


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn int, role string, text string, path string, n int")


def conversations(seed=1, families=3):
    rng = random.Random(seed)
    says = [f"says {k} " + "ö" * k for k in range(5)]
    rows = []
    for f in range(families):
        for c in range(f * 100, f * 100 + 25):
            rows += [(c, t, rng.choice("ua"), rng.choice(says[: 1 + t])) for t in range(rng.choice([1, 2, 3, 6, 9]))]
    long = [(k, rng.choice("ua"), says[k % 5]) for k in range(40)]
    rows += [(c, *t) for c in range(500, 530) for t in long[: 20 + c % 20]] + [(c, *t) for c in range(600, 640) for t in long]  # shared beginnings and copies
    return rows


def nodes(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


@pytest.mark.parametrize("most", [prefix_trie.MOST, 30])
def test_trie(spark, most):
    """Also where subtries are dealt again, level by level, until a part is one path."""
    rows = conversations()
    assert nodes(prefix_trie.conversation_trie(turns_of(spark, rows), most=most)) == brute.trie(brute.rebuilt(rows))


def test_trie_of_odd_rows(spark):
    rows = [(None, 0, "u", "lost"), (0, 1, "u", None), (0, None, None, "null turn first"), (0, 1, "a", None), (0, 1, "u", None), (-150, 0, "u", "x"), (-100, 0, "s", "head"), (-100, 1, "u", ""), (7, 0, "u", "no head turns"), (205, 0, "u", "head absent"), (233, 5, "u", "y" * 100000), (299, 0, None, None)]
    rows += [(c, 0, "u", "short") for c in range(700, 720)]
    for most in (prefix_trie.MOST, 2):
        assert nodes(prefix_trie.conversation_trie(turns_of(spark, rows), most=most)) == brute.trie(brute.rebuilt(rows))
    assert nodes(prefix_trie.conversation_trie(turns_of(spark, rows).limit(0))) == []
    empty = [(c, 0, "u", "x") for c in range(101, 140) if not brute.rebuilt([(c, 0, "u", "x")])[c]]
    assert nodes(prefix_trie.conversation_trie(turns_of(spark, empty))) == brute.trie(brute.rebuilt(empty)) and len(brute.trie(brute.rebuilt(empty))) == 1


def test_members_are_hashed_over_batches():
    batch = pa.RecordBatch.from_arrays([pa.array([b"a"] * 5 + [b"b"] + [b"c"] * 3, pa.binary()), pa.array([1, 2, 3, 10, 11, 4, 5, 6, 7], pa.int64())], ["pid", "conv_id"])
    whole = pa.Table.from_batches(prefix_trie._members(iter([batch])))
    for size in (1, 2, 4):
        assert pa.Table.from_batches(prefix_trie._members(batch.slice(k, size) for k in range(0, 9, size))).equals(whole)
    assert whole.column("n").to_pylist() == [5, 1, 3] and whole.column("conv_id").to_pylist() == [1, 4, 5]
