"""Texts made to collide under the quick scan hashes are still different texts."""

import random

import numpy as np
import pyarrow as pa

from motifmill.llm import minhash, near_dedup, suffix_dedup
from motifmill.llm import textscan as ts

MASK = (1 << 64) - 1


def step(state, lane, salt):
    """One step of ts.span_hash."""
    state = (state ^ lane) * int(ts._LANE[salt]) & MASK
    state ^= state >> 32
    state = state * int(ts._LEFT) & MASK
    return state ^ state >> 29


def forged(text, at, salt, rng, alphabet):
    """``text`` with 16 bytes from ``at`` (a multiple of 8) on replaced, so that span_hash of the whole stays the same."""
    state = int(ts.mix(np.array([len(text)], np.uint64) * ts._LANE[salt] + ts._SALT[salt])[0])
    lane = lambda i: int.from_bytes(text[i : i + 8], "little")
    for i in range(0, at, 8):
        state = step(state, lane(i), salt)
    want = step(state, lane(at), salt) ^ lane(at + 8)
    while True:
        first = bytes(rng.choice(alphabet) for _ in range(8))
        second = (step(state, int.from_bytes(first, "little"), salt) ^ want).to_bytes(8, "little")
        if first != text[at : at + 8] and all(c in alphabet for c in second):
            return text[:at] + first + second + text[at + 16 :]


def span_hash(raw, salt):
    return ts.span_hash(np.frombuffer(raw, np.uint8), np.zeros(1, np.int64), np.full(1, len(raw)), salt)[0]


def test_segments_that_collide_are_not_removed(spark):
    """Pairs of 200 bytes that differ in 16 of them, outside the part that classes share."""
    rng = random.Random(1)
    alphabet = bytes(range(32, 127))
    texts = []
    for salt in (0, 1):
        while len(texts) < 40 * (salt + 1):
            text = bytes(rng.choice(alphabet) for _ in range(200))
            for at in (0, 176):
                other = forged(text, at, salt, rng, alphabet)
                assert span_hash(text, salt) == span_hash(other, salt) and text != other
                texts += [text, other]
    df = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string")
    got = suffix_dedup.dedup_suffixes(df, length=200).collect()
    once = {t for t in texts if texts.count(t) == 1}
    assert {r.doc_id: r.n_removed for r in got} == {k: 0 if t in once else 200 for k, t in enumerate(texts)} and len(once) == 40


def test_words_that_collide_make_no_link(spark):
    """Two texts without a common word, whose words collide one by one."""
    rng = random.Random(2)
    alphabet = bytes(c for c in range(33, 127) if not 65 <= c <= 90)
    rows = []
    for salt in (0, 1):
        words = [bytes(rng.choice(alphabet) for _ in range(16)) for _ in range(60)]
        others = [forged(w, 0, salt, rng, alphabet) for w in words]
        assert all(span_hash(w, salt) == span_hash(x, salt) for w, x in zip(words, others, strict=True))
        rows += [b" ".join(words), b" ".join(others), b" ".join(words[:30] + words[31:])]
        rows += [b" ".join(words[:5] + others[:5] + words[5:10] + others[5:10])]  # shingles of one text that collide
    df = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.dedup_near(df, percent=80).collect()}
    assert got == {0: (56, 0), 1: (56, 1), 2: (55, 0), 3: (16, 3), 4: (56, 4), 5: (56, 5), 6: (55, 4), 7: (16, 7)}


def test_sizes_of_sets():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 1, 4, 5, 6, 300, 5000)] + ["a b " * 40, "A a\tA a  a a a"]
    for _, _, data, offsets in ts.slices(pa.array(texts)):
        data, offsets = minhash.folded(data, offsets)
        _, _, size = minhash.shingle_sets(data, offsets, 5)
        exact, at = minhash.exact_sets(data, offsets, 5, b"key")
        want = [len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) if (w := t.lower().split()) else 0 for t in texts]
        assert size.tolist() == want == np.diff(at).tolist()
