"""The quality classifier against plain versions of its parts, and by what it lets through."""

import random

import numpy as np
import pyarrow as pa
import pytest

from motifmill.llm import quality
from motifmill.llm import textscan as ts

from . import brute
from .test_text_operators import CASES, WORDS, table


def examples(seed=3):
    rng = random.Random(seed)
    good = [" ".join(rng.choice(WORDS[:13]) for _ in range(rng.randint(30, 120))) + "." for _ in range(400)]
    bad = [g.upper().replace(" ", "!! ") for g in good[:20]] + [g.replace(" ", "%%% ") for g in good[20:40]] + [" ".join(w for x in g.split()[:6] for w in [x] * 12) for g in good[40:60]] + [g + " you stupid pathetic idiot" for g in good[60:80]]
    return good[80:], bad


def slice_of(texts):
    (_, _, data, offsets), = ts.slices(pa.array(texts), 1 << 30)
    return quality.Slice(data, offsets)


def test_quality(spark):
    good, bad = examples()
    texts = [*good, *bad]
    rows = list(enumerate(texts)) + [(None, None), (900, ""), (901, " "), (902, "Fine."), (3, texts[3])]
    model = {r.doc_id: r for r in quality.classify(table(spark, rows)).collect()}
    n = len(good)
    assert sum(model[i].keep for i in range(n)) >= 0.99 * n and model[902].keep
    assert not any(model[i].keep for i in range(n, len(texts))) and not model[900].keep and not model[901].keep and not model[None].keep
    kept = quality.keep_good(table(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted([i for i, r in model.items() if r.keep] + [3])
    again = quality.classify(table(spark, rows).repartition(5)).collect()
    assert {r.doc_id: r.quality for r in again} == {i: r.quality for i, r in model.items()}


def test_votes():
    good, bad = examples()
    texts = [*good[:40], *bad, *(t or "" for _, t in [*CASES["ordinary"], *CASES["odd"]]), "Idiot!", "'idiot'", "\"", "!", "... loser", "a b c d!!"]
    known = {("word", b"beta"), ("front", b"gr\xc3\xb6\xc3")}
    hashed = np.sort(np.array([ts.span_hash(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]), int(kind == "front"))[0] for kind, x in known], np.uint64))
    for words, lexicon in ((set(), np.zeros(0, np.uint64)), (known, hashed)):
        assert [tuple(v) for v in quality.votes(slice_of(texts), lexicon).tolist()] == [brute.votes(t, words) for t in texts]


def test_label_model():
    good, bad = examples()
    rows = [brute.votes(t, set()) for t in [*good[:120], *bad]]
    kinds = sorted(set(rows))
    number = lambda v: sum(x * 3**j for j, x in enumerate(v))
    got = quality.fit_label_model(np.array([number(v) for v in kinds]), np.array([rows.count(v) for v in kinds]))
    assert [got[number(v)] for v in rows] == pytest.approx(brute.label_model(rows), abs=1e-6)


def test_prior_fades():
    """What a labeller does on most documents decides, not what it was taken for: one that votes bad on every second good text loses its say."""
    rng = random.Random(5)
    rows = [tuple([2] * 8 + [2, 2, 1, 1]) if k % 10 else tuple([0] * 6 + [2, 2, 2, 2, 1, 1]) for k in range(20_000)]
    rows = [(*r[:7], 0 if rng.random() < 0.5 else 2, *r[8:]) for r in rows]
    kinds = sorted(set(rows))
    number = lambda v: sum(x * 3**j for j, x in enumerate(v))
    got = quality.fit_label_model(np.array([number(v) for v in kinds]), np.array([rows.count(v) for v in kinds]))
    assert got[number((2, 2, 2, 2, 2, 2, 2, 0, 2, 2, 1, 1))] > 0.99 and got[number((0, 0, 0, 0, 0, 0, 2, 2, 2, 2, 1, 1))] < 0.01


def test_features_and_scorer():
    good, bad = examples()
    texts = [*good[:30], *bad[::3], "x", "a\n a"]
    s = slice_of(texts)
    dense = np.zeros((len(texts), quality.FEATURES))
    doc, col, val = quality.features(s)
    np.add.at(dense, (doc, col), val)
    for i, t in enumerate(texts):
        words = {}
        for w in t.encode().translate(brute.FOLD).split():
            k = int(ts.span_hash(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) >> 64 - quality.WORD_BITS
            words[k] = words.get(k, 0) + 1
        length = sum(words.values()) ** 0.5
        assert {k: pytest.approx(n**0.5 / length) for k, n in words.items()} == {int(k): dense[i, k] for k in np.flatnonzero(dense[i, : 1 << quality.WORD_BITS])}
    assert np.allclose((dense[:, 1 << quality.WORD_BITS :] ** 2).sum(axis=1), 1)
    target = np.array([float(i < 30) for i in range(len(texts))])
    w, seen = np.zeros(quality.FEATURES + 1), np.full(quality.FEATURES + 1, 1e-12)
    x = np.hstack([dense, np.ones((len(texts), 1))])
    for _ in range(50):
        slip = (1 / (1 + np.exp(-x @ w)) - target) / len(texts)
        grad = x.T @ slip + 1e-7 * w
        grad[-1] = slip.sum()
        seen += grad**2
        w -= 0.6 * grad / np.sqrt(seen)
    assert np.allclose(quality.fit_scorer(doc, col, val, target, rounds=50), w)


def test_learnt_words(spark):
    """Words of abuse in no list, from labels; those that stand in clean texts as well are not learnt."""
    rng = random.Random(7)
    good, _ = examples(4)
    insults = ["zworpel", "zworpig", "Grmblfx"]
    texts = [g + (" " + " ".join(rng.choices(insults, k=3)) + " again" if i % 8 == 0 else " again") for i, g in enumerate(good)]
    rows = [*enumerate(texts), (None, "x"), (5000, None)]
    marks = [(i, int(i % 8 == 0)) for i in range(0, len(texts), 2)] + [(None, 1), (7777, 1), (5000, 0), (1, None)]
    labelled = spark.createDataFrame(marks, "doc_id long, toxic int")
    docs = table(spark, rows)
    known = brute.lexicon([dict(rows)[i] for i, m in marks if m is not None and i in dict(rows) and i is not None], [bool(m) for i, m in marks if m is not None and i in dict(rows) and i is not None])
    want = {int(ts.span_hash(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]), int(kind == "front"))[0]) for kind, x in known}
    got = quality.learn_lexicon(docs, labelled)
    assert set(got.tolist()) == want and ("front", b"zworp") in known
    keep = {r.doc_id: r.keep for r in quality.classify(docs, labelled=labelled).collect()}
    assert all(keep[i] == bool(i % 8) for i in range(len(texts)))
    assert len(quality.learn_lexicon(docs, labelled.limit(0))) == 0 and quality.classify(docs.limit(0), labelled=labelled).count() == 0


def test_rows_without_ids_train_alike(spark):
    good, bad = examples()
    rows = [*enumerate([*good, *bad])]
    one = quality.train(table(spark, rows))
    other = quality.train(table(spark, [(None, t) for _, t in rows] * 2))
    assert np.abs(one.weights).max() > 0.1 and len(one.weights) == len(other.weights) and np.abs(other.weights).max() > 0.1
