"""Quality classifier trained on weak labels.

1. Labellers: simple, overlapping rules vote good, bad or nothing on every document.
   Two of them know words that a bounded sample of labelled rows shows to be abuse,
   in whatever language.
2. Label model: expectation-maximisation over the counts of vote patterns of the
   whole corpus estimates how each labeller votes on good, on malformed and on abusive
   documents and how many there are of each (Dawid and Skene). There are at most
   3 ** labellers patterns, so their counts have a fixed bound whatever the corpus.
3. Scorer: a linear model over hashed words and word shapes learns the posterior
   labels and scores every document. Its log-odds and the posterior's are added: the
   labellers decide where they speak up, the scorer where they hardly do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifmill.llm import textscan as ts
from motifmill.llm.minhash import FOLD
from motifmill.plans.storage import materialize, small_side

U64 = np.uint64
#: English words that abuse a reader, whatever a text is about; those of other languages are learnt.
ABUSE = "bastard bitch clown disgusting dumb fool idiot idiots imbecile jerk loser losers moron morons pathetic scum stupid trash ugly worthless".split()
BAD, NONE, GOOD = 0, 1, 2
LABELLERS = ("letters", "wordless", "symbols", "capitals", "shouting", "repetition", "runs", "monotony", "any_abuse", "much_abuse", "any_learnt", "much_learnt")
ABUSIVE = ("any_abuse", "much_abuse", "any_learnt", "much_learnt")
#: Those that need so many words: shares and runs in fewer say little.
LEAST_WORDS = dict.fromkeys(("repetition", "runs", "monotony", "capitals", "letters"), 20)
#: Words from which the other labellers but ABUSIVE vote.
SOME_WORDS = 5
#: (bad, good) votes that a labeller starts with on good, malformed and abusive documents; the corpus' own soon outnumber them.
PRIOR = ((0.01, 10.0), (1.0, 1.0), (1.0, 1.0))
#: At most about so many labelled rows, chosen by a hash of their id, are read for words of abuse.
LABEL_ROWS = 20_000
#: A learnt word, or beginning of PREFIX bytes, stands in so many abusive texts at least, and that many times as often there as in others; so many words at most.
LEAST_TEXTS, LEAST_RATIO, PREFIX, LEXICON = 8, 400, 5, 1 << 16
#: Hashed features: words, and word shapes behind them.
WORD_BITS, SHAPE_BITS = 16, 8
FEATURES = (1 << WORD_BITS) + (1 << SHAPE_BITS)
#: About so many different texts, chosen by their hash, train the scorer, of about so many words in all at most.
TRAIN_ROWS, TRAIN_WORDS = 8192, 6_000_000
#: A document is kept from this probability of being good.
KEEP_FROM = 0.5

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+<=>@[\\]^_`{|}~"]] = True
_SHAPE = np.zeros(256, np.int64)  # class of a byte: 1 lower, 2 upper, 3 digit, 4 other letter, 5 symbol, 6 punctuation
_SHAPE[33:127] = 6
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 1, 2, 3, 4
_SHAPE[_SYMBOL] = 5


class Slice:
    """Words of a slice of texts, and sums by text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.starts, self.ends, self.first = ts.words(data, offsets)
        self.n_words = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.n_words)), self.n_words)
        self.hash = ts.span_hash(FOLD[data], self.starts, self.ends)

    def bytes_in(self, table: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(table[self.data], dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def words_that(self, mask: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc[mask], minlength=len(self.n_words))

    def with_bytes(self, table: np.ndarray) -> np.ndarray:
        """Per word the number of bytes of a kind."""
        total = np.concatenate(([0], np.cumsum(table[self.data], dtype=np.int64)))
        return total[self.ends] - total[self.starts]

    def again(self) -> np.ndarray:
        """Is a word the same as the one before it in its text?"""
        out = np.zeros(len(self.hash), bool)
        out[1:] = (self.hash[1:] == self.hash[:-1]) & (self.doc[1:] == self.doc[:-1])
        return out

    def longest_run(self) -> np.ndarray:
        """Most times that a word stands in a row in each text."""
        begins = np.flatnonzero(~self.again())
        out = np.zeros(len(self.n_words), np.int64)
        np.maximum.at(out, self.doc[begins], np.diff(np.append(begins, len(self.hash))))
        return out


_abuse: list[np.ndarray] = []


def _abuse_hashes() -> np.ndarray:
    if not _abuse:
        words = [w.encode() for w in ABUSE]
        at = np.concatenate(([0], np.cumsum([len(w) for w in words])))
        _abuse.append(np.sort(ts.span_hash(np.frombuffer(b"".join(words), np.uint8), at[:-1], at[1:])))
    return _abuse[0]


def bare_words(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words without the punctuation mark at either end, and of their first PREFIX bytes (of longer ones; else as the word)."""
    if not len(s.ends):
        return s.hash, s.hash
    last = s.ends - (_SHAPE[s.data[s.ends - 1]] == 6)
    begin = s.starts + ((_SHAPE[s.data[s.starts]] == 6) & (last > s.starts + 1))
    last, low = np.maximum(last, begin), FOLD[s.data]
    whole = ts.span_hash(low, begin, last)
    long = last - begin > PREFIX
    front = whole.copy()
    front[long] = ts.span_hash(low, begin[long], begin[long] + PREFIX, 1)
    return whole, front


def _listed(words: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(words), bool)
    return known[np.minimum(np.searchsorted(known, words), len(known) - 1)] == words


def measures(s: Slice, lexicon: np.ndarray) -> dict[str, tuple[np.ndarray, float, float]]:
    """Of every text what each labeller looks at, with the measure from which it votes BAD and that below which it votes GOOD."""
    n = np.maximum(s.n_words, 1)
    visible = np.maximum(s.bytes_in(~ts.SPACE), 1)
    letters = s.bytes_in(_LETTER)
    plain = s.bytes_in(_LETTER | _DIGIT)
    capitals = s.bytes_in(_UPPER)
    marks = np.zeros(256, bool)
    marks[ord("!")] = True
    whole, front = bare_words(s)
    abuse = s.words_that(_listed(whole, _abuse_hashes()))
    learnt = s.words_that(_listed(whole, lexicon) | _listed(front, lexicon))
    order = np.lexsort((s.hash, s.doc))
    new = np.ones(len(order), bool)
    new[1:] = (s.hash[order][1:] != s.hash[order][:-1]) | (s.doc[order][1:] != s.doc[order][:-1])
    begins = np.flatnonzero(new)
    size = np.diff(np.append(begins, len(order)))
    top = np.zeros(len(n), np.int64)
    np.maximum.at(top, s.doc[order][begins], size)
    return {
        "letters": (1 - plain / visible, 0.15, 0.08),
        "wordless": (s.words_that(s.with_bytes(_LETTER | _DIGIT) == 0) / n, 0.08, 0.02),
        "symbols": (s.bytes_in(_SYMBOL) / visible, 0.02, 0.004),
        "capitals": (capitals / np.maximum(letters, 1), 0.3, 0.12),
        "shouting": (s.bytes_in(marks) / n, 0.25, 0.05),
        "repetition": (s.words_that(s.again()) / n, 0.15, 0.05),
        "runs": (s.longest_run(), 5, 4),
        "monotony": (top / n, 0.25, 0.15),
        "any_abuse": (abuse, 1, 1),
        "much_abuse": (abuse / n, 0.004, 0.001),
        "any_learnt": (learnt, 1, 1),
        "much_learnt": (learnt / n, 0.004, 0.001),
    }


def votes(s: Slice, lexicon: np.ndarray) -> np.ndarray:
    """One row a text, one column a labeller: BAD, GOOD or between them NONE.

    Texts of under SOME_WORDS words get no votes but on abuse, those of under 20 none of
    the labellers in LEAST_WORDS; without a lexicon those that were to learn it vote NONE.
    """
    out = np.full((len(s.n_words), len(LABELLERS)), NONE, np.int8)
    for j, (name, (x, bad, good)) in enumerate(measures(s, lexicon).items()):
        if name.endswith("_learnt") and not len(lexicon):
            continue
        least = 0 if name in ABUSIVE else LEAST_WORDS.get(name, SOME_WORDS)
        out[:, j] = np.where(s.n_words < least, NONE, np.where(x >= bad, BAD, np.where(x < good, GOOD, NONE)))
    return out


def patterns(v: np.ndarray) -> np.ndarray:
    return (v.astype(np.int64) * 3 ** np.arange(v.shape[1])).sum(axis=1)


def fit_label_model(pattern: np.ndarray, count: np.ndarray, rounds: int = 500) -> dict[int, float]:
    """Posterior probability of good for every pattern, by expectation-maximisation.

    There are good, malformed and abusive documents. On each kind a labeller has a rate
    of bad votes among its votes; no vote says nothing. It starts from the votes
    themselves: a bad one of the ABUSIVE labellers means abusive, else any bad one
    malformed. Without such a vote a document hardly starts as abusive, so that kind
    stays empty where there is no abuse. PRIOR is a fixed number of votes, so what it
    says fades as documents come.
    """
    v = pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    weight = count.astype(float)
    bad, voted = (v == BAD).astype(float), (v != NONE).astype(float)
    of_abuse = np.isin(np.array(LABELLERS), ABUSIVE)
    abused, any_bad = bad[:, of_abuse].any(axis=1), bad.any(axis=1)
    belief = np.stack([np.where(any_bad, 0.1, 0.9), np.where(any_bad, 0.9, 0.1), np.full(len(v), 0.001)], 1)
    belief[abused] = (0.1, 0.1, 0.8)
    for _ in range(rounds):
        old = belief
        mass = weight[:, None] * belief
        log = np.log((mass.sum(axis=0) + 1) / (weight.sum() + 3))[None, :].repeat(len(v), 0)
        for k, (yes, no) in enumerate(PRIOR):
            rate = (mass[:, k] @ bad + yes) / (mass[:, k] @ voted + yes + no)
            log[:, k] += bad @ np.log(rate) + (voted - bad) @ np.log(1 - rate)
        belief = np.exp(log - log.max(axis=1, keepdims=True))
        belief /= belief.sum(axis=1, keepdims=True)
        if np.abs(belief - old).max(initial=0) < 1e-9:
            break
    return {int(p): float(g) for p, g in zip(pattern, belief[:, 0], strict=True)}


def learn_lexicon(docs: DataFrame, labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_rows: int = LABEL_ROWS) -> np.ndarray:
    """Hashes of words and beginnings of words that stand in labelled abusive texts (``label_col`` = 1) and hardly in others (0), ascending.

    Reads at most about ``label_rows`` of the rows of ``labelled`` (``id_col``, ``label_col``); rows
    with a null id or label, or without a document, take no part.
    """
    marked = labelled.select(F.col(id_col).alias("id"), (F.col(label_col) == 1).alias("abusive")).dropna()
    total = marked.count()
    share = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("label")), F.lit(1 << 30)) < (1 << 30) * min(1.0, label_rows / max(total, 1))
    marked = small_side(materialize(marked.where(share).groupBy("id").agg(F.max("abusive").alias("abusive")), "labelled"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(marked, "id").select("abusive", "text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, slices in _slices(batches, 1):
            abusive, at = batch.column(0).to_numpy(zero_copy_only=False), 0
            for s in slices:
                own = abusive[at : at + len(s.n_words)]
                at += len(s.n_words)
                kinds = [np.concatenate(x) for x in zip(*((s.doc, h) for h in bare_words(s)), strict=True)]
                doc, word = np.array([], np.int64), np.array([], U64)
                if len(kinds[0]):
                    order = np.lexsort(kinds[::-1])
                    doc, word = kinds[0][order], kinds[1][order]
                    new = np.append(True, (doc[1:] != doc[:-1]) | (word[1:] != word[:-1]))
                    doc, word = doc[new], word[new]
                found, which = np.unique(word, return_inverse=True)
                bad = np.bincount(which, weights=own[doc], minlength=len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(bad), pa.array(np.bincount(which, minlength=len(found)) - bad)], ["word", "bad", "good"])

    sizes = texts.groupBy("abusive").count().collect()  # two rows at most
    many = {r[0]: r[1] for r in sizes}
    counted = texts.mapInArrow(words, "word long, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    often = (F.col("bad") >= LEAST_TEXTS) & (F.col("bad") * many.get(False, 0) >= LEAST_RATIO * F.col("good") * many.get(True, 0))
    found = counted.where(often).orderBy(F.desc("bad"), "word").limit(LEXICON).select("word").toArrow()
    return np.sort(found.column("word").to_numpy().view(U64))


def features(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value), ascending: roots of the counts of hashed words and of word shapes, each kind scaled to length one in a text."""
    n = len(s.n_words)
    word = (s.hash >> U64(64 - WORD_BITS)).astype(np.int64)
    if len(s.starts):
        front, back = _SHAPE[s.data[s.starts]], _SHAPE[s.data[s.ends - 1]]
        odd = s.with_bytes(_SYMBOL) > 0
        loud = 2 * s.with_bytes(_UPPER) > s.ends - s.starts
        shape = ((front * 7 + back) * 4 + odd + 2 * loud) % (1 << SHAPE_BITS - 1) + (s.again() << SHAPE_BITS - 1)
    else:
        shape = np.zeros(0, np.int64)
    docs, cols, vals = [], [], []
    for kind in (word, shape + (1 << WORD_BITS)):
        key, count = np.unique(s.doc * (1 << 20) + kind, return_counts=True)
        doc, count = key >> 20, np.sqrt(count)
        length = np.sqrt(np.bincount(doc, weights=count**2, minlength=n))
        docs.append(doc)
        cols.append(key & ((1 << 20) - 1))
        vals.append(count / np.maximum(length, 1e-12)[doc])
    doc, col, val = (np.concatenate(x) for x in (docs, cols, vals))
    order = np.argsort(doc, kind="stable")
    return doc[order], col[order], val[order]


def fit_scorer(doc: np.ndarray, col: np.ndarray, val: np.ndarray, target: np.ndarray, rounds: int = 200, rate: float = 0.6, ridge: float = 1e-7) -> np.ndarray:
    """Weights of a logistic regression on the posterior labels; the last one is the bias.

    Full gradients with a step size for each weight (AdaGrad), so that a telling word
    that few documents hold learns as fast as a common one.
    """
    w, seen = np.zeros(FEATURES + 1), np.full(FEATURES + 1, 1e-12)
    n = len(target)
    for _ in range(rounds if n else 0):
        z = np.bincount(doc, weights=val * w[col], minlength=n) + w[-1]
        slip = (1 / (1 + np.exp(-np.clip(z, -700, 700))) - target) / n
        grad = np.bincount(col, weights=val * slip[doc], minlength=FEATURES + 1) + ridge * w
        grad[-1] = slip.sum()
        seen += grad**2
        w -= rate * grad / np.sqrt(seen)
    return w


def _slices(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[Slice]]]:
    for batch in batches:
        yield batch, (Slice(data, offsets) for _, _, data, offsets in ts.slices(batch.column(at)))


class Model:
    """Learnt words, posteriors of the vote patterns and weights of the scorer."""

    def __init__(self, lexicon: np.ndarray, posteriors: dict[int, float], weights: np.ndarray):
        self.lexicon, self.posteriors, self.weights = lexicon, posteriors, weights.astype(np.float32)

    def judge(self, s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Posterior, score and both together of every text; without words there is nothing good in it: 0."""
        posterior = np.array([self.posteriors[int(p)] for p in patterns(votes(s, self.lexicon))], float)
        score = self.score(s)
        odds = np.log((posterior + 1e-12) / (1 - posterior + 1e-12)) + np.log((score + 1e-12) / (1 - score + 1e-12))
        return posterior, np.round(score, 6), np.round(np.where(s.n_words > 0, 1 / (1 + np.exp(-odds)), 0.0), 6)

    def score(self, s: Slice) -> np.ndarray:
        doc, col, val = features(s)
        z = np.bincount(doc, weights=val * self.weights[col], minlength=len(s.n_words)) + self.weights[-1]
        return np.where(s.n_words > 0, 1 / (1 + np.exp(-np.clip(z, -700, 700))), 0.0)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", labelled: DataFrame | None = None, train_rows: int = TRAIN_ROWS, train_words: int = TRAIN_WORDS) -> Model:
    """Fit the models. All documents are counted; the scorer sees about ``train_rows`` different texts (all, if fewer) of about ``train_words`` words.

    Texts are chosen by their hash, so that equal ones count as one however many rows
    hold them and whatever their ids are. What reaches the driver of a text is at most
    its words, and at most FEATURES, as packed features.
    """
    lexicon = np.zeros(0, U64) if labelled is None else learn_lexicon(docs, labelled, id_col=id_col, text_col=text_col)
    base = docs.select(F.col(text_col).alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, slices in _slices(batches, 0):
            for s in slices:
                kinds, which, counts = np.unique(patterns(votes(s, lexicon)), return_inverse=True, return_counts=True)
                words = np.bincount(which, weights=s.n_words, minlength=len(kinds)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), pa.array(counts, pa.int64()), pa.array(words)], ["pattern", "n", "words"])

    counted = base.mapInArrow(vote, "pattern long, n long, words long").groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).orderBy("pattern").collect()
    pattern, count = np.array([r[0] for r in counted], np.int64), np.array([r[1] for r in counted], np.int64)
    posteriors = fit_label_model(pattern, count)
    share = min(1.0, train_rows / max(int(count.sum()), 1), train_words / max(sum(r[2] for r in counted), 1))
    shared = docs.sparkSession.sparkContext.broadcast(posteriors)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, slices in _slices(batches, 0):
            for s in slices:
                good = [shared.value[int(p)] for p in patterns(votes(s, lexicon))]
                doc, col, val = features(s)
                cuts = np.searchsorted(doc, np.arange(len(good) + 1))
                rows = [i for i in range(len(good)) if s.n_words[i]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([good[i] for i in rows], pa.float64()), pa.array([col[cuts[i] : cuts[i + 1]].astype("<i4").tobytes() for i in rows], pa.binary()), pa.array([val[cuts[i] : cuts[i + 1]].astype("<f4").tobytes() for i in rows], pa.binary())],
                    ["good", "cols", "vals"],
                )

    dealt = F.xxhash64("text", F.lit("train"))
    picked = base.where("text <> ''").withColumn("dealt", dealt).where(F.pmod("dealt", F.lit(1 << 30)) < (1 << 30) * share).groupBy("dealt").agg(F.first("text").alias("text")).select("text")
    rows = picked.mapInArrow(sample, "good double, cols binary, vals binary").toArrow()
    cols = [np.frombuffer(x.as_py(), "<i4") for x in rows.column("cols")]
    doc = np.repeat(np.arange(len(cols)), [len(c) for c in cols]) if cols else np.zeros(0, np.int64)
    col = np.concatenate(cols).astype(np.int64) if cols else np.zeros(0, np.int64)
    val = np.concatenate([np.frombuffer(x.as_py(), "<f4") for x in rows.column("vals")]).astype(float) if cols else np.zeros(0)
    target = rows.column("good").to_numpy()
    # in one order, so that sums and with them weights do not depend on the order in which tasks ended
    order = sorted(range(len(cols)), key=lambda i: (len(cols[i]), target[i], cols[i].tobytes()))
    place = np.empty(len(cols), np.int64)
    place[order] = np.arange(len(cols))
    doc = place[doc]
    turn = np.argsort(doc, kind="stable")
    return Model(lexicon, posteriors, fit_scorer(doc[turn], col[turn], val[turn], target[order]))


def classify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", labelled: DataFrame | None = None, train_rows: int = TRAIN_ROWS, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, posterior (the label model's probability of good), score (the scorer's), quality (both), keep (quality >= keep_from) of every document.

    labelled: rows (``id_col``, toxic) from which words of abuse are learnt, see
    ``learn_lexicon``; without it the English list has to do. Null, empty and blank texts
    have quality 0 and are not kept; repeated rows score alike; a null id stays null; an
    empty table gives no rows; other columns, whatever their names, are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, id_col=id_col, text_col=text_col, labelled=labelled, train_rows=train_rows))
    ids = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, slices in _slices(batches, 1):
            three = [model.value.judge(s) for s in slices]
            posterior, score, both = (np.concatenate(x) if x else np.zeros(0) for x in (list(zip(*three, strict=True)) or [(), (), ()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(posterior, pa.float64()), pa.array(score, pa.float64()), pa.array(both, pa.float64()), pa.array(both >= keep_from)], ["doc_id", "posterior", "score", "quality", "keep"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"doc_id {ids}, posterior double, score double, quality double, keep boolean")


def keep_good(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", labelled: DataFrame | None = None, train_rows: int = TRAIN_ROWS, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier keeps, as ``classify`` has it: none of those without words, all or none of repeated ones; an empty table stays empty."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, id_col=id_col, text_col=text_col, labelled=labelled, train_rows=train_rows))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, slices in _slices(batches, at):
            both = [model.value.judge(s)[2] for s in slices]
            yield batch.filter(pa.array(np.concatenate(both) >= keep_from if both else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
