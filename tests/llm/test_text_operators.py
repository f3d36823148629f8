"""The operators on documents against brute force, on ordinary and on odd tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from motifmill.llm import collection, corpus, decontaminate, licences, mixing, near_dedup, quality, substring_dedup, suffix_dedup, tokens
from motifmill.llm import textscan as ts

from . import brute

WORDS = "alpha beta gamma delta the of and to in is that été größe niño 7 x".split()
#: Columns whose names the operators use inside.
EXTRA = ("uid", "part", "row", "c0", "size", "hash", "comp", "kind", "at", "n_words", "threshold")


def prose(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "\n", "\t ", "  "]) for _ in range(n))


def corpus_rows(seed=1, n=60):
    rng = random.Random(seed)
    passage, long = prose(rng, 70), prose(rng, 30000)
    out = [(0, None), (1, ""), (2, "   \n"), (3, "one"), (4, "One"), (5, "a b c d"), (6, "x" * 700), (7, "x" * 450 + " y"), (8, long), (9, "Head. " + long[: len(long) // 3])]
    while len(out) < n:
        text = prose(rng, rng.choice([3, 19, 20, 21, 60, 150]))
        kind = rng.random()
        if kind < 0.3:
            text = text + passage + prose(rng, 10)
        elif kind < 0.5:
            text = rng.choice(out)[1]
        elif kind < 0.7 and (old := (rng.choice(out)[1] or "").split(" ")):
            old[rng.randrange(len(old))] = "edit"
            text = " ".join(old)
        out.append((len(out), text))
    return out


def odd_rows():
    """Null and repeated ids, repeated rows."""
    rng = random.Random(5)
    t, u = prose(rng, 60), prose(rng, 60)
    return [(None, t), (None, t), (7, u), (7, u), (7, t + u), (3, None), (3, None), (3, "a"), (None, None), (9, u + " tail")]


def table(spark, rows, extra=True):
    """doc_id, text, lang, source, n_chars and columns with clashing names."""
    full = [(i, t, None, f"s{(i or 0) % 3}" if i != 3 else None, None if t is None else len(t)) + tuple(f"{c}{k}" for c in EXTRA) for k, (i, t) in enumerate(rows)]
    names = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
    return spark.createDataFrame(full, names).select("*") if extra else spark.createDataFrame(rows, "doc_id long, text string")


def in_order(spark, rows):
    """Rows in the order in which documents count as earlier: by id, nulls first, then by the text's hash."""
    got = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k int").orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64(F.coalesce("text", F.lit(""))), "k")
    return [(r.doc_id, r.text) for r in got.collect()]


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


CASES = {"ordinary": corpus_rows(), "odd": odd_rows()}


@pytest.fixture(params=sorted(CASES), scope="module")
def rows(request):
    return CASES[request.param]


def test_words_and_hashes():
    rng = random.Random(2)
    texts = [prose(rng, rng.randint(0, 40)) for _ in range(50)] + ["", " ", "é", "a" * 5000]
    import pyarrow as pa

    kinds = {}
    for lo, hi, data, offsets in ts.slices(pa.array(texts), 300):
        starts, ends, first = ts.words(data, offsets)
        h = ts.span_hash(data, starts, ends)
        for i in range(lo, hi):
            w = [bytes(data[a:b]) for a, b in zip(starts[first[i - lo] : first[i - lo + 1]], ends[first[i - lo] : first[i - lo + 1]], strict=True)]
            assert w == texts[i].encode().split()
            for x, y in zip(w, h[first[i - lo] : first[i - lo + 1]], strict=True):
                assert kinds.setdefault(x, y) == y
    assert len(set(kinds.values())) == len(kinds)


def test_long_text_hashes_by_blocks(monkeypatch):
    import numpy as np

    data = np.frombuffer(prose(random.Random(1), 2000).encode(), np.uint8)
    for q in (1, 3, 7, 8, 9, 16, 31, 100):
        grams = ts.gram_hash(data, q)
        raw = data.tobytes()
        kinds = {}
        for i, h in enumerate(grams.tolist()):
            assert kinds.setdefault(raw[i : i + q], h) == h
        assert len(set(kinds.values())) == len(kinds) and len(grams) == len(data) - q + 1
        with monkeypatch.context() as m:
            m.setattr(ts, "_GRAM_BLOCK", 128)
            assert (ts.gram_hash(data, q) == grams).all()


def thue_morse(n, a, b):
    word = a
    while len(word) < n:
        word += bytes({a[0]: b[0], b[0]: a[0]}[c] for c in word)
    return word


def test_words_that_balance_polynomials_differ(spark):
    """The Thue-Morse word and its complement: equal under any polynomial modulo 2 ** 64 with an odd multiplier."""
    import numpy as np

    for a, b in ((b"a", b"b"), (b"x", b"7"), (b"0", b"1")):
        for n in (512, 1024, 2048, 8192):
            both = np.frombuffer(thue_morse(n, a, b) + thue_morse(n, b, a), np.uint8)
            for salt in (0, 1):
                x, y = ts.span_hash(both, np.array([0, n]), np.array([n, 2 * n]), salt)
                assert x != y
            assert len(set(ts.gram_hash(both, n)[[0, n]].tolist())) == 2
    one, other = thue_morse(1024, b"a", b"b").decode(), thue_morse(1024, b"b", b"a").decode()
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*words[:10], w, *words[10:]])) for i, w in enumerate((one, other))] + [(2, f"{one} a b c d"), (3, f"{other} a b c d")]
    cut = [tuple(r) for r in substring_dedup.dedup_substrings(table(spark, rows)).collect()]
    same(cut, [(i, *d) for (i, _), d in zip(rows, brute.substring_digest([t for _, t in rows]), strict=True)])
    assert {r.doc_id: r.component_id for r in near_dedup.dedup_near(table(spark, rows[2:])).collect()} == {2: 2, 3: 3}


def test_parts_agree(spark):
    import numpy as np

    ids = [0, 1, -5, 2**40, -(2**63), 2**63 - 1]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "uid long").select(F.xxhash64("uid")).collect()]
    assert ts.xxhash64_long(np.array(ids)).tolist() == got
    parted = corpus.in_parts(spark.createDataFrame([(i,) for i in ids], "uid long"), 32).collect()
    assert [r.part for r in parted] == corpus.part_of(np.array(ids), 32).tolist()


def test_substring_dedup(spark, rows):
    ordered = in_order(spark, rows)
    for window in (20, 5):
        got = [tuple(r) for r in substring_dedup.dedup_substrings(table(spark, rows), window=window).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
        same(got, [(i, *d) for (i, _), d in zip(ordered, brute.substring_digest([t for _, t in ordered], window), strict=True)])


def test_cut_repeats(spark, rows):
    ordered = in_order(spark, rows)
    docs = table(spark, rows)
    got = substring_dedup.cut_repeats(docs)
    assert got.columns == docs.columns
    want = [(i, b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()) for (i, _), (w, gone) in zip(ordered, brute.removed_words([t for _, t in ordered], 20), strict=True)]
    same([(r.doc_id, " ".join(r.text.encode().split() and [x.decode() for x in r.text.encode().split()])) for r in got.collect()], want)
    kept = {r.uid: r for r in docs.collect()}
    assert all(tuple(r)[2:] == tuple(kept[r.uid])[2:] for r in got.collect())


def test_suffix_dedup(spark, rows):
    ordered = rows
    for length in (200, 30, 37):
        got = [tuple(r) for r in suffix_dedup.dedup_suffixes(table(spark, ordered), length=length).collect()]
        same(got, [(i, *d) for (i, _), d in zip(ordered, brute.suffix_digest([t for _, t in ordered], length), strict=True)])
        spans = {}
        for r in suffix_dedup.repeat_spans(table(spark, ordered), length=length).collect():
            spans[r.doc_id] = spans.get(r.doc_id, 0) + r.length
        total = {}
        for i, _, removed, _, _ in got:
            total[i] = total.get(i, 0) + removed
        assert spans == {i: n for i, n in total.items() if n}


def test_suffix_dedup_of_a_long_text(spark):
    """A text of more bytes than a slice with a repeat in itself and one in another document."""
    rng = random.Random(8)
    long = prose(rng, 220_000)
    assert len(long.encode()) > ts.SLICE_BYTES
    rows = [(0, long + long[1000:1400] + "end"), (1, "head " + long[500_000:500_199]), (2, long[600_000:600_900]), (3, "x")]
    got = [tuple(r) for r in suffix_dedup.dedup_suffixes(table(spark, rows)).collect()]
    same(got, [(i, *d) for (i, _), d in zip(rows, brute.suffix_digest([t for _, t in rows], 200), strict=True)])


def test_one_string_in_many_surroundings(spark):
    """A 120-byte string in surroundings of its own in every text, and one of 170 bytes in texts that mostly differ otherwise."""
    rng = random.Random(9)
    say = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    line, more = say(120), say(170)
    ends = [say(60) for _ in range(7)]
    rows = [(i, say(150) + (line if i % 2 else more + rng.choice(ends)) + say(150)) for i in range(3000)]
    got = [tuple(r) for r in suffix_dedup.dedup_suffixes(table(spark, rows, False)).collect()]
    same(got, [(i, *d) for (i, _), d in zip(rows, brute.suffix_digest([t for _, t in rows], 200), strict=True)])
    assert sum(r[2] > 0 for r in got) > 1400


@pytest.mark.parametrize("class_bytes", [0, 900, 20_000])
def test_large_classes_are_split(spark, class_bytes):
    """Classes of any size give the same rows: lines in surroundings that are partly shared, on one side, on both or by a few bytes, and texts of one letter."""
    rng = random.Random(class_bytes)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    lines, sides = [say(n) for n in (120, 165, 196, 230)], [say(n) for n in (1, 3, 9, 25, 45, 80)]
    rows = [(0, "a" * 900), (1, "b" + "a" * 300), (2, "a" * 199 + "b")]
    for i in range(3, 300):
        left, right = (rng.choice(sides) for _ in range(2))
        rows.append((i, say(rng.choice([0, 2, 90])) + left + rng.choice(lines) + right + say(rng.choice([0, 2, 90]))))
    for length in (200, 61):
        want = [(i, *d) for (i, _), d in zip(rows, brute.suffix_digest([t for _, t in rows], length), strict=True)]
        got = [tuple(r) for r in suffix_dedup.dedup_suffixes(table(spark, rows, False), length=length, class_bytes=class_bytes).collect()]
        same(got, want)


def test_a_line_in_a_hundred_thousand_surroundings(spark):
    """No 200-byte string stands twice; in two texts of all the line has the same 60 bytes behind it."""
    line = prose(random.Random(3), 60).encode()[:170].decode("utf-8", "ignore")
    df = spark.range(100_000).withColumnRenamed("id", "doc_id")
    own = lambda salt: F.sha2(F.concat(F.lit(salt), F.when(F.col("doc_id").isin(5, 77_777), 5).otherwise(F.col("doc_id")).cast("string")), 256)
    df = df.withColumn("text", F.concat(F.sha2(F.col("doc_id").cast("string"), 256), F.lit(line), own("r")))
    got = suffix_dedup.dedup_suffixes(df).where("n_removed > 0").orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_removed, r.n_spans) for r in got] == [(i, len(line.encode()) + 64, 1) for i in (5, 77_777)]


@pytest.mark.parametrize("external", [False, True])
def test_collections(tmp_path, monkeypatch, external):
    """Repeated windows of random collections, their columns in pieces of a few suffixes, in memory or in files that are gone afterwards."""
    import numpy as np

    rng = random.Random(external)
    for _ in range(120):
        letters, length = rng.choice([b"a", b"ab", b"abc", bytes(range(97, 123))]), rng.choice([2, 3, 4, 6, 8, 12])
        base = bytes(rng.choice(letters) for _ in range(3 * length))
        strings, cores, sizes = [], [], []
        for _ in range(rng.randint(1, 12)):
            n = rng.randint(1, length)
            left, right = rng.randint(0, length - n), rng.randint(0, length - n)
            right = max(right, length - n - left)
            string = bytearray(base[length - left : length + n + right])
            for at in rng.sample(range(len(string)), rng.randint(0, 2)):
                string[at] = rng.choice(letters)
            strings.append(bytes(string))
            cores.append(left)
            sizes.append(n)
        monkeypatch.setattr(collection, "PIECE", rng.choice([1, 3, 7, 1 << 19]))
        monkeypatch.setattr(collection, "EXTERNAL", 0)
        got = collection.repeated_windows(strings, np.array(cores), np.array(sizes), length, str(tmp_path / "columns") if external else None)
        assert [x.tolist() for x in got] == brute.repeated_windows(strings, cores, sizes, length)
    assert not external or not list((tmp_path / "columns").iterdir())


def test_near_dedup(spark, rows):
    ordered = in_order(spark, rows)
    for percent in (85, 50):
        got = [tuple(r) for r in near_dedup.dedup_near(table(spark, rows), percent=percent).collect()]
        groups = brute.near_groups([t for _, t in ordered], percent)
        same(got, [(i, n, ordered[g][0], g == k) for k, ((i, _), (n, g)) in enumerate(zip(ordered, groups, strict=True))])
    docs = table(spark, rows)
    kept = near_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    groups = brute.near_groups([t for _, t in ordered], 80)
    same([(r.doc_id, r.text) for r in kept.collect()], [x for k, (x, (_, g)) in enumerate(zip(ordered, groups, strict=True)) if g == k])


def test_near_dedup_chains_and_groups(spark):
    """Chains whose ends are far apart, and a group of edits of one text, found by the leader's and by the other pairs."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts, chain = [], list(base)
    for step in range(25):
        chain[step * 4] = f"c{step}"
        texts.append(" ".join(chain))
    for k in range(60):
        own = list(base)
        for at in rng.sample(range(120), rng.randint(1, 4)):
            own[at] = f"e{k}{at}"
        texts.append(" ".join(own))
    rows = list(enumerate(texts))
    for percent in (85, 80):
        got = {r.doc_id: r.component_id for r in near_dedup.dedup_near(table(spark, rows, False), percent=percent).collect()}
        assert got == {i: g for i, (_, g) in enumerate(brute.near_groups(texts, percent))}


def test_blocks_of_a_bucket(spark, monkeypatch):
    """The same result if buckets are cut into very small blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 400)
    test_near_dedup_chains_and_groups(spark)


def test_bands_follow_the_threshold(spark):
    for percent in (1, 5, 20, 50, 80, 85, 100):
        rows, bands = near_dedup.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= near_dedup.LOST
    pairs = []
    for k in range(100):  # exactly 64 of 128 shingles shared, no word in common with other pairs
        words = [f"{k}w{i}" for i in range(100)]
        pairs += [" ".join(words), " ".join([*words[:68], *(f"{k}x{i}" for i in range(32))])]
    a, b = brute.shingles(pairs[0]), brute.shingles(pairs[1])
    assert len(a & b) * 2 == len(a | b)
    got = {r.doc_id: r.component_id for r in near_dedup.dedup_near(table(spark, list(enumerate(pairs)), False), percent=50).collect()}
    assert all(got[i] == i - i % 2 for i in range(200))


def test_bayes_bound():
    n = 96
    assert near_dedup.least_matches(n, 85, 1e-9) < 0.75 * n < near_dedup.least_matches(n, 85, 0.01)
    assert near_dedup.least_matches(16, 85, 1e-9) <= 6


def test_token_counts(spark, rows):
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    odd = [*rows, (100, "a  b   c " * 9000 + " "), (101, "▁ a" * 20000), (102, "<s> x </s>"), (103, "  b\n\n c" * 8000)]
    got = [tuple(r) for r in tokens.count_tokens(table(spark, odd), public.path("piece_bpe_32k.model")).collect()]
    want = [(i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t in odd]
    same(got, want)


def test_token_counts_of_a_json_model(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rows = corpus_rows(n=20)
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(table(spark, rows), public.path("byte_bpe_50k.json")).collect()}
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in rows}


def test_licences(spark, rows):
    more = [(200, "The MIT License, the mit-license; Apache License. GNU General  Public\nLicense!"), (201, "CC BY-NC cc by cc  by"), (202, "permit license"), (203, "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */"), (204, "MIT Licensé")]
    odd = [*rows, *more]
    got = {}
    for r in licences.scan_licences(table(spark, odd)).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    want = {}
    for i, t in odd:
        want.setdefault(i, []).append(brute.licence_scan(t))
    assert {i: sorted(map(repr, x)) for i, x in got.items()} == {i: sorted(map(repr, x)) for i, x in want.items()}
    tagged = licences.scan_licences(table(spark, [more[3]])).first()
    assert tagged.labels == "apache-2.0,gpl-2.0-only with classpath-exception-2.0,mit" and tagged.score > 0.9


def test_licence_expressions(spark):
    p = licences.parse_expression
    assert p("MIT") == ({"mit"}, True) and p("A AND (b OR C)") == ({"a", "b", "c"}, False)
    assert p("GPL-2.0+ WITH x AND mit") == ({"gpl-2.0+ with x", "mit"}, False)
    assert p("") is None and p("and") is None and p("(MIT") is None and p("MIT */ done") == ({"mit"}, True)
    # a choice goes to the free side; a demand does not
    assert p("GPL-2.0 OR MIT") == ({"mit"}, True) and p("GPL-2.0 AND MIT") == ({"gpl-2.0", "mit"}, False)
    assert p("GPL-2.0 OR MIT AND agpl-3.0") == ({"gpl-2.0", "mit", "agpl-3.0"}, False) and p("(GPL-2.0 OR MIT) AND ISC") == ({"mit", "isc"}, True)
    assert p("MIT OR ISC") == ({"mit", "isc"}, True)
    # the longest well-formed beginning
    for text, beginning in {"MIT OR": "MIT", "MIT or (": "MIT", "(MIT OR Apache-2.0) and": "(MIT OR Apache-2.0)", "MIT AND (ISC OR": "MIT", "MIT) AND ISC": "MIT", "(a OR b) with c": "(a OR b)", "a with b with c": "a with b", "a OR OR b": "a", "MIT with (b)": "MIT", "MIT with": "MIT"}.items():
        assert p(text) == p(beginning) is not None
    assert p("MIT and all other parts") == ({"mit"}, True) == p("MIT or (at your choice)") and p("GPL-2.0-only and MIT") == ({"gpl-2.0-only", "mit"}, False)
    many = " OR ".join(f"(L{i} with e{i})" for i in range(4000))
    labels, free = p(many)
    assert len(labels) == 4000 and not free and p("(" * 5000 + "MIT" + ")" * 5000) == ({"mit"}, True)
    texts = ["x SPDX-License-Identifier: GPL-2.0 OR MIT\nAND gpl", "# spdx-license-identifier:ISC\r\n//SPDX License Identifier : AGPL-3.0 */", "SPDX-License-Identifier MIT", "notspdx-license-identifier: MIT", "é SPDX-License-Identifier: MIT " + many]
    got = licences.scan_licences(table(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [(r.labels, r.free) for r in got[:4]] == [("mit", True), ("agpl-3.0,isc", False), ("", None), ("", None)]
    assert got[0].score == 0.9 and got[1].score == pytest.approx(0.98) and got[4].labels == "mit"


def test_decontamination(spark):
    rng = random.Random(4)
    vocabulary = [f"{rng.choice(WORDS)}{rng.randrange(500)}" for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, say(30)) for k in range(8)] + [(50, None), (51, ""), (52, "short"), (53, None)]
    items += [(60, items[0][1])]
    docs = []
    for k in range(40):
        text = say(rng.choice([5, 50, 200]))
        item = items[k % 8][1]
        if k % 2:
            edits = list(item.upper() if k % 3 else item)
            for _ in range(rng.choice([0, 3, 10, 17, 30, 60])):
                at = rng.randrange(len(edits))
                edits[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "zz"])
            text = text + " \n" + "".join(edits) + " " + say(5)
        docs.append((k, text))
    docs += [(None, None), (None, items[0][1]), (41, ""), (42, items[1][1]), (42, items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t in docs:
        for k, x in items:
            x, t2 = decontaminate.normalised(x), decontaminate.normalised(t)
            if len(x) >= decontaminate.LEAST_ITEM:
                budget = decontaminate.edit_budget(len(x))
                edits = brute.least_edits(x, t2)
                if edits <= budget:
                    want.append((i, k, edits, budget))
    assert len(want) >= 10
    got = decontaminate.find_leaks(table(spark, docs), bench)
    same([tuple(r) for r in got.collect()], want)
    clean = decontaminate.drop_leaks(table(spark, docs), bench)
    leaked = {x[0] for x in want}
    same([r.doc_id for r in clean.collect()], [i for i, t in docs if (i, t) not in [(j, s) for j, s in docs if j in leaked and (j is not None or s)]])
    none = bench.limit(0)
    assert decontaminate.find_leaks(table(spark, docs), none).count() == 0 and decontaminate.drop_leaks(table(spark, docs), none).count() == len(docs)


def test_short_items(spark):
    """Items under 32 bytes: whole words without edits, one edit from 22 bytes on; beside long items and in texts over one block."""
    exact, one = "what is 6 times 7?", "name the capital of peru"
    items = [(0, exact), (1, one), (2, "a"), (3, "größe"), (4, "größe "), (5, None), (6, " \n"), (7, "(ii)"), (8, "日本"), (9, "is 6"), (10, "which river flows through the town of " + one)]
    say = "xx " * 400_000
    docs = [(0, "So: What  is\n6 times 7? No."), (1, "what is 6 times 77?"), (2, "name the capitol of Peru."), (3, "name thecapital of per u"), (4, "cat"), (5, "A"), (6, "x-a."), (7, "größere Größe, größe"), (8, "größer"), (9, "z(II)z"), (10, "この日本語"), (11, None), (12, ""), (13, say + exact), (14, say[:-1]), (15, "what"), (16, "is 6"), (17, "a" * 50), (18, "xname the capital of perux")]
    docs += [(19, "x" * ((1 << 20) - 2) + exact), (20, "x" * ((1 << 20) - 9) + " " + exact + " y")]
    want = []
    for i, t in docs:
        t = decontaminate.normalised(t)
        for k, x in items:
            x = decontaminate.normalised(x)
            budget = decontaminate.edit_budget(len(x))
            if x and (budget and len(t) < 1000 and (e := brute.least_edits(x, t)) <= budget):
                want.append((i, k, e, budget))
            elif x and not budget and re.search(rb"(?<![0-9a-z])" * x[:1].isalnum() + re.escape(x) + rb"(?![0-9a-z])" * x[-1:].isalnum(), t):
                want.append((i, k, 0, 0))
    assert {(0, 0), (2, 1), (5, 2), (7, 3), (7, 4), (9, 7), (10, 8), (13, 0), (18, 1), (20, 0)} <= {x[:2] for x in want} and not {1, 4, 8, 17, 19} & {x[0] for x in want if x[1] not in (9,)}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_leaks(table(spark, docs), bench)
    same([tuple(r) for r in got.collect()], want)
    same([r.doc_id for r in decontaminate.drop_leaks(table(spark, docs), bench).collect()], [i for i, _ in docs if i not in {x[0] for x in want}])


def test_budgets_and_kinds_of_ids(spark):
    budget = decontaminate.edit_budget
    assert [budget(n) for n in (1, 21, 22, 25, 32, 43, 100, 1000)] == [0, 0, 1, 2, 2, 3, 8, 80]
    docs = table(spark, [(0, "so it is said: the quick brown fox jumps over the lazy dog again"), (None, None), (1, "")])
    for kind, value in (("date", "date'2020-01-01'"), ("decimal(3,2)", "1.50bd"), ("smallint", "7s")):
        items = spark.sql(f"SELECT {value} AS item_id, 'The quick brown fax jumps ovr the lazy dog' AS text, 'x' AS uid, 1 AS doc_id")
        got = decontaminate.find_leaks(docs, items)
        assert dict(got.dtypes)["item_id"] == kind and [(r.doc_id, r.edits, r.budget) for r in got.collect()] == [(0, 2, 3)]
        assert decontaminate.drop_leaks(docs, items).count() == 2
    assert decontaminate.find_leaks(docs.limit(0), items).count() == decontaminate.drop_leaks(docs.limit(0), items).count() == 0


def test_passes_over_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 10)
    test_decontamination(spark)


def test_mixing(spark):
    rng = random.Random(9)
    rows = [(k, prose(rng, rng.randint(0, 40)) if k % 11 else None) for k in range(3000)] + [(None, "a b"), (5, "x"), (5, "x")]
    docs = table(spark, rows)
    got = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(7)).collect()
    same(map(tuple, got), map(tuple, again))
    assert len(got) == len(rows)
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        by.setdefault((r.source_size, r.target), []).append(r)
    assert sum(t for _, t in by) == pytest.approx(1.5 * total)
    for (size, target), group in by.items():
        assert target <= 2 * size + 1e-9 and abs(sum(r.taken for r in group) - target) <= 2 * max(r.size for r in group)
    taken = mixing.mix_rows(docs)
    assert taken.columns == [*docs.columns, "mix_copies"]
    assert sum(r.mix_copies * len(r.text.encode().split()) for r in taken.collect()) == sum(r.taken for r in got)


def test_mixing_of_rows_without_ids(spark):
    """Rows that share an id, or have none, are told apart by their texts."""
    rng = random.Random(2)
    rows = [(None if k % 2 else 5, prose(rng, rng.randint(1, 9)) + f" {k}", f"s{k % 3}") for k in range(900)]
    groups = {}
    for r in mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        groups.setdefault((r.source_size, r.target), []).append(r)
    assert len(groups) == 3
    for (_, target), group in groups.items():
        assert abs(sum(r.taken for r in group) - target) <= 2 * max(r.size for r in group)


def test_mixing_matches_sql(spark):
    import duckdb
    import pandas as pd

    rows = [(k, "w " * (k % 37), [None, "a", "b", "Z", "é"][k % 5] if k % 3 else "big") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    c = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "source"])  # noqa: F841
    c.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text, source FROM frame")
    same([tuple(r) for r in mixing.mix_sources(docs).collect()], c.execute(mixing.MIX_SQL).fetchall())


def test_empty_tables(spark):
    docs = table(spark, corpus_rows(n=12)).limit(0)
    assert substring_dedup.dedup_substrings(docs).count() == suffix_dedup.dedup_suffixes(docs).count() == near_dedup.dedup_near(docs).count() == 0
    assert licences.scan_licences(docs).count() == mixing.mix_sources(docs).count() == quality.classify(docs).count() == 0
    if public := pytest.importorskip("public_tokenizers"):
        assert tokens.count_tokens(docs, public.path("piece_bpe_32k.model")).count() == 0
    for f in (substring_dedup.cut_repeats, near_dedup.keep_one_of_each, quality.keep_good, mixing.mix_rows):
        assert f(docs).count() == 0
