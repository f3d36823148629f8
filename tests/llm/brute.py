"""Plain versions of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

FOLD = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def removed_words(texts, window):
    """Per text, in order: flags of the words that a window starting earlier elsewhere covers."""
    seen, out = set(), []
    for t in texts:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                gone[s : s + window] = [True] * window
            seen.add(k)
        out.append((w, gone))
    return out


def substring_digest(texts, window=20):
    return [(len(w), sum(g), hashlib.sha256(b" ".join(x for x, gone in zip(w, g, strict=True) if not gone)).hexdigest()) for w, g in removed_words(texts, window)]


def suffix_digest(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = [False] * len(x)
        for i in range(len(x) - length + 1):
            if count[x[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        out.append((len(x), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return out


def shingles(text, k=5):
    w = (text or "").encode().translate(FOLD).split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_groups(texts, percent):
    """(set size, number of the first text of the group) of every text."""
    sets, of = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                of[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def least_edits(item, text):
    """Edits between item and the best substring of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != t)))
        row = new
    return min(row)


def licence_scan(text):
    """n_words, n_base, first_word, last_word and the base labels."""
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for i in range(len(w)) for p, label in phrases.items() if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def repeated_windows(strings, cores, sizes, length):
    """Places whose window holds the core and stands as far before an equal core in another string."""
    at = Counter()
    windows = [[(i, (c - i, n, x[i : i + length])) for i in range(max(0, c + n - length), min(c, len(x) - length) + 1)] for x, c, n in zip(strings, cores, sizes, strict=True)]
    for w in windows:
        at.update(k for _, k in w)
    return [[i for i, k in w if at[k] > 1] for w in windows]


def least_edits_of_all(items, text):
    """least_edits of every item, all items' columns of the matrix at once, byte by byte of the text."""
    size = max(map(len, items))
    wanted = np.array([list(x) + [-1] * (size - len(x)) for x in items])
    index = np.arange(size + 1)
    column = np.tile(index, (len(items), 1))
    ends = (np.arange(len(items)), [len(x) for x in items])
    best = column[ends].copy()
    for c in text:
        new = np.zeros_like(column)
        new[:, 1:] = np.minimum(column[:, :-1] + (wanted != c), column[:, 1:] + 1)
        column = np.minimum.accumulate(new - index, axis=1) + index
        best = np.minimum(best, column[ends])
    return best.tolist()


ABUSE = set("bastard bitch clown disgusting dumb fool idiot idiots imbecile jerk loser losers moron morons pathetic scum stupid trash ugly worthless".split())
PUNCTUATION = set(map(ord, "!\"'(),-./:;?"))
SYMBOLS = set(map(ord, "#$%&*+<=>@[\\]^_`{|}~"))


def bare(word):
    """A lower-cased word without the punctuation mark at either end."""
    last = len(word) - (word[-1] in PUNCTUATION)
    begin = int(word[0] in PUNCTUATION and last > 1)
    return word[begin : max(last, begin)].translate(FOLD)


def fronts(word):
    return {("word", word), ("front", word[:5]) if len(word) > 5 else ("word", word)}


def lexicon(texts, marks, least=8, ratio=400):
    """Words and fronts that stand in ``least`` marked texts and 1 / ``ratio`` as often in others."""
    seen = {True: Counter(), False: Counter()}
    many = Counter()
    for t, mark in zip(texts, marks, strict=True):
        many[mark] += 1
        seen[mark].update({x for w in (t or "").encode().split() for x in fronts(bare(w))})
    return {x for x, n in seen[True].items() if n >= least and n * many[False] >= ratio * seen[False][x] * many[True]}


def votes(text, known):
    """Bad (0), none (1) or good (2) of every labeller."""
    raw = (text or "").encode()
    w = raw.split()
    n, seen = max(len(w), 1), [c for c in raw if c not in b" \t\n\v\f\r"]
    letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    plain = lambda c: letter(c) or 48 <= c <= 57
    low = [x.translate(FOLD) for x in w]
    again = sum(a == b for a, b in zip(low, low[1:], strict=False))
    run = longest = 0
    for k, x in enumerate(low):
        run = run + 1 if k and low[k - 1] == x else 1
        longest = max(longest, run)
    abuse = sum(bare(x) in {a.encode() for a in ABUSE} for x in w)
    learnt = sum(bool(fronts(bare(x)) & known) for x in w)
    visible = max(len(seen), 1)
    looks = [
        (1 - sum(map(plain, seen)) / visible, 0.15, 0.08, 20),
        (sum(not any(map(plain, x)) for x in w) / n, 0.08, 0.02, 5),
        (sum(c in SYMBOLS for c in seen) / visible, 0.02, 0.004, 5),
        (sum(65 <= c <= 90 for c in seen) / max(sum(map(letter, seen)), 1), 0.3, 0.12, 20),
        (raw.count(b"!") / n, 0.25, 0.05, 5),
        (again / n, 0.15, 0.05, 20),
        (longest, 5, 4, 20),
        (max(Counter(low).values(), default=0) / n, 0.25, 0.15, 20),
        (abuse, 1, 1, 0),
        (abuse / n, 0.004, 0.001, 0),
        (learnt, 1, 1, 0 if known else 10**9),
        (learnt / n, 0.004, 0.001, 0 if known else 10**9),
    ]
    return tuple(1 if len(w) < least else 0 if x >= bad else 2 if x < good else 1 for x, bad, good, least in looks)


def label_model(rows, rounds=500):
    """Posterior of good for every row of votes, by expectation-maximisation row by row."""
    prior = ((0.01, 10.0), (1.0, 1.0), (1.0, 1.0))
    belief = [[0.1, 0.1, 0.8] if 0 in v[8:] else [0.1, 0.9, 0.001] if 0 in v else [0.9, 0.1, 0.001] for v in rows]
    for _ in range(rounds):
        share = [(sum(b[k] for b in belief) + 1) / (len(rows) + 3) for k in range(3)]
        rate = [[(sum(b[k] for b, v in zip(belief, rows, strict=True) if v[j] == 0) + yes) / (sum(b[k] for b, v in zip(belief, rows, strict=True) if v[j] != 1) + yes + no) for j in range(12)] for k, (yes, no) in enumerate(prior)]
        new = []
        for v in rows:
            like = [share[k] * np.prod([1 if x == 1 else rate[k][j] if x == 0 else 1 - rate[k][j] for j, x in enumerate(v)]) for k in range(3)]
            new.append([x / sum(like) for x in like])
        moved = max(abs(x - y) for a, b in zip(belief, new, strict=True) for x, y in zip(a, b, strict=True))
        belief = new
        if moved < 1e-9:
            break
    return [b[0] for b in belief]


def fingerprint(text, k=4):
    """64 bits, each set where over half of the k-word shingles' hashes have it."""
    w = (text or "").encode().translate(FOLD).split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << p for p in range(64) if 2 * sum(h >> p & 1 for h in hashes) > len(hashes))


def linked(fingerprints, radius):
    """The first place that can be reached from every place over links of at most ``radius`` bits."""
    of = list(range(len(fingerprints)))
    for i, x in enumerate(fingerprints):
        for j, y in enumerate(fingerprints[:i]):
            if (x ^ y).bit_count() <= radius:
                a, b = of[i], of[j]
                of = [min(a, b) if c == max(a, b) else c for c in of]
    return of


def hard_negatives(rows, positives=5, negatives=10):
    """anchor, positive, rank, negative and both scores. rows: id, vector, label."""
    some = [(k, i, np.floor(256 * np.array(v, float)).astype(np.int64), (y + 1) % 10 if i % 7 == 0 else y) for k, (i, v, y) in enumerate(rows) if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for k, i, x, label in some:
        if i % 100:
            continue
        dot = lambda z: int(sum(int(a) * int(b) for a, b in zip(x, z, strict=False)))  # noqa: E731, B023
        scored = sorted(((-dot(z), j, y == label) for m, j, z, y in some if m != k))  # noqa: B023
        for ps, p, _ in [s for s in scored if s[2]][:positives]:
            inside = [s for s in scored if not s[2] and 30 * -ps <= 100 * -s[0] <= 90 * -ps][:negatives]
            out += [(i, p, r, j, -ps, -s) for r, (s, j, _) in enumerate(inside, 1)]
    return sorted(out)


def rebuilt(turns):
    """id -> list of (role, text): the first h turns of c - c % 100, then the own ones behind the first h."""
    own = {}
    for c, t, role, text in turns:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()[:16] + len(text or "").to_bytes(4, "big"), (role or "", text or "")))
    own = {c: [x[-1] for x in sorted(v, key=lambda x: x[:3])] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + v[h:]
    return out


def trie(convs):
    """Rows of all nodes of id -> list of (role, text)."""
    members = {}
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members.setdefault(tuple(convs[c][:d]), []).append(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in members)]
        ends = ",".join(str(c) for c in m if len(convs[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)
