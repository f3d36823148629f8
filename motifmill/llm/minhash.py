"""Word-shingle sets and their MinHash signatures."""

from __future__ import annotations

import hashlib

import numpy as np

from motifmill.llm import textscan as ts

U64 = np.uint64
#: A-Z to a-z, other bytes as they are.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts in small letters (A-Z), each run of white space one blank: equal bytes are equal words."""
    return ts.squeezed(data, offsets, FOLD)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sketches: hashes of each text's k-word shingles, distinct and ascending within a text, their offsets, and how many different shingles a text has. data: as ``folded``.

    A text of fewer words has its whole sequence as its only shingle; a text without
    words has none. The hashes are quick and can be made to collide, so shingles of
    one text that share a hash are compared byte by byte before they are counted once.
    """
    starts, ends, first = ts.words(data, offsets)
    words = ts.span_hash(data, starts, ends)
    counts = np.diff(first)
    ok = ts.window_ok(first, k)
    h, place = ts.window_hash(words, k)[ok], np.flatnonzero(ok)
    doc = np.repeat(np.arange(len(counts)), counts)[: len(ok)][ok]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = np.array([ts.window_hash(words[first[i] : first[i + 1]], int(counts[i]))[0] ^ U64(counts[i]) for i in short], U64)
        h, doc, place = np.concatenate([h, whole]), np.concatenate([doc, short]), np.concatenate([place, np.full(len(short), -1)])
    order = np.lexsort((h, doc))
    h, doc, place = h[order], doc[order], place[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.searchsorted(doc[new], np.arange(len(counts) + 1))
    size = np.diff(at)
    again = np.flatnonzero(~new)
    if len(again):
        raw = data.tobytes()
        shingle = lambda i: raw[starts[place[i]] : ends[place[i] + k - 1]]
        head = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))[again]
        more: dict[int, set[bytes]] = {}
        for i, j in zip(again.tolist(), head.tolist(), strict=True):
            if (x := shingle(i)) != shingle(j):
                more.setdefault(j, set()).add(x)
        for j, others in more.items():
            size[doc[j]] += len(others)
    return h[new], at, size


def exact_sets(data: np.ndarray, offsets: np.ndarray, k: int, key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Each text's k-word shingles as BLAKE2b digests of their words under a secret key, distinct and ascending within a text, and their offsets. data: as ``folded``."""
    starts, ends, first = ts.words(data, offsets)
    counts = np.diff(first)
    n = np.where(counts > 0, np.maximum(counts - k + 1, 1), 0)
    doc = np.repeat(np.arange(len(n)), n)
    word = np.repeat(first[:-1] - (np.cumsum(n) - n), n) + np.arange(len(doc))
    begin, end = starts[word], ends[np.minimum(word + k, first[1:][doc]) - 1]
    raw, h = data.tobytes(), np.empty(len(doc), U64)
    for lo in range(0, len(doc), 1 << 16):
        part = [hashlib.blake2b(raw[a:b], digest_size=8, key=key).digest() for a, b in zip(begin[lo : lo + (1 << 16)].tolist(), end[lo : lo + (1 << 16)].tolist(), strict=True)]
        h[lo : lo + len(part)] = np.frombuffer(b"".join(part), U64)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(counts) + 1))


_coefficients: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def signature(h: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values (32 bits each) of one set, by multiply-add-shift hashing of the set's hashes."""
    if n not in _coefficients:
        raw = ts.mix(np.arange(1, 2 * n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
        _coefficients[n] = (raw[:n] | U64(1), raw[n:])
    a, b = _coefficients[n]
    out = np.full(n, 2**64 - 1, U64)
    for lo in range(0, len(h), 4096):
        part = h[lo : lo + 4096]
        np.minimum(out, (part[None, :] * a[:, None] + b[:, None]).min(axis=1), out=out)
    return (out >> U64(32)).astype(np.uint32)
