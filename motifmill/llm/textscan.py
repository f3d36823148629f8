"""Whole Arrow text columns as byte buffers, scanned with numpy.

Nothing here loops over characters or words in Python, and nothing looks at a
prefix only: a slice holds whole texts, and a text longer than a slice is a slice
of its own whose hashes are computed block by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 20

#: ASCII white space: blank and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, row behind the last, bytes, offsets) of whole texts; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of the words, and for each text the index of its first word (one more entry at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = sep[data]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = gap[:-1]
    cut = offsets[:-1]
    before[cut[cut < n]] = True
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = gap[1:]
    cut = offsets[1:] - 1
    after[cut[cut >= 0]] = True
    np.logical_not(gap, out=gap)
    starts = np.flatnonzero(gap & before)
    ends = np.flatnonzero(gap & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values in place (a splitmix finaliser)."""
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


#: Odd multipliers of the two sides of ``pair`` and of a lane, by salt.
_LEFT, _RIGHT = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
_LANE = (U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F))
_SALT = (U64(0x2D358DCCAA6C78A5), U64(0x8BB84B93962EACC9))
#: Bytes from which a span is hashed by BLAKE2 on its own: the lanes of all spans go in step.
_LONG = 4096


def lanes(data: np.ndarray) -> np.ndarray:
    """The 64-bit values that begin at every byte, zeros behind the end; a view on a copy of ``data``."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))


def _low(size: np.ndarray) -> np.ndarray:
    """Masks of the low ``size`` bytes of a lane, size from 1 to 8."""
    return U64(2**64 - 1) >> ((8 - size).astype(U64) << U64(3))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hash of data[start:end], in time linear in the spans' bytes.

    Eight bytes a step are multiplied and folded into the state, which mixes it
    between steps, so that ordinary texts do not meet. Each step can be undone, so texts
    can be made to collide: for sketches and for finding candidates, not for equality.
    """
    size = np.asarray(ends, np.int64) - starts
    h = mix(size.astype(U64) * _LANE[salt] + _SALT[salt])
    if not len(size):
        return h
    view = lanes(data)
    long = np.flatnonzero(size > _LONG)
    for i in long.tolist():
        raw = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=bytes([salt])).digest()
        h[i] ^= np.frombuffer(raw, "<u8")[0]
    live = np.flatnonzero((size > 0) & (size <= _LONG))
    at, left, state = np.asarray(starts, np.int64)[live], size[live], h[live]
    while len(live):
        lane = view[at] & _low(np.minimum(left, 8))
        state ^= lane
        state *= _LANE[salt]
        state ^= state >> U64(32)
        state *= _LEFT
        state ^= state >> U64(29)
        more = left > 8
        if not more.all():
            h[live[~more]] = state[~more]
            live, at, left, state = live[more], at[more], left[more], state[more]
        at, left = at + 8, left - 8
    return mix(h)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in this order."""
    h = a * _LEFT
    h += (b ^ (b >> U64(31))) * _RIGHT
    h ^= h >> U64(29)
    return h


def window_hash(items: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of k consecutive items (64-bit values), from runs of 1, 2, 4, ...; the last two may overlap."""
    n = len(items) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    have, h = 1, items ^ _SALT[salt]
    while 2 * have <= k:
        h = pair(h[:-have], h[have:])
        have *= 2
    return mix(pair(h[:n], h[k - have : k - have + n]))


def window_ok(first: np.ndarray, k: int) -> np.ndarray:
    """For each run of k words in a slice: does it lie in one text? first: as from words()."""
    n = int(first[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    last = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(n) + k <= last


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray, first: np.ndarray, sep: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Kept words of each text joined by one separator: bytes and offsets."""
    size = np.where(keep, ends - starts + 1, 0)
    put = np.concatenate(([0], np.cumsum(size)))
    out = np.full(int(put[-1]), sep, np.uint8)
    s, e, at = starts[keep], ends[keep], put[:-1][keep]
    take = np.repeat(s - np.concatenate(([0], np.cumsum(e - s)[:-1])), e - s) + np.arange(int((e - s).sum())) if len(s) else np.zeros(0, np.int64)
    to = np.repeat(at - np.concatenate(([0], np.cumsum(e - s)[:-1])), e - s) + np.arange(int((e - s).sum())) if len(s) else take
    out[to] = data[take]
    begin = put[first[:-1]]
    end = put[first[1:]]
    return out, np.stack([begin, np.maximum(begin, end - 1)], 1)


def xxhash64_long(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's xxhash64 of a bigint, so that Python and the JVM deal rows alike."""
    p1, p2, p3, p4, p5 = (U64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, r: (v << U64(r)) | (v >> U64(64 - r))
    h = np.full(len(x), U64(seed) + p5 + U64(8), U64)
    h ^= turn(x.astype(np.int64).view(U64) * p2, 31) * p1
    h = turn(h, 27) * p1 + p4
    h ^= h >> U64(33)
    h *= p2
    h ^= h >> U64(29)
    h *= p3
    h ^= h >> U64(32)
    return h.view(np.int64)


_GRAM_BLOCK = 1 << 17


def gram_hash(data: np.ndarray, q: int) -> np.ndarray:
    """64-bit hash of every run of q bytes, block by block with the blocks overlapping by q - 1; from runs of 8, 16, 32, ..., the last two may overlap."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, U64)
    size, out = max(_GRAM_BLOCK, 4 * q), np.empty(n, U64)
    for b in range(0, n, size):
        part = data[b : min(b + size, n) + q - 1]
        own = len(part) - q + 1
        if q <= 8:
            out[b : b + own] = mix(lanes(part)[:own] & _low(np.int64(q)))
            continue
        have, h = 8, mix(lanes(part)[: len(part) - 7].copy())
        while 2 * have <= q:
            h = pair(h[:-have], h[have:])
            have *= 2
        out[b : b + own] = pair(h[:own], h[q - have : q - have + own])
    return out


def squeezed(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Texts with each run of ASCII white space as one blank and none in front; bytes mapped by ``fold``."""
    if not len(data):
        return data, offsets
    gap = SPACE[data]
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = gap[:-1]
    cut = offsets[:-1]
    before[cut[cut < len(data)]] = True
    keep = ~(gap & before)
    put = np.concatenate(([0], np.cumsum(keep)))
    data = np.where(gap, np.uint8(32), data if fold is None else fold[data])
    return data[keep], put[offsets]
