"""SimHash near-dedup with bit-sliced comparison.

1. Fingerprints: one scan hashes every document's word shingles and sets each of 64
   bits that more than half of the hashes have. Equal fingerprints are one class.
2. Candidates: the bits are cut into radius + 2 blocks. Two fingerprints within the
   radius differ in at most ``radius`` blocks, so at least two blocks agree; every
   fingerprint is entered once for each pair of blocks. Entries without company
   go. Entries that have more than BLOCK members are compared block against block.
3. Comparison: the fingerprints of a task lie as vertical bit planes, 64 of them in
   a word. A fingerprint meets a word's 64 neighbours at once: each plane's
   differences are added to carry-save counters by a few bitwise operations, and a
   word is abandoned as soon as all its neighbours are beyond the radius. A word whose
   members are connected with the asking one already is not compared. Only links
   that join components leave a task, never all pairs of a group.
4. Components by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifmill.llm import corpus as co
from motifmill.llm import minhash as mh
from motifmill.llm import textscan as ts
from motifmill.llm.components import components
from motifmill.plans.storage import discard, materialize

U64 = np.uint64
BITS = 64
ONES = U64(2**64 - 1)
#: Fingerprints of one key that are compared in one task; more go block against block.
BLOCK = 8192
#: Rows that a task gathers before it compares, and word comparisons that go in step.
GATHER, STEP = 1 << 16, 1 << 15
#: Planes between two looks at which words can be abandoned.
LOOK = 8
#: Shingles from which on a hash is taken one by one: those of all others go in step.
_LONG = 2048
_P1, _P2, _P3, _P4, _P5 = (U64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: The eight bits of a byte, one in each byte of a word.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(U64).ravel()


def _turn(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[start:end] for all spans in step, eight bytes at a time."""
    size = ends - starts
    seeds = U64(seed)
    with np.errstate(over="ignore"):
        v = [seeds + _P1 + _P2, seeds + _P2, seeds, seeds - _P1]
        begin = seeds + _P5
    view = ts.lanes(data)
    h = np.full(len(size), begin, U64)
    done = np.zeros(len(size), np.int64)
    wide = np.flatnonzero((size >= 32) & (size < _LONG))
    if len(wide):
        acc = [np.full(len(wide), x, U64) for x in v]
        live, stripes = np.arange(len(wide)), size[wide] // 32
        for s in range(int(stripes.max())):
            live = live[stripes[live] > s]
            at = starts[wide[live]] + 32 * s
            for k in range(4):
                acc[k][live] = _turn(acc[k][live] + view[at + 8 * k] * _P2, 31) * _P1
        merged = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
        for k in range(4):
            merged = (merged ^ (_turn(acc[k] * _P2, 31) * _P1)) * _P1 + _P4
        h[wide], done[wide] = merged, 32 * stripes
    h += size.astype(U64)
    for _ in range(3):
        live = np.flatnonzero((size - done >= 8) & (size < _LONG))
        h[live] = _turn(h[live] ^ (_turn(view[starts[live] + done[live]] * _P2, 31) * _P1), 27) * _P1 + _P4
        done[live] += 8
    live = np.flatnonzero((size - done >= 4) & (size < _LONG))
    h[live] = _turn(h[live] ^ ((view[starts[live] + done[live]] & U64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    done[live] += 4
    for _ in range(3):
        live = np.flatnonzero((size - done >= 1) & (size < _LONG))
        h[live] = _turn(h[live] ^ (data[starts[live] + done[live]].astype(U64) * _P5), 11) * _P1
        done[live] += 1
    h ^= h >> U64(33)
    h *= _P2
    h ^= h >> U64(29)
    h *= _P3
    h ^= h >> U64(32)
    for i in np.flatnonzero(size >= _LONG):
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return h


def fingerprints(data: np.ndarray, offsets: np.ndarray, words: int) -> np.ndarray:
    """64-bit fingerprint of every text of a slice; 0 without words."""
    data, offsets = ts.squeezed(data, offsets, mh.FOLD)
    starts, ends, first = ts.words(data, offsets)
    counts = np.diff(first)
    n = np.where(counts > 0, np.maximum(counts - words + 1, 1), 0)
    doc = np.repeat(np.arange(len(n)), n)
    begin = np.cumsum(n) - n
    word = np.repeat(first[:-1] - begin, n) + np.arange(len(doc))  # the shingle's first word
    last = np.minimum(word + words, first[1:][doc]) - 1
    set_ = np.zeros((len(n), BITS), np.int64)
    for lo in range(0, len(doc), GATHER):
        hi = min(lo + GATHER, len(doc))
        h = xxh64(data, starts[word[lo:hi]], ends[last[lo:hi]])
        # a byte of a word counts to 255: runs of one text and at most 255 shingles
        head = np.zeros(hi - lo, bool)
        head[0] = True
        head[1:] = doc[lo + 1 : hi] != doc[lo : hi - 1]
        head |= (np.arange(lo, hi) - begin[doc[lo:hi]]) % 255 == 0
        head = np.flatnonzero(head)
        sums = np.add.reduceat(_SPREAD[h.view(np.uint8).reshape(-1, 8)], head, axis=0)
        np.add.at(set_, doc[lo + head], sums.view(np.uint8).reshape(len(head), BITS))
    bits = (2 * set_ > n[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(U64).ravel()


def planes(fp: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints: row p holds bit p of each, 64 of them in a word."""
    padded = np.zeros(-(-len(fp) // 64) * 64, U64)
    padded[: len(fp)] = fp
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(U64)


def beyond(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter is above the radius."""
    more, same = over.copy(), ~over
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            same &= counters[k]
        else:
            more |= same & counters[k]
            same &= ~counters[k]
    return more


def near_lanes(vertical: np.ndarray, fp: np.ndarray, word: np.ndarray, mask: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, lanes): for each fingerprint the neighbours in its word, out of ``mask``, that differ in at most ``radius`` bits; rows without any are left out."""
    rows, fp = np.arange(len(fp)), fp.copy()
    counters = [np.zeros(len(fp), U64) for _ in range((radius + 1).bit_length())]
    over = np.zeros(len(fp), U64)
    for p in range(BITS):
        carry = vertical[p][word] ^ (U64(0) - ((fp >> U64(p)) & U64(1)))
        for c in counters:
            c ^= carry  # the new sum has the bit where the old one did not, so the carry is where it now lacks it
            carry &= ~c
        over |= carry
        if p % LOOK == LOOK - 1:
            left = mask & ~beyond(counters, over, radius)
            stay = left != 0
            if not stay.all():
                rows, fp, word, mask, over = rows[stay], fp[stay], word[stay], left[stay], over[stay]
                counters = [c[stay] for c in counters]
            else:
                mask = left
            if not len(rows):
                break
    return rows, mask


def unite(of: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Make one component of x[i] and y[i] for every i; of: the smallest member of each one's component, changed in place."""
    while True:
        a, b = of[x], of[y]
        apart = a != b
        if not apart.any():
            return
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(of, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := of[of], of):
            of[:] = up


def connected(fp: np.ndarray, begin: np.ndarray, end: np.ndarray, radius: int) -> np.ndarray:
    """The smallest member of each one's component, where row i is compared with the rows from begin[i] to end[i] - 1."""
    of = np.arange(len(fp))
    asks = np.flatnonzero(end > begin)
    if not len(asks):
        return of
    vertical = planes(fp)
    first = begin[asks] >> 6
    n = ((end[asks] - 1) >> 6) - first + 1
    stop = np.cumsum(n)
    for lo in range(0, int(stop[-1]), STEP):
        k = np.arange(lo, min(lo + STEP, int(stop[-1])))
        i = np.searchsorted(stop, k, "right")
        row, word = asks[i], first[i] + k - (stop[i] - n[i])
        low = np.maximum(begin[row] - 64 * word, 0).astype(U64)
        high = np.minimum(end[row] - 64 * word, 64).astype(U64)
        mask = (ONES << low) & (ONES >> (U64(64) - high))
        # a word of one component is not compared with a member of it
        lanes = np.append(of, np.full(-len(of) % 64, -1)).reshape(-1, 64)
        one = np.where((lanes == lanes[:, :1]).all(axis=1), lanes[:, 0], -1)
        open_ = one[word] != of[row]
        row, word, mask = row[open_], word[open_], mask[open_]
        hit, lanes = near_lanes(vertical, fp[row], word, mask, radius)
        for s in range(0, len(hit), 4096):  # at most 64 pairs a word
            at, lane = np.nonzero(np.unpackbits(np.ascontiguousarray(lanes[s : s + 4096]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            unite(of, row[hit[s + at]], 64 * word[hit[s + at]] + lane)
    return of


def _links(radius: int):
    """Arrow function: key, i, j, own, fp in the order of these, no group cut by a task's end -> links (a, b) that join components of a group."""

    def found(key: np.ndarray, own: np.ndarray, across: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(head, len(key)))
        end = np.repeat(head + size, size)
        first = own == own[np.repeat(head, size)]
        # of two blocks the first one asks the second; a block alone asks what comes behind
        cut = np.repeat(head + np.add.reduceat(first.astype(np.int64), head), size)
        begin = np.where(across, np.where(first, cut, end), np.arange(len(key)) + 1)
        of = connected(fp, begin, end, radius)
        x = np.flatnonzero(of != np.arange(len(of)))
        return pa.RecordBatch.from_arrays([pa.array(fp[x].view(np.int64)), pa.array(fp[of[x]].view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            i, j = (batch.column(k).to_numpy() for k in (1, 2))
            group = np.stack([batch.column(0).to_numpy(), i, j], 1)
            held.append((group, batch.column(3).to_numpy(), i != j, batch.column(4).to_numpy().view(U64)))
            if sum(len(x[0]) for x in held) < GATHER:
                continue
            group, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = len(group) - int((group[::-1] == group[-1]).all(axis=1).argmin() or len(group))
            held = [(group[cut:], *(x[cut:] for x in rest))]
            if cut:
                yield found(_numbered(group[:cut]), *(x[:cut] for x in rest))
        if held:
            group, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
            if len(group):
                yield found(_numbered(group), *rest)

    return run


def _numbered(group: np.ndarray) -> np.ndarray:
    return np.cumsum(np.append(True, (group[1:] != group[:-1]).any(axis=1)))


def block_keys(fp: Column, radius: int) -> list[Column]:
    """One key for every pair of the radius + 2 blocks of bits: its number and the two blocks' bits."""
    n = radius + 2
    cuts = [BITS * k // n for k in range(n + 1)]
    width = [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
    part = lambda k: F.call_function("shiftrightunsigned", fp, F.lit(cuts[k])).bitwiseAND(F.lit((1 << width[k]) - 1))
    return [(F.lit(t << 2 * max(width)) + F.shiftleft(part(a), width[b]) + part(b)).cast("long") for t, (a, b) in enumerate(combinations(range(n), 2))]


def near_fingerprints(kinds: DataFrame, radius: int) -> DataFrame:
    """(a, b): links between different fingerprints (fp) that give all components at ``radius``."""
    entries = kinds.select("fp", F.explode(F.array(*block_keys(F.col("fp"), radius))).alias("key"))
    shared = materialize(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-keys")
    dealt = entries.join(shared, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")
    sorted_ = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "own")
    links = materialize(sorted_.mapInArrow(_links(radius), "a long, b long"), "near-fingerprints")
    discard(shared)
    return links


def fingerprinted(docs: DataFrame, words: int = 4) -> DataFrame:
    """uid, doc_id, fp of every row. docs: uid, doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [fingerprints(data, offsets, words).view(np.int64) for _, _, data, offsets in ts.slices(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(got) if got else [], pa.int64())], ["uid", "doc_id", "fp"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("uid", "doc_id", "text").mapInArrow(run, f"uid long, doc_id {ids}, fp long")


def dedup_simhash(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, words: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every document.

    Words are lower-cased (A-Z) and cut at ASCII white space; a shingle is ``words`` of
    them joined by blanks, repeats included, a shorter text's whole sequence its only
    one. A bit is set where over half of the shingles' XXH64 (seed 42) have it.
    Fingerprints link at ``radius`` or fewer differing bits. Null, empty and blank texts
    have fingerprint 0, which links like any other. component_id is the smallest id
    that can be reached. Rows that repeat an id, or have none, are documents of their
    own, in the order of ``corpus.keyed``. An empty table gives no rows; other columns,
    whatever their names, are not read.
    """
    if not 0 <= radius <= 30:
        raise ValueError("radius must be from 0 to 30")
    held, direct = co.keyed(docs, id_col, text_col)
    prints = materialize(fingerprinted(held, words), "fingerprints")
    kinds = materialize(prints.groupBy("fp").agg(F.min("uid").alias("first")), "fingerprint-classes")
    comps = materialize(components(near_fingerprints(kinds, radius)), "fingerprint-components")
    classed = kinds.join(comps.withColumnRenamed("uid", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    heads = classed.groupBy("comp").agg(F.min("first").alias("head"))
    of = materialize(classed.join(heads, "comp").select("fp", "head"), "fingerprint-heads")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    out = prints.join(of, "fp")
    if direct:
        return out.select("doc_id", digits, F.col("head").cast(prints.schema["doc_id"].dataType).alias("component_id"))
    names = prints.select(F.col("uid").alias("head"), F.col("doc_id").alias("component_id"))
    return out.join(names, "head").select("doc_id", digits, "component_id")


def _simhash_sql() -> str:
    """XXH64 in 128-bit arithmetic modulo 2**64, over the shingles' bytes in hexadecimal."""
    p1, p2, p3, p4, p5 = (int(p) for p in (_P1, _P2, _P3, _P4, _P5))
    seed, whole = 42, 1 << 64
    big = lambda x: f"{x}::UHUGEINT"
    mod = lambda x: f"(({x}) % {big(whole)})"
    mul = lambda x, p: mod(f"({x}) * {big(p)}")
    turn = lambda x, r: f"({mod(f'({x}) * {big(1 << r)}')} + ({x}) // {big(1 << 64 - r)})"
    step = lambda acc, lane: mul(turn(mod(f"{acc} + {mul(lane, p2)}"), 31), p1)
    read = lambda first, n: f"('0x' || {' || '.join(f'substr(x, 2 * ({first}) + {2 * k + 1}, 2)' for k in reversed(range(n)))})::UBIGINT::UHUGEINT"
    starts = [(seed + p1 + p2) % whole, (seed + p2) % whole, seed, (seed - p1) % whole]
    accumulators = ", ".join(f"list_reduce(list_transform(range(0, n // 32), lambda t: lanes[4 * t + {k + 1}]), lambda a, b: {step('a', 'b')}, {big(v)}) AS v{k}" for k, v in enumerate(starts))
    merged = mod(" + ".join(turn(f"v{k}", r) for k, r in enumerate((1, 7, 12, 18))))
    for k in range(4):
        merged = mod(f"{mul(f'xor({merged}, {step(big(0), f"v{k}")})', p1)} + {big(p4)}")
    eight = mod(f"{mul(turn(f'xor(a, {step(big(0), "b")})', 27), p1)} + {big(p4)}")
    four = mod(f"{mul(turn(f'xor(h, {mul(read('n // 8 * 8', 4), p1)})', 23), p2)} + {big(p3)}")
    one = mul(turn(f"xor(a, {mul('b', p5)})", 11), p1)
    counts = ", ".join(f"sum((h >> {p}) & 1) AS b{p}" for p in range(BITS))
    bits = " + ".join(f"CASE WHEN 2 * b{p} > n THEN {1 << p}::UBIGINT ELSE 0::UBIGINT END" for p in range(BITS))
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda s: array_to_string(ws[s:s + 3], ' ')) END) AS s FROM w),
x AS MATERIALIZED (SELECT s, hex(encode(s)) AS x, octet_length(encode(s))::BIGINT AS n FROM (SELECT DISTINCT s FROM sh)),
l AS MATERIALIZED (SELECT s, x, n, list_transform(range(0, n // 8), lambda i: {read('8 * i', 8)}) AS lanes FROM x),
v AS MATERIALIZED (SELECT s, x, n, lanes, {accumulators} FROM l),
m AS MATERIALIZED (SELECT s, x, n, lanes, {mod(f"CASE WHEN n >= 32 THEN {merged} ELSE {big((seed + p5) % whole)} END + n::UHUGEINT")} AS h FROM v),
e AS MATERIALIZED (SELECT s, x, n, list_reduce(lanes[4 * (n // 32) + 1:], lambda a, b: {eight}, h) AS h FROM m),
f AS MATERIALIZED (SELECT s, x, n, CASE WHEN n % 8 >= 4 THEN {four} ELSE h END AS h FROM e),
o AS MATERIALIZED (SELECT s, list_reduce(list_transform(range(n - n % 4, n), lambda i: {read('i', 1)}), lambda a, b: {one}, h) AS h FROM f),
y AS MATERIALIZED (SELECT s, {mul(f'xor(h, h // {big(1 << 33)})', p2)} AS h FROM o),
z AS MATERIALIZED (SELECT s, {mul(f'xor(h, h // {big(1 << 29)})', p3)} AS h FROM y),
hashes AS MATERIALIZED (SELECT s, xor(h, h // {big(1 << 32)})::UBIGINT AS h FROM z),
sums AS (SELECT doc_id, count(*) AS n, {counts} FROM sh JOIN hashes USING (s) GROUP BY doc_id),
prints AS MATERIALIZED (SELECT d.doc_id, coalesce(p.fp, 0::UBIGINT) AS fp FROM documents d LEFT JOIN (SELECT doc_id, {bits} AS fp FROM sums) p USING (doc_id)),
kinds AS MATERIALIZED (SELECT fp, min(doc_id) AS first FROM prints GROUP BY fp),
links AS MATERIALIZED (SELECT a.fp AS a, b.fp AS b FROM kinds a JOIN kinds b ON bit_count(xor(a.fp, b.fp)) <= 4),
reach(a, b) AS (SELECT fp, fp FROM kinds UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
comps AS (SELECT r.a AS fp, min(k.first) AS component_id FROM reach r JOIN kinds k ON k.fp = r.b GROUP BY r.a)
SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM prints JOIN comps USING (fp)
"""


#: What dedup_simhash gives at radius 4 and four words.
SIMHASH_SQL = _simhash_sql()
