"""Suffix-array dedup: strings of ``length`` bytes that start in two places.

1. Segments. Of the 100-byte grams in a 200-byte window the one with the least hash
   is the window's anchor; consecutive windows with one anchor, as far as it stands
   in the same half of them, are a segment. All windows of a segment hold its core,
   the anchor and 50 bytes on that half's side of it. Anchor and half depend on the
   window's bytes only, so equal windows, wherever they are, lie in segments with
   equal cores: these are a class. A part of the corpus describes each of its
   different segments once, however often it holds it, and equal segments are one
   document with a count from there on; what is there twice is told to each part that
   has it, which finds its places again. So a passage that a third of all texts hold
   costs a class one description a part. A line in surroundings of its own in every
   text gives classes of one; a class without a second segment has no repeats.
   Where the different segments of a class hold more than ``class_bytes``, as those of a
   line in very many surroundings do, its windows are dealt to eight new classes by how
   many of their bytes stand in front of the core, each with a longer core, namely all
   that its windows have in common around the old one. Equal windows go the same way. A
   class that is still too large is dealt again, until a core is a whole window: twice
   for 200 bytes.
2. Suffixes. The documents of the other classes get their bytes and are built into a
   collection's Burrows-Wheeler transform and common prefixes, column by column
   (``collection``); their cores, compared byte by byte, are one symbol each. A window
   whose suffix shares 200 bytes with a neighbour is a repeat, and so are all windows
   of a document that is there twice.
3. Cut. The windows' bytes are removed from the texts.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from motifmill.llm import corpus as co
from motifmill.llm import textscan as ts
from motifmill.llm.collection import repeated_windows
from motifmill.plans.storage import discard, materialize, scratch

U64 = np.uint64
FLUSH, BLOCK = 1 << 17, 1 << 20
#: Symbols of the classes that are built as one collection; a class that holds more is one of its own.
COLLECTION = 4 << 20
#: Bytes of a class's different segments from which on it is split.
CLASS = 16 << 20
SHARES = 8
_SEGMENT = {"h": "<u8", "g": "<u8", "uid": "<i8", "start": "<u4", "part": "<u4", "n": "<u2", "a": "u1", "many": "u1"}
#: A part of a segment: its core is the ``k`` bytes from byte ``c`` on.
_SHARE = {"h": "<u8", "g": "<u8", "uid": "<i8", "start": "<u4", "part": "<u4", "n": "<u2", "c": "<u2", "k": "<u2", "many": "u1"}
_TWICE = {"h": "<u8", "g": "<u8", "n": "<u2"}
_RANGE = {"uid": "<i8", "start": "<u4", "n": "<u4"}
_WANTED = {"uid": "<i8", "start": "<u4", "n": "<u2", "h": "<u8", "c": "<u2", "k": "<u2", "known": "u1"}


def window_minima(key: np.ndarray, w: int) -> np.ndarray:
    """Least of every w consecutive values, by doubling."""
    have, out = 1, key
    while 2 * have <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < w:
        out = np.minimum(out[: len(out) - (w - have)], out[w - have :])
    return out


def halves(length: int) -> tuple[int, int]:
    """(bytes of an anchor, least place of an anchor in a window whose core begins in front of it)."""
    gram = length // 2
    return gram, (length - gram + 1) // 2


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor) of the segments of all texts in a slice, by place; the least hash and then the leftmost gram is the anchor."""
    gram, cut = halves(length)
    w = length - gram + 1
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    firsts, lasts, anchors = [], [], []
    for b in range(0, n, BLOCK):
        e = min(n, b + BLOCK)
        h = ts.gram_hash(data[b : e + length - 1], gram)
        key = (ts.mix(h) & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U64)
        at = (window_minima(key, w) & U64(0xFFFFFFFF)).astype(np.int64) + b
        start = np.arange(b, e)
        end = offsets[np.searchsorted(offsets, start, "right")]
        ok = start + length <= end
        at, start, end = at[ok], start[ok], end[ok]
        if not len(at):
            continue
        late = at - start >= cut
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (end[1:] != end[:-1]) | (late[1:] != late[:-1])
        begin = np.flatnonzero(new)
        firsts.append(start[begin])
        lasts.append(start[np.append(begin[1:], len(at)) - 1])
        anchors.append(at[begin])
    if not firsts:
        return (np.zeros(0, np.int64),) * 3
    first, last, anchor = (np.concatenate(x) for x in (firsts, lasts, anchors))
    # a segment that a block's end has cut
    late = anchor - first >= cut
    whole = np.ones(len(first), bool)
    whole[1:] = (anchor[1:] != anchor[:-1]) | (first[1:] != last[:-1] + 1) | (late[1:] != late[:-1])
    begin = np.flatnonzero(whole)
    return first[begin], last[np.append(begin[1:], len(first)) - 1], anchor[begin]


def cores(first: np.ndarray, anchor: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the segments' cores: what all windows that have their anchor on that side hold."""
    gram, cut = halves(length)
    late = anchor - first >= cut
    return np.where(late, anchor - cut, anchor), np.where(late, anchor + gram, anchor - cut + 1 + length)


def _described(data: np.ndarray, offsets: np.ndarray, length: int, key: bytes) -> tuple[np.ndarray, ...]:
    """(class, digest, first window, bytes, place of the anchor) of the segments in a slice.

    Segments of a class with equal digests and sizes count as equal, so digests are
    BLAKE2b under a secret key of the run: no text can be made to fit them. Classes are
    quick hashes: those that meet by mischance or malice are told apart in the build, by their bytes.
    """
    first, last, anchor = segments(data, offsets, length)
    if not len(first):
        return np.zeros(0, U64), np.zeros(0, U64), first, first, first
    raw = data.tobytes()
    digests = b"".join(hashlib.blake2b(raw[a:b], digest_size=8, key=key).digest() for a, b in zip(first.tolist(), (last + length).tolist(), strict=True))
    return ts.span_hash(data, *cores(first, anchor, length)), np.frombuffer(digests, U64), first, last - first + length, anchor - first


def _describe(parts: int, length: int, key: bytes):
    """Arrow function: uid, text, part, a part's rows in one task -> its different segments by bucket of their class; many: there once or more often."""
    shift, full = U64(64 - (parts.bit_length() - 1)), co.flush_at(parts, FLUSH, 64, 8 * FLUSH)

    def flush(held: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        x = {k: np.concatenate([f[k] for f in held]) for k in held[0]}
        order = np.argsort(ts.pair(ts.pair(x["h"], x["g"]), x["part"].astype(U64)), kind="stable")
        x = {k: v[order] for k, v in x.items()}
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([x[k][1:] != x[k][:-1] for k in ("h", "g", "n", "part")])
        head = np.flatnonzero(new)
        x = {k: v[head] for k, v in x.items()} | {"many": np.minimum(np.diff(np.append(head, len(order))), 2).astype(np.uint8)}
        return co.blocks([(i, 0, co.pack({k: f[k] for k in _SEGMENT})) for i, f in co.split_by((x["h"] >> shift).astype(np.int64), parts, x)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            uids, part = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for lo, hi, data, offsets in ts.slices(batch.column(1)):
                h, g, first, n, a = _described(data, offsets, length, key)
                if not len(first):
                    continue
                doc = np.searchsorted(offsets, first, "right") - 1
                held.append({"h": h, "g": g, "uid": uids[lo:hi][doc], "start": (first - offsets[doc]).astype(np.uint32), "part": part[lo:hi][doc].astype(np.uint32), "n": n.astype(np.uint16), "a": a.astype(np.uint8)})
                count += len(first)
                if count >= full:
                    yield flush(held)
                    held, count = [], 0
        if held:
            yield flush(held)

    return run


def _classes(parts: int, length: int, class_bytes: int, shares: bool = False):
    """All descriptions of a bucket, of segments or of shares of them -> answers by part.

    Kind 1: places of segments whose bytes are wanted; kind 3: of those whose class is to be
    split. What is there twice is told at once: whole segments, which each part finds
    again (kind 2), or the ranges of shares (kind 0).
    """

    def run(table: pa.Table) -> pa.Table:
        x = co.unpack(co.payloads(table, 0), _SHARE if shares else _SEGMENT)
        order = np.lexsort((x["start"], x["uid"], x["g"], x["h"]))
        x = {k: v[order] for k, v in x.items()}
        if not shares:
            core, end = cores(np.zeros(len(order), np.int64), x["a"].astype(np.int64), length)
            x |= {"c": core.astype(np.uint16), "k": (end - core).astype(np.uint16)}
        new_class = np.ones(len(order), bool)
        new_class[1:] = x["h"][1:] != x["h"][:-1]
        new_kind = new_class.copy()
        new_kind[1:] |= (x["g"][1:] != x["g"][:-1]) | (x["n"][1:] != x["n"][:-1])
        head = np.flatnonzero(new_kind)
        copies = np.add.reduceat(x["many"].astype(np.int64), head)
        kind = np.cumsum(new_kind) - 1
        of_class = (np.cumsum(new_class) - 1)[head]
        kinds_in, once_in = np.bincount(of_class), np.bincount(of_class, weights=copies == 1)
        large = np.bincount(of_class, weights=x["n"][head]) > class_bytes
        needed = (kinds_in[of_class] > 1) & (once_in[of_class] > 0)
        split = needed & large[of_class] & (x["k"][head] < length)
        asks = {k: x[k][head] for k in ("uid", "start", "n", "h", "c", "k")} | {"known": (copies > 1).astype(np.uint8)}
        if shares:
            again = np.flatnonzero((copies[kind] > 1) & (x["many"] == 1))
            told = (0, {k: x[k][again].astype(v) for k, v in _RANGE.items()}, x["part"][again])
        else:
            again = np.flatnonzero(copies[kind] > 1)
            told = (2, {k: x[k][again] for k in _TWICE}, x["part"][again])
        out = []
        for number, fields, part in (told, *((i, {k: v[rows] for k, v in asks.items()}, x["part"][head[rows]]) for i, rows in ((1, needed & ~split), (3, split)))):
            if len(part):
                out += [(i, number, co.pack(f)) for i, f in co.split_by(part.astype(np.int64), parts, fields)]
        return pa.Table.from_batches([co.blocks(out)])

    return run


def _asked(texts: pa.Table, x: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """Slices of a part's texts with the segments ``x`` that lie in them and where these begin (``at``)."""
    uids = texts.column("uid").to_numpy()
    got = np.isin(uids, x["uid"])
    texts, uids = texts.filter(pa.array(got)), uids[got]
    place = np.argsort(uids)
    row = place[np.searchsorted(uids, x["uid"], sorter=place)]
    order = np.lexsort((x["start"], row))
    x, row = {k: v[order] for k, v in x.items()}, row[order]
    for lo, hi, data, offsets in ts.slices(co.as_array(texts.column("text"), pa.large_string())):
        i, j = np.searchsorted(row, (lo, hi))
        if i < j:
            yield data, {k: v[i:j] for k, v in x.items()} | {"at": offsets[row[i:j] - lo] + x["start"][i:j]}


def _shares(x: dict[str, np.ndarray], length: int) -> Iterator[dict[str, np.ndarray]]:
    """The windows of segments in ``SHARES`` shares by how many of their bytes stand in front of the core: each with what its windows have in common as a longer core. Empty shares are left out."""
    at, start, n, c, k = (x[f].astype(np.int64) for f in ("at", "start", "n", "c", "k"))
    beside = length - k
    width = beside // SHARES + 1
    least, most = np.maximum(0, beside - (n - c - k)), np.minimum(beside, c)  # over all windows of the segment
    for j in range(SHARES):
        front, last = j * width, np.minimum((j + 1) * width - 1, beside)
        low, high = np.maximum(least, front), np.minimum(most, last)
        share = {"at": at + c - high, "start": start + c - high, "n": high - low + length, "c": high - front, "k": k + front + beside - last}
        some = low <= high
        yield {f: v[some] for f, v in (x | share).items()}


def _split(parts: int, length: int, key: bytes):
    """A part's texts and segments of classes to be split -> descriptions of their shares by bucket of the new classes."""
    shift = U64(64 - (parts.bit_length() - 1))

    def run(texts: pa.Table, asks: pa.Table) -> pa.Table:
        x, out = co.unpack(co.payloads(asks, 3), _WANTED), []
        for data, segment in _asked(texts, x) if len(x["uid"]) else ():
            raw = data.tobytes()
            for f in _shares(segment, length):
                digests = b"".join(hashlib.blake2b(raw[a : a + n], digest_size=8, key=key).digest() for a, n in zip(f["at"].tolist(), f["n"].tolist(), strict=True))
                core = f["at"] + f["c"]
                f |= {"h": ts.span_hash(data, core, core + f["k"]), "g": np.frombuffer(digests, U64), "many": 1 + f["known"]}
                f["part"] = np.full(len(core), asks.column("part")[0].as_py())
                out += [(i, 0, co.pack({k: v[k].astype(kind) for k, kind in _SHARE.items()})) for i, v in co.split_by((f["h"] >> shift).astype(np.int64), parts, f)]
        return pa.Table.from_batches([co.blocks(out)])

    return run


def _fetch(parts: int):
    """A part's texts and wanted segments -> the segments with their bytes by bucket of their class."""
    shift = U64(64 - (parts.bit_length() - 1))

    def run(texts: pa.Table, asks: pa.Table) -> pa.Table:
        x = co.unpack(co.payloads(asks, 1), _WANTED)
        if not len(x["uid"]):
            return pa.Table.from_batches([co.blocks([])])
        pieces: list[bytes] = []
        found = []
        for data, f in _asked(texts, x):
            raw = data.tobytes()
            pieces += [raw[a : a + n] for a, n in zip(f.pop("at").tolist(), f["n"].tolist(), strict=True)]
            found.append(f)
        x = {k: np.concatenate([f[k] for f in found]) for k in x}
        key = (x["h"] >> shift).astype(np.int64)
        out = []
        for i, f in co.split_by(key, parts, x | {"at": np.arange(len(key))}):
            out.append((i, 0, co.pack({k: f[k] for k in _WANTED}) + b"".join(pieces[a] for a in f["at"])))
        return pa.Table.from_batches([co.blocks(out)])

    return run


def _build(parts: int, length: int, folder: str):
    """All wanted segments of a bucket -> ranges of repeated windows in segments that are there once, by part. folder: for collections' columns."""

    def run(table: pa.Table) -> pa.Table:
        fields, pieces = [], []
        for raw in co.payloads(table, 0):  # the bytes stand behind the fields
            f = co.unpack([raw], _WANTED)
            ends = (len(raw) - int(f["n"].sum(dtype=np.int64)) + np.cumsum(f["n"].astype(np.int64))).tolist()
            pieces += [raw[e - n : e] for e, n in zip(ends, f["n"].tolist(), strict=True)]
            fields.append(f)
        x = {k: np.concatenate([f[k] for f in fields]) for k in _WANTED}
        order = np.argsort(x["h"], kind="stable")
        x, pieces = {k: v[order] for k, v in x.items()}, [pieces[i] for i in order]
        heads = np.append(np.flatnonzero(np.append(True, x["h"][1:] != x["h"][:-1])), len(order))
        weight = np.concatenate(([0], np.cumsum(x["n"].astype(np.int64))))
        uid, start, n = [], [], []
        c = 0
        while c < len(heads) - 1:
            e = max(c + 1, int(np.searchsorted(weight[heads], weight[heads[c]] + COLLECTION, "right")) - 1)
            lo, hi = int(heads[c]), int(heads[min(e, len(heads) - 1)])
            c = e
            for i, at in enumerate(repeated_windows(pieces[lo:hi], x["c"][lo:hi], x["k"][lo:hi], length, folder), lo):
                if x["known"][i] or not len(at):
                    continue
                begins = np.flatnonzero(np.append(True, np.diff(at) > 1))
                lasts = np.append(begins[1:], len(at)) - 1
                uid.append(np.full(len(begins), x["uid"][i]))
                start.append(x["start"][i] + at[begins])
                n.append(at[lasts] - at[begins] + length)
        if not uid:
            return pa.Table.from_batches([co.blocks([])])
        found = {"uid": np.concatenate(uid), "start": np.concatenate(start).astype(np.uint32), "n": np.concatenate(n).astype(np.uint32)}
        return pa.Table.from_batches([co.blocks([(i, 0, co.pack(f)) for i, f in co.split_by(co.part_of(found["uid"], parts), parts, found)])])

    return run


def _covered(texts: pa.Table, ranges: pa.Table, length: int, key: bytes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a part's texts and which of their bytes are covered: by given ranges, and by segments that are there twice."""
    x = co.unpack(co.payloads(ranges, 0), _RANGE)
    uids = texts.column("uid").to_numpy()
    order = np.argsort(x["uid"], kind="stable")
    x = {k: v[order].astype(np.int64) for k, v in x.items()}
    low, high = np.searchsorted(x["uid"], uids), np.searchsorted(x["uid"], uids, "right")
    twice = co.unpack(co.payloads(ranges, 2), _TWICE)
    key_of = lambda h, g, n: ts.pair(h, g) + n.astype(U64)
    order = np.argsort(key_of(*twice.values()))
    twice = {k: v[order] for k, v in twice.items()}
    keys = key_of(*twice.values())
    for lo, hi, data, offsets in ts.slices(co.as_array(texts.column("text"), pa.large_string())):
        count = high[lo:hi] - low[lo:hi]
        doc = np.repeat(np.arange(hi - lo), count)
        at = np.repeat(low[lo:hi], count) + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        begin, size = offsets[doc] + x["start"][at], x["n"][at]
        if len(keys):
            h, g, first, n, _ = _described(data, offsets, length, key)
            k = np.minimum(np.searchsorted(keys, key_of(h, g, n)), len(keys) - 1)
            hit = (twice["h"][k] == h) & (twice["g"][k] == g) & (twice["n"][k] == n)
            begin, size = np.concatenate([begin, first[hit]]), np.concatenate([size, n[hit]])
        edge = np.zeros(len(data) + 1, np.int32)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + size, -1)
        yield lo, hi, data, offsets, np.cumsum(edge)[:-1] > 0


def _run_starts(gone: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the maximal covered runs, which end with their text."""
    before = np.zeros(len(gone), bool)
    before[1:] = gone[:-1]
    before[offsets[:-1][offsets[:-1] < len(gone)]] = False
    return np.flatnonzero(gone & ~before)


def _digest(length: int, key: bytes):
    def run(texts: pa.Table, ranges: pa.Table) -> pa.Table:
        size, removed, spans, kept = [], [], [], []
        for lo, hi, data, offsets, gone in _covered(texts, ranges, length, key):
            size.append(np.diff(offsets))
            stay = np.concatenate(([0], np.cumsum(~gone)))[offsets]
            removed.append(size[-1] - np.diff(stay))
            begins = _run_starts(gone, offsets)
            spans.append(np.diff(np.searchsorted(begins, offsets)))
            raw = data[~gone].tobytes() if gone.any() else data.tobytes()
            kept += [hashlib.sha256(raw[stay[i] : stay[i + 1]]).hexdigest() for i in range(hi - lo)]
        size, removed, spans = (pa.array(np.concatenate(v) if v else [], pa.int64()) for v in (size, removed, spans))
        return pa.table({"doc_id": texts.column("doc_id"), "n_bytes": size, "n_removed": removed, "n_spans": spans, "kept_sha256": pa.array(kept, pa.string())})

    return run


def _spans(length: int, key: bytes):
    def run(texts: pa.Table, ranges: pa.Table) -> pa.Table:
        rows, start, size = [], [], []
        for lo, _, _, offsets, gone in _covered(texts, ranges, length, key):
            begins = _run_starts(gone, offsets)
            doc = np.searchsorted(offsets, begins, "right") - 1
            stops = np.append(np.flatnonzero(~gone), len(gone))
            end = np.minimum(stops[np.searchsorted(stops, begins)], offsets[doc + 1])
            rows.append(lo + doc)
            start.append(begins - offsets[doc])
            size.append(end - begins)
        rows, start, size = (pa.array(np.concatenate(v) if v else [], pa.int64()) for v in (rows, start, size))
        return pa.table({"doc_id": texts.column("doc_id").take(rows), "start": start, "length": size})

    return run


def _repeats(docs: DataFrame, id_col: str, text_col: str, length: int, key: bytes, class_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Texts in parts, and blocks by part with the byte ranges of repeats (kind 0) and the segments that are there twice (kind 2)."""
    if not 2 <= length <= 510:
        raise ValueError("length must be from 2 to 510 bytes")
    held, _ = co.keyed(docs, id_col, text_col)
    parts = co.part_count(docs)
    held = co.in_parts(held, parts)
    described = held.select("uid", "text", "part").repartition("part").mapInArrow(_describe(parts, length, key), co.BLOCKS)
    texts = held.select("uid", "text", "part")
    levels = [materialize(co.group_in_arrow(described, _classes(parts, length, class_bytes), co.BLOCKS), "segment-classes").withColumnRenamed("at", "part")]
    while not (large := levels[-1].where("kind = 3")).isEmpty():
        shares = texts.groupBy("part").cogroup(large.groupBy("part")).applyInArrow(_split(parts, length, key), co.BLOCKS)
        levels.append(materialize(co.group_in_arrow(shares, _classes(parts, length, class_bytes, True), co.BLOCKS), "segment-classes").withColumnRenamed("at", "part"))
    classes = reduce(DataFrame.unionByName, levels)
    fetched = texts.groupBy("part").cogroup(classes.where("kind = 1").groupBy("part")).applyInArrow(_fetch(parts), co.BLOCKS)
    built = materialize(co.group_in_arrow(fetched, _build(parts, length, scratch(docs.sparkSession, "columns")), co.BLOCKS), "segment-repeats").withColumnRenamed("at", "part")
    ranges = materialize(classes.where("kind in (0, 2)").unionByName(built), "ranges")
    discard(classes)
    return held, ranges


def dedup_suffixes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200, class_bytes: int = CLASS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document.

    Each byte goes that is covered by a string of ``length`` bytes (UTF-8) that also
    starts anywhere else, in the same document or another; all occurrences go.
    Shorter, empty and null texts keep all bytes. Repeated rows are documents of their
    own, so they repeat each other; null and repeated ids are numbered as
    ``corpus.keyed`` has it. An empty table gives no rows; other columns, whatever
    their names, are not read. class_bytes: what the different segments of a class may hold
    before it is split; the result does not depend on it.
    """
    key = os.urandom(16)
    held, ranges = _repeats(docs, id_col, text_col, length, key, class_bytes)
    ids = docs.schema[id_col].dataType.simpleString()
    return held.groupBy("part").cogroup(ranges.groupBy("part")).applyInArrow(_digest(length, key), f"doc_id {ids}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def repeat_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200, class_bytes: int = CLASS) -> DataFrame:
    """doc_id, start, length: the maximal byte ranges that ``dedup_suffixes`` removes, offsets from 0."""
    key = os.urandom(16)
    held, ranges = _repeats(docs, id_col, text_col, length, key, class_bytes)
    ids = docs.schema[id_col].dataType.simpleString()
    return held.groupBy("part").cogroup(ranges.groupBy("part")).applyInArrow(_spans(length, key), f"doc_id {ids}, start long, length long")


#: What dedup_suffixes gives for strings of 200 bytes, over the texts' bytes in hexadecimal.
SUFFIX_SQL = r"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
keyed AS (SELECT doc_id, list_transform(range(0, len(x) // 2 - 199), lambda p: md5(substr(x, 2 * p + 1, 400))) AS keys FROM t WHERE len(x) >= 400),
win AS (SELECT doc_id, unnest(keys) AS k, unnest(range(0, len(keys))) AS s FROM keyed),
repeated AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY k) AS n FROM win) WHERE n > 1),
places AS (SELECT doc_id, unnest(range(0, len(x) // 2)) AS i, unnest(list_transform(range(0, len(x) // 2), lambda p: substr(x, 2 * p + 1, 2))) AS b FROM t),
flagged AS (SELECT p.doc_id, p.i, p.b, coalesce(p.i - max(r.s) OVER (PARTITION BY p.doc_id ORDER BY p.i) < 200, false) AS gone
  FROM places p LEFT JOIN repeated r ON r.doc_id = p.doc_id AND r.s = p.i),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM flagged),
cut AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE begins) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM runs GROUP BY doc_id)
SELECT t.doc_id, (len(t.x) // 2)::BIGINT AS n_bytes, coalesce(c.n_removed, 0)::BIGINT AS n_removed, coalesce(c.n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(c.kept, ''))) AS kept_sha256
FROM t LEFT JOIN cut c ON c.doc_id = t.doc_id
"""
