"""Substring dedup with fixed-block anchors.

A run of ``window`` words holds at least one block of the text's own grid of
non-overlapping blocks of ``window // 2`` words. So of two equal windows each holds
an indexed block that the other meets with one of its rolling block-sized windows.

1. Index and probe: every part of the corpus sends its different grid blocks and the
   hashes of all its rolling block-sized windows to hash buckets. A block is an anchor
   if its hash was probed from anywhere else; that is told to each part that has
   such a block, which finds its places again. So a line that a third of all texts
   hold costs a bucket one entry a part for each of its blocks.
2. Extend: of every anchor all windows that hold it, up to ``window`` - block words to
   both sides, are looked up by a 128-bit BLAKE2 digest of their very words, not by the
   scan's hashes: a false anchor ends here, and texts made to collide in a fast hash do
   not pass for equal. Windows that are not the first of their kind cover words to
   remove; those in a row make up a maximal exact repeat.
3. Cut: the covered words leave the texts.

Rolling hashes are sent as 6 bytes each and at most twice by a producer, so that a
frequent line costs a producer two of them; false anchors are possible there and
only cause one more look-up in step 2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifmill.llm import corpus as co
from motifmill.llm import textscan as ts
from motifmill.plans.storage import discard, materialize

U64 = np.uint64
FLUSH = 1 << 20
_GRID = {"h": "<u8", "part": "<u4"}
_WINDOW = {"h": "<u8", "g": "<u8", "uid": "<i8", "start": "<u4"}
_PLACE = {"uid": "<i8", "start": "<u4"}


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of the BLAKE2 digest of the ``window`` words from each word ``at``, joined by one blank."""
    put = np.concatenate(([0], np.cumsum(ends - starts + 1)))
    raw = memoryview(ts.joined(data, starts, ends, np.ones(len(starts), bool), first)[0])
    made = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(put[at].tolist(), (put[at + window] - 1).tolist(), strict=True)])
    halves = np.frombuffer(made, "<u8").reshape(-1, 2)
    return np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1])


def _blocks(data: np.ndarray, offsets: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a slice (starts, ends, first of each text), hashes of all runs of ``block`` words, which of them lie in one text, and those of the texts' own grids."""
    starts, ends, first = ts.words(data, offsets)
    h, ok = ts.window_hash(ts.span_hash(data, starts, ends), block), ts.window_ok(first, block)
    at = np.arange(len(ok)) - np.repeat(first[:-1], np.diff(first))[: len(ok)]
    return starts, ends, first, h, ok, np.flatnonzero(ok & (at % block == 0))


def _probes(parts: int, block: int):
    """Arrow function: uid, text, part, a part's rows in one task -> blocks of rolling hashes (kind 0) and of different grid blocks (kind 1) by hash bucket."""
    shift, full = U64(64 - (parts.bit_length() - 1)), co.flush_at(parts, FLUSH, 512, 8 * FLUSH)

    def flush(rolling: list[np.ndarray], grid: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h = np.concatenate(rolling)
        h.sort()
        twice = np.zeros(len(h), bool)  # the third and later of a kind say nothing new
        twice[2:] = h[2:] == h[:-2]
        h = h[~twice]
        cuts = np.searchsorted(h, np.arange(1, parts, dtype=U64) << shift) if parts > 1 else np.zeros(0, int)
        out = [(i, 0, co.long_to_bytes6(x).tobytes()) for i, x in enumerate(np.split(h, cuts)) if len(x)]
        gh, part = (np.concatenate(x) for x in zip(*grid, strict=True))
        order = np.lexsort((part, gh))
        gh, part = gh[order], part[order]
        new = np.append(True, (gh[1:] != gh[:-1]) | (part[1:] != part[:-1]))
        for i, x in co.split_by((gh[new] >> shift).astype(np.int64), parts, {"h": gh[new], "part": part[new]}):
            out.append((i, 1, co.pack({k: x[k] for k in _GRID})))
        return co.blocks(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, grid, held = [], [], 0
        for batch in batches:
            part = batch.column(2).to_numpy()
            for lo, hi, data, offsets in ts.slices(batch.column(1)):
                _, _, first, h, ok, own = _blocks(data, offsets, block)
                if not ok.any():
                    continue
                doc = np.repeat(np.arange(hi - lo), np.diff(first))[own]
                rolling.append(h[ok])
                grid.append((h[own], part[lo:hi][doc].astype(np.uint32)))
                held += len(rolling[-1])
                if held >= full:
                    yield flush(rolling, grid)
                    rolling, grid, held = [], [], 0
        if rolling:
            yield flush(rolling, grid)

    return run


def _anchors(parts: int):
    """All blocks of a hash bucket -> the hashes of grid blocks that were probed from elsewhere too, by part that has them."""

    def run(table: pa.Table) -> pa.Table:
        own = co.unpack(co.payloads(table, 1), _GRID)
        low = own["h"] & U64((1 << 48) - 1)
        probed = co.bytes6_to_long(b"".join(co.payloads(table, 0)))
        probed.sort()
        order = np.argsort(low)
        found = np.empty(len(low), bool)
        found[order] = np.searchsorted(probed, low[order], "right") - np.searchsorted(probed, low[order]) > 1
        h, part = own["h"][found], own["part"][found].astype(np.int64)
        out = [(i, 0, co.pack(x)) for i, x in co.split_by(part, parts, {"h": h})] if len(h) else []
        return pa.Table.from_batches([co.blocks(out)])

    return run


def _sorted_places(places: dict[str, np.ndarray], uids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``uids`` (any order), places' second field, and for each row its range among them."""
    names = [k for k in places if k != "uid"]
    order = np.lexsort((places[names[0]], places["uid"]))
    uid, at = places["uid"][order], places[names[0]][order].astype(np.int64)
    return at, np.searchsorted(uid, uids), np.searchsorted(uid, uids, "right")


def _candidates(parts: int, block: int, window: int):
    """A part's texts and anchors -> windows that hold an anchor, by hash bucket (kind 0); later equal ones of the same part (kind 1)."""
    shift = U64(64 - (parts.bit_length() - 1))

    def run(texts: pa.Table, hits: pa.Table) -> pa.Table:
        uids = texts.column("uid").to_numpy()
        known = np.unique(co.unpack(co.payloads(hits, 0), {"h": "<u8"})["h"])
        if not len(known) or not len(uids):
            return pa.Table.from_batches([co.blocks([])])
        found = []
        for lo, hi, data, offsets in ts.slices(co.as_array(texts.column("text"), pa.large_string())):
            starts, ends, first, h, _, own = _blocks(data, offsets, block)
            ok = ts.window_ok(first, window)
            anchor = own[known[np.minimum(np.searchsorted(known, h[own]), len(known) - 1)] == h[own]]
            if not ok.any() or not len(anchor):
                continue
            doc = np.repeat(np.arange(hi - lo), np.diff(first))[anchor]
            # a window at s holds the anchor at a if a - (window - block) <= s <= a
            near = np.zeros(len(starts) + 1, np.int32)
            np.add.at(near, np.maximum(anchor - (window - block), first[:-1][doc]), 1)
            np.add.at(near, anchor + 1, -1)
            at = np.flatnonzero((np.cumsum(near)[: len(ok)] > 0) & ok)
            h, g = _digests(data, starts, ends, first, at, window)
            owner = np.repeat(np.arange(hi - lo), np.diff(first))[at]
            found.append((h, g, uids[lo:hi][owner], (at - first[:-1][owner]).astype(np.uint32)))
        if not found:
            return pa.Table.from_batches([co.blocks([])])
        h, g, uid, start = (np.concatenate(x) for x in zip(*found, strict=True))
        later = _later(h, g, uid, start)
        out = []
        if later.any():
            here = int(texts.column("part")[0].as_py())
            out.append((here, 1, co.pack({"uid": uid[later], "start": start[later]})))
        keep = ~later
        h, g, uid, start = h[keep], g[keep], uid[keep], start[keep]
        for i, x in co.split_by((h >> shift).astype(np.int64), parts, {"h": h, "g": g, "uid": uid, "start": start}):
            out.append((i, 0, co.pack({"h": x["h"], "g": x["g"], "uid": np.diff(x["uid"], prepend=0), "start": np.diff(x["start"].astype(np.int64), prepend=0).astype(np.int32)})))
        return pa.Table.from_batches([co.blocks(out)])

    return run


def _later(h: np.ndarray, g: np.ndarray, uid: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which entries have an equal hash (h, g) at a smaller (uid, start)?"""
    out = np.zeros(len(h), bool)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    many = np.zeros(len(h), bool)
    many[1:] |= same
    many[:-1] |= same
    some = order[many]
    order = some[np.lexsort((start[some], uid[some], g[some], h[some]))]
    out[order[1:]] = (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])
    return out


def _repeats(parts: int):
    """All windows of a hash bucket -> places of those that occur earlier elsewhere, by part."""

    def run(table: pa.Table) -> pa.Table:
        raws = co.payloads(table, 0)
        each = [co.unpack([raw], _WINDOW | {"start": "<i4"}) for raw in raws]
        out = [(int(a), 0, p) for a, k, p in zip(table.column("at").to_pylist(), table.column("kind").to_pylist(), table.column("payload").to_pylist(), strict=True) if k == 1]
        if each:
            h, g = (np.concatenate([x[k] for x in each]) for k in ("h", "g"))
            uid, start = (np.concatenate([np.cumsum(x[k], dtype=np.int64) for x in each]) for k in ("uid", "start"))
            later = _later(h, g, uid, start)
            uid, start = uid[later], start[later].astype(np.uint32)
            if len(uid):
                out += [(i, 0, co.pack(x)) for i, x in co.split_by(co.part_of(uid, parts), parts, {"uid": uid, "start": start})]
        return pa.Table.from_batches([co.blocks(out)])

    return run


def _cut(texts: pa.Table, places: pa.Table, window: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, tuple, np.ndarray]]:
    """Slices of a part's texts with their words and which of the words are covered."""
    uids = texts.column("uid").to_numpy()
    start_at, low, high = _sorted_places(co.unpack(co.payloads(places, 0), _PLACE), uids)
    for lo, hi, data, offsets in ts.slices(co.as_array(texts.column("text"), pa.large_string())):
        starts, ends, first = ts.words(data, offsets)
        counts = high[lo:hi] - low[lo:hi]
        doc = np.repeat(np.arange(hi - lo), counts)
        rank = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = first[:-1][doc] + start_at[low[lo:hi][doc] + rank]
        cover = np.zeros(len(starts) + 1, np.int32)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + window, -1)
        yield lo, hi, data, offsets, (starts, ends, first), np.cumsum(cover)[:-1] > 0


def blanked(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """The bytes with the words that go as blanks."""
    if not gone.any():
        return data
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts[gone]] += 1
    edge[ends[gone]] -= 1
    return np.where(np.cumsum(edge[:-1], dtype=np.int8) > 0, np.uint8(32), data)


def _digest(window: int):
    def run(texts: pa.Table, places: pa.Table) -> pa.Table:
        n_words, n_removed, kept = [], [], []
        for lo, hi, data, offsets, (starts, ends, first), gone in _cut(texts, places, window):
            n_words.append(np.diff(first))
            total = np.concatenate(([0], np.cumsum(gone)))
            n_removed.append(total[first[1:]] - total[first[:-1]])
            raw = blanked(data, starts, ends, gone).tobytes()
            kept += [hashlib.sha256(b" ".join(raw[offsets[i] : offsets[i + 1]].split())).hexdigest() for i in range(hi - lo)]
        n_words, n_removed = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (n_words, n_removed))
        return pa.table({"doc_id": texts.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(kept, pa.string())})

    return run


def _rewrite(window: int, columns: list[str], text_at: int):
    """The rows with covered words cut out of their text; what stands between kept words stays, a cut leaves one blank."""

    def run(texts: pa.Table, places: pa.Table) -> pa.Table:
        new = []
        for lo, hi, data, offsets, (starts, ends, first), gone in _cut(texts, places, window):
            raw = data.tobytes()
            for i in range(hi - lo):
                a, b = first[i], first[i + 1]
                out = gone[a:b]
                if not out.any():
                    new.append(raw[offsets[i] : offsets[i + 1]])
                    continue
                stay = np.flatnonzero(np.diff(np.concatenate(([1], out, [1])).astype(np.int8)))  # begins and ends of the kept runs
                new.append(b" ".join(raw[starts[a + s] : ends[a + e - 1]] for s, e in stay.reshape(-1, 2)))
        held = [texts.column(f"c{i}") for i in range(len(columns))]
        held[text_at] = pa.chunked_array([pa.array(new, pa.binary()).cast(pa.string())])
        return pa.table(held, names=columns)

    return run


def repeated_places(docs: DataFrame, parts: int, window: int) -> DataFrame:
    """Blocks by part with the places (uid, first word) of all windows that occur earlier elsewhere. docs: uid, text, part."""
    block = window // 2
    probes = docs.select("uid", "text", "part").repartition("part").mapInArrow(_probes(parts, block), co.BLOCKS)
    anchors = materialize(co.group_in_arrow(probes, _anchors(parts), co.BLOCKS), "anchors")
    anchors = anchors.withColumnRenamed("at", "part")
    windows = docs.select("uid", "text", "part").groupBy("part").cogroup(anchors.groupBy("part")).applyInArrow(_candidates(parts, block, window), co.BLOCKS)
    places = materialize(co.group_in_arrow(windows, _repeats(parts), co.BLOCKS), "repeats").withColumnRenamed("at", "part")
    discard(anchors)
    return places


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document.

    A word goes if a run of ``window`` words that covers it also starts earlier, in
    a document with a smaller id or earlier in the same one. Documents with fewer
    words, empty ones and null texts keep all (none). Rows that repeat an id, or have
    none, are documents of their own, in the order of ``corpus.keyed``. An empty table
    gives no rows; other columns, whatever their names, are not read.
    """
    held, _ = co.keyed(docs, id_col, text_col)
    parts = co.part_count(docs)
    held = co.in_parts(held, parts)
    places = repeated_places(held, parts, window)
    ids = docs.schema[id_col].dataType.simpleString()
    return held.groupBy("part").cogroup(places.groupBy("part")).applyInArrow(_digest(window), f"doc_id {ids}, n_words long, n_removed long, kept_sha256 string")


def cut_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """``docs`` with the same columns and rows, repeated words cut out of the text column.

    Null texts come back empty; empty ones, and texts of fewer words, stay as they are. Repeated
    rows stay, all but the first without the words that repeat it. An empty table
    stays empty; further columns pass through whatever their names.
    """
    held, _ = co.keyed(docs, id_col, text_col, rows=True)
    parts = co.part_count(docs)
    held = co.in_parts(held, parts)
    places = repeated_places(held, parts, window)
    run = _rewrite(window, [f"c{i}" for i in range(len(docs.columns))], docs.columns.index(text_col))
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    return held.groupBy("part").cogroup(places.groupBy("part")).applyInArrow(run, schema).toDF(*docs.columns)


#: What dedup_substrings gives for windows of 20 words.
SUBSTRING_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
keyed AS (SELECT doc_id, list_transform(range(1, len(ws) - 18), lambda s: md5(array_to_string(ws[s:s + 19], ' '))) AS keys FROM w WHERE len(ws) >= 20),
win AS (SELECT doc_id, unnest(keys) AS k, unnest(range(1, len(keys) + 1)) AS s FROM keyed),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, s + j AS i FROM later, range(0, 20) t(j)),
places AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
cut AS (SELECT p.doc_id, count(g.i) AS n_removed, string_agg(p.word, ' ' ORDER BY p.i) FILTER (WHERE g.i IS NULL) AS kept
  FROM places p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY p.doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(c.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(c.kept, '')) AS kept_sha256
FROM w LEFT JOIN cut c ON c.doc_id = w.doc_id
"""
