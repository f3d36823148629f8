"""Benchmark decontamination by pigeonhole edit matching.

A passage within ``budget`` edits of a test item leaves at least one of budget + 1
pieces of the item untouched. So the items are cut into such pieces, all places of
a text are hashed at once and looked up among the pieces' beginnings, and around
every exact piece the item is aligned with Myers' bit-parallel algorithm. Short items
that allow no edits are looked up whole, between the ends of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from motifmill.llm import textscan as ts
from motifmill.llm.minhash import FOLD

U64 = np.uint64
#: Edits allowed per byte of an item; shortest item that allows any; shortest that counts inside words when it allows none.
RATE, LEAST_EDITED, LEAST_ITEM = 0.08, 22, 32
#: Bytes of items that one pass over the documents looks for.
PASS_BYTES = 4 << 20
_FILTER_BITS = 20


def normalised(text: str | None) -> bytes:
    """A-Z lowered, white space runs as one blank, none at the ends."""
    return b" ".join((text or "").encode().lower().split())


def edit_budget(size: int, rate: float = RATE) -> int:
    return int(size * rate) if size >= LEAST_EDITED else 0


def cut_pieces(item: bytes, budget: int) -> list[tuple[int, bytes]]:
    """budget + 1 pieces that cover the item, with their offsets; sizes differ by one at most."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_match(item: bytes, text: bytes, budget: int, masks: dict[int, int] | None = None) -> tuple[int, int] | None:
    """(edits, end) of the best place of ``item`` in ``text``, the first among equals; None if all need more than ``budget``.

    Myers: one big integer holds a column of the edit matrix as differences of +1 and
    -1, so a byte of text costs a few integer operations whatever the item's length.
    """
    m = len(item)
    masks = byte_masks(item) if masks is None else masks
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, None
    for at, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | minus
        d = ((((eq & plus) + plus) ^ plus) | x) & full
        up, down = (minus | ~(d | plus)) & full, plus & d
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = (down | ~(x | up)) & full, up & x
        if score <= budget and (best is None or score < best[0]):
            best = (score, at + 1)
            if not score:
                break
    return best


def byte_masks(item: bytes) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


@dataclass
class Index:
    """Pieces of a pass's items, by the hash of their first ``size`` bytes."""

    ids: list
    items: list[bytes]
    budgets: list[int]
    size: int
    hashes: np.ndarray
    owner: np.ndarray
    offset: np.ndarray
    length: np.ndarray
    whole: np.ndarray
    filter: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[object, bytes]], rate: float) -> Index:
        ids, items = [r[0] for r in rows], [r[1] for r in rows]
        budgets = [edit_budget(len(x), rate) for x in items]
        pieces = [(i, at, p) for i, (x, k) in enumerate(zip(items, budgets, strict=True)) for at, p in cut_pieces(x, k)]
        size = min(len(p) for _, _, p in pieces)
        length = np.array([len(p) for _, _, p in pieces], np.int64)
        raw, begin = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8), np.cumsum(length) - length
        hashes, whole = ts.gram_hash(raw, size)[begin], ts.span_hash(raw, begin, begin + length)
        order = np.argsort(hashes, kind="stable")
        here = np.zeros(1 << _FILTER_BITS, bool)
        here[(hashes >> U64(64 - _FILTER_BITS)).astype(np.int64)] = True
        pick = lambda k: np.array([p[k] for p in pieces], np.int64)[order]
        return cls(ids, items, budgets, size, hashes[order], pick(0), pick(1), length[order], whole[order], here)

    def places(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(text, item, where the item would begin in the slice) of every piece that stands in a text, ascending and distinct."""
        h = ts.gram_hash(data, self.size)
        at = np.flatnonzero(self.filter[(h >> U64(64 - _FILTER_BITS)).astype(np.int64)])
        low, high = np.searchsorted(self.hashes, h[at]), np.searchsorted(self.hashes, h[at], "right")
        at, low, high = at[low < high], low[low < high], high[low < high]
        doc = np.searchsorted(offsets, at, "right") - 1
        inside = at + self.size <= offsets[doc + 1]
        at, low, high, doc = at[inside], low[inside], high[inside], doc[inside]
        n = high - low
        entry = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at, doc = np.repeat(at, n), np.repeat(doc, n)
        end = at + self.length[entry]
        same = end <= offsets[doc + 1]
        same[same] = ts.span_hash(data, at[same], end[same]) == self.whole[entry[same]]
        at, doc, entry = at[same], doc[same], entry[same]
        found = np.stack([doc, self.owner[entry], at - self.offset[entry]], 1)
        return np.unique(found, axis=0)


#: ASCII letters and digits: between two of them no word ends.
_WORD = np.zeros(256, bool)
_WORD[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_BLOCK = 1 << 20


@dataclass
class WholeIndex:
    """Short items that allow no edits, by size and hash; items with equal texts share an entry."""

    ids: list
    items: list[bytes]
    budgets: list[int]
    owners: list[list[int]]
    sizes: list[tuple[int, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list[tuple[object, bytes]], rate: float) -> WholeIndex:
        owners: dict[bytes, list[int]] = {}
        for i, (_, x) in enumerate(rows):
            owners.setdefault(x, []).append(i)
        by_size: dict[int, list[tuple[int, int]]] = {}
        for entry, x in enumerate(owners):
            by_size.setdefault(len(x), []).append((int(ts.span_hash(np.frombuffer(x, np.uint8), np.zeros(1, np.int64), np.full(1, len(x)))[0]), entry))
        sizes = [(k, np.array([h for h, _ in sorted(v)], U64), np.array([e for _, e in sorted(v)], np.int64)) for k, v in sorted(by_size.items())]
        return cls([r[0] for r in rows], list(owners), [0] * len(rows), list(owners.values()), sizes)

    def found(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
        """(text, item) of every item that stands in a text, its ends not inside a run of ASCII letters and digits; ascending texts."""
        n, most = len(data), self.sizes[-1][0]
        inside = np.zeros(n + 1, bool)
        inside[1:n] = _WORD[data[1:]] & _WORD[data[:-1]]
        inside[offsets] = False
        hits: set[tuple[int, int]] = set()
        for b in range(0, n, _BLOCK):
            part = data[b : b + _BLOCK + most]
            starts = np.flatnonzero(~inside[b : min(b + _BLOCK, n)] & (part[:_BLOCK] != 32))
            text = np.searchsorted(offsets, starts + b, "right") - 1
            for size, hashes, entries in self.sizes:
                fits = starts + b + size <= offsets[text + 1]
                at, of = starts[fits], text[fits]
                ends = ~inside[at + b + size]
                at, of = at[ends], of[ends]
                h = ts.span_hash(part, at, at + size)
                k = np.searchsorted(hashes, h)
                k[k == len(hashes)] = 0
                same = hashes[k] == h
                at, of, k = at[same], of[same], entries[k[same]]
                for j in np.unique(np.stack([of, k], 1), axis=0, return_index=True)[1].tolist():
                    if part[at[j] : at[j] + size].tobytes() == self.items[k[j]]:
                        hits.add((int(of[j]), int(k[j])))
        for doc, entry in sorted(hits):
            for i in self.owners[entry]:
                yield doc, i


def matches(index: Index | WholeIndex, masks: dict[int, dict], column: pa.Array) -> Iterator[tuple[int, int, int]]:
    """(row, item's number, least edits) of every row and item within the item's budget."""
    for lo, _, data, offsets in ts.slices(column):
        data, offsets = ts.squeezed(data, offsets, FOLD)
        if isinstance(index, WholeIndex):
            for doc, i in index.found(data, offsets):
                yield lo + doc, i, 0
            continue
        found = index.places(data, offsets)
        if not len(found):
            continue
        raw = data.tobytes()
        cuts = np.flatnonzero(np.diff(found[:, 0]) | np.diff(found[:, 1])) + 1
        for group in np.split(found, cuts):
            doc, i = int(group[0, 0]), int(group[0, 1])
            item, k = index.items[i], index.budgets[i]
            begin, end = int(offsets[doc]), int(offsets[doc + 1])
            spans: list[list[int]] = []
            for s in group[:, 2].tolist():
                a, b = max(begin, s - k), min(end, s + len(item) + k)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            if i not in masks:
                masks[i] = byte_masks(item)
            got = [m[0] for a, b in spans if (m := best_match(item, raw[a:b], k, masks[i]))]
            if got:
                yield lo + doc, i, min(got)


def item_passes(items: DataFrame, id_col: str, text_col: str, rate: float) -> Iterator[Index | WholeIndex]:
    """The test items in groups of bounded size, short ones that allow no edits apart; the driver holds a group of each kind at a time."""
    groups: dict[type, list] = {Index: [], WholeIndex: []}
    sizes = dict.fromkeys(groups, 0)
    for item_id, text in items.select(id_col, text_col).toLocalIterator():
        text = normalised(text)
        if not text:
            continue
        kind = WholeIndex if len(text) < LEAST_ITEM and not edit_budget(len(text), rate) else Index
        groups[kind].append((item_id, text))
        sizes[kind] += max(len(text), LEAST_ITEM)
        if sizes[kind] >= PASS_BYTES:
            yield kind.of(groups[kind], rate)
            groups[kind], sizes[kind] = [], 0
    for kind, group in groups.items():
        if group:
            yield kind.of(group, rate)


def find_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", rate: float = RATE) -> DataFrame:
    """doc_id, item_id, edits, budget: every document that holds a test item within its budget of edits.

    Edits count bytes of the normalised texts (A-Z lowered, white space runs as one
    blank); the budget is ``rate`` times the item's bytes, rounded down, and none for
    items under LEAST_EDITED bytes. Items of fewer than LEAST_ITEM bytes that allow no
    edits count as whole words only: where no ASCII letter or digit at their ends runs
    on into another. Empty items, null ones too, take no part. Null and empty texts hold nothing; repeated rows are reported
    each, as are items with equal texts; a null id stays null; an empty table gives no
    rows. Other columns of both tables, whatever their names, are not read. Test items go
    to the executors in passes of at most PASS_BYTES and one item; with none the
    result is empty.
    """
    ids, item_ids = docs.schema[id_col].dataType.simpleString(), items.schema[item_id_col].dataType.simpleString()
    schema = f"doc_id {ids}, item_id {item_ids}, edits long, budget long"
    spark, out, item_type = docs.sparkSession, None, to_arrow_type(items.schema[item_id_col].dataType)
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    for index in item_passes(items, item_id_col, item_text_col, rate):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, masks = shared.value, {}
            for batch in batches:
                found = list(matches(index, masks, batch.column(1)))
                rows = pa.array([r for r, _, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([index.ids[i] for _, i, _ in found], item_type), pa.array([e for _, _, e in found], pa.int64()), pa.array([index.budgets[i] for _, i, _ in found], pa.int64())], ["doc_id", "item_id", "edits", "budget"])

        part = picked.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", rate: float = RATE) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no test item as ``find_leaks`` has it. One scan a pass and no shuffle.

    Rows with null and empty texts stay, each of repeated rows stays or goes alike; an
    empty table stays empty; without test items all rows stay.
    """
    spark = docs.sparkSession
    at = docs.columns.index(text_col)
    for index in item_passes(items, item_id_col, item_text_col, rate):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, masks = shared.value, {}
            for batch in batches:
                stay = np.ones(batch.num_rows, bool)
                stay[[r for r, _, _ in matches(index, masks, batch.column(at))]] = False
                yield batch.filter(pa.array(stay))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
