"""Burrows-Wheeler transform and common prefixes of a collection of documents, built column by column.

Bauer, Cox and Rosone's construction: in every round each document inserts one more
symbol, from its end to its front. ``Columns`` is what the collection has so far: of
all suffixes inserted, in their order, the symbol in front (the transform) and the
number of symbols shared with the suffix before (the common prefixes). A round reads
it from front to back twice, once to rank this round's symbols and once to write the
next one with the new suffixes in their places. It lies in sequential files in the
shared folder, or in memory where the collection is small.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np

#: Suffixes in a piece of the columns, and symbols of a collection from which on its columns lie in files.
PIECE, EXTERNAL = 1 << 18, 4 << 20
_FAR = np.int16(32767)
Piece = tuple[np.ndarray, np.ndarray]


class Columns:
    """Symbols and common prefixes in order, replaced as a whole by every round. folder: where files go; None, or a file system that pyarrow does not know: memory."""

    def __init__(self, folder: str | None = None):
        self._held: list[Piece] = []
        self._fs, self._path = None, ""
        if folder is not None:
            from pyarrow import ArrowInvalid, ArrowNotImplementedError, fs

            try:
                self._fs, base = fs.FileSystem.from_uri(folder)
            except (ArrowInvalid, ArrowNotImplementedError, OSError):
                return
            self._fs.create_dir(base)
            self._name, self._round = f"{base}/{uuid.uuid4().hex}", 0

    def read(self) -> Iterator[Piece]:
        if self._fs is None:
            yield from self._held
        elif self._path:
            with self._fs.open_input_stream(self._path) as source:
                while head := source.read(8):
                    n = int(np.frombuffer(head, np.int64)[0])
                    yield np.frombuffer(source.read(2 * n), np.uint16), np.frombuffer(source.read(2 * n), np.int16)

    def replace(self, pieces: Iterable[Piece]) -> None:
        """Take ``pieces``, which may be made from what read() still gives, in place of what there is."""
        if self._fs is None:
            self._held = list(pieces)
            return
        self._round += 1
        old, new = self._path, f"{self._name}-{self._round}"
        with self._fs.open_output_stream(new) as sink:
            for symbols, shared in pieces:
                sink.write(np.int64(len(symbols)).tobytes())
                sink.write(symbols.tobytes())
                sink.write(shared.tobytes())
        self._path = new
        if old:
            self._fs.delete_file(old)

    def close(self) -> None:
        self._held = []
        if self._path:
            self._fs.delete_file(self._path)
            self._path = ""


class _Ranks:
    """One pass over the columns: of asked places, how often their symbol stands before, and the least common prefix from the place before and to the place behind with the same symbol."""

    def __init__(self, n: int, sigma: int):
        self.rank = np.zeros(n, np.int64)
        self.before, self.behind = np.full(n, -1, np.int16), np.full(n, -1, np.int16)
        self._count = np.zeros(sigma, np.int64)
        self._least = np.full(sigma, _FAR)  # least common prefix since a symbol's last place
        self._open = np.full(sigma, -1)  # asked place whose symbol has not come again
        self._so_far = np.full(sigma, _FAR)

    def piece(self, symbols: np.ndarray, shared: np.ndarray, at: np.ndarray, lo: int) -> None:
        """at: asked places in the piece, ascending; lo: the first one's number."""
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        count = np.bincount(symbols, minlength=len(self._count))
        head = np.cumsum(count) - count
        here = np.flatnonzero(count)
        padded = np.empty(n + 1, np.int16)
        padded[:n], padded[n] = shared, _FAR
        # least common prefix up to each symbol's first place, and behind its last one
        front, back = np.full(len(count), _FAR), np.full(len(count), _FAR)
        first, last = order[head[here]], order[head[here] + count[here] - 1]
        turn = np.argsort(first)
        front[here[turn]] = np.minimum.accumulate(np.minimum.reduceat(padded[: first.max() + 1], np.append(0, first[turn][:-1] + 1)))
        turn = np.argsort(last)
        behind = np.minimum.reduceat(padded, last[turn] + 1)
        back[here[turn]] = np.minimum.accumulate(behind[::-1])[::-1]
        least = shared.min()
        come = (self._open >= 0) & (count > 0)
        self.behind[self._open[come]] = np.minimum(self._so_far[come], front[come])
        self._open[come] = -1
        self._so_far = np.minimum(self._so_far, least)
        if len(at):
            turned = np.empty(n, np.int32)
            turned[order] = np.arange(n, dtype=np.int32)
            c, k = symbols[at], turned[at].astype(np.int64)
            mine = np.arange(lo, lo + len(at))
            self.rank[mine] = self._count[c] + k - head[c]
            inner = k > head[c]
            if inner.any():
                edges = np.stack([order[k[inner] - 1] + 1, at[inner] + 1], 1).ravel()
                self.before[mine[inner]] = np.minimum.reduceat(padded, edges)[::2]
            outer = ~inner & (self._count[c] > 0)
            self.before[mine[outer]] = np.minimum(self._least[c[outer]], front[c[outer]])
            inner = k < head[c] + count[c] - 1
            if inner.any():
                edges = np.stack([at[inner] + 1, order[k[inner] + 1] + 1], 1).ravel()
                self.behind[mine[inner]] = np.minimum.reduceat(padded, edges)[::2]
            outer = np.flatnonzero(~inner)
            self._open[c[outer]] = mine[outer]
            self._so_far[c[outer]] = back[c[outer]]
        self._least = np.where(count > 0, back, np.minimum(self._least, least))
        self._count += count


def _merged(pieces: Iterator[Piece], gap: np.ndarray, symbols: np.ndarray, shared: np.ndarray, behind: np.ndarray) -> Iterator[Piece]:
    """The pieces with new suffixes before the old ones of number ``gap`` (ascending); an old one right behind a new one shares ``behind`` with it."""
    last_of_gap = np.append(gap[1:] != gap[:-1], True) if len(gap) else np.zeros(0, bool)
    begin, done = 0, 0
    held: Piece | None = None
    for piece in _with_end(pieces):
        if piece is None:
            old = (np.zeros(0, np.uint16), np.zeros(0, np.int16))
            stop = len(gap)
        else:
            old = piece
            stop = int(np.searchsorted(gap, begin + len(old[0])))
        i = np.arange(done, stop)
        if len(i):
            s, p = old
            p = p.copy()
            near = i[last_of_gap[i]]
            inside = near[gap[near] - begin < len(p)]
            p[gap[inside] - begin] = behind[inside]
            stay = np.ones(len(s) + len(i), bool)
            stay[gap[i] - begin + np.arange(len(i))] = False
            out_s, out_p = np.empty(len(stay), np.uint16), np.empty(len(stay), np.int16)
            out_s[stay], out_p[stay] = s, p
            out_s[~stay], out_p[~stay] = symbols[i], shared[i]
            old = (out_s, out_p)
        begin, done = begin + (len(piece[0]) if piece is not None else 0), stop
        if held is not None and len(held[0]) + len(old[0]) > PIECE:
            yield held
            held = None
        held = old if held is None else (np.concatenate([held[0], old[0]]), np.concatenate([held[1], old[1]]))
        while len(held[0]) > 2 * PIECE:
            yield held[0][:PIECE], held[1][:PIECE]
            held = (held[0][PIECE:], held[1][PIECE:])
    if held is not None and len(held[0]):
        yield held


def _with_end(pieces: Iterator[Piece]) -> Iterator[Piece | None]:
    yield from pieces
    yield None


def insert_columns(code: np.ndarray, begin: np.ndarray, end: np.ndarray, need: np.ndarray, columns: Columns) -> tuple[np.ndarray, np.ndarray]:
    """(document, column) of the suffixes that share ``need`` symbols with a neighbour when their round is over.

    code: symbols from 1 on, a column a row; a document has those from ``begin`` to ``end``.
    From the last column to the first every document that has begun inserts one
    symbol. In front of all stand the documents' empty suffixes, which share nothing.
    The place of a new suffix is that of its symbol's block and the symbol's rank at
    the place of the suffix behind it; what it shares with its neighbours is one more
    than the least on the way between the two symbols.
    """
    m, sigma = len(begin), int(code.max(initial=0)) + 1
    layout = np.zeros((len(code) + 1, m), np.uint16)  # row of a column: behind the one in front of the first; 0: no text
    layout[1:] = code
    empty = np.zeros(m, np.uint16)  # symbols in front of the empty suffixes, once their documents have begun
    occurs = np.zeros(sigma, np.int64)
    starters = np.argsort(-end, kind="stable")
    starters = starters[end[starters] > begin[starters]]
    started = 0
    doc, at = np.zeros(0, np.int64), np.zeros(0, np.int64)
    found_doc, found_at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for column in range(len(code) - 1, -1, -1):
        stop = int(np.searchsorted(-end[starters], -column, "left"))
        fresh = np.sort(starters[started:stop])
        started = stop
        if len(fresh):
            empty[fresh] = layout[column + 1][fresh]
            occurs += np.bincount(empty[fresh], minlength=sigma)
            doc, at = np.concatenate([fresh, doc]), np.concatenate([fresh, at])
        if not len(doc):
            continue
        ranks, seen, asked = _Ranks(len(doc), sigma), 0, 0
        for number, (symbols, shared) in enumerate(columns.read()):
            if not number:
                symbols, shared = np.concatenate([empty, symbols]), np.concatenate([np.zeros(m, np.int16), shared])
            to = int(np.searchsorted(at, seen + len(symbols)))
            ranks.piece(symbols, shared, at[asked:to] - seen, asked)
            seen, asked = seen + len(symbols), to
        if not seen:
            ranks.piece(empty, np.zeros(m, np.int16), at, 0)
        symbol = layout[column + 1][doc]
        block = np.cumsum(occurs) - occurs - occurs[0]
        place = block[symbol] + ranks.rank
        turn = np.argsort(place)
        doc, place = doc[turn], place[turn]
        before, behind = ranks.before[turn] + np.int16(1), ranks.behind[turn] + np.int16(1)
        ahead = np.where(begin[doc] < column, layout[column][doc], 0).astype(np.uint16)
        columns.replace(_merged(columns.read(), place - np.arange(len(place)), ahead, before, behind))
        occurs += np.bincount(ahead, minlength=sigma)
        hit = np.maximum(before, behind) >= need[doc]
        found_doc.append(doc[hit])
        found_at.append(np.full(int(hit.sum()), column))
        go = begin[doc] < column
        doc, at = doc[go], place[go] + m
    columns.close()
    return np.concatenate(found_doc), np.concatenate(found_at)


def repeated_windows(strings: list[bytes], core: np.ndarray, size: np.ndarray, length: int, folder: str | None = None) -> list[np.ndarray]:
    """For each string the places whose ``length`` bytes hold its core and also stand around an equal core in another string.

    core, size: where a string's core begins and how long it is; a window that holds it
    begins at most ``length - size`` bytes before. The strings are the documents of a
    collection, lined up at their cores. A core is one symbol, the same for equal bytes,
    and every other byte is one; so a window is ``length - size + 1`` symbols, and
    windows that could be equal are inserted in one round.
    """
    m = len(strings)
    core, size = core.astype(np.int64), size.astype(np.int64)
    symbols: dict[bytes, int] = {}
    own = [symbols.setdefault(x[c : c + n], 257 + len(symbols)) for x, c, n in zip(strings, core.tolist(), size.tolist(), strict=True)]
    if len(symbols) > 65_000:
        raise ValueError("a collection has at most 65000 different cores")
    total = np.array([len(x) for x in strings], np.int64)
    middle = int(core.max(initial=0))
    begin, end = middle - core, middle + 1 + total - core - size
    text = np.frombuffer(b"".join(strings), np.uint8)
    row = np.repeat(np.arange(m), total)
    at = np.arange(len(text)) - np.repeat(np.cumsum(total) - total + core, total)
    side = (at < 0) | (at >= size[row])
    column = middle + np.where(at < 0, at, at - size[row] + 1)
    code = np.zeros((int(end.max(initial=0)), m), np.uint16)
    code[column[side], row[side]] = text[side] + np.uint16(1)
    code[middle] = own
    doc, column = insert_columns(code, begin, end, length - size + 1, Columns(folder if len(text) >= EXTERNAL else None))
    early = column <= middle
    doc, place = doc[early], column[early] - begin[doc[early]]
    turn = np.lexsort((place, doc))
    doc, place = doc[turn], place[turn]
    cuts = np.searchsorted(doc, np.arange(m + 1))
    return [place[cuts[i] : cuts[i + 1]] for i in range(m)]
