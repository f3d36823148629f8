"""Licence scans: Aho-Corasick finds notice phrases and identifier tags, a shunting-yard parser evaluates the tags' expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifmill.llm import textscan as ts

#: Notice phrases (lower-case words) and their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Phrases that the method adds.
MORE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
#: The tag in front of a licence expression, as words; what stands between it and the expression; a word of the scan.
TAG_WORDS = "spdx license identifier"
_COLON, _LINE, _WORD = re.compile(rb"[ \t]*:[ \t]*"), re.compile(rb"[^\r\n]*"), re.compile(rb"[^ ]+")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_RANK = {"or": 1, "and": 2, "with": 3}
#: Identifiers, and the beginnings of identifiers, that let a reader use the text freely.
FREE = {"mit", "mit-0", "isc", "zlib", "unlicense", "wtfpl", "0bsd", "bsl-1.0", "ncsa", "postgresql"}
FREE_FAMILIES = ("apache-", "bsd-", "cc0-", "cc-by-1", "cc-by-2", "cc-by-3", "cc-by-4", "python-", "psf-")
#: Beginnings of other identifiers that are known as such.
KNOWN_FAMILIES = FREE_FAMILIES + ("gpl-", "lgpl-", "agpl-", "gfdl-", "mpl-", "epl-", "eupl-", "cddl-", "cecill-", "artistic-", "ofl-", "osl-", "ms-", "busl-", "cc-by-", "licenseref-")

#: What a find adds to the certainty that a text states a licence.
CERTAIN = {"free tag": 0.9, "tag": 0.8, "base": 0.75, "more": 0.5}

#: Bytes to one word alphabet: A-Z lowered; 0-9, a-z and all non-ASCII bytes stay; the rest separates.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def is_free(identifier: str) -> bool:
    return identifier in FREE or identifier.startswith(FREE_FAMILIES)


def is_known(identifier: str) -> bool:
    return identifier in FREE or identifier.startswith(KNOWN_FAMILIES)


def longest_expression(text: str) -> list[str]:
    """Tokens of the longest well-formed beginning; none if there is none.

    ``with`` stands between two identifiers. Behind ``and`` or ``or`` in small letters,
    which prose uses too, only identifiers that are known are operands.
    """
    tokens = _TOKEN.findall(text)
    operand, depth, prose, whole, linked = True, 0, False, 0, ""
    for i, token in enumerate(tokens):
        low = token.lower()
        if low in _RANK:
            if operand or low == "with" and (tokens[i - 1] == ")" or linked == "with"):
                break
            operand, linked, prose = True, low, low != "with" and token == low
        elif token == "(":
            if not operand or linked == "with":
                break
            depth, linked = depth + 1, ""
        elif token == ")":
            if operand or not depth:
                break
            depth -= 1
        else:
            if not operand or prose and not is_known(low):
                break
            operand, prose = False, False
        if not operand and not depth:
            whole = i + 1
    return tokens[:whole]


def parse_expression(text: str) -> tuple[set[str], bool] | None:
    """(labels, free?) of the longest well-formed beginning of a licence expression; None if there is none.

    Shunting-yard over ``or`` < ``and`` < ``with`` and parentheses. An identifier is its
    own label, and free as ``is_free`` has it. ``and`` binds to both sides: all their
    labels, free if both are. ``or`` lets the reader choose: of a free side and one
    that is not, the free one's labels; else both sides'. Two identifiers with ``with``
    between them are one label, as free as the first. What follows the longest
    well-formed beginning, such as the end of a comment, an operator without a second
    side or an open parenthesis, is left. Labels are at most as many as identifiers.
    """
    queue, stack = [], []
    for token in longest_expression(text):
        low = token.lower()
        if low in _RANK:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                queue.append(stack.pop())
            stack.append(low)
        elif token == "(":
            stack.append(token)
        elif token == ")":
            while stack[-1] != "(":
                queue.append(stack.pop())
            stack.pop()
        else:
            queue.append((low,))
    values: list[tuple[set[str], bool]] = []  # labels, free?
    for item in [*queue, *reversed(stack)]:
        if isinstance(item, tuple):
            values.append(({item[0]}, is_free(item[0])))
            continue
        (right, right_free), (left, left_free) = values.pop(), values.pop()
        if item == "with":
            values.append(({f"{left.pop()} with {right.pop()}"}, left_free))
        elif item == "or" and left_free != right_free:
            values.append((left if left_free else right, True))
        else:
            large, small = (left, right) if len(left) >= len(right) else (right, left)
            large |= small
            values.append((large, left_free and right_free))
    return values[0] if values else None


def tagged_expressions(raw: bytes, folded: bytes, ends: list[int]) -> Iterator[str]:
    """What stands on the line behind each tag and a colon. ends: number of each tag's last word."""
    words = _WORD.finditer(folded)
    at = -1
    for end in ends:
        while at < end:
            word, at = next(words), at + 1
        if colon := _COLON.match(raw, word.end()):
            yield _LINE.match(raw, colon.end())[0].decode("utf-8", "replace")


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    auto = ahocorasick.Automaton()
    for kind, phrases in (("more", MORE_PHRASES), ("base", BASE_PHRASES), ("tag", {TAG_WORDS: ""})):
        for phrase, label in phrases.items():
            auto.add_word(f" {phrase} ", (kind, label, len(phrase) + 2))
    auto.make_automaton()
    return auto


def scan_text(raw: bytes) -> tuple[int, int, int | None, int | None, str, str, float, bool | None]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score and free of one text."""
    folded = raw.translate(_FOLD)
    found = folded.split()
    line = " " + b" ".join(found).decode("latin-1") + " "
    hits = list(_automaton().iter(line)) if found else []
    base = sorted(end + 1 - size for end, (kind, _, size) in hits if kind == "base")
    first = last = None
    if base:
        first = line.count(" ", 0, base[0])
        last = first + line.count(" ", base[0], base[-1])
    base_labels = {label for _, (kind, label, _) in hits if kind == "base"}
    labels = base_labels | {label for _, (kind, label, _) in hits if kind == "more"}
    kinds = {(kind, label) for _, (kind, label, _) in hits if kind != "tag"}
    free = None
    if tags := [end for end, (kind, _, _) in hits if kind == "tag"]:
        number, before, ends = -1, 0, []
        for end in tags:  # blanks in front of a word count the words before it
            number += line.count(" ", before, end)
            ends.append(number)
            before = end
        for expression in tagged_expressions(raw, folded, ends):
            if got := parse_expression(expression):
                labels |= {x.replace(",", "") for x in got[0]}
                kinds |= {("free tag" if got[1] else "tag", x) for x in got[0]}
                free = got[1] if free is None else free and got[1]
    doubt = 1.0
    for kind, _ in sorted(kinds):
        doubt *= 1 - CERTAIN[kind]
    return len(found), len(base), first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), round(1 - doubt, 6), free


def scan_licences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and free of every whole text.

    free: may the text be used freely by every expression behind an identifier tag?
    Null without one. One scan without a shuffle. Null and empty texts have no words,
    empty label lists and score 0; repeated rows are scanned each; a null id stays
    null; an empty table gives no rows; other columns, whatever their names, are not
    read.
    """
    ids = docs.schema[id_col].dataType.simpleString()
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.bool_()]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "free"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lo, hi, data, offsets in ts.slices(batch.column(1)):
                raw = data.tobytes()
                rows += [scan_text(raw[offsets[i] : offsets[i + 1]]) for i in range(hi - lo)]
            columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"doc_id {ids}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, free boolean")
