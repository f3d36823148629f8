"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifmill.llm import textscan as ts

#: Bytes of text that one call of the library gets, and the length from which a text is split.
BATCH_BYTES = 1 << 19
PIECE_BYTES = 1 << 15

#: A blank behind a character that is neither white space nor the library's own blank mark, and before some more text.
_BOUNDARY = re.compile(r"(?<=[^\s▁]) (?=.)", re.DOTALL)


def split_safely(text: str, size: int = PIECE_BYTES) -> list[str]:
    """Cut a text into pieces of about ``size`` bytes so that their token counts add up to the text's.

    A piece begins behind a single blank that follows a visible character: the
    encoder puts a blank mark before every piece, which stands for the dropped
    blank, and no vocabulary entry has a blank mark behind another character
    (checked by ``_splits``), so that no merge crosses the cut. A text without
    such blanks stays whole.
    """
    step = max(1, size * len(text) // max(1, len(text.encode())))  # characters of that many bytes, on the text's average
    out, lo = [], 0
    while len(text) - lo > step:
        cut = _BOUNDARY.search(text, lo + step)
        if not cut:
            break
        out.append(text[lo : cut.start()])
        lo = cut.end()
    return [*out, text[lo:]]


@lru_cache(maxsize=4)
def _model(path: str):
    """(encode a list of strings to lengths, may texts be split?) of a .model or .json file."""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
        plain = not any(re.search("[^▁]▁", p) for p in pieces)
        probe = "a b  c\n d"  # the normaliser must keep blanks and put one in front
        same = sp.decode(sp.encode(probe)) == probe and sp.encode("a b") == sp.encode("a") + sp.encode("b")
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)], plain and same
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return lambda texts: [len(x) for x in tok.encode_batch(texts, add_special_tokens=False)], False


def count_tokens(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each;
    a null id stays null; an empty table gives no rows; other columns of ``docs``,
    whatever their names, are not read. The plan is one scan without a shuffle: a call
    of the library gets at most BATCH_BYTES and one text, whatever the number of rows,
    and a .model's texts over PIECE_BYTES are cut where no token can cross (those of a
    .json file stay whole). ``model_path`` must exist on every executor.
    """
    ids = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, splits = _model(model_path)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            counts = [0] * batch.num_rows
            for lo, hi, _, _ in ts.slices(batch.column(1), BATCH_BYTES):
                pieces, owner, held = [], [], 0
                for i, text in enumerate(batch.column(1).slice(lo, hi - lo).to_pylist(), lo):
                    parts = split_safely(text) if text and splits else [text] if text else []
                    for part in parts:  # a long text's pieces go in several calls
                        own = int(sizes[i]) if len(parts) == 1 else len(part.encode())
                        if pieces and held + own > BATCH_BYTES:
                            for o, n in zip(owner, encode(pieces), strict=True):
                                counts[o] += n
                            pieces, owner, held = [], [], 0
                        pieces.append(part)
                        owner.append(i)
                        held += own
                for o, n in zip(owner, encode(pieces) if pieces else [], strict=True):
                    counts[o] += n
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"doc_id {ids}, n_bytes long, n_tokens long, over_limit boolean")
