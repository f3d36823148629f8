"""Symbol, pair and k-mer codes as Catalyst expressions. What holds a symbol outside the alphabet has no code: null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHABET = "ACGT"


def symbol_code(symbol: Column, alphabet: str = ALPHABET) -> Column:
    """0, 1, ... by the alphabet; null for anything else, the end marker too."""
    at = F.instr(F.lit(alphabet), symbol)
    return F.when((F.length(symbol) == 1) & (at > 0), at - 1).cast("int")


def pair_code(first: Column, second: Column) -> Column:
    """0 to 15: four times the first symbol's code and the second one's."""
    return 4 * symbol_code(first) + symbol_code(second)


def is_coded(seq: Column, alphabet: str = ALPHABET) -> Column:
    """Does a text hold symbols of the alphabet only?"""
    return F.length(F.translate(seq, alphabet, "")) == 0


def code_digits(seq: Column, alphabet: str = ALPHABET) -> Column:
    """A digit for each symbol."""
    return F.when(is_coded(seq, alphabet), F.translate(seq, alphabet, "".join(map(str, range(len(alphabet))))))


def kmer_code(kmer: Column) -> Column:
    """Base-4 number of a k-mer over ACGT, the last symbol least significant; k up to 31."""
    return F.conv(code_digits(kmer), 4, 10).cast("long")


def kmer_text(code: Column, k: int) -> Column:
    """The k-mer of a code."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", ALPHABET)


def packed_symbol(word: Column, place: Column, bits: int = 2, word_bits: int = 32) -> Column:
    """Code at a place (from 0, the highest bits first) of a packed word."""
    shift = F.lit(word_bits - bits) - place * bits
    return F.call_function("shiftrightunsigned", word.cast("long"), shift.cast("int")).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def unpacked(words: DataFrame, lengths: DataFrame, size: int) -> DataFrame:
    """contig_id, piece, codes: digits of ``size`` symbols (a multiple of 16) a row out of words of 16 symbols. words: contig_id, word_no, word; lengths: contig_id, n.

    Words meet in groups of ``size`` symbols and know by their number alone which piece
    they belong to; only the last one of a contig needs its length.
    """
    if size < 16 or size % 16:
        raise ValueError("size must be a multiple of 16")
    n, first = F.col("n"), F.col("piece") * size
    digits = F.aggregate(F.sort_array("r"), F.lit(""), lambda all_, x: F.concat(all_, F.lpad(F.conv(x["word"].cast("string"), 10, 4), 16, "0")))
    held = words.groupBy("contig_id", F.expr(f"word_no div {size // 16}").alias("piece")).agg(F.collect_list(F.struct("word_no", "word")).alias("r"))
    return held.join(lengths, "contig_id").select("contig_id", "piece", F.substring(digits, F.lit(1), F.least(F.lit(size), n - first).cast("int")).alias("codes"))


def folded(seq: Column, normalize: str | None = None) -> Column:
    """``normalize`` = 'upper' makes matching blind to case; None leaves symbols as they are."""
    if normalize not in (None, "upper"):
        raise ValueError("normalize must be None or 'upper'")
    return seq if normalize is None else F.upper(seq)


def count_symbol(seq: Column, symbol: str) -> Column:
    """Occurrences of one symbol, without a row for each."""
    return (F.length(seq) - F.length(F.translate(seq, symbol, ""))).cast("long")


def bits_per_symbol(symbols: Column) -> Column:
    return F.ceil(F.log2(symbols)).cast("int")


def ceil_div(x: Column, y: Column) -> Column:
    return F.floor((x + y - 1) / y).cast("long")
