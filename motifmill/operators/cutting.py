"""Cutting texts into overlapping pieces, in time linear in their length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places of the pieces of each level above the last one: a substring's cost grows with its distance from its text's beginning.
LEVELS = (1 << 20, 1 << 14, 1 << 10)
#: Bytes from which on a text's pieces are dealt out to other tasks.
SPREAD = 1 << 20


def most_bytes(texts: DataFrame, text_col: str) -> int:
    """Bytes of the longest text."""
    return texts.agg(F.max(F.octet_length(text_col))).first()[0] or 0


def pieces(texts: DataFrame, id_col: str, text_col: str, size: int, behind: int, longest: int | None = None) -> DataFrame:
    """id, base, part: pieces of ``size`` places and ``behind`` more symbols, from base (0-based) on; a place belongs to the piece in which it lies.

    Bases are multiples of ``size``. Texts of one-byte symbols are cut as bytes first,
    all of them level by level. Where a text is longer than SPREAD, the pieces of the last level but the
    wanted one are dealt out by a hash, so that one large text keeps all tasks busy. longest: ``most_bytes`` of the texts, where it is known already.
    """
    longest = most_bytes(texts, text_col) if longest is None else longest
    plain = F.octet_length(text_col) == F.length(text_col)
    out = texts.where(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("base"), F.col(text_col).alias("part"), F.length(text_col).alias("places"), F.when(plain, F.col(text_col).cast("binary")).alias("raw"))
    levels = [n // size * size for n in LEVELS if n > size and n >= 4 * size]
    for step in [*levels, size]:
        at = F.col("k") * step
        counted = out.withColumn("k", F.explode(F.expr(f"sequence(0, (places - 1) div {step})").cast("array<int>")))
        part = F.substring("part", at + 1, F.lit(step + behind))
        if "raw" in out.columns:
            part = F.when(F.col("raw").isNotNull(), F.substring("raw", at + 1, F.lit(step + behind)).cast("string")).otherwise(part)
        out = counted.select("id", (F.col("base") + at).alias("base"), part.alias("part"), F.least(F.lit(step), F.col("places") - at).alias("places"))
        if longest > SPREAD and levels and step == levels[-1]:
            out = out.repartition(F.col("id"), F.col("base"))
    return out.select("id", "base", "part")
