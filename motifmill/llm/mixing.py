"""Mixing sources to target weights with hash-threshold histograms, in DataFrame operations only.

Every document has a 36-bit hash of its id and text. Of a source's documents, those whose
hash lies below the source's threshold are taken once more than the others. The
threshold comes from nested histograms: words by source and the hash's first 12
bits, then only inside the bucket where the running sum crosses the budget the
next 12 bits, then the last 12. No documents are sorted, and a source's rows meet
in no task: every histogram is a sum with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifmill.plans.storage import materialize, small_side

LEVELS, BITS = 3, 12
WORD = r"[^\x20\x09-\x0D]+"


def doc_hash(id_col: Column, text: Column) -> Column:
    """36-bit hash of the id's decimal text and the text; null counts as empty."""
    both = F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, 9), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    """Number of runs of characters that are not ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...], budget: float, cap: int) -> DataFrame:
    """no_source, source, source_size, target from no_source, source, source_size.

    The sources share budget * all words by weight; a target stops at cap * its
    source's words and the excess goes to the others by weight. In order of
    cap * words / weight the sources that stop come first, so running sums find the
    level without iterating. The windows run over one row per source.
    """
    named = Window.orderBy("no_source", "source")
    everything = Window.partitionBy()
    level = Window.orderBy("ratio", "rank")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    ranked = totals.withColumn("rank", F.row_number().over(named)).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * cap).withColumn("ratio", F.col("most").cast("double") / F.col("weight"))
    summed = ranked.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(float(budget))).alias("total"),
        F.sum("weight").over(everything).alias("weights"),
        F.coalesce(F.sum("most").over(before), F.lit(0)).alias("stopped"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("stopped_weight"),
        F.row_number().over(level).alias("place"),
    )
    share = (F.col("total") - F.col("stopped")) / (F.col("weights") - F.col("stopped_weight"))
    found = summed.withColumn("share", share).withColumn("first", F.min(F.when(F.col("share") <= F.col("ratio"), F.struct("place", "share"))).over(everything))
    target = F.least(F.col("most").cast("double"), F.coalesce(F.col("first.share") * F.col("weight"), F.col("most").cast("double")))
    return found.select("no_source", "source", "source_size", target.alias("target"))


def _crossing(hist: DataFrame, keys: list[str]) -> DataFrame:
    """The bucket of each source in which the running sum, counted from ``below``, reaches ``rest``."""
    running = Window.partitionBy("no_source", "source").orderBy("bucket")
    upto = F.col("below") + F.sum("words").over(running)
    crossed = hist.withColumn("upto", upto).withColumn("start", F.col("upto") - F.col("words")).where((F.col("start") < F.col("rest")) & (F.col("rest") <= F.col("upto")))
    return crossed.select(*keys, "rest", "bucket", F.col("start").alias("below"), "upto")


def mix_plan(sized: DataFrame, weights: tuple[int, ...], budget: float, cap: int) -> DataFrame:
    """One row per source: no_source, source, source_size, target, full (whole passes), threshold. sized: no_source, source, size, hash."""
    keys = ["no_source", "source"]
    top = BITS * (LEVELS - 1)
    hist = materialize(sized.groupBy(*keys, F.shiftright("hash", top).alias("bucket")).agg(F.sum("size").alias("words")), "mix-histogram")
    plan = source_targets(hist.groupBy(*keys).agg(F.sum("words").alias("source_size")), weights, budget, cap)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = materialize(plan.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")), "mix-targets")
    at = _crossing(hist.join(small_side(plan.select(*keys, "rest")), keys).withColumn("below", F.lit(0).cast("long")), keys)
    for level in range(1, LEVELS):
        at = materialize(at, f"mix-level{level}")
        shift = BITS * (LEVELS - 1 - level)
        inside = sized.join(small_side(at.select(*keys, "rest", "below", F.col("bucket").alias("outer"))), keys).where(F.shiftright("hash", shift + BITS) == F.col("outer"))
        hist = inside.groupBy(*keys, "rest", "below", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        at = _crossing(hist, keys)
    # the last bucket is taken if that comes nearer to the budget
    last = at.select(*keys, (F.col("bucket") + F.when(F.col("rest") * 2 > F.col("below") + F.col("upto"), 1).otherwise(0)).alias("threshold"))
    out = plan.join(last, keys, "left").select(*keys, "source_size", "target", "full", F.coalesce("threshold", F.lit(0)).alias("threshold"))
    return materialize(out, "mix-plan")


def _keys(source: Column) -> list[Column]:
    return [source.isNull().alias("no_source"), F.coalesce(source.cast("string"), F.lit("")).alias("source")]


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, cap: int = 2) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words that the mix takes of every document.

    Sources in order of code point, null last, have ``weights`` in turn. A null text
    has size 0; rows with equal ids (null too) and equal texts share a hash and are
    taken alike, so a source's words miss its target by half the words of such a
    group at most; an empty table gives no rows; other columns, whatever their names,
    are not read.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), *_keys(F.col(source_col)), word_count(F.col(text_col)).alias("size"), doc_hash(F.col(id_col), F.col(text_col)).alias("hash"))
    sized = materialize(sized, "mix-sized")
    plan = mix_plan(sized.select("no_source", "source", "size", "hash"), weights, budget, cap)
    copies = F.col("full") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)
    return sized.join(small_side(plan), ["no_source", "source"]).select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"))


def mix_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", copies_col: str = "mix_copies", weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, cap: int = 2) -> DataFrame:
    """The rows of ``docs`` that the mix takes at least once, with the number of times in ``copies_col``.

    All columns stay, but one named as ``copies_col``, which is replaced. The texts are
    read where they lie: only sums by source and hash bucket are shuffled. Rows without
    words, null texts too, have nothing to take and go; repeated rows are taken alike;
    a null source is one; an empty table stays empty.
    """
    columns = [F.col(f"row.{F_name(c)}").alias(c) for c in docs.columns if c != copies_col]
    sized = docs.select(*_keys(F.col(source_col)), word_count(F.col(text_col)).alias("size"), doc_hash(F.col(id_col), F.col(text_col)).alias("hash"))
    plan = mix_plan(materialize(sized, "mix-sized"), weights, budget, cap)
    held = docs.select(*_keys(F.col(source_col)), doc_hash(F.col(id_col), F.col(text_col)).alias("hash"), word_count(F.col(text_col)).alias("size"), F.struct(*[F.col(F_name(c)) for c in docs.columns]).alias("row"))
    copies = (F.col("full") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)).cast("long")
    return held.join(small_side(plan.select("no_source", "source", "full", "threshold")), ["no_source", "source"]).where((copies > 0) & (F.col("size") > 0)).select(*columns, copies.alias(copies_col))


def F_name(column: str) -> str:  # noqa: N802
    """A column name that may hold dots or blanks, quoted."""
    return "`" + column.replace("`", "``") + "`"


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 9))::BIGINT AS h
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END) AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM totals),
ratios AS (SELECT *, source_size * 2 AS most, (source_size * 2)::DOUBLE / w AS ratio FROM weighed),
levels AS (
  SELECT *, row_number() OVER lv AS place, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS total, sum(w) OVER () AS ws,
         coalesce(sum(most) OVER (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st,
         coalesce(sum(w) OVER (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stw
  FROM ratios WINDOW lv AS (ORDER BY ratio, rk)),
shares AS (SELECT *, (total - st::DOUBLE) / (ws - stw)::DOUBLE AS share FROM levels),
level AS (SELECT arg_min(share, place) AS share FROM shares WHERE share <= ratio),
targets AS (
  SELECT s.source, s.source_size, least(s.most::DOUBLE, coalesce(l.share * s.w, s.most::DOUBLE)) AS target
  FROM shares s CROSS JOIN level l),
rests AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
units AS (
  SELECT s.source, s.h, sum(s.size) AS words FROM sized s GROUP BY s.source, s.h),
running AS (
  SELECT u.*, sum(u.words) OVER (PARTITION BY u.source ORDER BY u.h) AS upto FROM units u),
taken AS (
  SELECT r.source, r.h, 2 * (t.target - t.whole * t.source_size) > (r.upto - r.words) + r.upto AS more
  FROM running r JOIN rests t ON r.source IS NOT DISTINCT FROM t.source)
SELECT s.doc_id, s.size, t.source_size, t.target,
       (s.size * (t.whole + CASE WHEN k.more THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN rests t ON s.source IS NOT DISTINCT FROM t.source
JOIN taken k ON k.source IS NOT DISTINCT FROM s.source AND k.h = s.h
"""
