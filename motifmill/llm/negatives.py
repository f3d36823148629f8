"""Hard negatives by product quantisation with stored residual norms.

Vectors are made integers. A codebook for every ``SUB`` dimensions is fitted on a bounded
sample, its centres rounded to integers; every row is stored as one code for each
codebook, with the norm of what the codes leave out. For an anchor a table of its
products with all centres gives each row's approximate score by lookups, and by
Cauchy-Schwarz the exact score lies within the anchor's norm times the row's
residual norm around it. All of that is integer arithmetic, so bounds are rigorous:

1. Positives: in a block of rows, those of the anchor's label whose upper bound reaches
   the k-th best exact score so far are scored exactly, best bounds first.
2. Negatives: with a positive's score known, its window of scores is. Rows of other
   labels whose bounds touch the window are scored exactly, best bounds first, until
   no bound reaches the k-th best score found inside the window.

Anchors meet rows in blocks of both, dealt by row number; each block gives at
most k rows for an anchor (and positive), from which the best are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motifmill.plans.storage import materialize

#: Dimensions of a codebook, its centres, rows that codebooks are fitted on and rounds of fitting.
SUB, CENTRES, SAMPLE, ROUNDS = 2, 256, 4096, 8
#: Anchors and rows of a block, and rows of the smallest one, which small tables are cut into.
ANCHORS, ROWS, LEAST_ROWS = 4096, 1 << 15, 1024
#: Integer components below this bound, and dimensions up to that one, have products that fit a bigint.
LARGEST, MOST_DIMENSIONS = 1 << 26, 2048
#: Anchors whose tables are in memory at a time, and rows scored exactly at first.
_TABLES, _FIRST = 64, 64


def integers(vectors: DataFrame, *, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """id, label, x (array of bigint) of the rows that take part; x = floor(scale * component)."""
    x = F.col(vector_col)
    ints = F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(scale).cast("double")))
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * scale) < LARGEST - 1))
    named = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & good & (F.size(x) <= MOST_DIMENSIONS))
    return named.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), ints.alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix; shorter ones end with zeros."""
    size = np.asarray(column.value_lengths()).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), width), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


def fit(sample: np.ndarray) -> np.ndarray:
    """Integer centres by codebook (codebooks x CENTRES x SUB) from rows whose width is a multiple of SUB, by Lloyd's rounds from evenly spaced rows."""
    books = []
    for lo in range(0, sample.shape[1], SUB):
        part = sample[:, lo : lo + SUB].astype(np.float64)
        kinds = np.unique(part, axis=0)
        centres = kinds[np.linspace(0, len(kinds) - 1, CENTRES).astype(np.int64)]
        for _ in range(ROUNDS):
            of = _nearest(part, centres)
            count = np.bincount(of, minlength=CENTRES)
            sums = np.stack([np.bincount(of, part[:, k], CENTRES) for k in range(SUB)], 1)
            centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        books.append(np.rint(centres).astype(np.int64))
    return np.stack(books) if books else np.zeros((0, CENTRES, SUB), np.int64)


def _nearest(part: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(part), np.int64)
    for lo in range(0, len(part), 8192):
        p = part[lo : lo + 8192]
        out[lo : lo + 8192] = ((centres * centres).sum(axis=1)[None, :] - 2 * (p @ centres.T)).argmin(axis=1)
    return out


def encode(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared norms of the residuals) of integer rows."""
    codes = np.zeros((len(x), len(books)), np.uint8)
    left = np.zeros(len(x), np.float64)
    for j, centres in enumerate(books):
        part = x[:, j * SUB : (j + 1) * SUB]
        codes[:, j] = _nearest(part.astype(np.float64), centres.astype(np.float64))
        gap = (part - centres[codes[:, j]]).astype(np.float64)
        left += (gap * gap).sum(axis=1)
    return codes, left


def _coded(items: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """uid, id, label, x (packed integers), codes (packed), left (squared residual norm) of every row."""
    padded = len(books) * SUB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros((batch.num_rows, padded), np.int64)
            x[:, :width] = _matrix(batch.column(3), width)
            codes, left = encode(x, books)
            packed = x.astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in packed], pa.binary()), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(left)], ["uid", "id", "label", "x", "codes", "left"])

    return items.select("uid", "id", "label", "x").mapInArrow(run, "uid long, id long, label long, x binary, codes binary, left double")


class _Block:
    """Rows of one block, their bounds for one anchor, and exact scores on demand."""

    def __init__(self, rows: pa.Table, books: np.ndarray):
        self.uid, self.id, self.label = (rows.column(c).to_numpy() for c in ("uid", "id", "label"))
        n = len(self.uid)
        self.x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.int32).reshape(n, -1)
        self.codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(n, -1)
        self.left = rows.column("left").to_numpy()
        self.books = books
        self.large = np.abs(books).max(axis=(1, 2)) if len(books) else np.zeros(0, np.int64)

    def approximate(self, anchors: np.ndarray) -> np.ndarray:
        """Scores of the rows' centres (rows x anchors), a lookup for each codebook."""
        most = int((np.abs(anchors).reshape(len(anchors), len(self.books), SUB).sum(axis=2) * self.large).sum(axis=1).max(initial=0))
        kind = np.int32 if most < 2**31 else np.int64
        out = np.zeros((len(self.uid), len(anchors)), kind)
        for j, centres in enumerate(self.books):
            table = (centres @ anchors[:, j * SUB : (j + 1) * SUB].T).astype(kind)
            out += table[self.codes[:, j]]
        return out

    def reach(self, anchor: np.ndarray) -> np.ndarray:
        """How far at most a row's score lies from that of its centres."""
        return (np.sqrt((anchor.astype(np.float64) ** 2).sum() * self.left) * (1 + 1e-9)).astype(np.int64) + 1

    def best(self, anchor: np.ndarray, rows: np.ndarray, high: np.ndarray, k: int, least: int | None = None, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the k best out of ``rows`` with scores from ``least`` to ``most``, by score and then id; high: upper bounds of all rows."""
        rows = rows[np.argsort(-high[rows], kind="stable")]
        got, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, step = 0, _FIRST
        while at < len(rows) and not (len(score) >= k and high[rows[at]] < score[k - 1]):
            part = rows[at : at + step]
            exact = self.x[part].astype(np.int64) @ anchor
            inside = np.ones(len(part), bool)
            if least is not None:
                inside = (exact >= least) & (exact <= most)
            got, score = np.append(got, part[inside]), np.append(score, exact[inside])
            order = np.lexsort((self.id[got], -score))[:k]
            got, score = got[order], score[order]
            at, step = at + step, step * 2
        return got, score


def _anchor_rows(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("x").to_pylist()), np.int32).reshape(table.num_rows, -1).astype(np.int64)


def _positives(books: np.ndarray, k: int):
    """Rows of a block and a block of anchors -> anchor, row, score: the k best other rows of the same label."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if rows.num_rows and anchors.num_rows:
            block, x = _Block(rows, books), _anchor_rows(anchors)
            uid, label = anchors.column("uid").to_numpy(), anchors.column("label").to_numpy()
            for lo in range(0, len(x), _TABLES):
                near = block.approximate(x[lo : lo + _TABLES])
                for a in range(lo, min(lo + _TABLES, len(x))):
                    alike = np.flatnonzero((block.label == label[a]) & (block.uid != uid[a]))
                    got, score = block.best(x[a], alike, near[:, a - lo] + block.reach(x[a]), k)
                    out.append((np.full(len(got), uid[a]), block.id[got], score))
        a, i, s = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"anchor": a, "positive_id": i, "positive_score": s})

    return run


def _negatives(books: np.ndarray, k: int, low: int, high: int):
    """Rows of a block and a block of anchors with the scores of their positives -> anchor, positive's rank, row, score: the k best inside each window."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if rows.num_rows and anchors.num_rows:
            block, x = _Block(rows, books), _anchor_rows(anchors)
            uid, label = anchors.column("uid").to_numpy(), anchors.column("label").to_numpy()
            positives = anchors.column("positives").to_pylist()
            for lo in range(0, len(x), _TABLES):
                near = block.approximate(x[lo : lo + _TABLES])
                for a in range(lo, min(lo + _TABLES, len(x))):
                    reach = block.reach(x[a])
                    above, below = near[:, a - lo] + reach, near[:, a - lo] - reach
                    other = block.label != label[a]
                    for score, ranks in _by_score(positives[a]).items():
                        least, most = -(-low * score // 100), high * score // 100
                        if least > most:
                            continue
                        got, found = block.best(x[a], np.flatnonzero(other & (above >= least) & (below <= most)), above, k, least, most)
                        for r in ranks:
                            out.append((np.full(len(got), uid[a]), np.full(len(got), r), block.id[got], found))
        a, r, i, s = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4
        return pa.table({"anchor": a, "positive_rank": pa.array(r, pa.int32()), "negative_id": i, "negative_score": s})

    return run


def _by_score(positives: list[dict]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for p in positives:
        out.setdefault(p["positive_score"], []).append(p["positive_rank"])
    return out


def _in_blocks(rows: DataFrame, anchors: DataFrame, blocks: int, anchor_blocks: int):
    """Rows and anchors cogrouped, every block of the one with every block of the other."""
    every = lambda n: F.explode(F.expr(f"sequence(0, {n - 1})"))
    deal = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    left = rows.withColumn("block", deal(blocks)).withColumn("anchor_block", every(anchor_blocks))
    right = anchors.withColumn("anchor_block", deal(anchor_blocks)).withColumn("block", every(blocks))
    return left.groupBy("block", "anchor_block").cogroup(right.groupBy("block", "anchor_block"))


def mine(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchors: str = "id % 100 = 0", relabel: str | None = None, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its best other rows of the same label the best rows of other labels whose score is from ``low`` to ``high`` percent of the positive's.

    anchors: a condition on ``id`` and ``label``; relabel: a new label as an expression of
    both. Scores are integer inner products of floor(scale * component); higher ones
    come first, then smaller ids. Rows without an id, label or vector, with null or
    non-finite components, with components of 2**26 / scale and above or more than 2048
    dimensions (their products leave a bigint) take no part. Shorter vectors end with
    zeros; empty ones score 0. Rows that repeat an id are rows of their own, as
    anchors, positives and negatives. Anchors without positives, and positives without
    negatives inside their window, give no rows; so does an empty table. Other
    columns, whatever their names, are not read.
    """
    spark = vectors.sparkSession
    items = integers(vectors, id_col=id_col, vector_col=vector_col, label_col=label_col, scale=scale)
    if relabel:
        items = items.withColumn("label", F.expr(relabel).cast("long"))
    items = items.withColumn("uid", F.monotonically_increasing_id())
    items = materialize(items, "integer-vectors")
    anchor = F.expr(anchors)
    n, asked, width = items.agg(F.count(F.lit(1)), F.count(F.when(anchor, 1)), F.max(F.size("x"))).first()
    if not asked:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    sample = items.orderBy(F.xxhash64("uid", "id")).limit(SAMPLE).select("x").toArrow()
    padded = -(-width // SUB) * SUB
    x = np.zeros((sample.num_rows, padded), np.int64)
    x[:, :width] = _matrix(sample.column("x").combine_chunks(), width)
    books = fit(x)
    coded = materialize(_coded(items, books, width), "coded-vectors")
    asking = materialize(coded.where(anchor).select("uid", "id", "label", "x"), "anchors")
    blocks = max(-(-n // ROWS), min(2 * spark.sparkContext.defaultParallelism, -(-n // LEAST_ROWS)))
    anchor_blocks = -(-asked // ANCHORS)
    near = _in_blocks(coded, asking, blocks, anchor_blocks).applyInArrow(_positives(books, positives), "anchor long, positive_id long, positive_score long")
    ranked = near.withColumn("positive_rank", F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")))
    best = materialize(ranked.where(F.col("positive_rank") <= positives), "positives")
    windows = best.groupBy("anchor").agg(F.collect_list(F.struct("positive_rank", "positive_score")).alias("positives"))  # at most ``positives`` an anchor
    asking = materialize(asking.join(windows.withColumnRenamed("anchor", "uid"), "uid"), "anchors-with-positives")
    found = _in_blocks(coded, asking, blocks, anchor_blocks).applyInArrow(_negatives(books, negatives, low, high), "anchor long, positive_rank int, negative_id long, negative_score long")
    order = Window.partitionBy("anchor", "positive_rank").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    names = asking.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id"))
    out = found.join(best, ["anchor", "positive_rank"]).join(names, "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: What op11_hard_negatives gives.
NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, (row_number() OVER w)::INTEGER AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 10
"""
