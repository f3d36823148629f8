"""MinHash near-dedup with sequential Bayesian verification.

1. Sketch: one scan computes every document's number of different word shingles, the
   MinHash signature of their hashes and a BLAKE2b digest of its words. Documents with equal
   words are one class; only the class's first document goes on.
2. Candidates: classes that share a band of the signature. In every bucket all are
   compared with one leader, the member that has most company in its other buckets:
   in a group of near copies that is the text that the others come from, and it
   resolves most of the group with one pair a member.
3. Verification: signatures are compared in batches. After each batch a pair goes if
   the posterior probability that its similarity reaches the threshold is below
   ``miss``. What is left is verified on the full sets, whose shingles are BLAKE2b digests
   of their words under a key of the run; the quick hashes of the sketches decide no link.
4. What the leaders did not connect: in a bucket that holds several components, the
   members outside the largest one are compared with all members of other
   components, block against block, and verified alike, by the executor that holds
   the block. No other pair can change a component, members of the largest one do
   not meet each other, and only links that join components leave a block.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifmill.llm import corpus as co
from motifmill.llm import minhash as mh
from motifmill.llm import textscan as ts
from motifmill.llm.components import components
from motifmill.plans.storage import discard, materialize, small_side

U64 = np.uint64
#: Signature values, and those compared at a time.
WIDTH, BATCH = 96, 16
#: Chance at most that a pair right at the threshold shares no band.
LOST = 4e-6
#: Members of a bucket, and shingles in their sets, that make one block of it.
BLOCK, BLOCK_SHINGLES = 4096, 1 << 20
MISS = 1e-9


def banding(percent: int, width: int = WIDTH, lost: float = LOST) -> tuple[int, int]:
    """(rows, bands): the longest bands of which a pair at the threshold misses all with probability ``lost`` at most.

    With t = percent / 100 that is (1 - t ** rows) ** bands. Where even bands of one
    row out of ``width`` would lose more, there are as many as it takes.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    t = percent / 100
    for rows in range(8, 0, -1):
        if (1 - t**rows) ** (width // rows) <= lost:
            return rows, width // rows
    return 1, ceil(log(lost) / log(1 - t))


@lru_cache(maxsize=16)
def least_matches(n: int, percent: int, miss: float) -> int:
    """Matches out of n from which a pair stays: P(similarity >= threshold | matches) >= miss under a uniform prior.

    The posterior is Beta(matches + 1, n - matches + 1), whose upper tail at t is the
    chance of at most ``matches`` successes in n + 1 draws with probability t.
    """
    t, tail = percent / 100, 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def similar_enough(x: np.ndarray, y: np.ndarray, percent: int, miss: float) -> np.ndarray:
    """Rows of two signature matrices that are not pruned in any batch."""
    alive, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
    for lo in range(0, x.shape[1], BATCH):
        matches += (x[alive, lo : lo + BATCH] == y[alive, lo : lo + BATCH]).sum(axis=1)
        stay = matches >= least_matches(min(lo + BATCH, x.shape[1]), percent, miss)
        alive, matches = alive[stay], matches[stay]
    return alive


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """Bucket keys of every signature (a row each), one a band."""
    bands = sig.shape[1] // rows
    values = sig.reshape(len(sig), bands, rows).astype(U64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U64), (len(sig), bands)).copy()
    for r in range(rows):
        key = ts.pair(key, values[:, :, r])
    return ts.mix(key).view(np.int64)


def sketches(docs: DataFrame, words: int, rows: int, bands: int) -> DataFrame:
    """uid, doc_id, n_shingles, digest (of the words in their order), sig, keys (one bucket key a band); sig and keys are null without shingles. docs: uid, doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, digests, sigs, keys = [], [], [], []
            for lo, hi, data, offsets in ts.slices(batch.column(2)):
                data, offsets = mh.folded(data, offsets)
                h, at, n = mh.shingle_sets(data, offsets, words)
                size.append(n)
                raw = data.tobytes()
                digests += [hashlib.blake2b(raw[offsets[i] : offsets[i + 1]].rstrip(b" "), digest_size=16).digest() for i in range(hi - lo)]
                some = np.flatnonzero(n)
                sig = np.stack([mh.signature(h[at[i] : at[i + 1]], rows * bands) for i in some]) if len(some) else np.zeros((0, rows * bands), np.uint32)
                of, key = dict(zip(some.tolist(), range(len(some)), strict=True)), band_keys(sig, rows)
                sigs += [sig[of[i]].tobytes() if i in of else None for i in range(hi - lo)]
                keys += [key[of[i]] if i in of else None for i in range(hi - lo)]
            size = pa.array(np.concatenate(size) if size else [], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), size, pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["uid", "doc_id", "n_shingles", "digest", "sig", "keys"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("uid", "doc_id", "text").mapInArrow(run, f"uid long, doc_id {ids}, n_shingles long, digest binary, sig binary, keys array<long>")


def _prune(pairs: DataFrame, sigs: DataFrame, percent: int, miss: float, width: int) -> DataFrame:
    """The pairs (a, b) that signatures do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                stay = similar_enough(_matrix(batch.column(2), np.uint32, width), _matrix(batch.column(3), np.uint32, width), percent, miss)
                yield batch.select([0, 1]).take(pa.array(stay))

    joined = pairs.join(sigs.select(F.col("uid").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("uid").alias("b"), F.col("sig").alias("sig_b")), "b")
    return joined.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _shingles(docs: DataFrame, words: int, key: bytes) -> DataFrame:
    """uid and the set as packed digests, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in ts.slices(batch.column(1)):
                h, at = mh.exact_sets(*mh.folded(data, offsets), words, key)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([h[at[i] : at[i + 1]].tobytes() for i in range(hi - lo)], pa.binary())], ["uid", "shingles"])

    return docs.select("uid", "text").mapInArrow(run, "uid long, shingles binary")


def _verify(pairs: DataFrame, docs: DataFrame, percent: int, words: int, key: bytes) -> DataFrame:
    """Links: the pairs (a, b) whose full sets reach the threshold. Sets are built again for the documents in pairs only."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    stay.append(False)
                    continue
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                stay.append(100 * common >= percent * (len(both) - common))
            yield batch.select([0, 1]).filter(pa.array(stay, pa.bool_()))

    needed = materialize(pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct(), "pair-ends")
    texts = docs.select("uid", "text").join(small_side(needed), "uid", "left_semi")
    held = materialize(_shingles(texts, words, key), "pair-sets")
    joined = pairs.join(held.select(F.col("uid").alias("a"), F.col("shingles").alias("x")), "a").join(held.select(F.col("uid").alias("b"), F.col("shingles").alias("y")), "b")
    links = materialize(joined.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "pair-links")
    discard(held)
    return links


class _Joined:
    """Components of one block's members as links are found."""

    def __init__(self, comp: np.ndarray):
        _, self.of = np.unique(comp, return_inverse=True)

    def join(self, x: int, ys: np.ndarray) -> np.ndarray:
        """Link x with ys; returns those of ys that were not yet connected with each other or x."""
        new, first = np.unique(self.of[ys], return_index=True)
        first = first[new != self.of[x]]
        if len(first):
            self.of[np.isin(self.of, new)] = self.of[x]
        return ys[first]


def _rest_of_block(percent: int, miss: float, width: int, rows: int):
    """Arrow function: members that ask and members asked of a bucket, with signatures and sets -> links that join components."""

    def run(table: pa.Table) -> pa.Table:
        uid, comp, lead, band, large, asks = (table.column(c).to_numpy() for c in ("uid", "comp", "lead", "band", "large", "asks"))
        sig = _matrix(table.column("sig"), np.uint32, width)
        sets = [np.frombuffer(x, U64) for x in table.column("shingles").to_pylist()]
        size = np.array([len(x) for x in sets])
        begin = np.cumsum(size) - size
        kinds, token = np.unique(np.concatenate(sets), return_inverse=True)
        mine = np.zeros(len(kinds), bool)
        joined = _Joined(comp)
        earlier = int(band[0]) * rows  # a pair that shares an earlier band is compared there
        a, b = [], []
        there = np.flatnonzero(~asks & (uid != lead))  # pairs with the leader have been compared
        within = comp[there] == large[there]
        for x in np.flatnonzero(asks & (uid != lead)):
            ask = there[(joined.of[there] != joined.of[x]) & (within | (uid[there] > uid[x]))]  # of two that ask, the smaller one does
            ask = ask[100 * np.minimum(size[ask], size[x]) >= percent * np.maximum(size[ask], size[x])]
            if earlier and len(ask):
                ask = ask[~(sig[ask, :earlier] == sig[x, :earlier]).reshape(len(ask), -1, rows).all(axis=2).any(axis=1)]
            ask = ask[similar_enough(np.broadcast_to(sig[x], (len(ask), width)), sig[ask], percent, miss)]
            if not len(ask):
                continue
            mine[token[begin[x] : begin[x] + size[x]]] = True
            n = size[ask]
            at = np.repeat(begin[ask] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            common = np.add.reduceat(mine[token[at]].astype(np.int64), np.cumsum(n) - n)
            mine[token[begin[x] : begin[x] + size[x]]] = False
            new = joined.join(x, ask[100 * common >= percent * (size[x] + n - common)])
            a.append(np.full(len(new), uid[x]))
            b.append(uid[new])
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return run


def _rest(members: DataFrame, reps: DataFrame, docs: DataFrame, comps: DataFrame, percent: int, words: int, key: bytes, miss: float, width: int, rows: int) -> DataFrame:
    """Links that join components, among the pairs of one bucket that lie in different components and have not been compared with its leader.

    The members outside a bucket's largest component ask; all are asked whose sets
    are not too large or small for any that asks. Both sides are cut into blocks of
    bounded members and shingles: a member is sent once for each block of the other
    side, that is once where fewer than BLOCK members are outside.
    """
    held = members.join(comps, "uid", "left").withColumn("comp", F.coalesce("comp", "uid")).join(reps.select("uid", "n_shingles"), "uid")
    held = materialize(held, "bucket-components")
    by_comp = held.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"), F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    by_key = by_comp.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("large"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("comps")).where("comps > 1 and n > 2")
    outside = by_comp.join(by_key.select("key", "large"), "key").where("comp <> large")
    outside = outside.groupBy("key", "large").agg(F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), F.min("least").alias("least"), F.max("most").alias("most"))
    blocks = lambda n, shingles: F.ceil(F.greatest(n / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")
    open_ = materialize(outside.select("key", "large", blocks(F.col("n"), F.col("shingles")).alias("asking"), F.expr(f"least * {percent} / 100").alias("from_size"), F.expr(f"most * 100 / {percent}").alias("to_size")), "open-buckets")
    met = materialize(held.join(open_, "key").where("n_shingles between from_size and to_size"), "open-members")
    discard(held)
    asked = met.groupBy("key").agg(blocks(F.count(F.lit(1)), F.sum("n_shingles")).alias("asked"))
    met = met.join(asked, "key")
    texts = docs.select("uid", "text").join(small_side(materialize(met.select("uid").distinct(), "open-uids")), "uid", "left_semi")
    sets = materialize(_shingles(texts, words, key).join(reps.select("uid", "sig"), "uid"), "open-sets")
    deal = lambda n: F.pmod(F.xxhash64("uid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    both = met.where("comp <> large").withColumn("i", deal("asking")).withColumn("j", every("asked")).withColumn("asks", F.lit(True))
    both = both.unionByName(met.withColumn("j", deal("asked")).withColumn("i", every("asking")).withColumn("asks", F.lit(False)))
    columns = both.join(sets, "uid").select("key", "i", "j", "uid", "comp", "lead", "band", "large", "asks", "sig", "shingles")
    found = materialize(columns.groupBy("key", "i", "j").applyInArrow(_rest_of_block(percent, miss, width, rows), "a long, b long"), "open-links")
    discard(sets)
    return found


def near_groups(docs: DataFrame, *, percent: int, words: int = 5, miss: float = MISS) -> DataFrame:
    """uid, doc_id, n_shingles, comp (the smallest uid of the group). docs: uid, doc_id, text."""
    rows, bands = banding(percent)
    key = os.urandom(16)  # of this run: no text can be made to fit it
    sketch = materialize(sketches(docs, words, rows, bands), "sketches")
    sized = sketch.where("n_shingles > 0")
    copies = materialize(sized.groupBy("digest").agg(F.min("uid").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "copies")
    classed = materialize(sized.select("uid", "digest").join(small_side(copies), "digest", "left").select("uid", F.coalesce("rep", "uid").alias("rep")), "classes")
    discard(copies)
    reps = sized.join(materialize(classed.where("uid = rep").select("uid"), "class-heads"), "uid", "left_semi")
    entries = reps.select("uid", F.posexplode("keys").alias("band", "key"))
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialize(entries.join(shared, "key"), "bucket-members")
    company = members.groupBy("uid").agg(F.sum("size").alias("company"))
    ranked = members.join(company, "uid")
    leaders = ranked.groupBy("key").agg(F.max_by("uid", F.struct("company", -F.col("uid"))).alias("lead"))
    led = materialize(members.join(leaders, "key").select("key", "band", "uid", "lead"), "bucket-leaders")
    discard(members)
    sigs = reps.select("uid", "sig")
    pairs = led.where("uid <> lead").select(F.least("uid", "lead").alias("a"), F.greatest("uid", "lead").alias("b")).distinct()
    pairs = materialize(_prune(pairs, sigs, percent, miss, rows * bands), "led-pairs")
    links = _verify(pairs, docs, percent, words, key)
    discard(pairs)
    first = materialize(components(links), "led-components")
    more = _rest(led, reps, docs, first, percent, words, key, miss, rows * bands, rows)
    discard(led)
    if not more.isEmpty():
        first = materialize(components(links.unionByName(more)), "all-components")
    comp = classed.join(first.withColumnRenamed("uid", "rep"), "rep", "left").select("uid", F.coalesce("comp", "rep").alias("comp"))
    return sketch.select("uid", "doc_id", "n_shingles").join(comp, "uid", "left").withColumn("comp", F.coalesce("comp", "uid"))


def dedup_near(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, words: int = 5, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Documents are linked if 100 * intersection >= percent * union of their sets of
    ``words``-word shingles (lower-cased words between ASCII white space; a shorter
    text is one shingle). Null, empty and blank texts have no shingle and no link:
    each is kept. Rows that repeat an id, or have none, are documents of their own, in
    the order of ``corpus.keyed``: of a group one row is kept. An empty table gives no
    rows. Other columns, whatever their names, are not read.
    """
    held, direct = co.keyed(docs, id_col, text_col)
    groups = near_groups(held, percent=percent, words=words, miss=miss)
    if direct:
        return groups.select("doc_id", "n_shingles", F.col("comp").cast(groups.schema["doc_id"].dataType).alias("component_id"), (F.col("comp") == F.col("uid")).alias("kept"))
    groups = materialize(groups, "groups")
    heads = groups.select(F.col("uid").alias("comp"), F.col("doc_id").alias("component_id"))
    return groups.join(heads, "comp").select("doc_id", "n_shingles", "component_id", (F.col("comp") == F.col("uid")).alias("kept"))


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, words: int = 5, miss: float = MISS) -> DataFrame:
    """``docs`` with the same columns, of each group of near-duplicates only the row with the smallest id.

    Rows with null, empty and blank texts have no group and stay; of repeated rows one
    stays, and of rows that share an id those that are no near-duplicates of others;
    an empty table stays empty; further columns pass through whatever their names.
    """
    held, _ = co.keyed(docs, id_col, text_col, rows=True)
    groups = near_groups(held.select("uid", "doc_id", "text"), percent=percent, words=words, miss=miss)
    gone = materialize(groups.where("comp <> uid").select("uid"), "near-copies")
    kept = held.join(small_side(gone), "uid", "left_anti")
    return kept.select(*[F.col(f"c{i}") for i in range(len(docs.columns))]).toDF(*docs.columns)


#: What dedup_near gives at 85 percent and five words.
NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda s: array_to_string(ws[s:s + 4], ' ')) END) AS sh FROM w),
el AS (SELECT doc_id, unnest(sh) AS x, len(sh) AS n FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM el a JOIN el b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept
FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.sh
"""
