"""Conversations that share beginnings, as a trie of their turns.

1. Turns are reduced to 20 bytes each before anything is shuffled: 16 bytes of the
   SHA-256 of role and text, and the text's code points. A conversation is the list of
   its turns' bytes.
2. Equal conversations are one path with a count, the smallest id and the digest of its
   members' ids, which are hashed as a sorted stream. So copies, however many, do
   not make a subtrie large.
3. Paths are dealt by their first turn's digest into buckets, each of which is built
   into a trie of dictionaries in one task. Nodes are numbered as they are made, so
   parents come before their children: going backwards over the numbers is a
   postorder without recursion.
4. A first-turn subtrie of more than ``most`` turns is dealt again by the next turn, and
   so on until every part fits. The turns that all paths of a subtrie share are
   passed over at once: they are one chain of nodes. Chains are summed up afterwards
   from the parts below them, deepest ones first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifmill.plans.storage import materialize, small_side

#: Turns of different paths that one task builds into a trie.
MOST = 1 << 17
DIGEST = 16
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, up binary"
NONE_SHA256 = hashlib.sha256(b"").hexdigest()


def turn_bytes(role: Column, text: Column) -> Column:
    """16 bytes of a digest of (role, text), and the text's code points in four."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, DIGEST)
    return F.concat(digest, F.unhex(F.lpad(F.hex(F.length(text)), 8, "0")))


def _size(turn: Column) -> Column:
    return F.conv(F.hex(F.substring(turn, DIGEST + 1, 4)), 16, 10).cast("long")


def paths(turns: DataFrame, *, shared: str = "crc32(cast(conv_id as string)) % 6", family: int = 100, most_shared: int = 5) -> DataFrame:
    """conv_id, path of every rebuilt conversation: the first h turns of conversation c - c % family, then its own behind its first h. shared: h, at most ``most_shared``."""
    held = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_bytes(F.col("role"), F.col("text")).alias("e")).where("conv_id is not null")
    own = held.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "e"))).alias("own"))
    own = materialize(own.select("conv_id", F.transform("own", lambda x: x.e).alias("own")), "conversations")
    heads = own.where(f"conv_id % {family} = 0").select(F.col("conv_id").alias("head_id"), F.slice("own", 1, most_shared).alias("head"))
    built = own.withColumn("head_id", F.expr(f"conv_id - conv_id % {family}")).withColumn("h", F.expr(shared).cast("int")).join(heads, "head_id", "left")
    head = F.when(F.col("head").isNull() | (F.col("h") == 0), F.array().cast("array<binary>")).otherwise(F.slice("head", F.lit(1), F.col("h")))
    return built.select("conv_id", F.concat(head, F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))).alias("path"))


def prefix_digest(path: Column) -> Column:
    """16 bytes that stand for a whole list of turns, chained turn by turn."""
    return F.aggregate(path, F.lit(b"").cast("binary"), lambda a, x: F.substring(F.unhex(F.sha2(F.concat(a, x), 256)), 1, DIGEST))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pid, conv_id in this order, no path cut by a task's end -> pid, n, conv_id (smallest), ends_sha256 of each path; ids are hashed as they come."""
    now, n, first, digest = None, 0, 0, hashlib.sha256()
    out: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        pids, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        cuts = [0, *(k for k in range(1, len(pids)) if pids[k] != pids[k - 1]), len(pids)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if pids[lo] != now:
                if now is not None:
                    out.append((now, n, first, digest.hexdigest()))
                now, n, first, digest = pids[lo], 0, ids[lo], hashlib.sha256()
            digest.update(("," * (n > 0) + ",".join(map(str, ids[lo:hi]))).encode())
            n += hi - lo
        yield _path_rows(out)
        out = []
    if now is not None:
        yield _path_rows([(now, n, first, digest.hexdigest())])


def _path_rows(rows: list[tuple]) -> pa.RecordBatch:
    pid, n, first, ends = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(pid, pa.binary()), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(ends, pa.string())], ["pid", "n", "conv_id", "ends_sha256"])


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    """Paths of whole subtries -> their nodes. rows: path, at (turns in front of the subtrie), parent, up, n, conv_id, ends_sha256."""
    tops: dict[tuple, int] = {}
    kids: list[dict[bytes, int]] = []
    parent, depth, size, count, first, ends, above, up = [], [], [], [], [], [], [], []
    for path, at, over, chain, n, conv_id, digest in rows[["path", "at", "parent", "up", "n", "conv_id", "ends_sha256"]].sort_values("conv_id").itertuples(index=False):
        node = -1
        for d in range(at, len(path)):
            turn = path[d]
            into, name = (tops, (chain, turn)) if node < 0 else (kids[node], turn)
            child = into.get(name)
            if child is None:
                child = into[name] = len(kids)
                kids.append({})
                parent.append(node)
                depth.append(d + 1)
                size.append(int.from_bytes(turn[DIGEST:], "big"))
                count.append(0)
                first.append(conv_id)  # paths come by their smallest ids
                ends.append(NONE_SHA256)
                above.append(over if node < 0 else first[node])
                up.append(chain if node < 0 else None)
            node = child
            count[node] += n
        ends[node] = digest
    leaves, saved = [0] * len(kids), [0] * len(kids)
    for node in range(len(kids) - 1, -1, -1):  # children have larger numbers
        leaves[node] += not kids[node]
        saved[node] += (count[node] - 1) * size[node]
        if parent[node] >= 0:
            leaves[parent[node]] += leaves[node]
            saved[parent[node]] += saved[node]
    return pd.DataFrame({"conv_id": np.array(first, np.int64), "depth": np.array(depth, np.int64), "parent_conv_id": np.array(above, np.int64), "n_convs": np.array(count, np.int64), "n_children": np.array([len(k) for k in kids], np.int64), "n_leaves": np.array(leaves, np.int64), "saved_tokens": np.array(saved, np.int64), "ends_sha256": np.array(ends, object), "up": np.array(up, object)})


def _chain_nodes(chains: DataFrame, below: DataFrame) -> DataFrame:
    """The nodes of chains (key, at, to, turns, n, conv_id, parent, ends_sha256, up), with what the subtries below them say (up, n_leaves, saved_tokens)."""
    sums = below.where("up is not null").groupBy("up").agg(F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below")).withColumnRenamed("up", "key")
    sizes = F.transform("turns", lambda x: (F.col("n") - 1) * _size(x))
    held = chains.join(sums, "key").withColumn("own", sizes).withColumn("last", F.size("turns"))
    node = held.select("*", F.posexplode("own").alias("k", "_"))
    saved = F.col("below") + F.aggregate(F.slice("own", F.col("k") + 1, F.col("last") - F.col("k")), F.lit(0).cast("long"), lambda a, x: a + x)
    lowest, top = F.col("k") == F.col("last") - 1, F.col("k") == 0
    return node.select(
        "conv_id",
        (F.col("at") + F.col("k") + 1).cast("long").alias("depth"),
        F.when(top, F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(lowest, F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        "n_leaves",
        saved.alias("saved_tokens"),
        F.when(lowest, F.col("ends_sha256")).otherwise(F.lit(NONE_SHA256)).alias("ends_sha256"),
        F.when(top, F.col("up")).alias("up"),
    )


def _common(a: Column, b: Column) -> Column:
    """How many turns two lists begin with in common."""
    apart = F.array_position(F.zip_with(F.slice(a, F.lit(1), F.least(F.size(a), F.size(b))), F.slice(b, F.lit(1), F.least(F.size(a), F.size(b))), lambda x, y: x == y), False)
    return F.when(apart > 0, apart - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def trie_nodes(conversations: DataFrame, *, most: int = MOST) -> DataFrame:
    """A row for each node of the trie of conversations (conv_id, path).

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves, saved_tokens (over the node's subtree, each node's members but
    one times the code points of its last text) and ends_sha256 (of the ids of the
    members that end there, ascending and comma-joined).
    """
    held = materialize(conversations.withColumn("pid", prefix_digest(F.col("path"))), "conversation-paths")
    members = held.select("pid", "conv_id").repartition("pid").sortWithinPartitions("pid", "conv_id")
    ends = materialize(members.mapInArrow(_members, "pid binary, n long, conv_id long, ends_sha256 string"), "path-members")
    kinds = held.join(ends, ["pid", "conv_id"])
    first, total = ends.agg(F.min("conv_id"), F.sum("n")).first()
    spark = conversations.sparkSession
    if first is None:
        return spark.createDataFrame([], NODES).drop("up")
    rootward = kinds.where(F.size("path") == 0).select("ends_sha256").first()  # one path at most has no turns
    start = kinds.where(F.size("path") > 0).select("path", "n", "conv_id", "ends_sha256", F.lit(0).alias("at"), F.lit(first).alias("parent"), F.lit(None).cast("binary").alias("up"))
    keyed = lambda rows: rows.withColumn("key", prefix_digest(F.slice("path", F.lit(1), F.col("at") + 1)))
    open_, ready, chains = materialize(keyed(start), "trie-paths"), [], []
    while True:
        left = F.size("path") - F.col("at")
        parts = open_.groupBy("key").agg(F.sum(left).alias("turns"), F.count(F.lit(1)).alias("kinds"))
        large = materialize(parts.where((F.col("turns") > most) & (F.col("kinds") > 1)).select("key"), "large-subtries")
        if large.isEmpty():
            ready.append(open_)
            break
        ready.append(open_.join(small_side(large), "key", "left_anti"))
        split = open_.join(small_side(large), "key")
        shape = split.groupBy("key").agg(F.min("path").alias("low"), F.max("path").alias("high"), F.sum("n").alias("total"), F.min("conv_id").alias("least"), F.first("at").alias("at"), F.first("parent").alias("parent"), F.first("up").alias("up"))
        shape = materialize(shape.withColumn("to", _common(F.col("low"), F.col("high"))), "subtrie-shapes")
        rest = split.select("key", "path", "n", "conv_id", "ends_sha256").join(small_side(shape.select("key", "to", F.col("least").alias("parent"))), "key")
        # a path that ends where the chain does, if there is one, is the smallest of them
        ending = rest.where(F.size("path") == F.col("to")).select("key", "ends_sha256")
        chain = shape.join(ending, "key", "left").select("key", "at", F.slice("low", F.col("at") + 1, F.col("to") - F.col("at")).alias("turns"), F.col("total").alias("n"), F.col("least").alias("conv_id"), "parent", F.coalesce("ends_sha256", F.lit(NONE_SHA256)).alias("ends_sha256"), "up")
        chains.append(materialize(chain, "trie-chains"))
        deeper = rest.where(F.size("path") > F.col("to")).select("path", "n", "conv_id", "ends_sha256", F.col("to").alias("at"), "parent", F.col("key").alias("up"))
        open_ = materialize(keyed(deeper), "trie-paths")
    every = ready[0]
    for r in ready[1:]:
        every = every.unionByName(r)
    turns = every.agg(F.coalesce(F.sum(F.size("path") - F.col("at")), F.lit(0))).first()[0]
    buckets = max(16, -(-4 * turns // most))
    dealt = every.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    nodes = materialize(dealt.groupBy("bucket").applyInPandas(_build, NODES), "trie-nodes")
    for chain in reversed(chains):
        nodes = nodes.unionByName(materialize(_chain_nodes(chain, nodes), "chain-nodes"))
    top = nodes.where("depth = 1").agg(F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    root = top.select(
        F.lit(first).cast("long").alias("conv_id"),
        F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(total).cast("long").alias("n_convs"),
        F.col("kids").alias("n_children"),
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
        F.lit(rootward[0] if rootward else NONE_SHA256).alias("ends_sha256"),
    )
    return nodes.drop("up").unionByName(root)


def conversation_trie(turns: DataFrame, *, shared: str = "crc32(cast(conv_id as string)) % 6", family: int = 100, most_shared: int = 5, most: int = MOST) -> DataFrame:
    """The trie (see ``trie_nodes``) of the conversations rebuilt from turns (conv_id, turn, role, text), as ``paths`` has it.

    Turns stand by their number, null first; turns of equal number by the digest of role
    and text, so that repeated rows and ties give the same trie whatever their order. Null
    roles and texts are empty. Rows without conv_id belong to no conversation and are
    left out. A rebuilt conversation may have no turns: it ends at the root. An empty
    table has no conversation and gives no node. Texts of any length count whole; one
    conversation's turns, 20 bytes each, are one row. Other columns, whatever their
    names, are not read.
    """
    return trie_nodes(paths(turns, shared=shared, family=family, most_shared=most_shared), most=most)


#: What op12_conversation_trie gives. crc32 is taken bit by bit over the digits.
TRIE_SQL = """
WITH ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT conv_id, (xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))) % 6)::INTEGER AS h FROM ids),
turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY p) AS t FROM turns GROUP BY conv_id),
built AS (SELECT c.conv_id, list_concat(coalesce(b.t, [])[1:c.h], o.t[c.h + 1:]) AS path FROM crc c JOIN own o ON o.conv_id = c.conv_id LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
places AS (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM built),
nodes AS (SELECT path[1:depth] AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(length(path[1:depth][depth].text), 0) AS size,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(path) = depth), '')) AS ends_sha256 FROM (SELECT conv_id, path, depth FROM places) GROUP BY path[1:depth], depth, path[1:depth][depth].text),
kids AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.prefix = n.prefix AND len(k.prefix) = n.depth),
up AS (SELECT prefix, n_convs, size, n_children, unnest(range(0, depth + 1)) AS d FROM counted),
sums AS (SELECT prefix[1:d] AS prefix, d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * size)::BIGINT AS saved_tokens FROM up GROUP BY ALL)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens, c.ends_sha256
FROM counted c JOIN sums s ON s.prefix = c.prefix AND s.d = c.depth LEFT JOIN nodes p ON p.depth = c.depth - 1 AND p.prefix = c.prefix[1:c.depth - 1] AND c.depth > 0
"""
