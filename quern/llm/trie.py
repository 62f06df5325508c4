"""The prefix trie of conversations: shared beginnings counted once, by smallest-member ownership.

A node is a distinct sequence of first turns.  Of the conversations that begin
with it (its members) the smallest owns it; so a conversation owns a suffix of
its path, and every node is owned once.

1. Windows along each conversation give every turn's node (an XOR of digests of
   place, role and text up to here, 128 bits) and the characters up to it.
2. A minimum per node marks its owner, and a minimum per owner where its suffix
   starts.  A window per node would hold every conversation for the root; the
   minimum is combined before the shuffle.
3. One group-by of all occurrences by node then sums, over the members, the
   characters of their turns from here on minus those of turns they own, and
   flags for owned leaves and owned children.  That is the same as summing over
   the subtree.

Only digests and lengths are shuffled, no texts.  No node's members are
gathered: the digest of the conversations that end at a node is computed as
their sorted ids stream by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.mixing import hex_long
from quern.llm.store import stored

NODE = ("depth", "h1", "h2")
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame, keep: tuple = ()) -> DataFrame:
    """conv_id, ``pos`` from 1, two digests ``t1`` and ``t2`` of role and text, and ``n``, the text's code points; and the columns ``keep``.

    Turns stand by ``turn``, nulls first, equal ones by role, then by MD5 of role
    and text.  A null role or text is empty; rows without a conv_id belong to no
    conversation and go.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), F.md5(F.concat(role, F.lit("\0"), text)).alias("m"), F.length(text).cast("long").alias("n"))
    t = t.select("conv_id", "turn", F.col("role").alias("r"), "m", "n", *keep)
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "r", "m"))
    return t.select("conv_id", pos.alias("pos"), hex_long(F.col("m"), 15).alias("t1"), F.conv(F.substring("m", 16, 15), 16, 10).cast("long").alias("t2"), "n", *keep)


def paths(t: DataFrame) -> DataFrame:
    """The turns of every conversation as they are, and a row of ``pos`` 0 for its start."""
    at = t.select("conv_id", "pos", "t1", "t2", "n")
    return at.unionByName(t.where("pos = 1").select("conv_id", *_start()))


def _start() -> list:
    return [F.lit(0).alias("pos"), F.lit(0).cast("long").alias("t1"), F.lit(0).cast("long").alias("t2"), F.lit(0).cast("long").alias("n")]


def rebuilt_paths(t: DataFrame, family: int = 100, most: int = 6) -> DataFrame:
    """Paths of rebuilt conversations: the first h turns of conversation c - c % ``family``, then c's own after its first h; h = crc32(c) % ``most``.

    At most ``most`` - 1 turns of a conversation are handed on, to fewer than
    twice ``family`` others; the remainder has the sign of c, as in SQL.
    """
    heads = t.where(F.col("pos") < most).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "t1", "t2", "n"))).alias("head"))
    c = t.where("pos = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % most).cast("int").alias("h"))
    c = c.join(heads, "base", "left").select("conv_id", "h", F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.expr("slice(array(struct(0 AS pos, 0L AS t1, 0L AS t2, 0L AS n)), 1, 0)")).alias("head"))
    c = stored(c, "heads")
    theirs = c.select("conv_id", F.explode("head").alias("x")).select("conv_id", "x.*")
    own = t.join(c.select("conv_id", "h", F.size("head").alias("before")), "conv_id").where("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("before")).alias("pos"), "t1", "t2", "n")
    return own.unionByName(theirs).unionByName(c.select("conv_id", *_start()))


def occurrences(p: DataFrame) -> DataFrame:
    """Every conversation at every depth: the node (``depth``, ``h1``, ``h2``), its parent's ``p1`` and ``p2``, ``n``, characters before the turn, ``is_end``."""
    w = Window.partitionBy("conv_id").orderBy("pos")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("x1", F.when(F.col("pos") > 0, F.xxhash64("pos", "t1", "t2")).otherwise(0)).withColumn("x2", F.when(F.col("pos") > 0, F.xxhash64("t2", "t1", "pos")).otherwise(0))
    p = p.withColumn("h1", F.bit_xor("x1").over(so_far)).withColumn("h2", F.bit_xor("x2").over(so_far)).withColumn("before", F.sum("n").over(so_far) - F.col("n")).withColumn("is_end", F.lead("pos").over(w).isNull())
    return p.select("conv_id", F.col("pos").cast("long").alias("depth"), "h1", "h2", F.col("h1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("h2").bitwiseXOR(F.col("x2")).alias("p2"), "n", "before", "is_end")


def suffixes(occ: DataFrame) -> DataFrame:
    """Per conversation that owns any node: ``first``, the depth where its own suffix starts, ``shared``, the characters before it, and ``leaf``, whether its last node has no child."""
    nodes = occ.groupBy(*NODE, "before").agg(F.min("conv_id").alias("conv_id"), F.every("is_end").alias("childless"))
    s = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "before")).alias("s"), F.some("childless").alias("leaf"))
    return s.select("conv_id", F.col("s.depth").alias("first"), F.col("s.before").alias("shared"), "leaf")


def trie_nodes(p: DataFrame) -> DataFrame:
    """One row per node of the paths ``p``: owner, depth, parent's owner, members, children, leaves, characters saved, digest of the ends."""
    occ = stored(occurrences(p), "occurrences")
    o = occ.join(suffixes(occ), "conv_id", "left")
    unowned = F.col("first").isNull() | (F.col("depth") < F.col("first"))
    # A conversation without own nodes shares all its characters.
    o = o.withColumn("shared", F.coalesce("shared", F.sum("n").over(Window.partitionBy("conv_id"))))
    nodes = o.groupBy(*NODE).agg(
        F.min(F.struct("conv_id", "first")).alias("o"),
        F.any_value("p1").alias("p1"),
        F.any_value("p2").alias("p2"),
        F.count("*").alias("n_convs"),
        F.count_if(~F.col("is_end") & (F.col("depth") + 1 >= F.col("first"))).alias("n_children"),
        F.count_if(F.coalesce("leaf", F.lit(False))).alias("n_leaves"),
        F.sum(F.when(unowned, F.col("shared") - F.col("before")).otherwise(0)).alias("saved_tokens"),
        F.some("is_end").alias("some_end"),
    )
    nodes = stored(nodes.select(*NODE, F.col("o.conv_id").alias("conv_id"), F.col("o.first").alias("first"), "p1", "p2", "n_convs", "n_children", "n_leaves", "saved_tokens", "some_end"), "nodes")
    # The parent of a suffix's first node has another owner; all others' parents have their own.
    same = nodes.where("first < depth OR depth = 0").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    root = nodes.where("depth = 0").select(F.lit(1).cast("long").alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    top = nodes.where("first = depth AND depth = 1").join(F.broadcast(root), "depth")
    up = nodes.where("n_children > 0 AND depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    deep = nodes.where("first = depth AND depth > 1").join(up, ["depth", "p1", "p2"])
    every = same.unionByName(top).unionByName(deep)
    # Nodes where none ends, nearly all in deep tries, skip the join.
    ended = every.where("some_end").join(end_digests(occ), list(NODE)).unionByName(every.where("NOT some_end").withColumn("ends_sha256", F.lit(NO_ENDS)))
    return ended.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per node of rows sorted by node, then conv_id; only the running digest is kept."""
    node, digest = None, None

    def row(nodes, digests):
        cols = [pa.array([x[i] for x in nodes], pa.int64()) for i in range(3)]
        return pa.RecordBatch.from_arrays([*cols, pa.array(digests, pa.string())], names=[*NODE, "ends_sha256"])

    for batch in batches:
        if not batch.num_rows:
            continue
        depth, h1, h2, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        cut = np.flatnonzero((np.diff(depth) != 0) | (np.diff(h1) != 0) | (np.diff(h2) != 0)) + 1
        nodes, digests = [], []
        for a, b in zip([0, *cut], [*cut, len(ids)], strict=True):
            here = (int(depth[a]), int(h1[a]), int(h2[a]))
            if here != node:
                if node is not None:
                    nodes.append(node)
                    digests.append(digest.hexdigest())
                node, digest = here, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(",".join(map(str, ids[a:b].tolist())).encode())
        if nodes:
            yield row(nodes, digests)
    if node is not None:
        yield row([node], [digest.hexdigest()])


def end_digests(occ: DataFrame) -> DataFrame:
    """Per node where a conversation ends: the SHA-256 of their ids, ascending, joined by commas."""
    e = occ.where("is_end").select(*NODE, "conv_id").repartition(*NODE).sortWithinPartitions(*NODE, "conv_id")
    return e.mapInArrow(_digests, "depth long, h1 long, h2 long, ends_sha256 string")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they stand (conv_id, turn, role, text): see :func:`trie_nodes` and :func:`turns`.

    Repeated conversations are members of the same nodes; repeated rows are
    separate turns.  An empty table has no nodes.  Other columns are ignored.
    """
    return trie_nodes(paths(stored(turns(conversations), "turns")))


def owned_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, role, text of every turn, and ``owned``: false where a conversation of smaller id begins with the same turns.

    Training on owned turns only, the rest as context, takes every shared
    beginning once.
    """
    t = stored(turns(conversations, keep=("role", "text")), "turns")
    s = suffixes(stored(occurrences(paths(t)), "occurrences")).select("conv_id", "first")
    d = t.join(s, "conv_id", "left")
    owned = F.coalesce(F.col("pos") >= F.col("first"), F.lit(False))
    return d.select("conv_id", F.col("pos").cast("long").alias("depth"), "role", "text", owned.alias("owned"))


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    t = stored(turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turns")
    return trie_nodes(rebuilt_paths(t))


#: Subtrees are summed node by node: every node is counted at each beginning of one of its members' paths.
OP11_SQL = """
WITH crc AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS tbl),
t AS (SELECT conv_id, md5(coalesce(role, '') || chr(0) || coalesce(text, '')) AS m, length(coalesce(text, '')) AS n,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(role, '') || chr(0) || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, xor(list_reduce(list_transform(range(0, strlen(conv_id::VARCHAR)), lambda i: ord(substr(conv_id::VARCHAR, (i + 1)::INT, 1))::BIGINT), lambda a, b: xor(a >> 8, tbl[xor(a & 255, b) + 1]), 4294967295::BIGINT), 4294967295) % 6 AS h
      FROM (SELECT DISTINCT conv_id FROM t), crc),
a AS (SELECT c.conv_id, 0 AS part, t.pos, t.m, t.n FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.pos <= c.h
      UNION ALL SELECT c.conv_id, 1, t.pos, t.m, t.n FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h
      UNION ALL SELECT conv_id, -1, 0, '', 0 FROM c),
p AS (SELECT conv_id, n, row_number() OVER w - 1 AS depth, sha256(string_agg(m, ',') OVER w) AS node, row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS is_end FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM p),
g AS (SELECT depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '') AS ends FROM q GROUP BY depth, node),
k AS (SELECT parent, count(*) AS n_children FROM g GROUP BY parent),
s AS (SELECT p.node, count(*) FILTER (k.parent IS NULL) AS n_leaves, sum((g.n_convs - 1) * g.n) AS saved FROM g JOIN p ON p.conv_id = g.conv_id AND p.depth <= g.depth LEFT JOIN k ON k.parent = g.node GROUP BY p.node)
SELECT g.conv_id, g.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, g.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(g.ends) AS ends_sha256
FROM g JOIN s ON s.node = g.node LEFT JOIN k ON k.parent = g.node LEFT JOIN g u ON u.node = g.parent
"""
