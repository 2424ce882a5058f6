"""Prefix trie of conversations, rolled up in depth bands.

A node is a distinct sequence of first turns. Every turn of a conversation gets a 128-bit
hash of its place, role and text; the exclusive-or of the first ``d`` of them names the
node of depth ``d``, so the names come from running sums that may be cut anywhere and the
parent's name is the node's own without its last turn. Subtree totals rise in bands of
fixed height: a node explodes only to its ancestors of the same band, the roots of the
bands then form a trie of their own, ``height`` times less deep, which is rolled up in the
same way, and their completed totals go to the band above. Rounds grow with the logarithm
of the depth, rows by a factor of ``height`` at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colscope.operators.ranking import row_positions
from colscope.session import materialize

HEIGHT = 8
BLOCK = 1024
JOINED = 256
SHARED, STEMS = 5, 9


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` (from 0), ``total``, ``t1``, ``t2`` (hash of role and text), ``bytes``.

    Turns stand in order of turn (NULL first), then role, then text. Positions come from
    range partitions, so one conversation may hold a third of all rows.
    """
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return row_positions(rows, ["conv_id"], ["turn", "role", "text"], "pos").select(
        "conv_id", "pos", "total", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(1), "role", "text").alias("t2"),
        F.octet_length("text").cast("long").alias("bytes"))


def regrown(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that share stems: ``(turns, convs)`` from ``ordered_turns``.

    With h the crc32 of the decimal conv_id modulo 9, conversation c gets the first h turns
    of conversation c - c % 5 (the remainder has the sign of c) and then its own after the
    first h. ``convs`` has ``conv_id`` and ``n_turns``, which may be 0.
    """
    own = turns.groupBy("conv_id").agg(F.max("total").alias("own"))
    stem = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(STEMS)).cast("int")
    convs = own.select("conv_id", "own", stem.alias("h"), (F.col("conv_id") - F.col("conv_id") % SHARED).alias("base"))
    convs = convs.join(own.select(F.col("conv_id").alias("base"), F.col("own").alias("n_base")), "base", "left")
    convs = materialize(convs.withColumn("lent", F.least("h", F.coalesce("n_base", F.lit(0)))), "trie-stems")
    kept = turns.join(convs.select("conv_id", "h", "lent"), "conv_id").where("pos >= h").withColumn("pos", F.col("lent") + F.col("pos") - F.col("h"))
    lent = (turns.where((F.col("pos") < STEMS - 1) & (F.col("conv_id") % SHARED == 0)).withColumnRenamed("conv_id", "base")
            .join(convs.select("base", "conv_id", "h"), "base").where("pos < h"))
    columns = ["conv_id", "pos", "t1", "t2", "bytes"]
    return (kept.select(*columns).unionByName(lent.select(*columns)),
            convs.select("conv_id", (F.col("lent") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("n_turns")))


def members(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per conversation and depth: node name (``x1``, ``x2``), parent's name, ``bytes`` of the last text.

    ``ends`` marks the conversation's last node. The running exclusive-or goes block by
    block, so that no window holds more than ``BLOCK`` turns.
    """
    places = (F.col("pos"), F.col("t1"), F.col("t2"))
    rows = turns.select("conv_id", "pos", F.floor(F.col("pos") / BLOCK).alias("block"), F.xxhash64(*places).alias("f1"),
                        F.xxhash64(F.lit(7), *places).alias("f2"), "bytes")
    sums = rows.groupBy("conv_id", "block").agg(F.bit_xor("f1").alias("s1"), F.bit_xor("f2").alias("s2"), F.max("pos").alias("top"))
    earlier = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    long = sums.join(convs.where(F.col("n_turns") > BLOCK).select("conv_id"), "conv_id")
    carried = materialize(long.select("conv_id", "block", F.bit_xor("s1").over(earlier).alias("c1"), F.bit_xor("s2").over(earlier).alias("c2"))
                          .where("block > 0"), "trie-carried")
    inside = W.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = rows.withColumn("r1", F.bit_xor("f1").over(inside)).withColumn("r2", F.bit_xor("f2").over(inside)).join(carried, ["conv_id", "block"], "left")
    named = run.select("conv_id", (F.col("pos") + 1).alias("depth"), F.col("r1").bitwiseXOR(F.coalesce("c1", F.lit(0))).alias("x1"),
                       F.col("r2").bitwiseXOR(F.coalesce("c2", F.lit(0))).alias("x2"), "f1", "f2", "bytes")
    named = named.join(convs, "conv_id").select(
        "conv_id", "depth", "x1", "x2", F.col("x1").bitwiseXOR(F.col("f1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("f2")).alias("p2"),
        "bytes", (F.col("depth") == F.col("n_turns")).alias("ends"))
    nothing = F.lit(0).cast("long")
    top = convs.select("conv_id", nothing.alias("depth"), nothing.alias("x1"), nothing.alias("x2"), F.lit(None).cast("long").alias("p1"),
                       F.lit(None).cast("long").alias("p2"), nothing.alias("bytes"), (F.col("n_turns") == 0).alias("ends"))
    return materialize(named.unionByName(top), "trie-members")


SUMS = ["leaves", "saved"]


def roll_up(values: DataFrame, paths: DataFrame, deepest: int, height: int = HEIGHT) -> DataFrame:
    """``values`` (``conv_id``, ``depth``, ``x1``, ``x2`` and sums, a row per node) with sums over whole subtrees.

    ``conv_id`` is a member of the node, the smallest; ``paths`` names the nodes of every
    conversation by depth.
    """
    steps = paths.select("conv_id", F.floor(F.col("depth") / height).alias("band"), F.col("depth").alias("to"), F.col("x1").alias("a1"), F.col("x2").alias("a2"))
    named = [F.col("a1").alias("x1"), F.col("a2").alias("x2"), "conv_id", F.col("to").alias("depth"), *SUMS]

    def gathered(rows: DataFrame) -> DataFrame:
        return rows.groupBy("x1", "x2").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), *[F.sum(c).alias(c) for c in SUMS])

    banded = values.select("conv_id", "depth", *SUMS, F.floor(F.col("depth") / height).alias("band"))
    inside = materialize(gathered(banded.join(steps, ["conv_id", "band"]).where("to <= depth").select(*named)), "trie-band")
    if deepest < height:
        return inside
    coarse = (F.col("depth") / height).cast("long").alias("depth")
    at_root = F.col("depth") % height == 0
    whole = roll_up(inside.where(at_root).select("x1", "x2", "conv_id", coarse, *SUMS),
                    paths.where(at_root).select("conv_id", coarse, "x1", "x2"), deepest // height, height)
    above = whole.where("depth > 0").select("conv_id", *SUMS, (F.col("depth") - 1).alias("band")).join(steps, ["conv_id", "band"]).select(*named)
    return materialize(gathered(inside.unionByName(above.select(*inside.columns))), "trie-rolled")


def _id_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one node's ids as comma-joined texts of at most ``JOINED`` ids."""
    for b in batches:
        if not b.num_rows:
            continue
        x1, x2, ids = (b.column(c).to_numpy() for c in ("x1", "x2", "conv_id"))
        change = np.flatnonzero((np.diff(x1) != 0) | (np.diff(x2) != 0)) + 1
        edges = np.concatenate([[0], change, [len(ids)]])
        cuts = [s for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()) for s in range(a, z, JOINED)] + [len(ids)]
        joined = [",".join(map(str, ids[a:z].tolist())) for a, z in zip(cuts[:-1], cuts[1:])]
        first = np.array(cuts[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(x1[first]), pa.array(x2[first]), pa.array(ids[first]), pa.array(joined, pa.string())],
                                         names=["x1", "x2", "first", "ids"])


def _id_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's texts, one after the other; only the digest is carried on."""
    node, digest = None, None

    def row(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0][k] for d in done], pa.int64()) for k in (0, 1)]
                                          + [pa.array([d[1].hexdigest() for d in done], pa.string())], names=["x1", "x2", "ends_sha256"])

    for b in batches:
        done = []
        for x1, x2, ids in zip(b.column("x1").to_pylist(), b.column("x2").to_pylist(), b.column("ids").to_pylist()):
            if node == (x1, x2):
                digest.update(b"," + ids.encode())
            else:
                if node is not None:
                    done.append((node, digest))
                node, digest = (x1, x2), hashlib.sha256(ids.encode())
        yield row(done)
    if node is not None:
        yield row([(node, digest)])


def end_digests(rows: DataFrame) -> DataFrame:
    """``x1``, ``x2``, ``ends_sha256``: digest of the sorted, comma-joined ids of the conversations that end there.

    Sorting and joining spread over range partitions; a digest is sequential by nature,
    so one task then streams a node's texts of ``JOINED`` ids each.
    """
    texts = (rows.where("ends").select("x1", "x2", "conv_id").repartitionByRange("x1", "x2", "conv_id").sortWithinPartitions("x1", "x2", "conv_id")
             .mapInArrow(_id_texts, "x1 long, x2 long, first long, ids string"))
    return (texts.repartition("x1", "x2").sortWithinPartitions("x1", "x2", "first")
            .mapInArrow(_id_digests, "x1 long, x2 long, ends_sha256 string"))


def trie(turns: DataFrame, convs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """A row per node of the prefix trie of ``turns`` (``conv_id``, ``pos``, ``t1``, ``t2``, ``bytes``).

    ``convs`` lists all conversations with ``n_turns``; those without turns end at the
    root. Returns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` (bytes that sharing the nodes of the
    subtree saves), ``ends_sha256`` and the node's name ``x1``, ``x2``. No conversations
    give no rows.
    """
    rows = members(turns, convs)
    nodes = materialize(rows.groupBy("x1", "x2").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.max("bytes").alias("bytes")), "trie-nodes")
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count("*").alias("n_children"))
    children = materialize(nodes.join(children, ["x1", "x2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "trie-children")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    own = children.select("x1", "x2", "conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), saved.alias("saved"))
    whole = roll_up(own, rows.select("conv_id", "depth", "x1", "x2"), deepest, height)
    parents = nodes.select(F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    found = (children.join(parents, ["p1", "p2"], "left")
             .join(whole.select("x1", "x2", *SUMS), ["x1", "x2"]).join(end_digests(rows), ["x1", "x2"], "left"))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), "x1", "x2")


def conversation_trie(conversations: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The trie (see ``trie``) of conversations rebuilt with shared stems (see ``regrown``).

    NULL roles and texts are empty; rows of one turn are ordered by role, then text, and
    equal rows are turns of their own. Rows without a conv_id belong to no conversation and
    take no part. An empty table gives no rows, not even a root. Other columns are ignored.
    """
    turns, convs = regrown(materialize(ordered_turns(conversations), "trie-turns"))
    return trie(turns, convs, height)


# The crc32 of the decimal conv_id, bit by bit: 4294967295 and 3988292384 are the checksum's fixed values.
ORACLE = r"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, own, conv_id - conv_id % 5 AS base,
             xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1),
                 lambda i: [256 + ascii(substr(conv_id::VARCHAR, i, 1)), -1, -1, -1, -1, -1, -1, -1, -1]))),
                 lambda a, b: CASE WHEN b > 0 THEN xor(a, b - 256) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295) % 9 AS h
      FROM (SELECT conv_id, count(*) AS own FROM o GROUP BY conv_id)),
c AS (SELECT s.conv_id, s.h, s.base, least(s.h, coalesce(b.own, 0)) AS lent, least(s.h, coalesce(b.own, 0)) + greatest(0, s.own - s.h) AS n
      FROM s LEFT JOIN s b ON b.conv_id = s.base),
t AS (SELECT conv_id, lent + pos - h AS pos, role, text FROM o JOIN c USING (conv_id) WHERE pos >= h
      UNION ALL SELECT c.conv_id, pos, role, text FROM o JOIN c ON o.conv_id = c.base WHERE pos < h),
m AS (SELECT conv_id, pos + 1 AS depth, string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY pos) AS node, text FROM t
      UNION ALL SELECT conv_id, 0, '', '' FROM c),
n AS (SELECT node, depth, min(m.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * strlen(any_value(text)) AS saved,
             coalesce(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) FILTER (depth = c.n), '') AS ends
      FROM m JOIN c USING (conv_id) GROUP BY node, depth),
k AS (SELECT left(node, length(node) - 32) AS node, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node, depth)),
u AS (SELECT m.node, m.depth, sum((w.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(w.saved)::BIGINT AS saved_tokens
      FROM w JOIN m ON m.conv_id = w.conv_id AND m.depth <= w.depth GROUP BY 1, 2)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN u USING (node, depth) LEFT JOIN n p ON w.depth > 0 AND p.depth = w.depth - 1 AND p.node = left(w.node, length(w.node) - 32)
"""
