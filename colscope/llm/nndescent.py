"""Embedding near-duplicates by NN-descent over Spark joins.

Vectors of one cell (equal label and length) form a neighbour graph. Random-hyperplane
buckets give the first lists; each descent round lets the neighbours of a vertex, both
ways, meet in bounded chunks and keeps the best of each list. A list that is full of
links is saturated and is doubled; what is still saturated at the largest length is
completed exactly, in blocks against its whole cell. Recall is audited against brute
force for every id divisible by 50, vector by vector and without the saturated ones; a
poor audit buys more trees and rounds, and then exact blocks for all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.session import materialize

from .common import connected_components, key_runs, per_run

CHUNK = 96
BLOCK = 1024


def _units(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks()
    x = flat.flatten().to_numpy().astype(np.float64).reshape(rows, -1) if rows else np.zeros((0, 1))
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distinct_vectors(df: DataFrame) -> DataFrame:
    """Usable vectors, equal ones collapsed: ``node``, ``cell``, ``first``, ``copies``, ``audited`` (one has an id divisible by 50), ``vec``."""
    ok = df.where("label is not null and exists(vec, x -> x <> 0) and "
                  "not exists(vec, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    return (ok.groupBy("label", "vec").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.coalesce(F.bool_or(F.col("vec_id") % 50 == 0), F.lit(False)).alias("audited"))
            .select(F.monotonically_increasing_id().alias("node"), F.xxhash64("label", F.size("vec")).alias("cell"),
                    "label", "first", "copies", "audited", "vec"))


def _chunked(keys: DataFrame, most: int) -> DataFrame:
    """Split keys with more than ``most`` members by a hash of the member."""
    big = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most), "nn-crowded")
    return keys.join(big, "key", "left").select(
        F.when(F.col("n").isNull(), F.col("key")).otherwise(
            F.xxhash64("key", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / most)))).alias("key"), "node")


def _tree_keys(nodes: DataFrame, trees: range, leaf: int) -> DataFrame:
    sized = nodes.join(nodes.groupBy("cell").agg(F.count("*").alias("n")), "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells, n = b.column("cell").to_numpy(), b.column("n").to_numpy()
            bits = np.maximum(0, np.ceil(np.log2(np.maximum(n / leaf, 1)))).astype(int)
            dims = np.diff(b.column("vec").offsets.to_numpy())
            flat, at = b.column("vec").flatten().to_numpy(), np.concatenate([[0], np.cumsum(dims)])
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                x = np.stack([flat[at[i]:at[i + 1]] for i in own]).astype(np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                for t in trees:
                    planes = np.random.default_rng([7, t, int(dim)]).standard_normal((int(dim), 62))
                    sides = (x @ planes > 0) & (np.arange(62) < bits[own][:, None])
                    code = sides.astype(np.int64) @ (np.int64(1) << np.arange(62, dtype=np.int64))
                    key = cells[own] * np.int64(31) + code * np.int64(-7046029254386353131) + np.int64(t * 1000003)
                    yield pa.RecordBatch.from_arrays([pa.array(key), b.column("node").take(pa.array(own))], names=["key", "node"])

    return sized.select("node", "cell", "n", "vec").mapInArrow(run, "key long, node long")


def ranked_similarity(sim: np.ndarray, threshold: float) -> np.ndarray:
    """Similarities rounded, so that a pair has one value wherever it is met, but never across the threshold."""
    near = np.round(sim, 10)
    return np.where(sim >= threshold, np.maximum(near, threshold), np.minimum(near, np.nextafter(threshold, -1)))


def _local_join(members: DataFrame, nodes: DataFrame, lists: DataFrame | None, keep: int, threshold: float) -> DataFrame:
    """All pairs of every chunk's members that beat a list: ``node``, ``nbr``, ``sim``."""
    table = nodes.select("node", "vec", "cell")
    if lists is None:
        table = table.withColumn("kth", F.lit(-2.0))
    else:
        table = table.join(lists.select("node", F.get("near", F.col("k") - 1)["sim"].alias("kth")), "node", "left")
    rows = members.join(table, "node").select("key", "node", "cell", F.coalesce("kth", F.lit(-2.0)).alias("kth"), "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got, starts in key_runs(batches, "key"):
            node, kth, cell = (got.column(c).to_numpy() for c in ("node", "kth", "cell"))
            vecs = got.column("vec").combine_chunks()
            sizes = np.diff(vecs.offsets.to_numpy())
            even = _units(got.column("vec"), len(node)) if (sizes == sizes[0]).all() else None
            a, b, sim = [], [], []
            for s, e in zip(starts[:-1], starts[1:]):
                if e - s < 2 or (cell[s:e] != cell[s]).any():
                    continue
                x = even[s:e] if even is not None else _units(got.column("vec").slice(s, e - s), e - s)
                own = x @ x.T
                i, j = np.nonzero((own > kth[s:e, None]) & (node[s:e, None] != node[None, s:e]))
                a.append(node[s:e][i]), b.append(node[s:e][j]), sim.append(own[i, j])
            if not a:
                continue
            a, b, sim = np.concatenate(a), np.concatenate(b), ranked_similarity(np.concatenate(sim), threshold)
            order = np.lexsort((b, -sim, a))
            a, b, sim = a[order], b[order], sim[order]
            new = np.concatenate([[True], (np.diff(a) != 0) | (np.diff(b) != 0)]) if len(a) else np.zeros(0, bool)
            a, b, sim = a[new], b[new], sim[new]
            begin = np.concatenate([[0], np.flatnonzero(np.diff(a)) + 1]) if len(a) else np.zeros(0, int)
            rank = np.arange(len(a)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(a)]])))
            top = rank < keep
            yield pa.RecordBatch.from_arrays([pa.array(a[top]), pa.array(b[top]), pa.array(sim[top])], names=["node", "nbr", "sim"])

    return per_run(rows, "key", run, "node long, nbr long, sim double")


def _merged(lists: DataFrame, found: DataFrame, threshold: float, most: int) -> DataFrame:
    """Lists with the best of old and new neighbours; saturated ones grow."""
    fresh = found.groupBy("node").agg(F.collect_set(F.struct("sim", "nbr")).alias("fresh"))
    near = F.sort_array(F.array_distinct(F.concat("near", F.coalesce("fresh", F.array().cast("array<struct<sim:double,nbr:bigint>>")))), False)
    wide = lists.join(fresh, "node", "left").withColumn("near", near).withColumn("near", F.slice("near", 1, F.col("k")))
    grown = F.when(F.get("near", F.col("k") - 1)["sim"] >= threshold, F.least(F.col("k") * 2, F.lit(most))).otherwise(F.col("k"))
    return wide.select("node", "near", grown.cast("int").alias("k"))


def _members(lists: DataFrame, k: int) -> DataFrame:
    """Neighbours of every vertex both ways; many reverse neighbours come in chunks."""
    ahead = lists.select(F.col("node").alias("v"), F.explode("near.nbr").alias("u"))
    back = ahead.select(F.col("u").alias("v"), F.col("v").alias("u"))
    parts = materialize(back.groupBy("v").agg(F.ceil(F.count("*") / (2 * k)).alias("parts")), "nn-reverse")
    some = back.join(parts, "v").select("v", "u", F.pmod(F.xxhash64("u"), F.col("parts")).alias("c"))
    every = (ahead.join(parts, "v", "left")
             .select("v", "u", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("c")))
    return some.unionByName(every).select(F.xxhash64("v", "c").alias("key"), F.col("u").alias("node")).distinct()


def _block_pass(queries: DataFrame, nodes: DataFrame, threshold: float, links: bool) -> DataFrame:
    """Queries against all rows of their cell, block by block.

    Emits ``kind`` 0: links of a query (weighted by copies), 1: links of a row that is
    no query to queries, 2: a spanning forest of the block's links.
    """
    asked = nodes.join(queries.select("node", F.lit(True).alias("asked")), "node", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    sizes = (asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("rb"), F.ceil(F.count_if("asked") / BLOCK).alias("qb"))
             .where("qb > 0"))
    sized = asked.join(sizes, "cell")
    spread = lambda own, other, as_query: sized.where("asked" if as_query else "true").select(
        F.pmod(F.xxhash64("node"), F.col(own)).alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias("theirs"),
        "cell", "node", "copies", "asked", "vec", F.lit(as_query).alias("as_query"))
    rows = (spread("qb", "rb", True).withColumn("key", F.xxhash64("cell", "mine", "theirs"))
            .unionByName(spread("rb", "qb", False).withColumn("key", F.xxhash64("cell", "theirs", "mine")))
            .select("key", "node", "copies", "asked", "as_query", "vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got, starts in key_runs(batches, "key"):
            for s, e in zip(starts[:-1], starts[1:]):
                part = got.slice(s, e - s)
                node, copies, asked, query = (part.column(c).to_numpy() for c in ("node", "copies", "asked", "as_query"))
                query = query.astype(bool)
                if query.all() or not query.any():
                    continue
                x = _units(part.column("vec"), e - s)
                q, r = np.flatnonzero(query), np.flatnonzero(~query)
                hit = (x[q] @ x[r].T >= threshold) & (node[q][:, None] != node[r][None, :])
                kinds, a, b, n = [np.zeros(len(q), np.int64)], [node[q]], [node[q]], [hit @ copies[r]]
                if links:
                    plain = np.flatnonzero(~asked[r].astype(bool) & hit.any(0))
                    kinds.append(np.ones(len(plain), np.int64)), a.append(node[r][plain]), b.append(node[r][plain])
                    n.append(copies[q] @ hit[:, plain])
                    label, before = np.arange(len(q)), None
                    while before is None or (label != before).any():
                        before = label
                        down = np.where(hit, label[:, None], len(q)).min(0) if len(r) else np.zeros(0, int)
                        label = np.minimum(label, np.where(hit, down[None, :], len(q)).min(1))
                    at_r = np.flatnonzero(down < len(q))
                    at_q = np.flatnonzero(label != np.arange(len(q)))
                    for ids, root in ((node[r][at_r], node[q][down[at_r]]), (node[q][at_q], node[q][label[at_q]])):
                        kinds.append(np.full(len(ids), 2)), a.append(ids), b.append(root), n.append(np.zeros(len(ids), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in (kinds, a, b, n)], names=["kind", "a", "b", "n"])

    return per_run(rows, "key", run, "kind long, a long, b long, n long")


def near_vectors(df: DataFrame, threshold: float = 0.93, k: int = 8, most_k: int = 32, trees: int = 6, leaf: int = 48,
                 rounds: int = 4, target: float = 0.99, retries: int = 2) -> DataFrame:
    """Near-duplicate vectors: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Vectors with equal non-null label and length link at cosine >= ``threshold`` in
    double precision. A vector that is NULL, zero, or holds NULL, NaN or infinite
    components, or has no label, links with nothing. Equal vectors are collapsed first
    and count as links of each other; a repeated row is a vector of its own. ``n_links``
    counts the other vectors linked, ``component_id`` is the smallest id reachable. An
    empty table gives no rows. Other columns are ignored.

    Work per round is linear in the vectors (lists, chunks and trees are bounded); only
    saturated vectors pay a block comparison with their cell. If after ``retries`` fewer than
    ``target`` of the audited vectors have all their links, all vectors pay it.
    """
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("vec"))
    nodes = materialize(distinct_vectors(rows), "nn-nodes")
    truth = materialize(_block_pass(nodes.where("audited"), nodes, threshold, False)
                        .groupBy("a").agg(F.sum("n").alias("n")), "nn-audit")
    truth = truth.where("n > 0").select(F.col("a").alias("node"), F.col("n").alias("want"))
    lists = nodes.select("node", F.array().cast("array<struct<sim:double,nbr:bigint>>").alias("near"), F.lit(k).alias("k"))
    for attempt in range(retries + 1):
        keys = _chunked(_tree_keys(nodes, range(attempt * trees, (attempt + 1) * trees), leaf), CHUNK)
        lists = materialize(_merged(lists, _local_join(keys, nodes, lists, k, threshold), threshold, most_k), "nn-lists")
        seen = -1
        for _ in range(rounds):
            now = lists.agg(F.sum(F.size(F.filter("near", lambda x: x["sim"] >= threshold)))).first()[0] or 0
            if now == seen:
                break
            seen = now
            found = _local_join(_members(lists, k), nodes, lists, most_k, threshold)
            lists = materialize(_merged(lists, found, threshold, most_k), "nn-lists")
        degrees, links = _links(nodes, lists, threshold, k)
        audit = (truth.join(lists.where(_saturated(k, threshold)), "node", "left_anti").join(degrees, "node", "left")
                 .agg(F.count_if(F.coalesce("n", F.lit(0)) >= F.col("want")).alias("whole"), F.count("*").alias("vectors")).first())
        if audit.whole >= target * audit.vectors:
            break
    else:
        degrees, links = _links(nodes, lists, threshold, k, True)
    parts = connected_components(links, "nn")
    firsts = (nodes.join(parts, "node").groupBy("component").agg(F.min("first").alias("least")))
    named = (nodes.join(parts, "node", "left").join(firsts, "component", "left").join(degrees, "node", "left")
             .select("label", "vec", F.coalesce("least", "first").alias("component_id"),
                     (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    return rows.join(named, ["label", "vec"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _saturated(k: int, threshold: float) -> Column:
    return (F.size("near") >= k) & (F.get("near", F.size("near") - 1)["sim"] >= threshold)


def _links(nodes: DataFrame, lists: DataFrame, threshold: float, k: int, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """Direct links per node (without own copies) and links enough for the components.

    A list of ``k`` or more that ends in a link may be cut off: its node is completed
    exactly, with ``every`` all nodes are.
    """
    full = lists.where(F.lit(True) if every else _saturated(k, threshold)).select("node")
    full = materialize(full, "nn-saturated")
    near = (lists.select("node", F.explode("near").alias("x")).where(F.col("x.sim") >= threshold)
            .select(F.least("node", "x.nbr").alias("a"), F.greatest("node", "x.nbr").alias("b")).distinct()
            .join(full.withColumnRenamed("node", "a"), "a", "left_anti").join(full.withColumnRenamed("node", "b"), "b", "left_anti"))
    near = materialize(near.select("a", "b"), "nn-links")
    exact = materialize(_block_pass(full, nodes, threshold, True), "nn-exact")
    sizes = nodes.select("node", "copies")
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = (both.join(sizes.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), F.col("copies").alias("n"))
               .unionByName(exact.where("kind < 2").select(F.col("a").alias("node"), "n")))
    degrees = materialize(counted.groupBy("node").agg(F.sum("n").alias("n")), "nn-degrees")
    return degrees, near.unionByName(exact.where("kind = 2").select("a", "b"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
      AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT r.a AS vec_id, coalesce(any_value(n.n), 0) AS n_links, min(r.b) AS component_id, min(r.b) = r.a AS kept
FROM r LEFT JOIN n ON n.a = r.a GROUP BY r.a
"""
