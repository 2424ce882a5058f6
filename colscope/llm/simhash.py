"""SimHash near-duplicates: exact Hamming neighbours by vantage-point trees.

A top tree over a bounded sample of fingerprints deals all distinct fingerprints to
shards. A fingerprint up to ``radius`` outside a ball also goes to the ball's inner
shard, so every pair within the radius meets in at least one shard. Inside a shard the
same split goes on down to leaves, where pairs are compared bit-parallel. A leaf emits
a spanning forest of its links, not the links: what leaves a task is linear in its
fingerprints however dense a group of copies is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.session import materialize

from .common import connected_components, key_runs, per_run

LEAF = 512
TILE = 1024
FP_SCHEMA = "doc_id long, fp long"


def word_fingerprint(text: str | None, shingle: int) -> int:
    """64-bit majority of the XXH64 (seed 42) of word shingles, repeats included.

    Words are runs of non-white-space bytes after lower-casing A-Z. A text with fewer
    words has one shingle, its whole sequence; one without words (or NULL) gives 0.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    total, hashes = np.zeros(64, np.int64), []
    last = ends[min(shingle, len(words)) - 1:][:n].tolist()
    for at in range(0, n, 65536):
        hashes = np.fromiter([digest(joined[s:e], 42) for s, e in
                              zip(starts[at:at + 65536][:n - at].tolist(), last[at:at + 65536])], np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id`` and its fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([word_fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, FP_SCHEMA)


class VpTree:
    """Vantage points and radii over a sample; deals fingerprints to shards."""

    def __init__(self, sample: np.ndarray, shards: int, radius: int):
        self.radius, self.shards, self.root = radius, 0, None
        self.root = self._grow(np.unique(sample), max(8, len(sample) // max(1, shards)))

    def _grow(self, fps: np.ndarray, least: int):
        split = _best_split(fps, self.radius) if len(fps) > 2 * least else None
        if split is None:
            self.shards += 1
            return self.shards - 1
        vp, mu, d = split
        return vp, mu, self._grow(fps[d <= mu], least), self._grow(fps[d > mu], least)

    def deal(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard numbers and the fingerprints that go there."""
        shards, out, todo = [], [], [(self.root, fps)]
        while todo:
            node, part = todo.pop()
            if not len(part):
                continue
            if isinstance(node, int):
                shards.append(np.full(len(part), node, np.int64))
                out.append(part)
                continue
            vp, mu, inner, outer = node
            d = np.bitwise_count(part ^ vp).astype(np.int16)
            todo += [(inner, part[d <= mu + self.radius]), (outer, part[d > mu])]
        return (np.concatenate(shards), np.concatenate(out)) if out else (np.zeros(0, np.int64), fps[:0])


def _best_split(fps: np.ndarray, radius: int):
    """Vantage point and radius with the least work in both halves, or None."""
    best, found = 0.85 * float(len(fps)) ** 2, None
    for vp in fps[np.linspace(0, len(fps) - 1, 6).astype(int)]:
        d = np.bitwise_count(fps ^ vp).astype(np.int16)
        below = np.cumsum(np.bincount(d, minlength=65 + radius + 1)).astype(float)
        inner, outer = below[radius:], len(fps) - below[:len(below) - radius]
        work = np.where((outer > 0) & (inner < len(fps)), inner ** 2 + outer ** 2, np.inf)
        mu = int(np.argmin(work))
        if work[mu] < best:
            best, found = work[mu], (vp, mu, d)
    return found


def close_forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spanning forest (a, b, distance) of all pairs within ``radius``; shortest links first."""
    out, todo = [], [np.unique(fps)]
    while todo:
        part = todo.pop()
        split = _best_split(part, radius) if len(part) > LEAF else None
        if split is not None:
            _, mu, d = split
            todo += [part[d <= mu + radius], part[d > mu]]
            continue
        tiles = [part[i:i + TILE] for i in range(0, len(part), TILE)]
        for i, x in enumerate(tiles):
            for y in tiles[i + 1:] or [x[:0]]:
                out.append(_spanning(np.concatenate([x, y]), radius))
    a, b, d = (np.concatenate(x) for x in zip(*out)) if out else (fps[:0], fps[:0], np.zeros(0, np.int64))
    return a, b, d


def _spanning(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dist = np.bitwise_count(fps[:, None] ^ fps[None, :])
    np.fill_diagonal(dist, 255)
    some = np.flatnonzero((dist <= radius).any(1))
    dist = np.where(dist <= radius, dist, 255)[np.ix_(some, some)].astype(np.int64)
    fps, n = fps[some], len(some)
    near, parent, free = np.full(n, 255), np.zeros(n, np.int64), np.ones(n, bool)
    a, b, d = [], [], []
    for _ in range(n):
        i = int(np.argmin(np.where(free, near, 999)))
        if near[i] <= radius:
            a.append(fps[i]), b.append(fps[parent[i]]), d.append(near[i])
        free[i] = False
        closer = free & (dist[i] < near)
        near[closer], parent[closer] = dist[i][closer], i
    return np.array(a, np.uint64), np.array(b, np.uint64), np.array(d, np.int64)


def hamming_links(fps: DataFrame, radius: int = 2, sample: int = 8192, per_shard: int = 20_000, least_shards: int = 48) -> DataFrame:
    """Spanning links ``a``, ``b``, ``distance`` of distinct fingerprints within ``radius``.

    ``fps`` has one row per distinct ``t`` (number of a fingerprint table, links stay
    within one) and ``fp``. Only the top trees are fitted on samples (``sample``
    fingerprints a table or 16 a shard, in hash order, sent to the driver); every
    fingerprint is indexed and every pair within the radius is found. The number of shards
    follows the fingerprints, ``per_shard`` each, so a shard always fits one task.
    """
    sizes = {r.t: r.n for r in fps.groupBy("t").agg(F.count("*").alias("n")).collect()}
    trees = {}
    for t, n in sizes.items():
        shards = max(-(-least_shards // len(sizes)), -(-n // per_shard))
        rows = fps.where(F.col("t") == t).orderBy(F.xxhash64("fp"), "fp").limit(max(sample, 16 * shards)).toPandas()
        trees[t] = VpTree(rows["fp"].to_numpy(np.int64).view(np.uint64), shards, radius)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tables, fp = b.column("t").to_numpy(), b.column("fp").to_numpy().view(np.uint64)
            for t in np.unique(tables).tolist():
                shard, part = trees[t].deal(fp[tables == t])
                yield pa.RecordBatch.from_arrays([pa.array(shard + (t << 32)), pa.array(part.view(np.int64))], names=["shard", "fp"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in key_runs(batches, "shard"):
            shard, values = table.column("shard").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
            for s, e in zip(starts[:-1], starts[1:]):
                a, b, d = close_forest(values[s:e], radius)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), shard[s] >> 32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(d)],
                                                 names=["t", "a", "b", "distance"])

    dealt = fps.select(F.col("t").cast("long").alias("t"), "fp").mapInArrow(deal, "shard long, fp long")
    return per_run(dealt, "shard", pairs, "t long, a long, b long, distance long")


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every document.

    Documents link where fingerprints differ in ``radius`` bits or fewer; a component
    is named after its smallest id. Equal fingerprints are collapsed before the search
    and rejoined by a skew-splitting join. NULL, empty and blank texts have fingerprint
    zero and link like any other. A repeated row is returned as often as it stands; a
    NULL id is never a component's name unless the group has no other id. An empty table
    gives no rows. Other columns are ignored, whatever their names.
    """
    marked = materialize(fingerprints(docs, shingle, id_col, text_col), "simhash")
    names = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    parts = connected_components(hamming_links(names.withColumn("t", F.lit(0).cast("long")), radius), "simhash")
    roots = (names.join(parts.select(F.col("node").alias("fp"), "component"), "fp")
             .groupBy("component").agg(F.min("least").alias("first")))
    # Written, so that both sides of the last join are plain shuffles, which Spark splits when one is hot.
    named = materialize(names.join(parts.join(roots, "component").select(F.col("node").alias("fp"), "first"), "fp", "left")
                        .select("fp", F.coalesce("first", "least").alias("component_id")), "simhash-names")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """All columns of ``docs``, of each group of ``simhash_groups`` the document with the smallest id.

    Rows of one id are one document: they stay if any of them names its group. Rows
    without an id cannot be told apart and stay. Empty texts are one group, as their
    fingerprints are equal. An empty table gives no rows.
    """
    groups = simhash_groups(docs, shingle, radius)
    # Written, so that the join below has a plain side, which Spark splits when an id is hot.
    gone = materialize(groups.groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("gone"))
                       .where("gone").select("doc_id"), "simhash-gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
