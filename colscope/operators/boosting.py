"""Gradient boosting over histograms: softmax loss, leaf-wise trees, one tree per class and round.

Features are binned once, to one byte each, and written in blocks of rows, column by
column, as only the passes read them. A pass over that table adds up gradients and
Hessians by (class, new leaf, feature, bin); the sums are shuffled by (class, feature) and
added, and the executors pick the best split of their features, so the driver sees a few
splits a pass whatever the number of rows, features and bins. The trees of a round, one
per class, grow in the same passes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

BINS, BLOCK, ROWS = 256, 8192, 50_000
STORED = "y binary, key binary, bins binary, scores binary"


@dataclass
class Tree:
    """Splits in the order they were made: split i sends part of ``leaf`` to the new leaf i + 1."""

    leaf: list[int] = field(default_factory=list)
    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    value: list[float] = field(default_factory=lambda: [0.0])

    def leaves(self, columns: Sequence[np.ndarray], binned: bool) -> np.ndarray:
        """Leaf number of every row; a missing value is bin 0, or NaN."""
        at = np.zeros(len(columns[0]), np.uint8)
        for i, (leaf, f) in enumerate(zip(self.leaf, self.feature)):
            x = columns[f]
            right = x > (self.bin[i] if binned else self.cut[i])
            if not self.missing_left[i]:
                right |= (x == 0) if binned else np.isnan(x)
            # Bytes are added, not assigned under a mask, which takes several times as long.
            at += (right & (at == leaf)).view(np.uint8) * np.uint8(i + 1 - leaf)
        return at


@dataclass
class BoostedModel:
    features: list[str]
    labels: list[str]
    label: str
    base: list[float]
    rounds: list[list[Tree]]

    def _probability(self) -> Column:
        base, rounds = np.array(self.base), self.rounds

        @F.pandas_udf("array<double>")
        def probability(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in batches:
                x = [c.to_numpy(float, na_value=np.nan) for c in columns]
                yield pd.Series(list(softmax(add_trees(start_scores(base, len(x[0])), rounds, x, False)).T))

        return probability(*[F.col(f"`{c}`").cast("double") for c in self.features])

    def transform(self, df: DataFrame) -> DataFrame:
        """``probability`` by class, ``prediction`` and, where the label column is there, its number ``label``.

        A class that training did not see gets the number after the last.
        """
        out = df.withColumn("probability", self._probability())
        out = out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))
        if self.label not in df.columns:
            return out
        at = F.array_position(F.array(*[F.lit(x) for x in self.labels]), F.col(f"`{self.label}`").cast("string"))
        return out.withColumn("label", F.when(at > 0, at - 1).otherwise(len(self.labels)).cast("double"))

    def importances(self) -> list[float]:
        """Share of the total gain by feature."""
        gains = np.zeros(len(self.features))
        for trees in self.rounds:
            for t in trees:
                np.add.at(gains, t.feature, t.gain)
        return (gains / max(gains.sum(), 1e-300)).tolist()

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedModel:
        kept = json.loads(spark.read.text(path, wholetext=True).first()[0])
        return BoostedModel(**{**kept, "rounds": [[Tree(**t) for t in trees] for trees in kept["rounds"]]})


def start_scores(base: np.ndarray, rows: int) -> np.ndarray:
    """Scores by class and row: a class is one run of memory."""
    return np.repeat(base[:, None], rows, axis=1)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=0))
    return e / e.sum(axis=0)


def add_trees(scores: np.ndarray, rounds: Sequence[Sequence[Tree]], columns: Sequence[np.ndarray], binned: bool) -> np.ndarray:
    for trees in rounds:
        for k, tree in enumerate(trees):
            if tree.leaf:
                scores[k] += np.take(np.array(tree.value), tree.leaves(columns, binned))
    return scores


def bin_edges(train: DataFrame, features: Sequence[str], accuracy: int = 10_000) -> list[np.ndarray]:
    """Upper edges of each feature's bins: quantiles, at most 254 of them."""
    shares = F.array(*[F.lit(i / (BINS - 1)) for i in range(1, BINS - 1)])
    value = lambda c: F.col(f"`{c}`").cast("double")
    row = train.agg(*[F.percentile_approx(F.when(~F.isnan(value(c)), value(c)), shares, accuracy).alias(str(i)) for i, c in enumerate(features)]).first()
    return [np.unique(np.array(row[i] or [], float)) for i in range(len(features))]


@dataclass
class Block:
    """Some thousand rows of the binned table."""

    y: np.ndarray
    key: np.ndarray
    bins: np.ndarray
    scores: np.ndarray

    def take(self, rows: np.ndarray) -> Block:
        return Block(self.y[rows], self.key[rows], self.bins[:, rows], self.scores[:, rows])


def _packed(block: Block) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (block.y, block.key, block.bins, block.scores)], names=["y", "key", "bins", "scores"])


def binned_table(train: DataFrame, features: Sequence[str], label: str, labels: Sequence[str], edges: Sequence[np.ndarray], base: Sequence[float], total: int) -> DataFrame:
    """Blocks of the class number ``y``, a ``key`` for drawing rows, a byte per feature (0: missing) and the scores so far."""
    start = np.array(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, BLOCK) for whole in batches for at in range(0, whole.num_rows, BLOCK)):
            bins = np.empty((len(edges), b.num_rows), np.uint8)
            for i, e in enumerate(edges):
                x = b.column(i + 2).to_numpy(zero_copy_only=False).astype(float)
                bins[i] = np.where(np.isnan(x), 0, np.searchsorted(e, x) + 1)
            yield _packed(Block(b.column(0).to_numpy(), b.column(1).to_numpy(), bins, start_scores(start, b.num_rows)))

    number = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(f"`{label}`").cast("string")).cast("int") - 1
    columns = [F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)]
    rows = train.where(F.col(f"`{label}`").isNotNull()).select(number.alias("y"), F.monotonically_increasing_id().alias("key"), *columns)
    # A pass over fewer rows than ROWS takes less time than a task; more files than cores are left as they come.
    cores, had = train.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()
    files = min(cores, -(-total // ROWS))
    spread = rows.repartition(files) if had < files else rows.coalesce(files) if had <= cores else rows
    return materialize(spread.mapInArrow(run, STORED), "binned")


def _read_blocks(binned: DataFrame) -> RDD:
    """The table as an RDD of ``Block``, kept by the executors: some hundred short passes read nothing else.

    A DataFrame pass would plan each of them anew, which takes longer than the pass. What
    a lost executor kept is read again from the written table.
    """
    def block(row) -> Block:
        y = np.frombuffer(row.y, np.int32)
        return Block(y, np.frombuffer(row.key, np.int64), np.frombuffer(row.bins, np.uint8).reshape(-1, len(y)), np.frombuffer(row.scores, float).reshape(-1, len(y)))

    return binned.rdd.map(block).persist(StorageLevel.MEMORY_AND_DISK)


def with_scores(blocks: RDD, rounds: Sequence[Sequence[Tree]]) -> RDD:
    """The blocks with more trees added to their scores, so that later passes need not walk them."""
    out = blocks.map(lambda b: Block(b.y, b.key, b.bins, add_trees(b.scores.copy(), rounds, list(b.bins), True))).persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    blocks.unpersist()
    return out


def in_bag(keys: np.ndarray, bag: int, share: float, seed: int) -> np.ndarray:
    """Whether a row is drawn: a hash of its key and the number of the draw."""
    mask = (1 << 64) - 1
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xD1B54A32D192ED03 + bag * 0x8CB92BA72F3D8DD7) & mask)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) < np.uint64(min(int(share * 2.0 ** 64), mask))


def drawn_rows(blocks: RDD, bag: int, share: float, seed: int) -> RDD:
    """The rows of one draw without their keys, kept until the next draw: its passes read nothing else."""
    def draw(block: Block) -> Block:
        drawn = block.take(np.flatnonzero(in_bag(block.key, bag, share, seed)))
        return Block(drawn.y.astype(np.min_scalar_type(len(drawn.scores))), drawn.key[:0], drawn.bins, drawn.scores)

    return blocks.map(draw).persist(StorageLevel.MEMORY_AND_DISK)


def gradient_cells(block: Block, trees: Sequence[Tree], wanted: Sequence[Sequence[int]], allowed: Sequence[Sequence[int]]) -> list[np.ndarray]:
    """Per class: gradients, Hessians and rows by (allowed feature, wanted leaf, bin) as an array of three sums a cell."""
    k, columns = len(block.scores), list(block.bins)
    p, out = softmax(block.scores), []
    for c in range(k):
        slots = len(wanted[c])
        sums = np.zeros((len(allowed[c]), slots, BINS, 3))
        out.append(sums)
        if not slots:
            continue
        g = p[c] - (block.y == c)
        h = np.maximum(k / (k - 1) * p[c] * (1 - p[c]), 1e-16) if k > 1 else np.full(len(block.y), 1e-16)
        # Cells of all leaves are counted at once; a leaf that is not wanted goes behind the others.
        start = np.full(len(trees[c].leaf) + 1, slots * BINS)
        start[list(wanted[c])] = np.arange(slots) * BINS
        first = np.take(start, trees[c].leaves(columns, True))
        for i, f in enumerate(allowed[c]):
            cell = first + columns[f]
            for j, w in enumerate((g, h, None)):
                sums[i, :, :, j] = np.bincount(cell, weights=w, minlength=(slots + 1) * BINS)[:slots * BINS].reshape(slots, BINS)
    return out


@dataclass
class Split:
    gain: float
    feature: int
    bin: int
    missing_left: bool
    left: np.ndarray
    right: np.ndarray


def best_split(cells: np.ndarray, feature: int, least_rows: int, least_hessian: float) -> Split | None:
    """The split of one leaf by one feature that gains most; ``cells`` are sums by bin. The first of equal ones."""
    best, whole = None, cells.sum(axis=0)
    parent = whole[0] ** 2 / max(whole[1], 1e-16)
    for missing_left in ((True, False) if cells[0, 2] else (True,)):
        left = np.cumsum(cells[1:-1], axis=0) + (cells[0] if missing_left else 0)
        right = whole - left
        ok = (np.minimum(left[:, 2], right[:, 2]) >= least_rows) & (np.minimum(left[:, 1], right[:, 1]) >= least_hessian)
        if not ok.any():
            continue
        gain = np.where(ok, left[:, 0] ** 2 / np.maximum(left[:, 1], 1e-16) + right[:, 0] ** 2 / np.maximum(right[:, 1], 1e-16) - parent, -1.0)
        at = int(np.argmax(gain))
        if gain[at] > 1e-9 and (best is None or gain[at] > best.gain):
            best = Split(float(gain[at]), feature, at + 1, missing_left, left[at], right[at])
    return best


def _keep_best(found: dict[tuple[int, int], Split], key: tuple[int, int], split: Split | None) -> None:
    """Of equal gains that of the first feature stands, in whatever order the splits come."""
    if split and (key not in found or (split.gain, -split.feature) > (found[key].gain, -found[key].feature)):
        found[key] = split


def _best_splits(drawn: RDD, rounds: Sequence[Sequence[Tree]], trees: Sequence[Tree], wanted: Sequence[Sequence[int]], allowed: Sequence[Sequence[int]], features: int,
                 least_rows: int, least_hessian: float) -> dict[tuple[int, int], Split]:
    """The split of most gain by (class, leaf); the sums of a class and feature meet in one task, only splits go to the driver."""
    def partial(part: Iterator[Block]) -> Iterator[tuple[int, np.ndarray]]:
        total = None
        for block in part:
            block.scores = add_trees(block.scores.copy(), rounds, list(block.bins), True)
            cells = gradient_cells(block, trees, wanted, allowed)
            total = [a + b for a, b in zip(total, cells)] if total else cells
        for c, sums in enumerate(total or []):
            if wanted[c]:
                yield from ((c * features + f, cells) for f, cells in zip(allowed[c], sums))

    def choose(part: Iterator[tuple[int, np.ndarray]]) -> Iterator[dict[tuple[int, int], Split]]:
        found = {}
        for key, cells in part:
            c, f = divmod(key, features)
            for slot, leaf in enumerate(wanted[c]):
                _keep_best(found, (c, leaf), best_split(cells[slot], f, least_rows, least_hessian))
        yield found

    sums, pieces = drawn.mapPartitions(partial), drawn.getNumPartitions()
    if pieces > 1:
        tasks = min(pieces, drawn.context.defaultParallelism, len(trees) * features)
        sums = sums.reduceByKey(lambda a, b: a + b, tasks, int)
    best = {}
    for found in sums.mapPartitions(choose).collect():
        for key, split in found.items():
            _keep_best(best, key, split)
    return best


class _Growing:
    """A tree while its leaves are split, the one of most gain first."""

    def __init__(self, allowed: Sequence[int], leaves: int, deepest: int):
        self.tree, self.allowed, self.leaves, self.deepest = Tree(), allowed, leaves, deepest
        self.depth, self.sums, self.open, self.new = [0], [np.zeros(3)], {}, [0]

    def wanted(self) -> list[int]:
        """Leaves whose sums a further split needs."""
        return [n for n in self.new if self.depth[n] < self.deepest] if len(self.depth) < self.leaves else []

    def grow(self, splits: dict[int, Split], edges: Sequence[np.ndarray]) -> None:
        """Take the best splits of the wanted leaves and make those of most gain."""
        self.open |= splits
        self.new = []
        while self.open and len(self.depth) < self.leaves and not self.wanted():
            leaf = max(self.open, key=lambda n: self.open[n].gain)
            s, t, new = self.open.pop(leaf), self.tree, len(self.depth)
            t.leaf.append(leaf), t.feature.append(s.feature), t.bin.append(s.bin), t.gain.append(s.gain), t.missing_left.append(s.missing_left)
            t.cut.append(float(edges[s.feature][s.bin - 1]) if s.bin <= len(edges[s.feature]) else float("inf"))
            self.depth[leaf] += 1
            self.depth.append(self.depth[leaf])
            self.sums[leaf] = s.left
            self.sums.append(s.right)
            self.new = [leaf, new]

    def close(self, rate: float) -> Tree:
        if self.tree.leaf:
            self.tree.value = [float(-rate * g / max(h, 1e-16)) for g, h, _ in self.sums]
        return self.tree


def _dropped(kept: RDD | None) -> None:
    """Give up what the executors keep of an earlier draw."""
    if kept is not None:
        kept.unpersist()


def fit(train: DataFrame, features: Sequence[str], label: str, trees: int = 100, leaves: int = 3, depth: int = 2, rate: float = 0.1, least_rows: int = 40,
        least_hessian: float = 3.0, feature_share: float = 0.8, row_share: float = 0.8, row_every: int = 5, refresh: int = 5, seed: int = 100) -> BoostedModel:
    """Boosted trees for the classes in ``label``; rows without a label take no part.

    Every round grows one tree per class to at most ``leaves`` leaves and ``depth`` levels
    over a share of the features; the share of rows is drawn anew every ``row_every``
    rounds. A leaf keeps ``least_rows`` rows and a Hessian sum of ``least_hessian``. NULL and NaN go
    to the side that gains more. Training ends early when no class finds a split.
    """
    counts = {r.c: r.n for r in train.where(F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{label}`").cast("string").alias("c")).agg(F.count("*").alias("n")).collect()}
    labels = sorted(counts)
    if not labels:
        raise ValueError("no labelled rows")
    base = [float(np.log(counts[c] / sum(counts.values()))) for c in labels]
    edges = bin_edges(train, features)
    blocks, kept, fresh = _read_blocks(binned_table(train, features, label, labels, edges, base, sum(counts.values()))), [], []
    rng, drawn = np.random.default_rng(seed), None
    for r in range(trees if len(labels) > 1 else 0):
        if len(fresh) == refresh:
            blocks, kept, fresh, drawn = with_scores(blocks, fresh), kept + fresh, [], _dropped(drawn)
        if drawn is None or r % row_every == 0:
            _dropped(drawn)
            drawn = drawn_rows(blocks, r // row_every, row_share, seed)
        size = max(1, round(feature_share * len(features)))
        growing = [_Growing(sorted(rng.choice(len(features), size, replace=False).tolist()), leaves, depth) for _ in labels]
        while any(wanted := [g.wanted() for g in growing]):
            best = _best_splits(drawn, fresh, [g.tree for g in growing], wanted, [g.allowed for g in growing], len(features), least_rows, least_hessian)
            for c, g in enumerate(growing):
                g.grow({leaf: split for (k, leaf), split in best.items() if k == c}, edges)
        if not any(g.tree.leaf for g in growing):
            break
        fresh = fresh + [[g.close(rate) for g in growing]]
    _dropped(drawn)
    blocks.unpersist()
    return BoostedModel(list(features), labels, label, base, kept + fresh)
