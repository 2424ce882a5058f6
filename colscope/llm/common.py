"""Helpers the operators share: runs of equal keys, staged tables, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.session import materialize


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal keys, with the first row of each run (and the end).

    The partition must be sorted by ``key``, an integer column. Memory holds one
    Arrow batch and one unfinished run.
    """
    carry: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        carry.append(batch)
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if carry[0].column(key)[0].as_py() == keys[-1]:
            continue
        last = int(np.searchsorted(keys, keys[-1]))
        table = pa.Table.from_batches([*carry[:-1], batch.slice(0, last)])
        carry = [batch.slice(last)]
        yield table, _starts(table, key)
    if carry:
        table = pa.Table.from_batches(carry)
        yield table, _starts(table, key)


def _starts(table: pa.Table, key: str) -> np.ndarray:
    keys = table.column(key).to_numpy()
    return np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])


def per_run(df: DataFrame, key: str, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply ``fn`` to partitions that hold whole keys, sorted by key."""
    return df.repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(fn, schema)


FEW_EDGES = 1_000_000


def connected_components(edges: DataFrame, label: str, rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges`` has long columns ``a`` and ``b``; the result has ``node`` and
    ``component``. Large-star and small-star rounds: every step is a minimum per
    node (combined before the shuffle) and a join to one row per node. Of more edges than
    ``FEW_EDGES`` the minima are written first: both sides of the joins are then plain
    shuffles, so Spark splits a hub with a third of the edges. Fewer edges fit any task,
    and the write would take longer than the join. Each round is written to the shared
    folder, which also cuts its lineage.
    """
    stars = materialize(_oriented(edges.select("a", "b")), f"{label}-edges")
    before = _mark(stars)
    for _ in range(rounds):
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            stars.select(F.col("b").alias("u"), F.col("a").alias("v")))
        written = materialize if before[0] > FEW_EDGES else lambda df, _: df
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{label}-least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = materialize(_oriented(large), f"{label}-large")
        root = written(large.groupBy("a").agg(F.min("b").alias("m")), f"{label}-root")
        small = large.join(root, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            root.select("a", F.col("m").alias("b")))
        stars = materialize(_oriented(small), f"{label}-small")
        after = _mark(stars)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


LEAST_BITS, MOST_BITS = 1 << 24, 1 << 28


def member_words(df: DataFrame, column: str) -> np.ndarray:
    """A filter of a long column: 16 bits a row, rounded up to a power of two, 2 MiB at least and 32 MiB at most.

    It lets through every member and some others, more of them when rows outnumber the
    bits; a join must follow.
    """
    bits = LEAST_BITS
    rows = df.count()
    while bits < MOST_BITS and bits < 16 * rows:
        bits *= 2
    bit = F.pmod(F.col(column), F.lit(bits))
    rows = (df.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))").alias("bits"))
            .groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas())
    words = np.zeros(bits // 64, np.int64)
    words[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return words.view(np.uint64)


def membership(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    bit = values.view(np.uint64) & np.uint64(64 * len(words) - 1)
    return (words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
