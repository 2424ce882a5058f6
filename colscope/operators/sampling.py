"""Deterministic splits and samples, driven by md5 of the row key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .ranking import row_positions


def hash_order(key: Column, seed: str = "") -> Column:
    """Seeded pseudo-random order of keys, equal on every engine and run."""
    return F.md5(F.concat(F.lit(seed), key.cast("string")).cast("binary"))


def hash_number(key: Column, seed: str = "") -> Column:
    """The first 32 bits of the hash, 0 to 2^32 - 1."""
    return F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("bigint")


def assign_split(df: DataFrame, key: str, weights: dict[str, float], seed: str = "",
                 name: str = "split") -> DataFrame:
    """Split name per row from its key: all rows of a key stay together, no shuffle.

    Shares are exact to 2^-32: a key's 32-bit hash is compared with the summed weights.
    """
    number, edge, chain = hash_number(F.col(key), seed), 0.0, None
    total = sum(weights.values())
    names = list(weights)
    for split in names[:-1]:
        edge += weights[split] / total
        hit = number < round(edge * (1 << 32))
        chain = F.when(hit, split) if chain is None else chain.when(hit, split)
    last = F.lit(names[-1])
    return df.withColumn(name, last if chain is None else chain.otherwise(last))


# Hex digits of the hash by which rows are counted before any is ranked: 4096 buckets.
DIGITS = 3
BEYOND = "g"  # after every hex digit


def _bucket(hashed: Column) -> Column:
    return F.substring(hashed, 1, DIGITS)


def random_sample(df: DataFrame, n: int, key: str, seed: str = "") -> DataFrame:
    """``n`` rows with the smallest hashes (all rows when there are fewer). ``key`` is unique.

    One pass counts rows by the first digits of the hash. Keys in buckets below the one in
    which the n-th row lies are taken by a filter; only that one bucket's keys are ranked.
    """
    hashed = hash_order(F.col(key), seed)
    counts = sorted(map(tuple, df.groupBy(_bucket(hashed).alias("b")).agg(F.count("*").alias("n")).collect()), key=lambda r: r[0] or BEYOND)
    before, edge = 0, BEYOND
    for bucket, rows in counts:
        if before + rows > n:
            edge = bucket
            break
        before += rows
    if edge == BEYOND:
        return df
    narrow = df.select(F.col(key).alias("_key"), hashed.alias("_h"))
    at_edge = narrow.where(_bucket(F.col("_h")).eqNullSafe(F.lit(edge)))
    few = row_positions(at_edge.withColumn("_all", F.lit(0)), ["_all"], ["_h", "_key"], "_pos").where(F.col("_pos") < n - before)
    below = narrow.where(_bucket(F.col("_h")) < F.coalesce(F.lit(edge), F.lit(BEYOND)))
    chosen = materialize(below.select("_key").unionByName(few.select("_key")), "sample")
    return df.join(chosen, F.col(key).eqNullSafe(F.col("_key")), "left_semi")


def first_rows(df: DataFrame, n: int, order: Sequence[Column], key: str) -> DataFrame:
    """The first ``n`` rows by ``order`` and the unique ``key``, whatever ``n`` is."""
    narrow = df.select(F.col(key).alias("_key"), F.lit(0).alias("_all"), *order)
    columns = [c for c in narrow.columns if c not in ("_key", "_all")]
    placed = row_positions(narrow, ["_all"], [*columns, "_key"], "_pos").where(F.col("_pos") < n)
    return df.join(placed.select("_key"), F.col(key).eqNullSafe(F.col("_key")), "left_semi")


def stratified_sample(df: DataFrame, n: int, stratum: str, key: str, seed: str = "") -> DataFrame:
    """Floor share of each stratum, the rest filled from all other rows; small hashes first. ``key`` is unique.

    One pass counts rows by stratum and first digits of the hash. That gives, per stratum,
    the bucket its share ends in: what lies below is taken by a filter, and only the rows
    of those buckets, and of the few buckets that fill the rest, are ranked.
    """
    hashed = F.coalesce(hash_order(F.col(key), seed), F.lit("f" * 32))
    narrow = df.select(F.struct(F.col(stratum)).alias("_s"), F.col(key).alias("_key"), hashed.alias("_h"))
    counts = materialize(narrow.groupBy("_s", _bucket(F.col("_h")).alias("_b")).agg(F.count("*").alias("n")), "strata")
    rows = counts.agg(F.sum("n")).first()[0] or 0
    along = W.partitionBy("_s").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    size = F.sum("n").over(W.partitionBy("_s"))
    run = counts.withColumns({"_before": F.coalesce(F.sum("n").over(along), F.lit(0)),
                              "_quota": F.least(F.floor(size * F.lit(n) / F.lit(max(rows, 1))), size)})
    taken = F.greatest(F.lit(0), F.least("n", F.col("_quota") - F.col("_before")))
    run = materialize(run.withColumn("_over", F.col("n") - taken), "strata-run")
    # One row per stratum: the bucket its share ends in, and how many of its rows are wanted.
    edges = run.groupBy("_s").agg(F.coalesce(F.min(F.when(F.col("_over") > 0, F.col("_b"))), F.lit(BEYOND)).alias("_edge"),
                                  F.max(F.when(F.col("_over") > 0, F.greatest(F.lit(0), F.col("_quota") - F.col("_before")))).alias("_need"))
    buckets = sorted(map(tuple, run.groupBy("_b").agg(F.sum("n"), F.sum("_over")).collect()))
    missing = n - sum(all_ - over for _, all_, over in buckets)
    last, spare = "", 0
    for bucket, _, over in buckets:
        if spare >= missing:
            break
        last, spare = bucket, spare + over
    close = narrow.join(edges, "_s").withColumn("_b", _bucket(F.col("_h")))
    at_edge = row_positions(close.where("_b = _edge"), ["_s"], ["_h", "_key"], "_pos")
    at_edge = at_edge.select("_key", "_h", "_b", (F.col("_pos") < F.col("_need")).alias("_in"))
    left = at_edge.where(~F.col("_in") & (F.col("_b") <= last)).select("_key", "_h").unionByName(
        close.where((F.col("_b") > F.col("_edge")) & (F.col("_b") <= last)).select("_key", "_h"))
    filled = row_positions(left.withColumn("_all", F.lit(0)), ["_all"], ["_h", "_key"], "_place").where(F.col("_place") < missing)
    below = close.where("_b < _edge")
    chosen = materialize(below.select("_key").unionByName(at_edge.where("_in").select("_key")).unionByName(filled.select("_key")), "sample")
    return df.join(chosen, F.col(key).eqNullSafe(F.col("_key")), "left_semi")


def systematic_sample(df: DataFrame, n: int, key: str, seed: str = "", start: int | None = None) -> DataFrame:
    """Every ``N // n``-th row by (unique) key from a hashed start, ``n`` rows in all."""
    # Only keys are ranked and written; the few chosen ones then pick their rows.
    placed = row_positions(df.select(key, F.lit(0).alias("_all")), ["_all"], [key], "_pos")
    step = F.greatest(F.floor(F.col("total") / n), F.lit(1))
    number = F.conv(F.substring(F.md5(F.lit(f"start{seed}").cast("binary")), 1, 8), 16, 10).cast("bigint")
    first = F.pmod(number, step) if start is None else F.lit(start)
    gap = F.col("_pos") - first
    chosen = placed.where((gap >= 0) & (gap % step == 0) & (F.floor(gap / step) < n))
    return df.join(chosen.select(key), key, "left_semi")


def sample_examples(df: DataFrame, n: int | None, key: str, method: str = "random",
                    stratum: str | None = None, seed: str = "") -> DataFrame:
    """Sample by method; no size, an unknown method or a missing stratum keeps all rows."""
    if n is None or method not in ("random", "stratified", "systematic"):
        return df
    if method == "random":
        return random_sample(df, n, key, seed)
    if method == "systematic":
        return systematic_sample(df, n, key, seed)
    return df if stratum is None else stratified_sample(df, n, stratum, key, seed)


def row_split(df: DataFrame, weights: Sequence[float], key: str, seed: str = "") -> list[DataFrame]:
    """Disjoint parts covering all rows."""
    names = {str(i): w for i, w in enumerate(weights)}
    marked = assign_split(df, key, names, seed, "_part")
    return [marked.where(F.col("_part") == name).drop("_part") for name in names]
