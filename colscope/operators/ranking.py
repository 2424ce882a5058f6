"""Exact ranks inside groups of any size.

A window over a group puts the whole group in one task, which fails when one
column of a table holds a third of all rows. Here the rows are range-shuffled on
(keys, order), so a big group spreads over many partitions. Counts per
(keys, partition) are tiny, and their running sum turns local positions into
positions in the whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

PART = "_part"


def range_stage(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range-shuffle on (keys, order) and fix the partition number of every row.

    The written copy makes the numbering final: both the counts per partition
    and the rows read the same placement, whatever is recomputed later.
    """
    shuffled = df.repartitionByRange(*keys, *order)
    return materialize(shuffled.withColumn(PART, F.spark_partition_id()), "ranked")


def running_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                      weight: Column | None = None, lead_of: str | None = None) -> DataFrame:
    """Add ``before`` (weight of earlier rows of the group) and ``total``.

    With ``lead_of`` the next row's value of that column is added as ``nxt``.
    Every window here covers one (keys, partition) piece or one row per piece.
    """
    return staged_positions(range_stage(df, keys, order), keys, order, weight, lead_of)


def staged_positions(staged: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                     weight: Column | None = None, lead_of: str | None = None) -> DataFrame:
    """``running_positions`` of rows that ``range_stage`` has placed.

    Groups are matched as one struct, which is never NULL, so a NULL key is a
    group like any other and the windows reuse the shuffle of the join.
    """
    w = F.lit(1).cast("bigint") if weight is None else weight
    sums = [F.sum(w).alias("_w")]
    if lead_of:
        first = F.min(lead_of) if lead_of == order[0] else F.min_by(lead_of, F.struct(*order))
        sums.append(first.alias("_first"))
    group_key = F.struct(*keys).alias("_k")
    pieces = staged.groupBy(group_key, PART).agg(*sums)
    along = W.partitionBy("_k").orderBy(PART)
    group = W.partitionBy("_k")
    offsets = pieces.select(
        "_k", PART,
        F.coalesce(F.sum("_w").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.sum("_w").over(group).alias("total"),
        *([F.lead("_first").over(along).alias("_next_first")] if lead_of else []))
    local = W.partitionBy("_k", PART).orderBy(*order)
    prior = F.sum(w).over(local.rowsBetween(W.unboundedPreceding, -1))
    out = (staged.select("*", group_key).join(offsets, ["_k", PART])
           .withColumn("before", F.col("_offset") + F.coalesce(prior, F.lit(0))))
    if lead_of:
        out = out.withColumn("nxt", F.coalesce(F.lead(lead_of).over(local), F.col("_next_first")))
    return out.drop("_k", "_offset", "_next_first", PART)


def row_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  name: str = "position") -> DataFrame:
    """0-based position of each row in its group, and the group's row count ``total``."""
    return running_positions(df, keys, order).withColumnRenamed("before", name)


def quantile_columns(value: str, weight: Column, probs: dict[str, float]) -> dict[str, Column]:
    """Aggregates giving exact, linearly interpolated quantiles of ranked rows."""
    out = {}
    for name, p in probs.items():
        place = (F.col("total") - 1) * F.lit(float(p))
        low, high = F.floor(place), F.ceil(place)

        def at(k: Column) -> Column:
            inside = (F.col("before") <= k) & (k < F.col("before") + weight)
            return F.max(F.when(inside, F.col(value)))

        out[name] = at(low) + F.max(place - low) * (at(high) - at(low))
    return out


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    probs: dict[str, float], accuracy: int = 2000, count: str | None = None) -> DataFrame:
    """Exact quantiles per group of any size, moving only the rows near them.

    A mergeable sketch brackets each quantile: its rank error is at most
    ``n / accuracy``, and the bracket is four times as wide on both sides. One
    more scan counts the rows, keeping values inside a bracket and folding all
    others into one cell per gap. Sorting those few cells gives exact ranks. ``count``
    names a column with the group's number of values.
    """
    keys = list(keys)
    kept = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    margin = 4.0 / accuracy
    targets = sorted(set(probs.values()))
    edges = [max(p - margin, 0.0) for p in targets] + [min(p + margin, 1.0) for p in targets]
    sketch = F.percentile_approx("v", F.array(*[F.lit(e) for e in edges]), accuracy)
    brackets = materialize(kept.groupBy(*keys).agg(sketch.alias("_edges")), "brackets")

    m = len(targets)
    low = [F.get("_edges", F.lit(i)) for i in range(m)]
    high = [F.get("_edges", F.lit(m + i)) for i in range(m)]
    v = F.col("v")
    # Edges rise with the targets, so the number of brackets begun orders the cells,
    # and inside a cell everything beyond the brackets comes last.
    begun = sum(((v >= lo).cast("int") for lo in low), F.lit(0))
    inside = F.lit(False)
    for lo, hi in zip(low, high):
        inside = inside | v.between(lo, hi)
    cells = (kept.join(brackets, keys)
             .select(*keys, begun.alias("_begun"), (~inside).cast("int").alias("_beyond"),
                     F.when(inside, v).alias("v"))
             .groupBy(*keys, "_begun", "_beyond", "v").agg(F.count(F.lit(1)).alias("cnt")))
    ranked = running_positions(cells, keys, ["_begun", "_beyond", "v"], F.col("cnt"))
    cols = quantile_columns("v", F.col("cnt"), probs)
    counted = [F.max("total").alias(count)] if count else []
    return ranked.groupBy(*keys).agg(*[c.alias(n) for n, c in cols.items()], *counted)
