"""Deduplication, joins and set comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as fn
from .ranking import row_positions

# The chart types kept for training and their numbers.
TRACE_CODES = {"bar": 0, "box": 1, "heatmap": 2, "histogram": 3, "line": 4, "scatter": 5}


# Types whose values fit, as a whole number, above 60 bits of hash in one decimal.
WHOLE = ("tinyint", "smallint", "int", "bigint", "date")


def keep_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """First row per key by ``order``; NULL comes last, ties go by a hash of the row.

    Keys become two 64-bit hashes, a row one; maps are hashed as JSON. With a whole-number
    order, that and the row's hash are packed into one decimal, so a single aggregate over
    narrow rows chooses, combined map-side and without a sort, and one semi-join then fetches
    the chosen rows. Other orders are compared alone first; whole rows are read and hashed only
    where they share the least.
    """
    kinds = dict(df.dtypes)
    flat = lambda c: F.to_json(F.struct(c)) if "map<" in kinds[c] else F.col(f"`{c}`")
    named = [x for k in keys for x in (F.col(f"`{k}`").isNull(), flat(k))]
    hashed = F.xxhash64(*[x for c in df.columns for x in (F.col(f"`{c}`").isNull(), flat(c))])
    ids = {"_k1": F.xxhash64(*named), "_k2": F.xxhash64(F.lit(1), *named)}
    by = list(ids)
    if kinds[order] not in WHOLE:
        marked = df.withColumns({**ids, "_order": F.col(order)})
        least = marked.groupBy(*by).agg(F.min("_order").alias("_least"))
        first = marked.join(least, by).where(F.col("_order").eqNullSafe(F.col("_least")))
        row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), hashed)
        return first.groupBy(*by).agg(row.alias("_first")).select(*[F.col("_first")[c].alias(c) for c in df.columns])
    place = F.unix_date(order) if kinds[order] == "date" else F.col(order)
    whole = F.coalesce(place.cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)"))
    packed = (whole * F.lit(str(1 << 60)).cast("decimal(19,0)") + F.shiftrightunsigned(hashed, 4)).cast("decimal(38,0)")
    marked = df.withColumns({**ids, "_row": packed})
    best = marked.groupBy(*by).agg(F.min("_row").alias("_row"))
    chosen = marked.join(best, [*by, "_row"], "left_semi")
    # The rows are dealt by key and hash already: equal rows meet without another shuffle.
    once = chosen.dropDuplicates([*by, "_row"]) if any("map<" in k for k in kinds.values()) else chosen.distinct()
    return once.select(*df.columns)


def distinct_ordered(df: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with the place of their first occurrence."""
    return df.groupBy(value).agg(F.min(order).alias("first_at"))


def union_chunks(parts: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name; columns missing in a part are NULL."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def known_traces(df: DataFrame, column: str = "trace_type") -> DataFrame:
    """Keep the six chart types and add their number."""
    codes = F.create_map(*[F.lit(x) for kv in TRACE_CODES.items() for x in kv])
    return df.where(F.col(column).isin(*TRACE_CODES)).withColumn(f"{column}_n", codes[F.col(column)])


def labeled_features(features: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Features joined with their labels, both reduced to the first row per field."""
    left = known_traces(keep_first(outcomes, ["field_id"], "fid")).drop("trace_type_n")
    right = keep_first(features, ["field_id"], "fid").where("exists")
    return left.join(right, ["field_id", "fid"])


def with_chart_type(features: DataFrame, cases: DataFrame, key: str = "fid") -> DataFrame:
    """Chart type looked up by case id."""
    return features.join(cases.select(F.col("id").alias(key), F.col("chart").alias("trace_type")), key)


def member_rows(df: DataFrame, ids: DataFrame, key: str = "fid") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def rekey_results(results: DataFrame, dataset: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dataset id per result by (queries, irrelevant tables); first match wins.

    Also returns the results without a match.
    """
    on = ["nl_queries", "irrelevant_tables"]
    index = dataset.groupBy(*on).agg(F.min("id").alias("data_id"))
    return results.join(index, on), results.join(index, on, "left_anti")


def table_recall(predicted: Column, truth: Column) -> Column:
    """Every true table is among the predicted ones (case and ``.csv`` ignored)."""
    have = F.transform(predicted, fn.bare_table_name)
    return F.size(F.array_except(F.transform(truth, F.lower), have)) == 0


def column_recall(predicted: Column, truth: Column) -> Column:
    """Every true table exists and holds all its true columns."""
    def covered(want: Column) -> Column:
        same = F.filter(F.map_entries(predicted),
                        lambda p: fn.bare_table_name(p["key"]) == F.lower(want["key"]))
        first = F.get(same, F.lit(0))
        left = F.array_except(F.transform(want["value"], F.lower), F.transform(first["value"], F.lower))
        return (F.size(same) > 0) & (F.size(left) == 0)
    return F.forall(F.map_entries(truth), covered)


def chunk_numbers(df: DataFrame, run: str, order: str, interval: int) -> DataFrame:
    """1-based report chunk per result; the last chunk of a run may be short."""
    placed = row_positions(df, [run], [order], "_pos")
    return (placed.withColumn("chunk_number", (F.floor(F.col("_pos") / interval) + 1).cast("bigint"))
            .withColumn("in_run", F.col("total")).drop("_pos", "total"))


# Reasons of manual corrections.
CORRECTION_REASONS = ["abnormal_gt", "format", "decimal", "merge"]


def apply_corrections(results: DataFrame, corrections: DataFrame) -> DataFrame:
    """Mark corrected results as right and reviewed ones as manual."""
    notes = corrections.select("data_id", F.col("reason").alias("correction_reason"), F.lit(True).alias("_seen"))
    fixed = F.col("correction_reason").isin(*CORRECTION_REASONS)
    joined = results.join(notes, "data_id", "left")
    return (joined.withColumn("manual", F.coalesce("_seen", F.lit(False)))
            .withColumn("correct", F.col("correct") | F.coalesce(fixed, F.lit(False)))
            .withColumn("correction_reason", F.when(fixed, F.col("correction_reason")))
            .drop("_seen"))
