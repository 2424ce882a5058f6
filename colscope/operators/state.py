"""Profile state of a growing corpus: mergeable summaries per chunk, united without rereading cells.

Exact profiles (``operators/profile.py``) read every cell again when a chunk comes in. A
state keeps per field what can be merged: counts and ends exactly, distinct values,
frequent values and quantiles as sketches of bounded size. Stated errors, of the merged
state: distinct values within 1.04 / sqrt(2^12) = 1.7 % (one standard error; exact for a few
hundred), frequent values exact while a field has no more than ``TRACKED`` distinct ones,
else their counts are off by at most 3.5 n / 8192 and values no more frequent than that may
be missing (all of them, in a long flat field), ranks of quantiles within about 0.5 %.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import append_chunk, read_chunks

KEYS = ("fid", "field_id")
DISTINCT_BITS = 12
TRACKED = 4096
QUANTILE_K = 800


def field_state(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mergeable summary of each field of ``cells`` (``keys`` and ``raw`` as text).

    Numbers are the finite values the texts read as; other texts and NULLs are left out of
    the ends and quantiles. A field of NULLs only has empty sketches; an empty table
    gives no rows. Partial states combine before the shuffle, so a hot field is no hot task.
    """
    number = F.expr("try_cast(raw as double)")
    finite = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    return cells.select(*keys, "raw", finite.alias("x")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("raw").isNull()).alias("nulls"), F.count("x").alias("numbers"),
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("x").alias("total"),
        # Hashes, as the sketch would pass over the empty text.
        F.hll_sketch_agg(F.when(F.col("raw").isNotNull(), F.xxhash64("raw")), F.lit(DISTINCT_BITS)).alias("distinct_state"),
        F.expr(f"approx_top_k_accumulate(raw, {TRACKED}) filter (where raw is not null)").alias("common_state"),
        F.kll_sketch_agg_double("x", F.lit(QUANTILE_K)).alias("quantile_state"))


def merge_states(states: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One state per field from the states of its chunks; states of states merge alike."""
    return states.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("n", "nulls", "numbers")], F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("total").alias("total"),
        F.hll_union_agg("distinct_state").alias("distinct_state"),
        F.expr("approx_top_k_combine(common_state)").alias("common_state"),
        F.kll_merge_agg_double("quantile_state").alias("quantile_state"))


def state_profile(states: DataFrame, common: int = 5, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Readable figures of merged states: ``n_distinct``, ``common`` (value, count) and ``q25``-like columns."""
    some = F.col("numbers") > 0
    at = {f"q{round(q * 100)}": F.when(some, F.kll_sketch_get_quantile_double("quantile_state", F.lit(float(q)))) for q in quantiles}
    return states.select(
        *[c for c in states.columns if not c.endswith("_state") and c != "total"], (F.col("total") / F.when(some, F.col("numbers"))).alias("mean"),
        F.hll_sketch_estimate("distinct_state").alias("n_distinct"),
        F.expr(f"approx_top_k_estimate(common_state, {common})").alias("common"), *[c.alias(name) for name, c in at.items()])


def add_chunk(cells: DataFrame, root: str, chunk: int) -> None:
    """Keep the state of one chunk; a repeated chunk replaces itself."""
    append_chunk({"states": field_state(cells)}, root, chunk)


def corpus_state(spark: SparkSession, root: str) -> DataFrame:
    """Merged states of all chunks kept under ``root``; no cell is read."""
    empty = spark.createDataFrame([], "fid string, field_id string, raw string")
    return merge_states(read_chunks(spark, root, "states", field_state(empty).schema).drop("chunk"))
