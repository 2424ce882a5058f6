"""Column profiling: raw cells in, one row of features per field out.

Input of the raw functions is the long *cells* table
``(fid, field_id, field_name, ord, pos, raw)``. Everything but the sequence
features is computed from the histogram ``(fid, field_id, raw, cnt)``: repeated
values collapse map-side before the first shuffle, and no step needs a whole
field in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names as fn
from ..functions import typing as ty
from ..session import materialize
from .ranking import PART, quantile_columns, range_stage, row_positions, running_positions, staged_positions

KEYS = ["fid", "field_id"]

# The two readings of the quantile probabilities. The reference
# numbers are hundredths of a percent, so its "q25" is the 0.25th percentile.
QUANTILE_SCALES = {
    "reference": {"q1": 0.0001, "q25": 0.0025, "q75": 0.0075, "q99": 0.0099},
    "quartile": {"q1": 0.01, "q25": 0.25, "q75": 0.75, "q99": 0.99},
}


# ---------------------------------------------------------------- histograms

# Longest array a repeated value is unfolded into.
UNFOLD = 65_536


def raw_histogram(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distinct raw texts per field with their counts.

    A field's name and place belong to its key: carried as aggregates they would make
    Spark sort every cell before counting.
    """
    return cells.groupBy(*keys, *_carried(cells), "raw").agg(F.count(F.lit(1)).alias("cnt"))


def _carried(df: DataFrame) -> list[str]:
    return [c for c in ("field_name", "ord") if c in df.columns]


def value_histogram(rows: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Distinct non-null values per group with their counts."""
    weight = F.sum("cnt") if "cnt" in rows.columns else F.count(F.lit(1))
    return (rows.where(F.col(value).isNotNull())
            .groupBy(*keys, F.col(value).alias("v")).agg(weight.alias("cnt")))


# ------------------------------------------------- basics, types, uniqueness

def field_basics(hist: DataFrame, keys: Sequence[str] = KEYS, also: Sequence[Column] = ()) -> DataFrame:
    """Length, missing values, type votes and the winning type of each field, and the aggregates in ``also``."""
    votes = ty.vote_columns(F.col("raw"), F.col("cnt"))
    counted = hist.groupBy(*keys, *_carried(hist)).agg(
        F.sum("cnt").alias("length"),
        F.sum(F.when(F.col("raw").isNull(), F.col("cnt")).otherwise(F.lit(0))).alias("num_none"),
        *[c.alias(f"score_{n}") for n, c in votes.items()], *also)
    scores = {n: F.col(f"score_{n}") for n in ty.TYPE_ORDER}
    typed = (counted.withColumn("data_type", ty.winning_type(scores))
             .withColumn("general_type", ty.general_type(F.col("data_type"))))
    return typed.select(
        "*", F.lit(True).alias("exists"),
        *[(F.col("data_type") == t).alias(f"data_type_is_{t}") for t in ty.TYPE_ORDER],
        *[(F.col("general_type") == g).alias(f"general_type_is_{g}") for g in ("c", "q", "t")],
        F.try_divide("num_none", "length").alias("percentage_none"),
        (F.col("num_none") > 0).alias("has_none"))


def only_field(basics: DataFrame, table_key: str = "fid") -> DataFrame:
    """Mark fields that are alone in their table."""
    widths = basics.groupBy(table_key).agg((F.count(F.lit(1)) == 1).alias("is_only_field"))
    return basics.join(widths, table_key)


def uniqueness(hist: DataFrame, keys: Sequence[str] = KEYS, threshold: float = 0.95) -> DataFrame:
    """Distinct count, share and flags from a histogram of values ``v``."""
    share = F.try_divide(F.count(F.lit(1)), F.sum("cnt"))
    return hist.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_unique_elements"),
        share.alias("unique_percent"),
        (F.count(F.lit(1)) == F.sum("cnt")).alias("is_unique"),
        (share >= threshold).alias("is_unique_list"))


def categorical_stats(hist: DataFrame, keys: Sequence[str] = KEYS, value: str = "raw") -> DataFrame:
    """Text length statistics, frequency entropy and share of the mode.

    Lengths are regrouped first; that table is as small as the longest text.
    """
    kept = hist.where(F.col(value).isNotNull())
    freq = kept.groupBy(*keys).agg(
        F.sum("cnt").alias("n"),
        F.sum(F.col("cnt") * F.ln(F.col("cnt"))).alias("_clnc"),
        F.max("cnt").alias("_mode"))
    lengths = kept.groupBy(*keys, F.length(value).cast("double").alias("v")).agg(F.sum("cnt").alias("cnt"))
    mean = F.try_divide(F.sum(F.col("v") * F.col("cnt")), F.sum("cnt"))
    spread = lengths.groupBy(*keys).agg(
        mean.alias("mean_value_length"),
        F.percentile(F.col("v"), 0.5, F.col("cnt")).alias("median_value_length"),
        F.min("v").alias("min_value_length"), F.max("v").alias("max_value_length"),
        F.sqrt(F.greatest(F.try_divide(F.sum(F.col("v") * F.col("v") * F.col("cnt")), F.sum("cnt")) - mean * mean, F.lit(0.0)))
        .alias("std_value_length"))
    n = F.col("n")
    return (freq.select(*keys,
                        F.greatest(F.ln(n) - F.col("_clnc") / n, F.lit(0.0)).alias("list_entropy"),
                        F.try_divide("_mode", "n").alias("percentage_of_mode"))
            .join(spread, list(keys)))


# ------------------------------------------------------------ numeric fields

def value_totals(hist: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """First pass over values: count, mean, range and the value entropy."""
    size = F.abs(F.col("v"))
    return _with_mean(hist.groupBy(*keys).agg(
        F.sum("cnt").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.sum(F.col("v") * F.col("cnt")).alias("_sum"), F.sum(size * F.col("cnt")).alias("_abs"), F.sum(_xlnx(F.col("v")) * F.col("cnt")).alias("_xlnx")))


def _xlnx(v: Column) -> Column:
    return F.when(v == 0, F.lit(0.0)).otherwise(F.abs(v) * F.ln(F.abs(v)))


def _with_mean(totals: DataFrame) -> DataFrame:
    """Mean and value entropy of totals."""
    return (totals.withColumn("mean", F.col("_sum") / F.col("n"))
            .withColumn("entropy", F.when(
                (F.col("min") >= 0) | (F.col("max") <= 0),
                F.when(F.col("_abs") > 0, F.ln("_abs") - F.try_divide("_xlnx", "_abs"))))
            .drop("_abs", "_xlnx"))


def centered_stats(hist: DataFrame, totals: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Second pass, around the mean: variance, shape, moments, mean deviation.

    Moments are taken around the mean found before, because raw power sums cancel.
    The totals are one row per group; AQE broadcasts them when they are small and
    splits the skewed side of a sort-merge join otherwise.
    """
    gap = F.col("v") - F.col("mean")
    joined = hist.join(totals.select(*keys, "mean"), list(keys))
    weight = F.sum("cnt")
    sums = joined.groupBy(*keys).agg(
        *[(F.sum(F.pow(gap, F.lit(k)) * F.col("cnt")) / weight).alias(f"moment_{k}") for k in range(2, 11)],
        (F.sum(F.abs(gap) * F.col("cnt")) / weight).alias("avg_abs_dev"))
    return _with_shape(sums)


def _with_shape(sums: DataFrame) -> DataFrame:
    """Variance and shape of the moments."""
    var = F.col("moment_2")
    out = (sums.withColumn("var", var).withColumn("std", F.sqrt("var"))
           .withColumn("skewness", F.try_divide(F.col("moment_3"), F.pow("moment_2", F.lit(1.5))))
           .withColumn("kurtosis", F.try_divide(F.col("moment_4"), var * var) - 3.0))
    return out.drop("moment_2", "moment_3", "moment_4")


def stage_values(hist: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The histogram written once in value order; every numeric pass reads it."""
    return range_stage(hist, keys, ["v"])


def ranked_values(staged: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Staged rows with ``before``, ``total`` and the next larger value ``nxt``."""
    return staged_positions(staged, keys, ["v"], F.col("cnt"), lead_of="v")


def order_stats(ranked: DataFrame, keys: Sequence[str] = KEYS,
                quantile_scale: str = "reference", also: Sequence[str] = ()) -> DataFrame:
    """Everything that needs sorted values: quantiles, Gini, spacing, distinct count.

    Quantiles of the scales in ``also`` come from the same pass, prefixed with their name.
    """
    probs = {"median": 0.5, **QUANTILE_SCALES[quantile_scale]}
    for other in also:
        probs |= {f"{other}_{q}": p for q, p in QUANTILE_SCALES[other].items()}
    n = F.max("total")
    low, high, total = F.min("v"), F.max("v"), F.sum(F.col("v") * F.col("cnt"))
    shift = F.when(low < 0, -low).otherwise(F.lit(0.0))
    gini_top = F.sum(F.col("cnt") * (2 * F.col("before") + F.col("cnt") - F.col("total")) * F.col("v"))
    step = F.col("nxt") - F.col("v")
    # n-1 ratios of neighbours: repeats inside a value give 1, x/0 makes the field NULL.
    ratio = F.try_divide(F.col("v"), F.col("nxt"))
    blocked = F.max(((F.col("nxt") == 0) | ((F.col("v") == 0) & (F.col("cnt") > 1))).cast("int"))
    repeats = F.sum(F.col("cnt") - 1)
    ratio_mean = F.try_divide(repeats + F.coalesce(F.sum(ratio), F.lit(0.0)), n - 1)
    ratio_sq = F.try_divide(repeats + F.coalesce(F.sum(ratio * ratio), F.lit(0.0)), n - 1)
    step_mean = F.try_divide(high - low, n - 1)
    step_sq = F.try_divide(F.coalesce(F.sum(step * step), F.lit(0.0)), n - 1)

    return _with_spacing(ranked.groupBy(*keys).agg(
        *[c.alias(name) for name, c in quantile_columns("v", F.col("cnt"), probs).items()],
        F.try_divide(gini_top, n * (total + n * (shift + 1e-7))).alias("gini"),
        F.count(F.lit(1)).alias("num_unique_values"),
        _coefficient(step_sq, step_mean).alias("lin_space_sequence_coeff"),
        F.when(blocked == 0, _coefficient(ratio_sq, ratio_mean)).alias("log_space_sequence_coeff")))


def _coefficient(square: Column, mean: Column) -> Column:
    """Standard deviation over mean, from the means of squares and values."""
    return F.try_divide(F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))), mean)


def _with_spacing(ordered: DataFrame) -> DataFrame:
    """Spacing flags and the quartile dispersion."""
    return (ordered.withColumn("is_lin_space", F.coalesce(F.col("lin_space_sequence_coeff") <= 0.001, F.lit(False)))
            .withColumn("is_log_space", F.coalesce(F.col("log_space_sequence_coeff") <= 0.001, F.lit(False)))
            .withColumn("quant_coeff_disp", F.try_divide(F.col("q75") - F.col("q25"), F.col("q75") + F.col("q25"))))


def median_abs_dev(hist: DataFrame, centers: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Median distance from the median; ``centers`` carries ``median`` per group."""
    gaps = (hist.join(centers.select(*keys, "median"), list(keys))
            .groupBy(*keys, F.abs(F.col("v") - F.col("median")).alias("v")).agg(F.sum("cnt").alias("cnt")))
    ranked = running_positions(gaps, keys, ["v"], F.col("cnt"))
    middle = quantile_columns("v", F.col("cnt"), {"med_abs_dev": 0.5})["med_abs_dev"]
    return ranked.groupBy(*keys).agg(middle.alias("med_abs_dev"))


def outlier_stats(hist: DataFrame, stats: DataFrame, keys: Sequence[str] = KEYS, also: Sequence[str] = ()) -> DataFrame:
    """Outlier shares and flags; ``stats`` carries q1, q25, q75, q99, mean and std.

    The quantiles of the scales in ``also`` give their own prefixed results in the same pass.
    """
    fences = _fences(also)
    wanted = [f"{prefix}{q}" for prefix in ("", *(f"{scale}_" for scale in also)) for q in ("q1", "q25", "q75", "q99")]
    joined = hist.join(stats.select(*keys, *wanted, "mean", "std"), list(keys))
    hits = {name: F.sum(F.when((F.col("v") < lo) | (F.col("v") > hi), F.col("cnt")).otherwise(F.lit(0)))
            for name, (lo, hi) in fences.items()}
    return joined.groupBy(*keys).agg(
        *[(h / F.sum("cnt")).alias(f"percent_outliers_{k}") for k, h in hits.items()],
        *[(h > 0).alias(f"has_outliers_{k}") for k, h in hits.items()])


def _fences(also: Sequence[str] = ()) -> dict[str, tuple[Column, Column]]:
    """The ends beyond which a value lies outside, by rule."""
    fences = {}
    for prefix in ("", *(f"{scale}_" for scale in also)):
        q1, q25, q75, q99 = (F.col(f"{prefix}{q}") for q in ("q1", "q25", "q75", "q99"))
        fences |= {f"{prefix}15iqr": (q25 - 1.5 * (q75 - q25), q75 + 1.5 * (q75 - q25)),
                   f"{prefix}3iqr": (q25 - 3 * (q75 - q25), q75 + 3 * (q75 - q25)), f"{prefix}1_99": (q1, q99),
                   f"{prefix}3std": (F.col("mean") - 3 * F.col("std"), F.col("mean") + 3 * F.col("std"))}
    return fences


def add_normality(stats: DataFrame) -> DataFrame:
    """Omnibus K2 test from ``n``, biased ``skewness`` and excess ``kurtosis`` (n >= 8).

    Formulas: D'Agostino (1970) for skewness, Anscombe and Glynn (1983) for
    kurtosis. Shared terms are columns of their own, so none is computed twice.
    """
    n, c = F.col("_n"), F.col
    beta = (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3)
            / ((n - 2) * (n + 5) * (n + 7) * (n + 9)))
    variance = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    shape = (6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9))
             * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))))
    steps = [
        {"_n": F.when(c("n") >= 8, c("n").cast("double"))},
        {"_y": c("skewness") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2))),
         "_w2": F.sqrt(2 * (beta - 1)) - 1,
         "_x": (c("kurtosis") + 3 - 3 * (n - 1) / (n + 1)) / F.sqrt(variance),
         "_s": shape},
        {"_q": F.when(c("_y") == 0, F.lit(1.0)).otherwise(c("_y")) / F.sqrt(2 / (c("_w2") - 1)),
         "_a": 6 + 8 / c("_s") * (2 / c("_s") + F.sqrt(1 + 4 / (c("_s") * c("_s"))))},
        {"_d": 1 + c("_x") * F.sqrt(2 / (c("_a") - 4))},
        {"skew_z": F.ln(c("_q") + F.sqrt(c("_q") * c("_q") + 1)) / F.sqrt(0.5 * F.ln("_w2")),
         "kurtosis_z": (1 - 2 / (9 * c("_a"))
                        - F.signum("_d") * F.cbrt(F.try_divide(1 - 2 / c("_a"), F.abs("_d"))))
         / F.sqrt(2 / (9 * c("_a")))},
        {"normality_statistic": c("skew_z") * c("skew_z") + c("kurtosis_z") * c("kurtosis_z")},
        {"normality_p": F.exp(-c("normality_statistic") / 2)},
        {"is_normal_5": c("normality_p") < 0.05, "is_normal_1": c("normality_p") < 0.01},
    ]
    for step in steps:
        stats = stats.withColumns(step)
    return stats.drop("_n", "_y", "_w2", "_x", "_s", "_q", "_a", "_d")


def numeric_stats(hist: DataFrame, keys: Sequence[str] = KEYS,
                  quantile_scale: str = "reference", with_mad: bool = True) -> DataFrame:
    """All numeric features from ``(keys, v, cnt)``."""
    keys = list(keys)
    hist = stage_values(hist, keys)
    totals = value_totals(hist, keys)
    centered = centered_stats(hist, totals, keys)
    ordered = order_stats(ranked_values(hist, keys), keys, quantile_scale)
    stats = totals.join(centered, keys).join(ordered, keys)
    if with_mad:
        # Three consumers follow; the table has one row per field.
        stats = materialize(stats, "field_stats")
        stats = stats.join(median_abs_dev(hist, stats, keys), keys)
    return _with_ratios(stats.join(outlier_stats(hist, stats, keys), keys))


def _with_ratios(stats: DataFrame) -> DataFrame:
    """Ratios of the numeric features and the test for normality."""
    value_range = F.col("max") - F.col("min")
    out = stats.select(
        "*", value_range.alias("range"),
        F.try_divide("mean", "max").alias("normalized_mean"),
        F.try_divide("median", "max").alias("normalized_median"),
        F.try_divide(value_range, F.col("mean")).alias("normalized_range"),
        F.try_divide("var", "mean").alias("coeff_var"))
    return add_normality(out).drop("_sum", "q1", "q99", "skew_z", "kurtosis_z")


def summary_vector(hist: DataFrame, prefix: str, keys: Sequence[str] = KEYS,
                   quantile_scale: str = "reference") -> DataFrame:
    """Short prefixed summary of a numeric vector, from staged or plain histogram rows."""
    keys = list(keys)
    hist = hist if PART in hist.columns else stage_values(hist, keys)
    totals = value_totals(hist, keys)
    ordered = order_stats(ranked_values(hist, keys), keys, quantile_scale)
    stats = totals.join(centered_stats(hist, totals, keys), keys).join(ordered, keys)
    stats = materialize(stats, "field_stats")
    stats = stats.join(median_abs_dev(hist, stats, keys), keys)
    wanted = {
        "min": F.col("min"), "median": F.col("median"), "mean": F.col("mean"), "max": F.col("max"),
        "var": F.col("var"), "cv": F.try_divide("var", "mean"), "madm": F.col("med_abs_dev"),
        "qcd": F.col("quant_coeff_disp"), "avg_abs_dev": F.col("avg_abs_dev"),
        "normalized_field_length_range": F.try_divide(F.col("max") - F.col("min"), F.col("max")),
    }
    return stats.select(*keys, *[c.alias(f"{prefix}_{n}") for n, c in wanted.items()])


# ----------------------------------------------------------------- sequences

def sequence_stats(rows: DataFrame, keys: Sequence[str] = KEYS, value: str = "v",
                   pos: str = "pos", text: str | None = None) -> DataFrame:
    """``is_sorted``, ``is_monotonic`` and ``sortedness`` of values along ``pos``.

    Rows are ranked by position once, and each is compared with the next. The i-th
    number by position is paired with the i-th in sorted order, an equi join on the
    rank of 8-byte values; the sorted side is unfolded from the histogram. Fields that
    are text carry their values in ``text`` and get ``is_sorted`` only. Rows without
    a position have no order: they are left out, a field of such rows gets no result.
    """
    keys = list(keys)
    words = F.col(text) if text else F.lit(None).cast("string")
    kept = (rows.select(*keys, F.col(pos).alias("pos"), F.struct(F.col(value).alias("v"), words.alias("t")).alias("x"))
            .where("pos is not null and (x.v is not null or x.t is not null)"))
    placed = materialize(running_positions(kept, keys, ["pos"], lead_of="x"), "sequence")
    numbers = placed.where("x.v is not null").select(*keys, F.col("before").alias("position"), F.col("x.v").alias("at"))
    ranked = running_positions(value_histogram(numbers.withColumnRenamed("at", "v"), keys), keys, ["v"], F.col("cnt"))
    # A value that fills a third of a large field unfolds in two steps, in bounded arrays.
    ends = ranked.select(*keys, "v", "cnt", "before", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cnt") - 1, F.lit(UNFOLD))).alias("_from"))
    in_order = ends.select(*keys, F.col("v").alias("sorted"), F.explode(F.sequence(
        F.col("before") + F.col("_from"), F.col("before") + F.least(F.col("_from") + UNFOLD, F.col("cnt")) - 1)).alias("position"))
    # Both sides hold the same values, so one centre and one variance serve both.
    centers = numbers.groupBy(*keys).agg(F.avg("at").alias("mean"), F.count("at").alias("n"))
    gap, gap_sorted = F.col("at") - F.col("mean"), F.col("sorted") - F.col("mean")
    r = F.abs(F.try_divide(F.sum(gap * gap_sorted), F.sum(gap * gap)))
    paired = (numbers.join(in_order, [*keys, "position"]).join(centers, keys).groupBy(*keys)
              .agg(F.when(F.max("n") < 2, F.lit(1.0)).otherwise(r).alias("sortedness")))
    rising = placed.groupBy(*keys).agg(
        F.bool_and(F.coalesce(F.col("nxt") >= F.col("x"), F.lit(True))).alias("is_sorted"), F.count("x.v").alias("_n"))
    return (rising.join(paired, keys, "left")
            .select(*keys, "is_sorted", F.when(F.col("_n") > 0, F.lit(True)).alias("is_monotonic"), "sortedness"))


# -------------------------------------------------------------- column pairs

def _ends(hist: DataFrame, table_keys: Sequence[str], field: str) -> DataFrame:
    """One row per field with its least and largest value."""
    return hist.groupBy(*table_keys, field).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def _with_overlap(pairs: DataFrame, table_keys: Sequence[str]) -> DataFrame:
    """Overlap flag and share of pairs with their four ends."""
    a_lo, a_hi, b_lo, b_hi = (F.col(c) for c in ("a_lo", "a_hi", "b_lo", "b_hi"))
    meets = (a_hi >= b_lo) & (b_hi >= a_lo)
    nested = ((b_hi >= a_hi) & (b_lo <= a_lo)) | ((a_hi >= b_hi) & (a_lo <= b_lo))
    shared = F.when(b_lo >= a_lo, a_hi - b_lo).otherwise(b_hi - a_lo)
    share = F.greatest(F.try_divide(shared, a_hi - a_lo), F.try_divide(shared, b_hi - b_lo))
    return pairs.select(
        *table_keys, "field_a", "field_b", meets.alias("has_overlap"),
        F.when(nested, F.lit(1.0)).when(meets, share).otherwise(F.lit(0.0)).alias("overlap_percent"))


def range_overlap(hist: DataFrame, table_keys: Sequence[str], field: str = "field_id", wanted: DataFrame | None = None) -> DataFrame:
    """Overlap flag and share of the value ranges of two fields of a table.

    ``wanted`` (the table keys, ``field_a``, ``field_b``) names the pairs. Without it
    every two fields of a table are paired, which only suits tables of few fields;
    ``overlapping_fields`` gives the pairs that meet of tables of any width.
    """
    # One row per field, written once for both sides of the pairing.
    ends = materialize(_ends(hist, table_keys, field), "ends")
    a = ends.select(*table_keys, F.col(field).alias("field_a"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    b = ends.select(*table_keys, F.col(field).alias("field_b"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    if wanted is None:
        pairs = a.join(b, list(table_keys)).where(F.col("field_a") < F.col("field_b"))
    else:
        pairs = wanted.join(a, [*table_keys, "field_a"]).join(b, [*table_keys, "field_b"])
    return _with_overlap(pairs, table_keys)


def overlapping_fields(hist: DataFrame, table_keys: Sequence[str], field: str = "field_id", block: int = 64) -> DataFrame:
    """The pairs of ``range_overlap`` whose ranges meet, without pairing the others.

    The lower ends of a table are ranked; a running count gives for each field how many
    of them lie at or below its upper end. The fields it meets to its right are then
    one run of ranks, cut into blocks of ``block`` ranks for an equality join. Work and rows
    follow the meeting pairs: besides them at most two blocks a field are looked at.
    Fields without a value meet nothing; NULL table keys belong to no table.
    """
    keys = list(table_keys)
    ends = _ends(hist.where(F.col("v").isNotNull()), keys, field)
    events = ends.select(*keys, field, F.posexplode(F.array("lo", "hi")).alias("end", "x"))
    placed = running_positions(events, keys, ["x", "end", field], (F.col("end") == 0).cast("bigint"))
    at = lambda end, name: F.max(F.when(F.col("end") == end, F.col(name)))
    spans = placed.groupBy(*keys, field).agg(at(0, "x").alias("lo"), at(1, "x").alias("hi"),
                                             at(0, "before").alias("rank"), at(1, "before").alias("reach"))
    # Written once for both sides, which are then plain and can be split when a table is wide.
    spans = materialize(spans, "spans")
    left = (spans.where("reach > rank + 1")
            .withColumn("block", F.explode(F.sequence(F.floor((F.col("rank") + 1) / block), F.floor((F.col("reach") - 1) / block))))
            .select(*keys, "block", F.col(field).alias("f"), F.col("lo").alias("f_lo"), F.col("hi").alias("f_hi"), F.col("rank").alias("f_rank"), "reach"))
    right = spans.withColumn("block", F.floor(F.col("rank") / block)).drop("reach")
    met = left.join(right, [*keys, "block"]).where("rank > f_rank and rank < reach")
    first = F.col("f") < F.col(field)
    pick = lambda mine, other, name: F.when(first, F.col(mine)).otherwise(F.col(other)).alias(name)
    return _with_overlap(met.select(
        *keys, pick("f", field, "field_a"), pick(field, "f", "field_b"), pick("f_lo", "lo", "a_lo"), pick("f_hi", "hi", "a_hi"),
        pick("lo", "f_lo", "b_lo"), pick("hi", "f_hi", "b_hi")), keys)


def shared_elements(hist: DataFrame, field_a: str, field_b: str, table_keys: Sequence[str] = (),
                    field: str = "field_id", value: str = "v") -> DataFrame:
    """Distinct values that occur in both fields of the same table."""
    keys = [*table_keys, value]
    a = hist.where(F.col(field) == field_a).select(*keys).distinct()
    b = hist.where(F.col(field) == field_b).select(*keys)
    return a.join(b, keys, "left_semi")


# ------------------------------------------------------------------ assembly

def distinct_fields(cells: DataFrame, fields: DataFrame) -> DataFrame:
    """Cells in which equally named columns of one table are fields of their own: ``a``, ``a.1`` by place.

    ``fields`` has a row per ``fid``, ``field_id`` and ``ord``. A number that another column
    of the table already bears is passed over.
    """
    ids = fields.select(*KEYS, "ord").distinct().groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("ord", "field_id"))).alias("all"))
    names = F.transform("all", lambda f: f["field_id"])
    named = ids.select("fid", F.posexplode(F.arrays_zip(F.transform("all", lambda f: f["ord"]).alias("ord"), names.alias("old"), fn.unique_names(names).alias("new"))).alias("i", "f"))
    named = materialize(named.select("fid", F.col("f.ord").alias("ord"), F.col("f.old").alias("field_id"), F.col("f.new").alias("_new")).where("field_id <> _new"), "renamed")
    return (cells.join(named, ["fid", "field_id", "ord"], "left")
            .select(*[F.coalesce("_new", "field_id").alias(c) if c == "field_id" else F.col(c) for c in cells.columns]))


def profile_columns(cells: DataFrame, quantile_scale: str = "reference") -> DataFrame:
    """One wide feature row per field, written; flags default to FALSE, numbers to NULL.

    A table of at most ``ROW_CELLS`` cells meets in one task and each of its fields in one row;
    its features are expressions over that row's array. Larger tables, and those with NULL field
    ids or equal column names, go through histograms and ranks, where no task holds a whole field.
    """
    sizes = cells.where("fid is not null").groupBy("fid").agg(
        ((F.count(F.lit(1)) > ROW_CELLS) | F.bool_or(F.col("field_id").isNull())).alias("large"))
    sizes = materialize(sizes, "sizes")
    kinds = {r.large for r in sizes.select("large").distinct().collect()}
    large, parts = sizes.where("large").select("fid"), []
    if False in kinds:
        small = cells.where("fid is not null")
        small = materialize(_profile_rows(small.join(large, "fid", "left_anti") if True in kinds else small, quantile_scale), "features")
        parts.append(small.where("not _renamed").drop("_renamed"))
        renamed = small.where("_renamed").select("fid").distinct()
        if not renamed.isEmpty():
            large, kinds = large.union(renamed), kinds | {True}
    if True in kinds or not parts:
        whole = cells.join(large, "fid", "left_semi") if parts else cells
        parts.append(materialize(_profile_long(whole.select(*cells.columns), quantile_scale), "features"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _profile_long(cells: DataFrame, quantile_scale: str) -> DataFrame:
    """``profile_columns`` of fields of any length."""
    hist = materialize(raw_histogram(cells), "hist")
    basics = materialize(only_field(field_basics(hist)), "basics")
    if "ord" in cells.columns and not basics.groupBy(*KEYS).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return _profile_long(distinct_fields(cells, basics), quantile_scale)
    types = basics.select(*KEYS, "data_type", "general_type")
    typed = hist.join(types, KEYS)
    numeric = value_histogram(
        typed.where("general_type = 'q'").withColumn("v", ty.parse_typed(F.col("raw"), F.col("data_type"))), KEYS)
    numbers = numeric_stats(numeric, KEYS, quantile_scale)
    texts = typed.where("general_type = 'c' and raw is not null")
    words = categorical_stats(texts, KEYS)
    text_unique = uniqueness(texts, KEYS).drop("is_unique_list")

    rows = (cells.join(types, KEYS)
            .withColumn("v", ty.parse_typed(F.col("raw"), F.col("data_type")))
            .withColumn("t", F.when(F.col("general_type") == "c", F.col("raw"))))
    order = sequence_stats(rows, KEYS, text="t")

    wide = (basics.join(numbers, KEYS, "left").join(words, KEYS, "left")
            .join(text_unique, KEYS, "left").join(order, KEYS, "left"))
    return _with_defaults(wide)


def _with_defaults(wide: DataFrame) -> DataFrame:
    """Distinct counts of whole numbers, name features and defaults."""
    is_int = F.col("data_type") == "integer"
    n_unique = F.coalesce(F.col("num_unique_elements"), F.when(is_int, F.col("num_unique_values")))
    n_values = F.when(is_int, F.col("n"))
    wide = wide.withColumns({
        "unique_percent": F.coalesce("unique_percent", F.try_divide(n_unique, n_values)),
        "is_unique": F.coalesce("is_unique", n_unique == n_values),
        "num_unique_elements": n_unique})
    if "space_in_name" not in wide.columns:
        wide = wide.withColumns(fn.name_features(F.col("field_name")))
    flags = [f.name for f in wide.schema.fields if f.dataType.simpleString() == "boolean"]
    drop = ["n", "num_unique_values", *[f"score_{t}" for t in ty.TYPE_ORDER]]
    return wide.fillna(False, subset=flags).drop(*drop)


# ----------------------------------------------------- fields held in one row

# Cells of the largest table whose fields are profiled as arrays.
ROW_CELLS = 1_000


def _total(items: Column, of: Callable[[Column], Column]) -> Column:
    """Sum of a number of each item."""
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + of(x))


def _runs(ordered: Column) -> Column:
    """Histogram of a sorted array: ``v``, ``cnt`` and ``before`` in order."""
    begins = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
    return F.transform(begins, lambda i: F.struct(F.get(ordered, i).alias("v"), i.cast("bigint").alias("before")))


def _counted(runs: Column, total: Column) -> Column:
    """Runs with ``cnt`` and the next value ``nxt``."""
    def one(r: Column, i: Column) -> Column:
        after = F.get(runs, i + 1)
        return F.struct(r["v"].alias("v"), (F.coalesce(after["before"], total) - r["before"]).alias("cnt"), r["before"].alias("before"), after["v"].alias("nxt"))
    return F.transform(runs, one)


def _quantile(ordered: Column, p: float) -> Column:
    """Linearly interpolated quantile of a sorted array."""
    place = (F.size(ordered) - 1) * F.lit(float(p))
    low, high = F.floor(place), F.ceil(place)
    at = lambda k: F.get(ordered, k.cast("int"))
    return at(low) + (place - low) * (at(high) - at(low))


def _profile_rows(cells: DataFrame, quantile_scale: str) -> DataFrame:
    """``profile_columns`` of small tables; fields of tables with equal column names are marked ``_renamed``.

    Tables are dealt out once; grouping by field and counting by table need no other shuffle.
    """
    of = F.struct(*_carried(cells))
    dealt = cells.select(*KEYS, of.alias("_of"), F.struct("pos", "raw").alias("_cell"), "raw", F.lit(1).alias("cnt")).repartition("fid")
    rows = field_basics(dealt, KEYS, [F.min("_of").alias("_of"), (~F.min("_of").eqNullSafe(F.max("_of"))).alias("_twice"), F.collect_list("_cell").alias("_cells")])
    table = W.partitionBy("fid")
    rows = rows.withColumns({"is_only_field": F.count(F.lit(1)).over(table) == 1, "_renamed": F.max("_twice").over(table)})
    basic = [F.col("_of")[c].alias(c) for c in _carried(cells)] + [F.col(c) for c in rows.columns if c not in (*KEYS, "_of", "_twice", "_cells", "_renamed")]
    names = F.struct(*[c.alias(name) for name, c in fn.name_features(F.col("_of.field_name")).items()])
    # Finished features are carried on as one struct each: every step over arrays copies all columns of its row. Steps without
    # arrays stand between such with arrays: fused at the end they make one method too long for the JVM to compile.
    rows = _row_values(rows.select(*KEYS, F.struct(*basic).alias("_basic"), names.alias("_names"), "general_type", "data_type", "_renamed", "_cells"))
    for step, source in ((lambda r: _row_numbers(r, quantile_scale), "_sorted"), (_row_words, "_words"), (_row_order, "_rows")):
        made = step(rows)
        fresh = [c for c in made.columns if c not in rows.columns]
        rows = made.select(*[c for c in rows.columns if c != source], F.struct(*fresh).alias(f"_made{source}"))
    return _with_defaults(rows.select(*KEYS, "_renamed", "_basic.*", "_made_sorted.*", "_made_words.*", "_made_rows.*", "_names.*"))


def _row_values(rows: DataFrame) -> DataFrame:
    """The cells of each field read by its type: ``_rows`` by position, ``_sorted`` numbers, ``_words``."""
    is_text, empty = F.col("general_type") == "c", lambda c: F.when(F.size(c) > 0, c)
    value = F.when(is_text, F.lit(None).cast("double")).otherwise
    read = F.transform("_cells", lambda c: F.struct(c["pos"].alias("pos"), F.struct(
        (value(ty.parse_typed(c["raw"], F.col("data_type"))) + F.lit(0.0)).alias("v"), F.when(is_text, c["raw"]).alias("t")).alias("x")))
    rows = rows.withColumn("_read", read).drop("_cells")
    numbers = F.filter(F.transform("_read", lambda r: r["x"]["v"]), lambda v: v.isNotNull())
    words = F.filter(F.transform("_read", lambda r: r["x"]["t"]), lambda t: t.isNotNull())
    placed = F.filter("_read", lambda r: r["pos"].isNotNull() & (r["x"]["v"].isNotNull() | r["x"]["t"].isNotNull()))
    return rows.withColumns({
        "_sorted": F.when(F.col("general_type") == "q", empty(F.sort_array(numbers))),
        "_words": F.when(is_text, empty(F.sort_array(words))),
        "_rows": empty(F.sort_array(placed))}).drop("_read")


def _row_numbers(rows: DataFrame, quantile_scale: str) -> DataFrame:
    """``numeric_stats`` of the array ``_sorted``."""
    s, c = F.col("_sorted"), F.col
    rows = rows.withColumns({"n": F.when(s.isNotNull(), F.size(s).cast("bigint")), "_runs": F.when(s.isNotNull(), _runs(s))})
    rows = rows.withColumn("_runs", _counted(c("_runs"), c("n")))
    h = c("_runs")
    rows = _with_mean(rows.withColumns({
        "min": F.get(s, F.lit(0)), "max": F.get(s, F.size(s) - 1), "_sum": _total(h, lambda r: r["v"] * r["cnt"]),
        "_abs": _total(h, lambda r: F.abs(r["v"]) * r["cnt"]), "_xlnx": _total(h, lambda r: _xlnx(r["v"]) * r["cnt"])}))
    gap = lambda r: r["v"] - c("mean")
    rows = _with_shape(rows.withColumns({
        **{f"moment_{k}": _total(h, lambda r, k=k: F.pow(gap(r), F.lit(k)) * r["cnt"]) / c("n") for k in range(2, 11)},
        "avg_abs_dev": _total(h, lambda r: F.abs(gap(r)) * r["cnt"]) / c("n")}))
    probs = {"median": 0.5, **QUANTILE_SCALES[quantile_scale]}
    shift = F.when(c("min") < 0, -c("min")).otherwise(F.lit(0.0))
    gini_top = _total(h, lambda r: r["cnt"] * (2 * r["before"] + r["cnt"] - c("n")) * r["v"])
    step = lambda r: F.coalesce(r["nxt"] - r["v"], F.lit(0.0))
    ratio = lambda r: F.coalesce(F.try_divide(r["v"], r["nxt"]), F.lit(0.0))
    repeats = c("n") - F.size(h)
    blocked = F.exists(h, lambda r: F.coalesce(r["nxt"] == 0, F.lit(False)) | ((r["v"] == 0) & (r["cnt"] > 1)))
    over = lambda total: F.try_divide(total, c("n") - 1)
    log_spaced = _coefficient(over(repeats + _total(h, lambda r: ratio(r) * ratio(r))), over(repeats + _total(h, ratio)))
    rows = _with_spacing(rows.withColumns({
        **{name: _quantile(s, p) for name, p in probs.items()},
        "gini": F.try_divide(gini_top, c("n") * (c("_sum") + c("n") * (shift + 1e-7))),
        "num_unique_values": F.when(s.isNotNull(), F.size(h).cast("bigint")),
        "lin_space_sequence_coeff": _coefficient(over(_total(h, lambda r: step(r) * step(r))), over(c("max") - c("min"))),
        "log_space_sequence_coeff": F.when((F.size(h) > 1) & ~blocked, log_spaced)}))
    rows = rows.withColumn("_gaps", F.sort_array(F.transform(s, lambda v: F.abs(v - c("median")))))
    rows = rows.withColumn("med_abs_dev", _quantile(c("_gaps"), 0.5))
    hits = {name: _total(h, lambda r, lo=lo, hi=hi: F.when((r["v"] < lo) | (r["v"] > hi), r["cnt"]).otherwise(F.lit(0)).cast("double"))
            for name, (lo, hi) in _fences().items()}
    rows = rows.withColumns({f"percent_outliers_{k}": x / c("n") for k, x in hits.items()})
    rows = rows.withColumns({f"has_outliers_{k}": c(f"percent_outliers_{k}") > 0 for k in hits})
    return _with_ratios(rows.drop("_runs", "_gaps"))


def _row_words(rows: DataFrame) -> DataFrame:
    """``categorical_stats`` and ``uniqueness`` of the array ``_words``."""
    w, c = F.col("_words"), F.col
    n = F.size(w)
    rows = rows.withColumns({"_begins": F.when(w.isNotNull(), F.transform(_runs(w), lambda r: r["before"])),
                             "_lengths": F.sort_array(F.transform(w, lambda t: F.length(t).cast("double")))})
    begins, lengths = c("_begins"), c("_lengths")
    rows = rows.withColumn("_counts", F.transform(begins, lambda b, i: F.coalesce(F.get(begins, i + 1), n.cast("bigint")) - b))
    distinct = F.when(w.isNotNull(), F.size("_counts").cast("bigint"))
    mean = _total(lengths, lambda x: x) / n
    square = _total(lengths, lambda x: x * x) / n
    return rows.withColumns({
        "list_entropy": F.when(w.isNotNull(), F.greatest(F.ln(n) - _total(c("_counts"), lambda k: k * F.ln(k)) / n, F.lit(0.0))),
        "percentage_of_mode": F.try_divide(F.array_max("_counts"), n),
        "mean_value_length": mean, "median_value_length": _quantile(lengths, 0.5),
        "min_value_length": F.get(lengths, F.lit(0)), "max_value_length": F.get(lengths, F.size(lengths) - 1),
        "std_value_length": F.when(w.isNotNull(), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))),
        "num_unique_elements": distinct, "unique_percent": F.try_divide(distinct, n), "is_unique": distinct == n}).drop("_begins", "_lengths", "_counts")


def _row_order(rows: DataFrame) -> DataFrame:
    """``sequence_stats`` of the array ``_rows``."""
    c = F.col
    rising = F.forall(F.transform("_rows", lambda r, i: F.get(c("_rows"), i + 1)["x"] >= r["x"]), lambda up: F.coalesce(up, F.lit(True)))
    at = F.filter(F.transform("_rows", lambda r: r["x"]["v"]), lambda v: v.isNotNull())
    rows = rows.withColumns({"is_sorted": rising, "_at": F.when(F.size(at) > 0, at)})
    rows = rows.withColumns({"is_monotonic": F.when(c("_at").isNotNull(), F.lit(True)), "_center": _total(c("_at"), lambda v: v) / F.size("_at")})
    gap = lambda v: v - c("_center")
    both = F.zip_with("_at", F.sort_array("_at"), lambda a, b: gap(a) * gap(b))
    r = F.abs(F.try_divide(_total(both, lambda x: x), _total(c("_at"), lambda v: gap(v) * gap(v))))
    return rows.withColumn("sortedness", F.when(F.size("_at") < 2, F.lit(1.0)).otherwise(r)).drop("_at", "_center")
