"""Feature preparation: clipping, scaling, encoding, padding, reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranking import exact_quantiles, row_positions


def _long(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return (df.select(*[F.col(c).cast("double").alias(c) for c in features])
            .unpivot([], list(features), "feature", "x"))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


# ------------------------------------------------------------------ clipping

def fit_bounds(train: DataFrame, features: Sequence[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Exact quantile bounds of the finite training values, one row per feature.

    A feature without a finite value gets the bounds 0 and 1.
    """
    found = exact_quantiles(_long(train, features).where(_finite(F.col("x"))), ["feature"], "x",
                            {"lo": low, "hi": high}, count="n")
    names = train.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    def bound(name: str, default: float) -> Column:
        missed = F.raise_error(F.concat(F.lit("no exact bound was found for "), F.col("feature"))).cast("double")
        return F.when(F.col("n").isNull(), default).otherwise(F.coalesce(name, missed)).alias(name)

    return names.join(found, "feature", "left").select("feature", bound("lo", 0.0), bound("hi", 1.0))


def clip(value: Column, lo: float, hi: float) -> Column:
    """Values outside the bounds move to them; NaN and NULL move to the upper one."""
    x = value.cast("double")
    return F.when(x.between(lo, hi), x).when(x < lo, F.lit(lo)).otherwise(F.lit(hi))


def apply_bounds(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """Clip every bounded column. The bounds are one row per column of ``df``."""
    wanted = {r["feature"]: (r["lo"], r["hi"])
              for r in bounds.where(F.col("feature").isin(*df.columns)).collect()}
    return df.withColumns({f: clip(F.col(f), lo, hi) for f, (lo, hi) in wanted.items()})


def save_parameters(params: DataFrame, path: str) -> None:
    """Learned parameters (bounds, scales or label numbers) for later data."""
    params.write.mode("overwrite").parquet(path)


def load_parameters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# ------------------------------------------------------------------- scaling

def fill_flags(df: DataFrame, flags: Sequence[str], as_number: bool = False) -> DataFrame:
    out = df.fillna(False, subset=list(flags))
    if as_number:
        out = out.withColumns({f: F.col(f).cast("double") for f in flags})
    return out


def fit_scales(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean and population deviation per feature; a constant feature scales by 1."""
    stats = _long(train, features).groupBy("feature").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return stats.withColumn("std", F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(1.0)))


def apply_scales(df: DataFrame, scales: DataFrame) -> DataFrame:
    """Z-scores. The scales are one row per column of ``df``."""
    wanted = {r["feature"]: (r["mean"], r["std"])
              for r in scales.where(F.col("feature").isin(*df.columns)).collect()}
    return df.withColumns({f: (F.col(f) - F.lit(m)) / F.lit(s) for f, (m, s) in wanted.items()})


# ------------------------------------------------------------------ encoding

def fit_labels(df: DataFrame, column: str, null_label: str | None = None) -> DataFrame:
    """Alphabetical numbering ``(label, idx)`` of the distinct labels.

    Missing labels are left out, or are a class of their own under ``null_label``.
    """
    text = F.col(column).cast("string")
    named = text if null_label is None else F.coalesce(text, F.lit(null_label))
    labels = (df.select(named.alias("label")).where("label is not null").distinct()
              .withColumn("_all", F.lit(0)))
    return row_positions(labels, ["_all"], ["label"], "idx").select("label", "idx")


def encode_labels(df: DataFrame, column: str, mapping: DataFrame, name: str | None = None) -> DataFrame:
    """Label number by the saved mapping; unknown labels become -1."""
    keyed = mapping.select(F.col("label").alias(column), F.col("idx").alias("_idx"))
    return (df.join(keyed, column, "left")
            .withColumn(name or f"{column}_n", F.coalesce("_idx", F.lit(-1))).drop("_idx"))


def decode_labels(df: DataFrame, index: str, mapping: DataFrame, name: str) -> DataFrame:
    """Label of a number; numbers outside the mapping become ``unknown``."""
    keyed = mapping.select(F.col("idx").alias(index), F.col("label").alias("_label"))
    return df.join(keyed, index, "left").withColumn(name, F.coalesce("_label", F.lit("unknown"))).drop("_label")


def one_hot(index: Column, size: Column | int) -> Column:
    """Indicator array; an index of -1 gives zeros only."""
    top = (F.lit(size) if isinstance(size, int) else size).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), top), lambda i: F.when(i == index, 1.0).otherwise(0.0))


def one_hot_by(df: DataFrame, index: str, mapping: DataFrame, name: str) -> DataFrame:
    """Indicator array over all labels of a mapping."""
    size = mapping.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.withColumn("_size", size).withColumn(name, one_hot(F.col(index), F.col("_size"))).drop("_size")


def one_hot_columns(df: DataFrame, column: str, classes: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{column}_{c}": F.when(F.col(column) == c, 1.0).otherwise(0.0) for c in classes})


# ------------------------------------------------------------------ sequences

def field_sequences(df: DataFrame, key: str, order: str, features: Sequence[str],
                    segment: int = 25) -> DataFrame:
    """Feature rows of a table as an ordered array.

    A table with at most ``segment`` rows is one array. A longer one continues in
    the next segments, so no task ever holds more than a segment of one key.
    """
    placed = row_positions(df.select(key, order, *[f for f in features if f not in (key, order)]), [key], [order], "_pos")
    vector = F.array(*[F.col(f).cast("double") for f in features])
    return (placed.withColumn("segment", F.floor(F.col("_pos") / segment).cast("int"))
            .groupBy(key, "segment")
            .agg(F.array_sort(F.collect_list(F.struct(F.col("_pos"), vector.alias("x")))).alias("_rows"))
            .select(key, "segment", F.transform("_rows", lambda r: r["x"]).alias("x")))


def pad_sequences(seqs: DataFrame, width: int | None = None) -> DataFrame:
    """Pad to one width (the longest sequence by default) and add the mask."""
    dims = F.size(F.get("x", F.lit(0)))
    longest = F.lit(width) if width else seqs.agg(F.max(F.size("x")).alias("w")).scalar()
    out = seqs.withColumn("n_valid", F.size("x")).withColumn("width", longest.cast("int"))
    zeros = F.array_repeat(F.lit(0.0), dims)
    gap = F.greatest(F.col("width") - F.col("n_valid"), F.lit(0))
    return (out.withColumn("x", F.concat("x", F.array_repeat(zeros, gap)))
            .withColumn("mask", F.transform(F.sequence(F.lit(0), F.col("width") - 1),
                                            lambda i: i < F.col("n_valid"))))


# ------------------------------------------------------------------ reshaping

def matrix_columns(x: Column, y: Column, classify: Column) -> Column:
    """Wide x times classes matrix to three parallel arrays: unit, value, class."""
    units = F.get(x, F.lit(0))
    n = F.size(units)

    def per_class(pick) -> Column:
        return F.flatten(F.transform(classify, lambda c, i: F.transform(
            F.sequence(F.lit(0), n - 1), lambda j: pick(c, i, j))))

    return F.array(per_class(lambda c, i, j: F.get(units, j)),
                   per_class(lambda c, i, j: F.get(F.get(y, i), j).cast("string")),
                   per_class(lambda c, i, j: c))


def matrix_rows(df: DataFrame, key: str) -> DataFrame:
    """The same matrix as rows ``(key, pos, unit, value, class)``."""
    cells = (df.select(key, F.get("x_data", F.lit(0)).alias("units"), "y_data", F.posexplode("classify").alias("i", "class"))
             .select(key, "i", "class", F.get("y_data", F.col("i")).alias("ys"),
                     F.size("units").alias("n"), F.posexplode("units").alias("j", "unit")))
    return cells.select(key, (F.col("i") * F.col("n") + F.col("j")).alias("pos"), "unit",
                        F.get("ys", F.col("j")).alias("value"), "class")


def column_lists(df: DataFrame, key: str, order: str, columns: Sequence[str], segment: int = 1000) -> DataFrame:
    """Result table to value lists per column, in segments of bounded length."""
    placed = row_positions(df.select(key, order, *[c for c in columns if c not in (key, order)]), [key], [order], "_pos")
    texts = [F.col(c).cast("string").alias(c) for c in columns]
    cells = placed.select(key, "_pos", *texts).unpivot([key, "_pos"], list(columns), "column", "value")
    packed = F.array_sort(F.collect_list(F.struct("_pos", "value")))
    return (cells.withColumn("segment", F.floor(F.col("_pos") / segment).cast("int"))
            .groupBy(key, "column", "segment")
            .agg(F.transform(packed, lambda r: r["value"]).alias("values")))


def csv_text(df: DataFrame, key: str, order: str, columns: Sequence[str], null_token: str = "nan",
             segment: int = 1000) -> DataFrame:
    """Result table as CSV text per case, in segments of bounded length; segment 0 has the header."""
    placed = row_positions(df.select(key, order, *[c for c in columns if c not in (key, order)]), [key], [order], "_pos")

    def cell(c: str) -> Column:
        text = F.coalesce(F.col(c).cast("string"), F.lit(null_token))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.rlike('[",\r\n]'), quoted).otherwise(text)

    line = F.concat_ws(",", *[cell(c) for c in columns])
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col("_pos"), line.alias("line")))), lambda r: r["line"])
    header = F.when(F.col("segment") == 0, F.lit(",".join(columns) + "\n")).otherwise(F.lit(""))
    packed = (placed.withColumn("segment", F.floor(F.col("_pos") / segment).cast("int"))
              .groupBy(key, "segment").agg(F.array_join(lines, "\n").alias("_body")))
    return packed.select(key, "segment", F.concat(header, "_body", F.lit("\n")).alias("csv"))
