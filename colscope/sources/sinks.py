"""Writers for features, outcomes, predictions, mappings and reports."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_features(features: DataFrame, outcomes: DataFrame, root: str, append: bool = True, fmt: str = "parquet") -> None:
    """Feature and outcome rows under ``root``, appended batch by batch or replaced."""
    mode = "append" if append else "overwrite"
    for name, df in (("field_level_features", features), ("field_level_outcomes", outcomes)):
        df.write.mode(mode).format(fmt).option("header", True).save(f"{root}/{name}")


# Fixed value: columns of a chunk manifest.
MANIFEST = "chunk long, attempt string"


def append_chunk(tables: dict[str, DataFrame], root: str, chunk: int) -> None:
    """Append one numbered chunk of several tables to ``root``; a repeated chunk replaces itself.

    Each attempt writes to folders of its own. Only when all tables are whole does one row
    of the manifest name the attempt, so readers see a chunk of all tables or of none,
    and a job that stopped midway or ran twice leaves no rows behind. Attempts of one
    chunk are ordered by their start; two at the same time are both whole, the later start counts.
    """
    attempt = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/{name}/chunk={chunk}/attempt={attempt}")
    spark = next(iter(tables.values())).sparkSession
    spark.range(1).select(F.lit(chunk).cast("long").alias("chunk"), F.lit(attempt).alias("attempt")).write.mode("append").parquet(f"{root}/manifest")


def read_chunks(spark: SparkSession, root: str, name: str, schema: T.StructType | str) -> DataFrame:
    """Rows of table ``name`` from the last whole attempt of each chunk, with the number ``chunk``.

    The manifest has a row per attempt and meets the partition columns, so that Spark
    prunes the folders of other attempts.
    """
    last = (spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
            .groupBy("chunk").agg(F.max("attempt").alias("attempt")))
    own = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    placed = T.StructType([*own.fields, T.StructField("chunk", T.LongType()), T.StructField("attempt", T.StringType())])
    rows = spark.read.schema(placed).parquet(f"{root}/{name}")
    return rows.join(last, ["chunk", "attempt"], "left_semi").select(*own.names, "chunk")


def write_by_width(features: DataFrame, root: str, table_key: str = "fid",
                   subsets: dict[str, Sequence[str]] | None = None) -> None:
    """Features partitioned by the number of fields of their table, and column subsets."""
    widths = features.groupBy(table_key).agg(F.count(F.lit(1)).alias("num_fields"))
    features.join(widths, table_key).write.mode("append").partitionBy("num_fields").parquet(f"{root}/by_field")
    for name, columns in (subsets or {}).items():
        features.select(*columns).write.mode("append").parquet(f"{root}/{name}")


def write_csv(df: DataFrame, path: str, null_token: str = "nan", mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("nullValue", null_token).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, null_token: str = "nan") -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("nullValue", null_token)
            .option("escape", '"').csv(path))


# Header of the prediction file.
PREDICTION_COLUMNS = ["field_id", "fid", "predicted_trace_type", "confidence",
                      "top1_type", "top1_prob", "top2_type", "top2_prob"]


def write_predictions(scored: DataFrame, path: str, fmt: str = "csv") -> None:
    rows = scored
    if "fid" not in rows.columns:
        rows = rows.withColumn("fid", F.lit("unknown"))
    rows.select(*PREDICTION_COLUMNS).write.mode("overwrite").format(fmt).option("header", True).save(path)


def json_safe(c: Column, kind: T.DataType) -> Column:
    """A value JSON can hold: ISO dates, base64 bytes, text for NaN and infinities."""
    if isinstance(kind, T.BinaryType):
        return F.base64(c)
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: json_safe(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(F.transform_keys(c, lambda k, v: k.cast("string")),
                                  lambda k, v: json_safe(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[json_safe(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return c


def report_json(df: DataFrame, name: str = "report") -> DataFrame:
    """One JSON text per row."""
    fields = [json_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*fields)).alias(name))


def write_reports(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    report_json(df, "value").write.mode(mode).text(path)
