"""Ways into the long cells table ``(fid, field_id, field_name, ord, pos, raw)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table_cells(df: DataFrame, columns: Sequence[str], pos: str | Column | None = None,
                fid: str | Column = "table") -> DataFrame:
    """Unpivot a wide table; ``pos`` must identify the row order when order matters."""
    fid = F.lit(fid) if isinstance(fid, str) else fid
    place = F.lit(None).cast("bigint") if pos is None else (F.col(pos) if isinstance(pos, str) else pos)
    texts = [F.col(c).cast("string").alias(c) for c in columns]
    order = F.create_map(*[F.lit(x) for i, c in enumerate(columns) for x in (c, i)])
    return (df.select(fid.alias("fid"), place.cast("bigint").alias("pos"), *texts)
            .unpivot(["fid", "pos"], list(columns), "field_id", "raw")
            .select("fid", "field_id", F.col("field_id").alias("field_name"),
                    order[F.col("field_id")].alias("ord"), "pos", "raw"))


def numeric_values(df: DataFrame, columns: Sequence[str], pos: str | None = None,
                   fid: str = "table") -> DataFrame:
    """Typed shortcut ``(fid, field_id, pos, v)``: no text round trip for numeric columns."""
    place = F.lit(None).cast("bigint") if pos is None else F.col(pos).cast("bigint")
    return (df.select(F.lit(fid).alias("fid"), place.alias("pos"),
                      *[F.col(c).cast("double").alias(c) for c in columns])
            .unpivot(["fid", "pos"], list(columns), "field_id", "v"))


def role_array_cells(df: DataFrame, key: str = "id") -> DataFrame:
    """Two-role arrays ``x_data``/``y_data`` to cells; y fields are numbered after x."""
    width = F.coalesce(F.size("x_data"), F.lit(0))
    x = df.select(key, F.lit("x").alias("is_x_or_y"), F.posexplode("x_data").alias("ord", "data"))
    y = (df.select(key, width.alias("_w"), F.posexplode("y_data").alias("ord", "data"))
         .select(key, F.lit("y").alias("is_x_or_y"), (F.col("ord") + F.col("_w")).alias("ord"), "data"))
    fields = x.unionByName(y)
    name = F.concat(F.col(key).cast("string"), F.col("ord").cast("string"))
    return fields.select(
        F.col(key).alias("fid"), name.alias("field_id"), name.alias("field_name"), "ord",
        "is_x_or_y", F.posexplode("data").alias("pos", "raw"))
