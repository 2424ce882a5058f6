"""Chart-ready data: binned, grouped, aggregated, sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import row_positions

AGGREGATES = {"count": lambda c: F.count(c), "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def bin_label(x: Column, unit: str | None) -> tuple[Column, Column]:
    """Label of a bin and the key that sorts its labels in calendar order."""
    if unit is None:
        return x, x
    if unit == "year":
        return F.date_format(x, "yyyy"), F.year(x)
    if unit == "month":
        return F.date_format(x, "MMM"), F.month(x)
    if unit == "year_month":
        return F.date_format(x, "yyyy-MM"), F.date_format(x, "yyyy-MM")
    if unit == "weekday":
        return F.date_format(x, "EEE"), F.weekday(x) + 1
    raise ValueError("bin must be year, month, year_month or weekday")


def chart_data(df: DataFrame, x: str, y: str | None = None, agg: str = "count", bin: str | None = None,
               classify: str | None = None, fill: float | None = None) -> DataFrame:
    """Rows ``(x, [class,] y, x_key)`` of a chart.

    Rows without x are dropped; a missing y is dropped unless ``fill`` is given.
    """
    data = df.where(F.col(x).isNotNull())
    if y is not None:
        data = data.fillna(fill, subset=[y]) if fill is not None else data.where(F.col(y).isNotNull())
    label, key = bin_label(F.col(x), bin)
    value = F.count(F.lit(1)) if y is None else AGGREGATES[agg](F.col(y))
    groups = [label.alias("x"), key.alias("x_key")]
    if classify:
        groups.append(F.col(classify).alias("class"))
    return data.groupBy(*groups).agg(value.alias("y"))


def sort_chart(points: DataFrame, sort: str | None) -> DataFrame:
    """Add the place ``ord`` of each point: by calendar key, or by x or y on request."""
    orders = {None: ["x_key"], "x": ["x"], "x_desc": [F.desc("x_key")], "y": ["y", "x_key"], "y_desc": [F.desc("y"), "x_key"]}
    order = list(orders[sort])
    if "class" in points.columns:
        order.append("class")
    return row_positions(points.withColumn("_all", F.lit(0)), ["_all"], order, "ord").drop("_all", "total")


def chart_lists(ordered: DataFrame, segment: int = 1000) -> DataFrame:
    """``x_data``, ``y_data`` and ``classify`` arrays, in segments of bounded length."""
    cols = [c for c in ("x", "y", "class") if c in ordered.columns]
    packed = F.array_sort(F.collect_list(F.struct("ord", *cols)))
    out = (ordered.withColumn("segment", F.floor(F.col("ord") / segment).cast("int"))
           .groupBy("segment").agg(packed.alias("p")))
    names = {"x": "x_data", "y": "y_data", "class": "classify"}

    def values(column: str) -> Column:
        return F.transform("p", lambda r: r[column])

    return out.select("segment", *[values(c).alias(names[c]) for c in cols])
