"""Encoding labels of fields, mined from chart specifications.

A chart with its traces and fields is one row, so everything up to the
per-field rows is an expression over arrays: no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as fn

# The six data sources of a trace.
SOURCES = ["xsrc", "ysrc", "zsrc", "locationsrc", "labelsrc", "valuesrc"]


def draws_line(trace: Column) -> Column:
    """A scatter trace that draws a line."""
    line = F.coalesce(F.size(trace["line"]), F.lit(0)) > 0
    marker = F.try_element_at(trace["marker"], F.lit("line"))
    color = F.get_json_object(marker, "$.color")
    outlined = F.coalesce(marker.rlike(r'^\{\s*"'), F.lit(False)) & F.coalesce(color != "transparent", F.lit(True))
    return F.coalesce(trace["mode"].isin("lines+markers", "lines"), F.lit(False)) | line | outlined


def trace_kind(trace: Column) -> Column:
    return F.when((trace["type"] == "scatter") & draws_line(trace), "line").otherwise(trace["type"])


def _references(traces: Column) -> Column:
    """All (trace number, source kind, field id) of a chart in reading order."""
    def of_trace(t: Column, i: Column) -> Column:
        refs = F.array(*[F.struct(i.alias("trace"), F.lit(s).alias("src"), t[s].alias("raw")) for s in SOURCES])
        return F.transform(F.filter(refs, lambda r: r["raw"].isNotNull() & (r["raw"] != "")),
                           lambda r: F.struct(r["trace"].alias("trace"), r["src"].alias("src"),
                                              fn.source_field_id(r["raw"]).alias("field_id")))
    return F.flatten(F.transform(traces, of_trace))


def _count(refs: str, src: str) -> Column:
    """References of one source kind."""
    return F.size(F.filter(refs, lambda r: r["src"] == src))


def field_outcomes(charts: DataFrame, label_mode: str = "reference") -> DataFrame:
    """Trace type, source flags and counts of each field of each chart.

    ``label_mode="reference"``: a referenced field takes the type of the chart's
    last readable trace. ``"own"``: of the last trace that references it. ``"both"``
    gives the second as ``own_trace_type`` beside the first, in one pass. A trace
    naming an unknown field ends the reading of its chart: earlier trace types
    stay, flags and counts are NULL.
    """
    if label_mode not in ("reference", "own", "both"):
        raise ValueError("label_mode must be 'reference', 'own' or 'both'")
    prepared = (charts.select(
        "fid", "fields", F.transform("traces", trace_kind).alias("kinds"),
        _references(F.col("traces")).alias("refs"))
        .withColumn("known", F.transform("fields", lambda f: fn.field_id(F.col("fid"), f["uid"])))
        .withColumn("broken", F.array_min(F.transform(
            F.filter("refs", lambda r: ~F.array_contains(F.col("known"), r["field_id"])),
            lambda r: r["trace"])))
        .withColumn("last", F.when(F.col("broken").isNull(), F.size("kinds") - 1).otherwise(F.col("broken") - 1))
        .withColumn("uses", F.array(*[_count("refs", src) for src in SOURCES])))
    # The references of a field are picked out once; all that follows looks at these few only.
    fields = (prepared.select("fid", "kinds", "refs", "uses", "broken", "last", F.explode("known").alias("field_id"))
              .withColumn("named", F.filter("refs", lambda r: r["field_id"] == F.col("field_id")))
              .withColumn("seen", F.filter("named", lambda r: r["trace"] <= F.col("last"))))

    mine = F.col("seen")
    own_last = F.array_max(F.transform(mine, lambda r: r["trace"]))
    whole = F.col("broken").isNull()
    kind = lambda at: F.when(F.size(mine) > 0, F.get("kinds", at))
    columns = [kind(own_last if label_mode == "own" else F.col("last")).alias("trace_type")]
    if label_mode == "both":
        columns.append(kind(own_last).alias("own_trace_type"))
    fields = fields.withColumns({f"n_{src}": _count("named", src) for src in SOURCES})
    flags, singles, counts = [], [], []
    for i, src in enumerate(SOURCES):
        n = F.col(f"n_{src}")
        hit = whole & (n > 0)
        alone = hit & (n > 1) & (n == F.get("uses", F.lit(i)))
        flags.append(F.when(hit, F.lit(True)).alias(f"is_{src}"))
        singles.append(F.when(alone, F.lit(True)).alias(f"is_single_{src}"))
        counts.append(F.when(hit, n).alias(f"num_{src}"))
    return fields.select("fid", "field_id", *columns, *flags, *singles, *counts,
                         (~whole).alias("has_unresolved"))


def axis_inventory(charts: DataFrame) -> DataFrame:
    """Axes named by the traces and by the layout of each chart."""
    def used(axis: str) -> Column:
        named = F.filter(F.transform("traces", lambda t: t[axis]), lambda a: a.isNotNull() & (a != ""))
        return F.array_sort(F.array_distinct(named))

    def laid_out(axis: str) -> Column:
        keys = F.coalesce("layout_keys", F.array().cast("array<string>"))
        return F.array_sort(F.filter(keys, lambda k: k.contains(axis)))

    return charts.select("fid", used("xaxis").alias("x_axes"), used("yaxis").alias("y_axes"),
                         laid_out("xaxis").alias("x_layout_axes"), laid_out("yaxis").alias("y_layout_axes"))


def trace_types(charts: DataFrame) -> DataFrame:
    """One row per trace with its raw type, NULL when missing."""
    return charts.select("fid", F.explode(F.transform("traces", lambda t: t["type"])).alias("trace_type"))


def trace_type_counts(charts: DataFrame) -> DataFrame:
    return trace_types(charts).groupBy("trace_type").agg(F.count(F.lit(1)).alias("n"))


def axis_role(is_x: Column, is_y: Column) -> Column:
    """``x`` for an x-only field, ``y`` for a y-only field, else NULL."""
    x, y = F.coalesce(is_x, F.lit(False)), F.coalesce(is_y, F.lit(False))
    return F.when(x & is_y.isNull(), "x").when(y & is_x.isNull(), "y")
