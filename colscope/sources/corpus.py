"""Readers for chart corpora, keyed JSON, CSV databases and batch reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ..functions import names as fn
from ..operators.ranking import PART, range_stage, row_positions, running_positions
from ..operators.sampling import first_rows
from ..session import materialize

CORPUS_SCHEMA = "fid STRING, chart_data STRING, layout STRING, table_data STRING"

TRACE_SCHEMA = (
    "ARRAY<STRUCT<type: STRING, mode: STRING, line: MAP<STRING, STRING>,"
    " marker: MAP<STRING, STRING>, xsrc: STRING, ysrc: STRING, zsrc: STRING,"
    " locationsrc: STRING, labelsrc: STRING, valuesrc: STRING, xaxis: STRING, yaxis: STRING>>")
TABLE_SCHEMA = ("MAP<STRING, STRUCT<cols: MAP<STRING,"
                " STRUCT<uid: STRING, `order`: INT, data: ARRAY<STRING>>>>>")


def read_corpus_tsv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Tab-separated chart corpus with a header; lines of the wrong width are dropped.

    A partition plays the part of a chunk. JSON cells double their quotes, so
    the quote escapes itself.
    """
    return (spark.read.schema(CORPUS_SCHEMA)
            .option("sep", "\t").option("header", True).option("mode", "DROPMALFORMED")
            .option("quote", '"').option("escape", '"').csv(path))


def write_corpus_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    (df.write.mode(mode).option("sep", "\t").option("header", True)
     .option("quote", '"').option("escape", '"').csv(path))


def _whole_json(text: Column, kind: str) -> Column:
    """Parse ``text`` as the value ``r``; ``end`` is read only when nothing follows it."""
    wrapped = F.concat(F.lit('{"r":'), text, F.lit(',"end":1}'))
    return F.from_json(wrapped, f"STRUCT<r: {kind}, `end`: INT>")


def parse_corpus(raw: DataFrame) -> DataFrame:
    """Parsed corpus with a ``reason`` for rows that cannot be used.

    ``reason`` is NULL for good rows, ``unparsable`` when one of the three JSON
    cells is broken, ``empty`` when there are no traces or no table. Each cell is
    parsed once, with only the members that are used.
    """
    cells = F.struct(_whole_json(F.col("chart_data"), TRACE_SCHEMA).alias("c"),
                     _whole_json(F.col("layout"), "MAP<STRING, STRING>").alias("l"),
                     _whole_json(F.col("table_data"), TABLE_SCHEMA).alias("t"))
    # A generator of one row: filters on parsed values stay above it. Pushed below
    # a projection they would parse every cell a second time.
    parsed = raw.select("fid", F.inline(F.array(cells)))
    readable = F.col("c.end").isNotNull() & F.col("l.end").isNotNull() & F.col("t.end").isNotNull()
    reason = (F.when(~readable, "unparsable")
              .when(F.coalesce(F.size("c.r"), F.lit(0)) <= 0, "empty")
              .when(F.coalesce(F.size("t.r"), F.lit(0)) <= 0, "empty"))
    return parsed.select("fid", F.col("c.r").alias("traces"), F.map_keys("l.r").alias("layout_keys"),
                         F.col("t.r").alias("tables"), reason.alias("reason"))


def n_fields() -> Column:
    """Fields of a parsed chart's first table."""
    return F.size(F.get(F.map_values("tables"), F.lit(0))["cols"])


def wide_charts(parsed: DataFrame, max_fields: int) -> DataFrame:
    """``fid`` and ``n_fields`` of the usable charts that ``clean_corpus`` leaves out at this limit."""
    return (parsed.where(F.col("reason").isNull() & (n_fields() > max_fields))
            .select("fid", n_fields().alias("n_fields")))


def clean_corpus(parsed: DataFrame, max_fields: int | None = None) -> DataFrame:
    """Usable charts with ``fields`` in table order.

    All charts are kept unless a limit is given; ``wide_charts`` then lists the others.
    Only the first table of a chart counts; map entries keep the JSON order, and of
    columns with one name the last stands.
    """
    entries = F.map_entries(F.get(F.map_values("tables"), F.lit(0))["cols"])
    cols = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    fields = F.transform(cols, lambda e: F.struct(
        e["value"]["order"].alias("ord"), e["key"].alias("name"),
        e["value"]["uid"].alias("uid"), e["value"]["data"].alias("data")))
    kept = parsed.where(F.col("reason").isNull())
    if max_fields is not None:
        kept = kept.where(n_fields() <= max_fields)
    return kept.select("fid", "traces", "layout_keys", F.array_sort(fields).alias("fields"))


def corpus_cells(charts: DataFrame) -> DataFrame:
    """Cells of all fields of cleaned charts."""
    fields = charts.select("fid", F.explode("fields").alias("f"))
    return (fields.select("fid", fn.field_id(F.col("fid"), F.col("f.uid")).alias("field_id"),
                          F.col("f.name").alias("field_name"), F.col("f.ord").alias("ord"),
                          F.posexplode("f.data").alias("pos", "raw")))


# A whole JSON text, the rest of one that began earlier, and the start of one that goes on.
_TEXT, _TEXT_END, _TEXT_START = r'"(?:[^"\\]++|\\.)*+"', r'^(?:[^"\\]++|\\.)*+"', r'"(?:[^"\\]++|\\.)*+$'


def _deeper(outside: Column) -> Column:
    """Brackets opened less those closed."""
    opened = F.length(outside) - F.length(F.translate(outside, "{[", ""))
    return opened - (F.length(outside) - F.length(F.translate(outside, "}]", "")))


def read_keyed_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object keyed by id, to rows ``(id, value)`` with value as JSON text.

    The file is read in ranges, a row up to each closing brace. Each row knows how many
    quotes it holds and, for a start inside and outside a text, how much deeper it ends; two
    running sums over the rows tell which braces end a top-level entry, so the entries of
    one large document are cut, and then parsed, in many tasks. An entry must fit into a row.
    """
    rows = (spark.read.option("lineSep", "}").text(path)
            .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("at"), "value"))
    rows = rows.withColumn("quotes", F.length(F.regexp_replace("value", r'(?s)\\.|[^"\\]', '')))
    order = ["block", "at"]
    placed = running_positions(rows, ["path"], order, F.col("quotes")).withColumnRenamed("before", "seen").drop("total")
    inside = F.col("seen") % 2 == 1
    rest = F.when(~inside, F.col("value")).when(F.col("quotes") > 0, F.regexp_replace("value", "(?s)" + _TEXT_END, "")).otherwise("")
    outside = F.regexp_replace(F.regexp_replace(rest, "(?s)" + _TEXT, ""), "(?s)" + _TEXT_START, "")
    placed = placed.withColumn("ends_outside", (F.col("seen") + F.col("quotes")) % 2 == 0).withColumn("deeper", _deeper(outside) - F.col("ends_outside").cast("int"))
    depths = running_positions(placed, ["path"], order, F.col("deeper")).withColumnRenamed("before", "depth").drop("total")
    # A row at whose end the depth is 1 or 0 ends an entry; the next row begins another.
    depths = depths.withColumn("ends", (F.col("ends_outside") & (F.col("depth") + F.col("deeper") <= 1)).cast("int"))
    entries = running_positions(depths, ["path"], order, F.col("ends")).withColumnRenamed("before", "entry")
    whole = entries.groupBy("path", "entry").agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("rows"), F.max("ends").alias("closed"),
                                                 F.min_by(F.col("depth") + F.col("deeper"), F.when(F.col("ends") == 1, 0)).alias("after"))
    text = F.array_join(F.transform("rows", lambda r: r["value"]), "}")
    text = F.when((F.col("closed") == 1) & (F.col("after") == 1), F.concat(text, F.lit("}"))).otherwise(text)
    bare = F.when(F.col("entry") == 0, F.regexp_replace(text, r"^\x{FEFF}?\s*\{", "")).otherwise(F.regexp_replace(text, r"^\s*,", ""))
    return whole.select(F.explode(F.from_json(F.concat(F.lit("{"), bare, F.lit("}")), "map<string,string>")).alias("id", "value"))


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str = "id STRING, value STRING") -> DataFrame:
    return spark.read.schema(schema).json(path)


CASE_SCHEMA = (
    "STRUCT<nl_queries: ARRAY<STRING>, db_id: STRING, hardness: STRING, describe: STRING,"
    " irrelevant_tables: ARRAY<STRING>, sort: STRING, chart: STRING, tables: ARRAY<STRING>,"
    " columns: MAP<STRING, ARRAY<STRING>>,"
    " vis_obj: STRUCT<chart: STRING, x_data: ARRAY<ARRAY<STRING>>, y_data: ARRAY<ARRAY<STRING>>,"
    " classify: ARRAY<STRING>>, vis_query: STRUCT<data_part: STRUCT<sql_part: STRING>>>")


def case_rows(keyed: DataFrame) -> DataFrame:
    """Benchmark cases from ``(id, value)`` rows."""
    return keyed.select("id", F.from_json("value", CASE_SCHEMA).alias("case")).select("id", "case.*")


def read_csv_table(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One CSV table with a header, every column as text."""
    return spark.read.option("header", True).csv(path)


def csv_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Catalog ``(db_id, table, path)`` of ``root/<db_id>/<table>.csv`` (file or folder)."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.csv")
             .option("recursiveFileLookup", True).load(root).select("path"))
    parts = F.split("path", "/")
    in_folder = F.element_at(parts, -2).endswith(".csv")
    name = F.when(in_folder, F.element_at(parts, -2)).otherwise(F.element_at(parts, -1))
    db = F.when(in_folder, F.element_at(parts, -3)).otherwise(F.element_at(parts, -2))
    return files.select(db.alias("db_id"), F.regexp_replace(name, r"\.csv$", "").alias("table"), "path")


_CELL = r'(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+|)'


def csv_cells(record: Column) -> Column:
    """Cells of one CSV record; quoted cells may hold commas, line breaks and doubled quotes, an empty one is NULL.

    What stands behind a closing quote is kept, as is a quote inside an unquoted cell.
    """
    parts = F.regexp_extract_all(F.concat(record, F.lit(",")), F.lit(f'({_CELL}|"[^,]*+),'), 1)
    quoted = r'(?s)^"((?:[^"]++|"")*+)"(.*)$'
    return F.transform(parts, lambda p: F.when(
        p.rlike(quoted), F.nullif(F.concat(F.replace(F.regexp_extract(p, quoted, 1), F.lit('""'), F.lit('"')), F.regexp_extract(p, quoted, 2)), F.lit("")))
        .when(p != "", p))


def csv_records(lines: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Lines (``value``, without their line feed) to records: ``keys``, ``record`` from 0, ``total``, ``value``.

    Whether a line starts inside quotes follows from the lines before it. Each line is a
    small function: it swaps the state, keeps it, or sets it whatever it was. Swaps are
    summed up and the last setting line is found, first in each range of lines and then over
    the ranges, so a file may be split anywhere. Only lines of records over several lines
    are gathered. A carriage return before the line feed is dropped.
    """
    keys, order = list(keys), list(order)
    line = F.regexp_replace("value", "\r$", "")
    whole = f"^{_CELL}(?:,{_CELL})*+$"
    has = F.contains("value", F.lit('"'))
    opens = F.when(has, ~line.rlike(whole)).otherwise(False)
    closing = F.regexp_replace(line, r'^(?:[^"]++|"")*+"', "x")
    stays = F.when(has & line.rlike(r'^(?:[^"]++|"")*+"'), ~closing.rlike(whole)).otherwise(True)
    marked = lines.withColumns({"_open": opens, "_stay": stays})
    staged = range_stage(marked.withColumn("_swap", (F.col("_open") & ~F.col("_stay")).cast("int")), keys, order)
    pieces = staged.groupBy(*keys, PART).agg(F.sum("_swap").alias("_s"), F.count("*").alias("_n"))
    parts = W.partitionBy(*keys).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    offsets = pieces.select(*keys, PART, F.coalesce(F.sum("_s").over(parts), F.lit(0)).alias("_s0"), F.coalesce(F.sum("_n").over(parts), F.lit(0)).alias("_n0"))
    local = W.partitionBy(*keys, PART).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = (staged.join(materialize(offsets, "csv-offsets"), [*keys, PART])
              .withColumns({"_swaps": F.col("_s0") + F.coalesce(F.sum("_swap").over(local), F.lit(0)),
                            "_line": F.col("_n0") + F.coalesce(F.count("*").over(local), F.lit(0))}).drop("_s0", "_n0"))
    # The state a setting line leaves, seen from the start: later swaps come on top.
    left = F.when(F.col("_open") == F.col("_stay"), F.struct("_line", (F.col("_open").cast("int") + F.col("_swaps")).alias("state")))
    placed = materialize(placed.withColumn("_set", left), "csv-lines")
    set_before = materialize(placed.groupBy(*keys, PART).agg(F.max("_set").alias("_m")).select(*keys, PART, F.max("_m").over(parts).alias("_m0")), "csv-set")
    known = placed.join(set_before, [*keys, PART]).withColumn("_last", F.greatest(F.max("_set").over(local), F.col("_m0")))
    inside = (F.coalesce(F.col("_last.state"), F.lit(0)) + F.col("_swaps")) % 2 == 1
    ends_inside = F.when(inside, F.col("_stay")).otherwise(F.col("_open"))
    known = known.select(*keys, "_line", line.alias("value"), F.col("value").alias("_raw"), inside.alias("_in"), ends_inside.alias("_on"))
    numbered = running_positions(known, keys, ["_line"], (~F.col("_in")).cast("int"))
    record = F.when(F.col("_in"), F.col("before") - 1).otherwise(F.col("before")).alias("record")
    numbered = materialize(numbered.select(*keys, record, "_line", "value", "_raw", "total", (~F.col("_in") & ~F.col("_on")).alias("_alone")), "csv-records")
    joined = (numbered.where("not _alone").groupBy(*keys, "record").agg(F.array_sort(F.collect_list(F.struct("_line", "_raw"))).alias("rows"), F.max("total").alias("total"))
              .select(*keys, "record", "total", F.regexp_replace(F.array_join(F.transform("rows", lambda r: r["_raw"]), "\n"), "\r$", "").alias("value")))
    return numbered.where("_alone").select(*keys, "record", "total", "value").unionByName(joined)


def read_database_cells(spark: SparkSession, root: str) -> DataFrame:
    """Cells of every table below ``root/<db_id>/<table>.csv``: ``db_id`` and the columns of cells.

    One scan of all files, which may be split: lines are ranked by file, start of the split
    and place in it, and put together to records (see ``csv_records``), so quoted cells may
    hold line breaks. A row's ``pos`` counts from 0 in its table. A table that is a folder
    has its files in order of name; each file starts with the header. Blank lines are no
    rows. Names are made unique as ``functions.names.unique_names`` says. Lines end in LF or CR LF.
    """
    lines = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").option("lineSep", "\n").text(root)
             .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("at"), "value"))
    records = csv_records(lines, ["path"], ["block", "at"]).where("value <> ''").drop("total")
    placed = materialize(row_positions(records, ["path"], ["record"], "row"), "csv-rows")
    parts = F.split("path", "/")
    in_folder = F.element_at(parts, -2).endswith(".csv")
    name = F.when(in_folder, F.element_at(parts, -2)).otherwise(F.element_at(parts, -1))
    db = F.when(in_folder, F.element_at(parts, -3)).otherwise(F.element_at(parts, -2))
    earlier = W.partitionBy("db_id", "fid").orderBy("path").rowsBetween(W.unboundedPreceding, -1)
    # One row per file: its table, its header and the rows of the table's files before it.
    files = placed.where("row = 0").select(
        "path", db.alias("db_id"), F.regexp_replace(name, r"\.csv$", "").alias("fid"), csv_cells(F.regexp_replace("value", "^\\x{FEFF}", "")).alias("header"),
        (F.col("total") - 1).alias("rows"))
    files = materialize(files.withColumn("header", fn.unique_names(F.col("header"))).withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0))), "csv-files")
    rows = (placed.where("row > 0").join(files, "path")
            .select("db_id", "fid", (F.col("before") + F.col("row") - 1).alias("pos"), "header", csv_cells(F.col("value")).alias("cells")))
    return rows.select("db_id", "fid", "pos", F.posexplode("header").alias("ord", "field_name"), "cells").select(
        "db_id", "fid", F.col("field_name").alias("field_id"), "field_name", "ord", "pos", F.get("cells", F.col("ord")).alias("raw"))


def database_tables(db_tables: DataFrame, root: str) -> DataFrame:
    """Paths of the listed tables, from ``(db_id, tables ARRAY<STRING>)`` rows."""
    listed = db_tables.select("db_id", F.explode("tables").alias("table"))
    return listed.withColumn("path", F.concat_ws("/", F.lit(root), "db_id", F.concat("table", F.lit(".csv"))))


RESULT_SCHEMA = (
    "data_id STRING, test_case_id BIGINT, status STRING, correct BOOLEAN,"
    " input STRUCT<hardness: STRING, sort: STRING, nl_queries: ARRAY<STRING>, irrelevant_tables: ARRAY<STRING>>,"
    " evaluation STRUCT<final: STRUCT<expected: ARRAY<ARRAY<STRING>>, predicted: ARRAY<ARRAY<STRING>>, correct: BOOLEAN>,"
    " table: STRUCT<expected: ARRAY<STRING>, predicted: ARRAY<STRING>, correct: BOOLEAN>,"
    " column: STRUCT<expected: MAP<STRING, ARRAY<STRING>>, predicted: MAP<STRING, ARRAY<STRING>>, correct: BOOLEAN>>,"
    " execution_time STRING, tokens BIGINT, error_message STRING")


def read_batch_reports(spark: SparkSession, path: str | Sequence[str], list_name: str = "batch_results",
                       multi_line: bool = True) -> DataFrame:
    """Results of many report files; unreadable files give no rows.

    ``multi_line=False`` reads the splittable form, one report per line.
    """
    row = T.StructType.fromDDL(RESULT_SCHEMA)
    schema = T.StructType([T.StructField(list_name, T.ArrayType(row))])
    reports = spark.read.option("multiLine", multi_line).schema(schema).json(path)
    return reports.select(F.col("_metadata.file_name").alias("file_name"),
                          F.explode(list_name).alias("r")).select("file_name", "r.*")


def feature_rows(df: DataFrame, header_column: str = "exists") -> DataFrame:
    """Feature rows without the header lines that appended CSV files repeat."""
    c = F.col(header_column)
    return df.where(c.isNull() | (c.cast("string") != header_column))


# Identifiers and labels that are no model inputs.
ID_AND_LABELS = ["field_id", "fid", "is_xsrc", "is_ysrc", "trace_type_n", "is_x_or_y", "trace_type"]


def split_features_labels(df: DataFrame, mode: str = "train") -> tuple[DataFrame, DataFrame | None]:
    """Model inputs and the two label columns; ``predict`` keeps everything as input."""
    if mode not in ("train", "test", "val", "predict"):
        raise ValueError("mode must be train, test, val or predict")
    if mode == "predict":
        return df, None
    labels = df.select(*[c for c in ("fid", "field_id", "is_x_or_y", "trace_type") if c in df.columns])
    return model_inputs(df), labels


def model_inputs(df: DataFrame, drop: Sequence[str] = ID_AND_LABELS) -> DataFrame:
    return df.drop(*drop)


def with_default_labels(df: DataFrame, trace_type: str = "unknown", role: str = "x") -> DataFrame:
    """Constant labels for unlabeled data that goes through a labeled path."""
    return df.withColumn("trace_type", F.lit(trace_type)).withColumn("is_x_or_y", F.lit(role))


def first_cases(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    """First ``n`` cases by (unique) key; -1 keeps all."""
    return df if n < 0 else first_rows(df, n, [], key)
