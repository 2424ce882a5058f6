"""Schema catalogs, prompt tables, transcripts and batch scoring."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as fn
from ..functions import typing as ty
from ..functions.jsontext import mask_chart_terms
from .evaluate import seconds
from .ranking import row_positions

# The chart types a ranking prompt lists.
CHART_TYPES = ["Bar", "Line", "Pie", "Scatter", "Stacked Bar", "Grouping Line", "Grouping Scatter"]

TEMPLATES = {
    "table_selection": (
        "Pick the tables needed to answer the question.\n\nSchema:\n{DATABASE_SCHEMA}\n\n"
        "Question:\n{QUESTION}\n\nHint:\n{HINT}\n\n"
        'Answer with JSON only: {"table_names": [...], "chain_thought": "..."}'),
    "column_selection": (
        "Pick the columns needed to answer the question.\n\nSchema:\n{DATABASE_SCHEMA}\n\n"
        "Question:\n{QUESTION}\n\nHint:\n{HINT}\n\n"
        'Answer with JSON only: {"TABLE": ["COLUMN", ...], "chain_thought": "..."}'),
    "code_generation": (
        "Write the query whose result answers the question.\n\nSchema:\n{DATABASE_SCHEMA}\n\n"
        "Question:\n{QUESTION}\n\nHint:\n1.{HINT}\n2.Columns that may matter:\n{COLS}\n\n"
        'Answer with JSON only: {"code": "...", "chain_thought": "..."}'),
    "chart_drawing": (
        "Choose how to draw this table for the question.\n\nTable:\n{DATAFRAME}\n\nColumns:\n{COLUMNS}\n\n"
        'Question:\n{QUESTION}\n\nAnswer with JSON only: {"code": "..."}'),
    "chart_ranking": (
        "Rank the chart types from most to least suitable for the data.\n\nSchema:\n{DATABASE_SCHEMA}\n\n"
        "Data:\n{DATA}\n\nTypes: " + ", ".join(CHART_TYPES) + "\n\n"
        'Answer with JSON only: {"type": [...], "chain_thought": "..."}'),
}


# ------------------------------------------------------------ schema catalogs

def column_examples(cells: DataFrame, head: int = 5) -> DataFrame:
    """Type and example of each column from the first non-null of its first rows.

    ``cells`` carries ``pos`` counted from 0 inside each table.
    """
    shown = cells.where((F.col("pos") < head) & F.col("raw").isNotNull())
    column = ["fid", "field_name", "ord"]
    at = shown.groupBy(*column).agg(F.min("pos").alias("pos"))
    firsts = shown.join(at, [*column, "pos"]).select(*column, F.col("raw").alias("example"))
    return firsts.withColumn("data_type", ty.example_type(F.col("example")))


def keep_tables(examples: DataFrame, tables: Sequence[str]) -> DataFrame:
    """Only the named tables, given with or without ``.csv``; an empty list keeps all."""
    if not tables:
        return examples
    bare = [t.removesuffix(".csv") for t in tables]
    return examples.where(F.regexp_replace("fid", r"\.csv$", "").isin(*bare))


def schema_catalog(cells: DataFrame, tables: Sequence[str] = (), head: int = 5) -> DataFrame:
    """Schema JSON per table: columns with type and example, in column order."""
    kept = keep_tables(column_examples(cells, head), tables)
    column = F.struct(F.col("field_name").alias("name"), F.col("data_type"), F.col("example"))
    # One entry per column of a table, never per row.
    entries = F.array_sort(F.collect_list(F.struct("ord", column.alias("c"))))
    per_table = kept.groupBy("fid").agg(F.transform(entries, lambda e: e["c"]).alias("columns"))
    return per_table.select("fid", F.to_json(F.struct(F.col("fid").alias("tablename"), "columns")).alias("schema_json"))


def database_schema(catalog: DataFrame, db_tables: DataFrame) -> DataFrame:
    """Schema text per database: the JSON list of its tables, by name."""
    joined = db_tables.select("db_id", F.col("table").alias("fid")).join(catalog, "fid")
    listed = F.array_sort(F.collect_list(F.struct("fid", "schema_json")))
    return joined.groupBy("db_id").agg(F.concat(
        F.lit("["), F.array_join(F.transform(listed, lambda s: s["schema_json"]), ","), F.lit("]")).alias("schema_info"))


# ------------------------------------------------------------------- prompts

def read_template(spark: SparkSession, path: str) -> str:
    """Text of one template file."""
    return spark.read.text(path, wholetext=True).first()["value"]


def render(template: str, values: dict[str, Column]) -> Column:
    """Fill ``{KEY}`` placeholders; the prompt is NULL when a value is NULL.

    The template is split at its placeholders, so braces inside values or in the
    rest of the template are left alone.
    """
    pieces, rest = [], template
    while rest:
        places = [(rest.find("{" + k + "}"), k) for k in values if "{" + k + "}" in rest]
        if not places:
            pieces.append(F.lit(rest))
            break
        at, key = min(places)
        pieces += [F.lit(rest[:at])] if at else []
        pieces.append(values[key].cast("string"))
        rest = rest[at + len(key) + 2:]
    return F.concat(*pieces)


# Fixed order of the sections of a prompt.
SECTIONS = ["instruction", "context", "input", "output_format", "constraint", "output"]


def sections_prompt(sections: dict[str, Column], titles: dict[str, str] | None = None) -> Column:
    """Titled sections in the fixed order, NULL ones left out."""
    titles = titles or {}
    parts = [F.concat(F.lit(titles.get(s, s.replace("_", " ").capitalize()) + ":\n"), sections[s])
             for s in SECTIONS if s in sections]
    return F.concat_ws("\n", *parts)


def hint_text(describe: Column, irrelevant: Column) -> Column:
    shown = F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(
        irrelevant, lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", "), F.lit("]")), F.lit("none"))
    words = F.coalesce(F.when(describe != "", describe), F.lit("none"))
    return F.concat(F.lit("More about the chart: "), words, F.lit("\nTables that do not matter: "), shown)


def data_listing(lists: Column) -> Column:
    """``data i: [...]`` lines of value lists."""
    return F.array_join(F.transform(lists, lambda l, i: F.concat(
        F.lit("data "), i.cast("string"), F.lit(": ["), F.array_join(l, ", ", "None"), F.lit("]"))), "\n")


def stage_prompts(requests: DataFrame, stage: str, schemas: DataFrame | None = None, mask: bool = True,
                  template: str | None = None) -> DataFrame:
    """Prompt per request of one stage.

    ``requests`` carries what the stage needs: db_id, query, describe,
    irrelevant_tables, cols, data (lists), dataframe, column_names.
    """
    joined = requests if schemas is None else requests.join(schemas, "db_id", "left")
    have = set(joined.columns)
    values: dict[str, Column] = {}
    if "schema_info" in have:
        values["DATABASE_SCHEMA"] = F.col("schema_info")
    if "query" in have:
        values["QUESTION"] = mask_chart_terms(F.col("query")) if mask else F.col("query")
    if {"describe", "irrelevant_tables"} <= have:
        values["HINT"] = hint_text(F.col("describe"), F.col("irrelevant_tables"))
    for key, column in (("COLS", "cols"), ("DATAFRAME", "dataframe"), ("COLUMNS", "column_names")):
        if column in have:
            values[key] = F.col(column)
    if "data" in have:
        values["DATA"] = data_listing(F.col("data"))
    return joined.withColumn("prompt", render(template or TEMPLATES[stage], values))


def few_shot_block(sample: DataFrame, order: str, fields: Sequence[str]) -> DataFrame:
    """Numbered example block from a drawn sample, which is small by its size argument."""
    shown = [F.concat(F.lit(f"{f}: "), F.coalesce(F.col(f).cast("string"), F.lit("None"))) for f in fields]
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat_ws("\n", *shown).alias("text"))))
    lines = F.transform(items, lambda e, i: F.concat((i + 1).cast("string"), F.lit(".\n"), e["text"], F.lit("\n")))
    return sample.agg(F.array_join(lines, "").alias("examples"))


def chat_transcripts(turns: DataFrame, key: str = "conv_id", order: str = "turn", system: str | None = None,
                     names: dict[str, str] | None = None, segment: int = 200) -> DataFrame:
    """Transcript per conversation, in segments of at most ``segment`` turns.

    Ordinary conversations are one segment. Segments keep a conversation that
    holds much of the table from meeting in one task; joined in order they are
    the whole transcript.
    """
    names = names or {"user": "User", "assistant": "Assistant"}
    shown = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    placed = row_positions(turns.select(key, order, "role", "text"), [key], [order], "_pos")
    line = F.concat(F.coalesce(F.try_element_at(shown, F.col("role")), F.col("role")), F.lit(": "), F.col("text"))
    packed = F.array_sort(F.collect_list(F.struct(F.col("_pos"), line.alias("line"))))
    body = F.array_join(F.transform(packed, lambda r: r["line"]), "\n")
    out = (placed.withColumn("segment", F.floor(F.col("_pos") / segment).cast("int"))
           .groupBy(key, "segment").agg(F.count(F.lit(1)).alias("turns"), body.alias("transcript")))
    if system is None:
        return out
    head = F.when(F.col("segment") == 0, F.lit(f"System: {system}\n")).otherwise(F.lit(""))
    return out.withColumn("transcript", F.concat(head, "transcript"))


# -------------------------------------------------------------- batch scoring

Model = Callable[[str], dict]
RUN_FIELDS = "model string, raw_response string, status string, error string, tokens bigint, execution_time string"


def batch_infer(requests: DataFrame, model: Model, prompt: str = "prompt", stage: str = "stage",
                retries: int = 3) -> DataFrame:
    """Run a user-supplied model function on every prompt, partition by partition.

    ``model`` returns ``content``, ``tokens`` and ``model``. A failing call is
    repeated up to ``retries`` times, then recorded as failed.
    """
    def call(text: str) -> dict:
        began, answer, error = time.perf_counter(), None, None
        for _ in range(max(retries, 1)):
            try:
                answer, error = model(text), None
                break
            except Exception as err:  # recorded, not raised
                error = str(err)
        answer = answer or {}
        return {"model": answer.get("model"), "raw_response": answer.get("content"),
                "status": "failed" if error else "success", "error": error,
                "tokens": int(answer.get("tokens", 0)),
                "execution_time": f"{time.perf_counter() - began:.2f}s"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = pd.DataFrame([call(t) for t in batch[prompt]],
                                   columns=["model", "raw_response", "status", "error", "tokens", "execution_time"])
            yield pd.concat([batch.reset_index(drop=True).assign(stage=stage), answers], axis=1)

    inputs = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    return requests.mapInPandas(run, f"{inputs}, stage string, {RUN_FIELDS}")


def stage_stats(runs: DataFrame) -> DataFrame:
    """Runs, tokens and mean seconds per stage and status."""
    return runs.groupBy("stage", "status").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("tokens").cast("bigint").alias("tokens"),
        F.avg(seconds(F.col("execution_time"))).alias("mean_seconds"))


def failed_stages(runs: DataFrame) -> DataFrame:
    return runs.where("status = 'failed'")


def latest_stage(runs: DataFrame, key: str = "run_id", order: str = "started") -> DataFrame:
    """Last record of each run."""
    rest = [c for c in runs.columns if c != key]
    return runs.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def selected_tables(predicted: Column) -> Column:
    """Lower-case table names of a selection answer."""
    return F.transform(predicted, fn.bare_table_name)
