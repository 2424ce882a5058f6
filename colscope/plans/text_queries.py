"""Registered queries for prompts, answers, catalogs, batch scoring and sinks."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from ..functions import jsontext as js
from ..operators import evaluate as ev
from ..operators import ledger
from ..operators import prompts as pt
from ..operators import sampling as sm
from ..session import materialize, scratch_path
from ..sources import corpus as co
from ..sources import sinks
from ..sources.cells import table_cells
from . import flows
from .eval_queries import LOG_SQL, SCORE_SQL, class_scores, result_log
from .registry import query, rounded, table

TERMS_SQL = "text"
for _term in js.CHART_TERMS:
    TERMS_SQL = f"regexp_replace({TERMS_SQL}, '{_term}', '', 'gi')"


@query("mask_terms", oracle=f"""
WITH t AS (SELECT doc_id, text || ' Show a STACKED BAR chart, a pipeline and a grouping line; ' || source AS text FROM documents)
SELECT doc_id, md5({TERMS_SQL}) AS masked_md5, length({TERMS_SQL}) AS masked_length FROM t""")
def mask_terms(spark, sf):
    text = F.concat("text", F.lit(" Show a STACKED BAR chart, a pipeline and a grouping line; "), "source")
    rows = table(spark, sf, "documents").select("doc_id", js.mask_chart_terms(text).alias("m"))
    return rows.select("doc_id", F.md5(F.col("m").cast("binary")).alias("masked_md5"),
                       F.length("m").cast("bigint").alias("masked_length"))


def answers(spark, sf):
    """Model answers made from the event properties: fenced, wrapped in prose, damaged.

    Two kinds hold what strict parsers refuse: raw line breaks in a text, and NaN.
    """
    ev_rows = table(spark, sf, "events")
    p, m = F.col("props"), F.pmod("event_id", F.lit(11))
    inner = F.regexp_replace(p, r"^\{|\}$", "")
    text = (F.when(m == 0, p).when(m == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```")))
            .when(m == 2, F.concat(F.lit("Sure: "), p, F.lit(" done")))
            .when(m == 3, F.concat(F.lit("{"), inner, F.lit(",}"))).when(m == 4, inner)
            .when(m == 5, F.regexp_replace(p, '"', "'")).when(m == 6, F.lit("[1,2]"))
            .when(m == 7, F.lit("no json")).when(m == 8, F.lit("{}"))
            .when(m == 9, F.concat(F.lit('{"code": "a\n\tb",\n'), inner, F.lit("}")))
            .otherwise(F.concat(F.lit('{"score": NaN, '), inner, F.lit("}"))))
    return ev_rows.select("event_id", "props", text.alias("answer"))


@query("clean_json", oracle="""
WITH t AS (SELECT event_id, event_id % 11 AS m, props AS p, substr(props, 2, length(props) - 2) AS i FROM events)
SELECT event_id, CASE WHEN m <= 2 THEN p WHEN m = 3 THEN p WHEN m = 4 THEN i WHEN m = 5 THEN replace(p, '"', '''')
  WHEN m = 6 THEN '[1,2]' WHEN m = 7 THEN 'no json' WHEN m = 8 THEN '{}'
  WHEN m = 9 THEN '{"code": "a' || chr(10) || chr(9) || 'b",' || chr(10) || i || '}' ELSE '{"score": NaN, ' || i || '}' END AS cleaned FROM t""")
def clean_json(spark, sf):
    return answers(spark, sf).select("event_id", js.clean_response(F.col("answer")).alias("cleaned"))


@query("parse_json", oracle="""
SELECT event_id, event_id % 11 NOT IN (6, 7, 8) AS valid, CASE WHEN event_id % 11 NOT IN (6, 7, 8) THEN CAST(json_extract(props, '$.k') AS VARCHAR) END AS k,
  CASE event_id % 11 WHEN 6 THEN 'root is not an object' WHEN 7 THEN 'not readable as JSON' ELSE '' END AS errors FROM events""")
def parse_json(spark, sf):
    parsed = js.parse_responses(answers(spark, sf), "answer")
    return parsed.select("event_id", "valid", F.get_json_object("data", "$.k").alias("k"),
                         F.array_join("errors", ";").alias("errors"))


CATALOG = {"nation": ("n_nationkey", ["n_nationkey", "n_name", "n_regionkey"]),
           "customer": ("c_custkey", ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]),
           "orders": ("o_orderkey", ["o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice"])}


def catalog_cells(spark, sf):
    cells = None
    for name, (key, cols) in CATALOG.items():
        part = table_cells(table(spark, sf, name), cols, key, f"{name}.csv")
        cells = part if cells is None else cells.unionByName(part)
    # The first customer has no segment, so the example comes from the next one.
    return cells.withColumn("raw", F.when(~((F.col("field_name") == "c_mktsegment") & (F.col("pos") == 0)), F.col("raw")))


def _catalog_sql() -> str:
    kinds = {"c_acctbal": "float", "o_totalprice": "float", "n_name": "string", "c_name": "string", "c_mktsegment": "string",
             "o_orderstatus": "string", "o_orderdate": "datetime"}
    parts = []
    for name, (key, cols) in CATALOG.items():
        for c in cols:
            row = 1 if c == "c_mktsegment" else 0
            parts.append(f"SELECT '{name}.csv' AS table_name, '{c}' AS column_name, '{kinds.get(c, 'integer')}' AS data_type, "
                         f"CAST({c} AS VARCHAR) AS example FROM {name} WHERE {key} = {row}")
    return " UNION ALL ".join(parts)


@query("schema_catalog", oracle=_catalog_sql())
def schema_catalog(spark, sf):
    catalog = pt.schema_catalog(catalog_cells(spark, sf), ["nation", "customer.csv", "orders"])
    shape = "struct<tablename:string,columns:array<struct<name:string,data_type:string,example:string>>>"
    rows = catalog.select(F.from_json("schema_json", shape).alias("s")).select("s.tablename", F.explode("s.columns").alias("c"))
    return rows.select(F.col("tablename").alias("table_name"), F.col("c.name").alias("column_name"), "c.data_type", "c.example")


@query("prompt_table", oracle=f"""
WITH s AS (SELECT *, row_number() OVER (PARTITION BY table_name) AS rn FROM ({_catalog_sql()})),
q AS (SELECT doc_id, 'plot ' || source AS text, lang FROM documents)
SELECT doc_id, TRUE AS has_schema, {TERMS_SQL} AS question, lang <> 'en' AS has_describe,
  'More about the chart: ' || CASE WHEN lang = 'en' THEN 'none' ELSE lang END || chr(10) || 'Tables that do not matter: [''t_' || lang || ''', ''x'']' AS hint FROM q""")
def prompt_table(spark, sf):
    dbs = spark.createDataFrame([("shop", "customer.csv"), ("shop", "orders.csv"), ("geo", "nation.csv")], "db_id string, table string")
    schemas = pt.database_schema(pt.schema_catalog(catalog_cells(spark, sf)), dbs)
    requests = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, "shop").otherwise("geo").alias("db_id"),
        F.concat(F.lit("plot "), "source").alias("query"), F.when(F.col("lang") != "en", F.col("lang")).alias("describe"),
        F.array(F.concat(F.lit("t_"), "lang"), F.lit("x")).alias("irrelevant_tables"))
    out = pt.stage_prompts(requests, "table_selection", schemas)
    p = F.col("prompt")
    return out.select(
        "doc_id", p.contains('"tablename":"').alias("has_schema"),
        F.regexp_extract(p, r"(?s)Question:\n(.*)\n\nHint:", 1).alias("question"),
        (~p.contains("More about the chart: none")).alias("has_describe"),
        F.regexp_extract(p, r"(?s)Hint:\n(.*)\n\nAnswer", 1).alias("hint"))


@query("prompt_stages", oracle="""
SELECT c_custkey, 'Pick the columns|C1|Q' AS columns_prompt, 'data 0: [' || c_name || ', None]' || chr(10) || 'data 1: [' || c_mktsegment || ']' AS data_block,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'instruction:' || c_mktsegment END AS sections FROM customer""")
def prompt_stages(spark, sf):
    c = table(spark, sf, "customer")
    lists = F.array(F.array(F.col("c_name"), F.lit(None).cast("string")), F.array(F.col("c_mktsegment")))
    requests = c.select("c_custkey", F.lit("C1").alias("cols"), F.lit("Q pie").alias("query"), lists.alias("data"),
                        F.lit("S").alias("schema_info"), "c_mktsegment")
    cols = pt.stage_prompts(requests, "code_generation", template="Pick the columns|{COLS}|{QUESTION}").withColumnRenamed("prompt", "columns_prompt")
    ranked = pt.stage_prompts(cols, "chart_ranking")
    block = F.regexp_extract("prompt", r"(?s)Data:\n(.*)\n\nTypes:", 1)
    segment = F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))
    text = F.regexp_replace(F.lower(F.regexp_extract(pt.sections_prompt({"instruction": segment}), r"(?s)^(\w+:)", 1)), r"\n", "")
    return ranked.select("c_custkey", F.rtrim("columns_prompt").alias("columns_prompt"), block.alias("data_block"),
                         F.when(segment.isNotNull(), F.concat(text, segment)).alias("sections"))


@query("few_shot_block", oracle="""
WITH j AS (SELECT l.doc_id, d.source, l.quality FROM labels l JOIN documents d USING (doc_id)),
s AS (SELECT * FROM j ORDER BY md5('fs' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 5),
n AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS i FROM s)
SELECT string_agg(i || '.' || chr(10) || 'source: ' || source || chr(10) || 'quality: ' || quality || chr(10), '' ORDER BY i) AS examples FROM n""")
def few_shot_block(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    rows = table(spark, sf, "labels").select("doc_id", "quality").join(d, "doc_id")
    return pt.few_shot_block(sm.sample_examples(rows, 5, "doc_id", "random", seed="fs"), "doc_id", ["source", "quality"])


@query("chat_render", oracle="""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations)
SELECT conv_id, CAST(pos // 4 AS INTEGER) AS segment, count(*) AS turns, md5(CASE WHEN pos // 4 = 0 THEN 'System: be brief' || chr(10) ELSE '' END ||
  string_agg(CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE role END || ': ' || text, chr(10) ORDER BY pos)) AS transcript_md5
FROM p GROUP BY conv_id, pos // 4""")
def chat_render(spark, sf):
    out = pt.chat_transcripts(table(spark, sf, "conversations"), system="be brief", segment=4)
    return out.select("conv_id", "segment", "turns", F.md5(F.col("transcript").cast("binary")).alias("transcript_md5"))


def stub_model(prompt: str) -> dict:
    """Deterministic stand-in for a model service; fails on questions."""
    if prompt.endswith("?"):
        raise ValueError("question")
    return {"content": json.dumps({"words": len(prompt.split(" "))}), "tokens": len(prompt), "model": "stub"}


def scored_turns(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("prompt"))
    return pt.batch_infer(turns, stub_model, stage="answer")


@query("batch_infer", oracle="""
SELECT conv_id, turn, CASE WHEN text LIKE '%?' THEN 'failed' ELSE 'success' END AS status, CASE WHEN text LIKE '%?' THEN 'question' END AS error,
  CASE WHEN text LIKE '%?' THEN NULL ELSE CAST(len(string_split(text, ' ')) AS VARCHAR) END AS words, CASE WHEN text LIKE '%?' THEN 0 ELSE length(text) END AS tokens FROM conversations""")
def batch_infer(spark, sf):
    out = js.parse_responses(scored_turns(spark, sf), "raw_response")
    return out.select("conv_id", "turn", "status", "error", F.get_json_object("data", "$.words").alias("words"), "tokens")


@query("resumable_inference", oracle="""
SELECT conv_id, turn, CASE WHEN text LIKE '%?' THEN 'failed' ELSE 'success' END AS status, CASE WHEN text LIKE '%?' THEN 'question' END AS error,
  CASE WHEN text LIKE '%?' THEN 0 ELSE length(text) END AS tokens, CAST(CASE WHEN text LIKE '%?' THEN 2 ELSE 1 END AS BIGINT) AS calls FROM conversations""")
def resumable_inference(spark, sf):
    """The stage run twice on one ledger: the second run asks only what failed."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    path = scratch_path(spark, "ledger")
    ledger.answer_once(turns, stub_model, path, stage="answer", unit=500, units=8)
    out = ledger.answer_once(turns, stub_model, path, stage="answer", unit=500, units=8)
    calls = materialize(spark.read.parquet(path).groupBy("digest").agg(F.count(F.lit(1)).alias("calls")), "calls")
    return (out.withColumn("digest", ledger.request_digest("answer", F.col("prompt"))).join(calls, "digest")
            .select("conv_id", "turn", "status", "error", "tokens", "calls"))


def answering_model(prompt: str) -> dict:
    """Deterministic stand-in: answers with the numbers of its question, wrong for every third one."""
    numbers = [int(x) for x in re.findall(r"#(\d+)", prompt)]
    if numbers[0] % 11 == 0:
        raise ValueError("refused")
    given = [numbers[0] + (numbers[0] % 3 == 0), numbers[1]]
    return {"content": "```json\n" + json.dumps({"values": [[str(x) for x in given]]}) + "\n```", "tokens": 7, "model": "stub"}


@query("batch_evaluation", oracle="""
WITH c AS (SELECT o_custkey AS run_id, o_orderkey AS id, o_orderkey % 11 <> 0 AS ok, o_orderkey % 11 <> 0 AND o_orderkey % 3 <> 0 AS correct FROM orders),
n AS (SELECT *, (row_number() OVER (PARTITION BY run_id ORDER BY id) - 1) // 10 + 1 AS chunk_number FROM c)
SELECT run_id, chunk_number, count(*) AS total_cases, CAST(sum(correct::INT) AS BIGINT) AS final_correct_cases, round(avg(correct::INT), 6) AS final_accuracy,
  CAST(sum(CASE WHEN ok THEN 7 ELSE 0 END) AS BIGINT) AS total_tokens FROM n GROUP BY run_id, chunk_number""")
def batch_evaluation(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    number = lambda c: F.concat(F.lit("#"), F.col(c).cast("string"))
    requests = o.select(F.col("o_orderkey").alias("test_case_id"), F.col("o_custkey").alias("run_id"),
                        F.concat_ws(" ", number("o_orderkey"), number("o_custkey")).alias("query"), F.lit("id").alias("cols"))
    answered = flows.run_stage(requests, "code_generation", answering_model)
    values = F.from_json(F.get_json_object("data", "$.values"), "array<array<string>>")
    text = lambda c: F.col(c).cast("string")
    used = F.array(F.lit("orders"))
    columns = F.create_map(F.lit("orders"), F.array(F.lit("o_orderkey")))
    cases = answered.select(
        "run_id", "test_case_id", "tokens", F.lit("").alias("sort"), F.array(F.array(text("test_case_id"), text("run_id"))).alias("expected"),
        F.coalesce(values, F.array().cast("array<array<string>>")).alias("predicted"), used.alias("tables"), used.alias("predicted_tables"),
        columns.alias("columns"), columns.alias("predicted_columns"))
    _, chunks, _ = flows.evaluate_batch(cases)
    return rounded(chunks.select(
        "run_id", "chunk_number", "total_cases", "final_correct_cases", "final_accuracy", "total_tokens"))


@query("stage_stats", oracle="""
WITH r AS (SELECT event_type AS stage, CASE WHEN value > 100 THEN 'failed' ELSE 'success' END AS status, CAST(round(value) AS BIGINT) AS tokens,
  event_id % 7 + 0.25 AS s FROM events)
SELECT stage, status, count(*) AS runs, CAST(sum(tokens) AS BIGINT) AS tokens, round(avg(s), 6) AS mean_seconds FROM r GROUP BY stage, status""")
def stage_stats(spark, sf):
    runs = table(spark, sf, "events").select(
        F.col("event_type").alias("stage"), F.when(F.col("value") > 100, "failed").otherwise("success").alias("status"),
        F.round("value").cast("bigint").alias("tokens"),
        F.concat((F.col("event_id") % 7).cast("string"), F.lit(".25s")).alias("execution_time"))
    return rounded(pt.stage_stats(runs))


# ------------------------------------------------------------ sinks, read back

@query("batch_reports_scan", oracle=f"""
WITH {LOG_SQL} SELECT hardness, count(*) AS cases, CAST(sum(f::INT) AS BIGINT) AS correct_cases, CAST(sum(tokens) AS BIGINT) AS tokens FROM l WHERE NOT failed GROUP BY hardness""")
def batch_reports_scan(spark, sf):
    log = result_log(spark, sf).select(
        F.col("case_id").cast("string").alias("data_id"), "status", "correct", F.struct("hardness").alias("input"), "tokens")
    path = scratch_path(spark, "reports")
    # One report per row, each with a list of one result, plus one unreadable file.
    sinks.write_reports(log.select(F.array(F.struct(*log.columns)).alias("batch_results")), path)
    spark.range(1).select(F.lit("{broken").alias("value")).write.mode("append").text(path)
    reports = co.read_batch_reports(spark, path, multi_line=False)
    ok = reports.where("status = 'success'").withColumn("hardness", F.col("input.hardness"))
    return ok.groupBy("hardness").agg(F.count(F.lit(1)).alias("cases"), F.count_if("correct").alias("correct_cases"),
                                      F.sum("tokens").alias("tokens"))


@query("sink_roundtrip", oracle="""
SELECT c_custkey, c_name || ', "quoted"' AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
  strftime(TIMESTAMP '2024-01-02 03:04:05', '%Y-%m-%dT%H:%M:%S') || '.000000' AS stamp, base64(encode(c_mktsegment)) AS payload FROM customer""")
def sink_roundtrip(spark, sf):
    c = table(spark, sf, "customer")
    rows = c.select("c_custkey", F.concat("c_name", F.lit(', "quoted"')).alias("name"),
                    F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("c_acctbal"))
    path = scratch_path(spark, "csv")
    sinks.write_csv(rows, path)
    back = sinks.read_csv(spark, path, rows.schema)
    reports = c.select("c_custkey", F.lit("2024-01-02 03:04:05").cast("timestamp").alias("stamp"),
                       F.col("c_mktsegment").cast("binary").alias("payload"))
    target = scratch_path(spark, "json")
    sinks.write_reports(reports, target)
    texts = spark.read.schema("c_custkey bigint, stamp string, payload string").json(target)
    return back.join(texts, "c_custkey")


@query("partitioned_sink", oracle="""
SELECT CAST(n AS INTEGER) AS num_fields, count(*) AS tables, CAST(sum(n) AS BIGINT) AS fields FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY n""")
def partitioned_sink(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("fid"), "l_linenumber", "l_quantity")
    root = scratch_path(spark, "by_width")
    sinks.write_by_width(li, root, "fid", {"quantities": ["fid", "l_quantity"]})
    back = spark.read.parquet(f"{root}/by_field")
    subset = spark.read.parquet(f"{root}/quantities").groupBy("fid").agg(F.count(F.lit(1)).alias("n"))
    widths = back.groupBy("fid").agg(F.max("num_fields").alias("num_fields"))
    return widths.join(subset, "fid").groupBy("num_fields").agg(
        F.count(F.lit(1)).alias("tables"), F.sum("n").alias("fields"))


@query("append_sink", oracle="""
SELECT event_type, 2 * count(*) AS features, count(*) AS outcomes FROM events GROUP BY event_type""")
def append_sink(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type")
    root = scratch_path(spark, "appended")
    sinks.write_features(e, e, root, append=False)
    sinks.write_features(e, e.limit(0), root)
    f = spark.read.parquet(f"{root}/field_level_features").groupBy("event_type").agg(F.count(F.lit(1)).alias("features"))
    o = spark.read.parquet(f"{root}/field_level_outcomes").groupBy("event_type").agg(F.count(F.lit(1)).alias("outcomes"))
    return f.join(o, "event_type")


@query("append_chunks", oracle="""
SELECT user_id % 3 AS chunk, event_type, count(*) AS features, count(DISTINCT user_id) AS outcomes FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2""")
def append_chunks(spark, sf):
    """All events appended in three chunks, the second one twice."""
    e = table(spark, sf, "events").select("event_id", "event_type", "user_id").where("user_id is not null")
    users = e.select("event_type", "user_id").distinct()
    root = scratch_path(spark, "chunks")
    for chunk in (0, 1, 1, 2):
        mine = F.col("user_id") % 3 == chunk
        sinks.append_chunk({"features": e.where(mine), "outcomes": users.where(mine)}, root, chunk)
    count = lambda df, name: df.groupBy("chunk", "event_type").agg(F.count(F.lit(1)).alias(name))
    f = count(sinks.read_chunks(spark, root, "features", e.schema), "features")
    return f.join(count(sinks.read_chunks(spark, root, "outcomes", users.schema), "outcomes"), ["chunk", "event_type"])


@query("prediction_sink", oracle=f"""
WITH {SCORE_SQL}
SELECT CAST(a.vec_id AS VARCHAR) AS field_id, 'unknown' AS fid, 'class_' || a.cls AS predicted_trace_type, 'class_' || a.cls AS top1_type, 'class_' || b.cls AS top2_type
FROM r a JOIN r b ON a.vec_id = b.vec_id WHERE a.rk = 0 AND b.rk = 1""")
def prediction_sink(spark, sf):
    labels = F.array(*[F.lit(f"class_{i}") for i in range(10)])
    scored = ev.top_k(class_scores(spark, sf), "probability", labels).withColumn("field_id", F.col("vec_id").cast("string"))
    path = scratch_path(spark, "predictions")
    sinks.write_predictions(scored, path)
    return co.read_csv_table(spark, path).select("field_id", "fid", "predicted_trace_type", "top1_type", "top2_type")
