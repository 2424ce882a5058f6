"""Registered queries over chart corpora built from the events table.

Every event becomes one chart: two traces over the fields a, b and c. The
second trace of some events names an unknown field, and some charts are broken,
empty or too wide.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsontext as js
from ..functions import typing as ty
from ..operators import labels as lb
from ..operators import models as ml
from ..operators import prep
from ..operators import profile as pr
from ..operators import prompts as pt
from ..operators import relational as rl
from ..sources import corpus as co
from ..sources import sinks
from ..sources.cells import role_array_cells, table_cells
from ..session import materialize, scratch_path
from . import flows
from .registry import query, rounded, table

EVENTS_PER_TASK = 50_000

# Fixed values of the generated corpus: event type to first trace.
KINDS = {"view": "scatter", "click": "bar", "error": "box", "signup": "heatmap", "purchase": "histogram"}
KIND_SQL = ("CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END")


def events(spark, sf):
    return table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def spread_events(spark, sf):
    """Events dealt out evenly: a chart is many times as long as its event, so a file's splits make few and heavy tasks."""
    ev = events(spark, sf)
    return ev.repartition(max(spark.sparkContext.defaultParallelism, -(-ev.count() // EVENTS_PER_TASK)))


def event_charts(ev):
    """Raw corpus rows (JSON texts) of events."""
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    fid = F.concat(user, F.lit(":"), F.col("event_id").cast("string"))
    src = lambda uid: F.concat(user, F.lit(":9:"), uid)
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    first = F.struct(
        kinds[F.col("event_type")].alias("type"), F.when(F.col("k") % 2 == 0, "lines").otherwise("markers").alias("mode"),
        src(F.lit("a")).alias("xsrc"), src(F.lit("b")).alias("ysrc"),
        F.lit(None).cast("string").alias("zsrc"), F.lit("x").alias("xaxis"))
    second = F.struct(
        F.lit("bar").alias("type"), F.lit(None).cast("string").alias("mode"), src(F.lit("a")).alias("xsrc"),
        src(F.when(F.col("k") % 10 == 0, "zz").otherwise("c")).alias("ysrc"),
        F.when(F.col("k") % 3 == 0, src(F.lit("c"))).alias("zsrc"), F.lit("x2").alias("xaxis"))
    width = F.when(F.col("event_id") % 5 == 0, 30).otherwise(3)
    cols = F.map_from_entries(F.transform(F.sequence(F.lit(1), width), lambda i: F.struct(
        F.concat(F.lit("col "), i.cast("string")).alias("key"),
        F.struct(F.char(96 + i).alias("uid"), (i - 1).alias("order"),
                 F.array((F.col("value") * i).cast("string"), F.lit("x")).alias("data")).alias("value"))))
    tables = F.create_map(F.concat(F.lit("t"), F.col("event_id").cast("string")), F.struct(cols.alias("cols")))
    broken = F.col("event_id") % 17 == 0
    return ev.select(
        fid.alias("fid"),
        F.when(broken, '[{"type":').when(F.col("event_id") % 13 == 0, "[]")
        .otherwise(F.to_json(F.array(first, second))).alias("chart_data"),
        F.lit('{"xaxis":{},"yaxis2":{},"title":"t"}').alias("layout"),
        F.to_json(tables).alias("table_data"))


# The same corpus for the checks: usable events with the flags the labels depend on.
USABLE = f"""ev AS (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k, 'u' || user_id AS u FROM events),
ok AS (SELECT *, u || ':' || event_id AS fid, k % 10 = 0 AS broken,
  CASE WHEN event_type = 'view' AND k % 2 = 0 THEN 'line' ELSE {KIND_SQL} END AS kind
  FROM ev WHERE event_id % 17 <> 0 AND event_id % 13 <> 0 AND event_id % 5 <> 0)"""


def usable_charts(spark, sf):
    return materialize(co.clean_corpus(co.parse_corpus(event_charts(spread_events(spark, sf))), 25), "charts")


@query("clean_corpus", oracle="""
SELECT coalesce(CASE WHEN event_id % 17 = 0 THEN 'unparsable' WHEN event_id % 13 = 0 THEN 'empty' END,
    CASE WHEN event_id % 5 = 0 THEN 'too wide' ELSE 'kept' END) AS outcome,
  count(*) AS charts, CAST(sum(CASE WHEN event_id % 17 = 0 OR event_id % 13 = 0 OR event_id % 5 = 0 THEN 0 ELSE 3 END) AS BIGINT) AS fields
FROM events GROUP BY 1""")
def clean_corpus(spark, sf):
    parsed = materialize(co.parse_corpus(event_charts(spread_events(spark, sf))), "parsed")
    kept = co.clean_corpus(parsed, 25).select(F.lit("kept").alias("outcome"), F.size("fields").alias("w"))
    wide = co.wide_charts(parsed, 25).select(F.lit("too wide").alias("outcome"), F.lit(0).alias("w"))
    broken = parsed.where("reason is not null").select(F.col("reason").alias("outcome"), F.lit(0).alias("w"))
    return kept.unionByName(wide).unionByName(broken).groupBy("outcome").agg(
        F.count(F.lit(1)).alias("charts"), F.sum("w").alias("fields"))


@query("trace_type_counts", oracle=f"""
WITH {USABLE} SELECT trace_type, count(*) AS n FROM (
  SELECT {KIND_SQL} AS trace_type FROM ok UNION ALL SELECT 'bar' FROM ok) GROUP BY trace_type""")
def trace_type_counts(spark, sf):
    return lb.trace_type_counts(usable_charts(spark, sf))


OUTCOME_SQL = f"""WITH {USABLE}, m AS (SELECT unnest(['reference', 'own']) AS label_mode),
f AS (SELECT ok.*, m.label_mode, s.uid FROM ok, m, (SELECT unnest(['a', 'b', 'c']) AS uid) s)
SELECT label_mode, fid, u || ':' || uid AS field_id,
  CASE WHEN broken THEN CASE WHEN uid = 'c' THEN NULL ELSE kind END
    WHEN label_mode = 'own' AND uid = 'b' THEN kind ELSE 'bar' END AS trace_type,
  CASE WHEN NOT broken AND uid = 'a' THEN 'true' END AS is_xsrc,
  CASE WHEN NOT broken AND uid <> 'a' THEN 'true' END AS is_ysrc,
  CASE WHEN NOT broken AND uid = 'c' AND k % 3 = 0 THEN 'true' END AS is_zsrc,
  CASE WHEN NOT broken AND uid = 'a' THEN 'true' END AS is_single_xsrc,
  CAST(CASE WHEN NOT broken AND uid = 'a' THEN 2 END AS DOUBLE) AS num_xsrc,
  CAST(CASE WHEN NOT broken AND uid <> 'a' THEN 1 END AS DOUBLE) AS num_ysrc, broken AS has_unresolved FROM f"""


@query("field_outcomes", oracle=OUTCOME_SQL)
def field_outcomes(spark, sf):
    both = lb.field_outcomes(usable_charts(spark, sf), "both")
    modes = F.array(*[F.struct(F.lit(m).alias("label_mode"), F.col(c).alias("trace_type")) for m, c in (("reference", "trace_type"), ("own", "own_trace_type"))])
    out = both.withColumn("_mode", F.explode(modes)).drop("trace_type").select("*", "_mode.*")
    flags = [F.col(c).cast("string").alias(c) for c in ("is_xsrc", "is_ysrc", "is_zsrc", "is_single_xsrc")]
    return out.select("label_mode", "fid", "field_id", "trace_type", *flags,
                      F.col("num_xsrc").cast("double").alias("num_xsrc"),
                      F.col("num_ysrc").cast("double").alias("num_ysrc"), "has_unresolved")


@query("axis_roles", oracle=f"""
WITH {USABLE} SELECT role, axes, layout_axes, count(*) AS n FROM (
  SELECT CASE WHEN broken THEN NULL WHEN uid = 'a' THEN 'x' ELSE 'y' END AS role, 'x,x2' AS axes, 'xaxis/yaxis2' AS layout_axes
  FROM ok, (SELECT unnest(['a', 'b', 'c']) AS uid)) GROUP BY role, axes, layout_axes""")
def axis_roles(spark, sf):
    charts = usable_charts(spark, sf)
    roles = lb.field_outcomes(charts).select("fid", lb.axis_role(F.col("is_xsrc"), F.col("is_ysrc")).alias("role"))
    axes = lb.axis_inventory(charts).select(
        "fid", F.array_join("x_axes", ",").alias("axes"),
        F.concat_ws("/", F.array_join("x_layout_axes", ","), F.array_join("y_layout_axes", ",")).alias("layout_axes"))
    return roles.join(axes, "fid").groupBy("role", "axes", "layout_axes").agg(F.count(F.lit(1)).alias("n"))


@query("corpus_profile", oracle=f"""
WITH {USABLE}, f AS (SELECT fid, u || ':' || uid AS field_id, 'col ' || i AS field_name, i * value AS v, regexp_full_match(CAST(i * value AS VARCHAR), '(0|-?[1-9][0-9]*)') AS whole,
  CASE WHEN broken THEN CASE WHEN uid = 'c' THEN NULL ELSE kind END ELSE 'bar' END AS trace_type
  FROM ok, (SELECT 'a' AS uid, 1 AS i UNION ALL SELECT 'b', 2 UNION ALL SELECT 'c', 3))
SELECT fid, field_id, field_name, CAST(2 AS BIGINT) AS length, CASE WHEN whole THEN 'integer' ELSE 'string' END AS data_type, trace_type FROM f""")
def corpus_profile(spark, sf):
    charts = usable_charts(spark, sf)
    basics = pr.field_basics(pr.raw_histogram(co.corpus_cells(charts)))
    labels = lb.field_outcomes(charts).select("fid", "field_id", "trace_type")
    return basics.join(labels, ["fid", "field_id"]).select(
        "fid", "field_id", "field_name", "length", "data_type", "trace_type")


@query("features_join_labels", oracle=f"""
WITH {USABLE}, o AS (SELECT 'u' || user_id || ':' || uid AS field_id, fid, kind, broken, uid FROM ok, (SELECT unnest(['a', 'b', 'c']) AS uid)),
d AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY field_id ORDER BY fid) = 1),
t AS (SELECT *, CASE WHEN broken THEN CASE WHEN uid = 'c' THEN NULL ELSE kind END ELSE 'bar' END AS trace_type FROM d)
SELECT field_id, fid, trace_type, CAST(2 AS BIGINT) AS length, TRUE AS "exists",
  CASE trace_type WHEN 'bar' THEN 0 WHEN 'box' THEN 1 WHEN 'heatmap' THEN 2 WHEN 'histogram' THEN 3 WHEN 'line' THEN 4 WHEN 'scatter' THEN 5 END AS trace_type_n
FROM t WHERE trace_type IN ('bar', 'box', 'heatmap', 'histogram', 'line', 'scatter')""")
def features_join_labels(spark, sf):
    charts = usable_charts(spark, sf)
    features = pr.field_basics(pr.raw_histogram(co.corpus_cells(charts))).select("fid", "field_id", "length", "exists")
    outcomes = lb.field_outcomes(charts).select("fid", "field_id", "trace_type")
    return rl.known_traces(rl.labeled_features(features, outcomes))


NESTED = ('{"meta":{"id":%s,"tags":[{"k":"first"},{"note":null}]},"props":%s,'
          '"text":"{\\"deep\\":1}","tail":{"list":[1,[{"deep":{"v":%s}}]],"note":"n"}}')


@query("nested_key_find", oracle="""
SELECT event_id, 'first' AS k, '{"v":' || user_id || '}' AS deep, NULL AS note, 'n' AS note_found,
  CAST(event_id AS VARCHAR) AS id FROM events""")
def nested_key_find(spark, sf):
    parts = NESTED.split("%s")
    text = F.concat(F.lit(parts[0]), F.col("event_id").cast("string"), F.lit(parts[1]), "props",
                    F.lit(parts[2]), F.col("user_id").cast("string"), F.lit(parts[3]))
    docs = events(spark, sf).select("event_id", text.alias("doc"))
    return js.find_keys(docs, "doc", ["id", "k", "deep", "note"], suffix="_found").select(
        "event_id", "id", "k", "deep", "note", "note_found")


@query("tsv_corpus_scan", oracle="""
SELECT 'u' || user_id || ':' || event_id AS fid,
  CASE WHEN event_id % 17 = 0 THEN 'unparsable' WHEN event_id % 13 = 0 THEN 'empty' END AS reason FROM events""")
def tsv_corpus_scan(spark, sf):
    path = scratch_path(spark, "corpus_tsv")
    co.write_corpus_tsv(event_charts(spread_events(spark, sf)), path)
    return co.parse_corpus(co.read_corpus_tsv(spark, path)).select("fid", "reason")


EVENTS_PER_FILE = 20_000


@query("json_map_scan", oracle="""
SELECT user_id || '-' || event_type AS id, event_type AS chart, count(*) AS points, round(sum(value), 3) AS total FROM events GROUP BY 1, 2""")
def json_map_scan(spark, sf):
    # One JSON object of some thousand events per file, written as one line each; keys carry the event. A file per
    # user and type would make as many files as there are users.
    ev = table(spark, sf, "events").withColumn("id", F.concat_ws("-", F.col("user_id").cast("string"), "event_type"))
    case = F.struct(F.col("event_type").alias("chart"), "value", "id")
    entry = F.struct(F.concat_ws("-", "id", F.col("event_id").cast("string")).alias("key"), case.alias("value"))
    files = max(16, -(-ev.count() // EVENTS_PER_FILE))
    docs = (ev.groupBy(F.pmod(F.xxhash64("event_id"), F.lit(files)).alias("part"))
            .agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")))
    path = scratch_path(spark, "keyed_json")
    docs.select("value").write.option("maxRecordsPerFile", 1).text(path)
    keyed = co.read_keyed_json(spark, path)
    lines = keyed.select(F.get_json_object("value", "$.id").alias("id"), "value")
    target = scratch_path(spark, "json_lines")
    co.write_json_lines(lines, target)
    rows = co.read_json_lines(spark, target)
    case = F.from_json("value", "struct<chart:string,value:double>")
    out = rows.groupBy("id", case["chart"].alias("chart")).agg(
        F.count(F.lit(1)).alias("points"), F.sum(case["value"]).alias("total"))
    return rounded(out, 3)


@query("role_arrays_to_cells", oracle="""
WITH r AS (SELECT o_orderkey AS fid, [[o_orderpriority, o_orderstatus], [CAST(o_custkey AS VARCHAR)]] AS x, [[CAST(o_orderkey AS VARCHAR), o_orderstatus]] AS y FROM orders)
SELECT fid, fid || '0' AS field_id, 0 AS ord, 'x' AS is_x_or_y, 0 AS pos, x[1][1] AS raw FROM r
UNION ALL SELECT fid, fid || '0', 0, 'x', 1, x[1][2] FROM r UNION ALL SELECT fid, fid || '1', 1, 'x', 0, x[2][1] FROM r
UNION ALL SELECT fid, fid || '2', 2, 'y', 0, y[1][1] FROM r UNION ALL SELECT fid, fid || '2', 2, 'y', 1, y[1][2] FROM r""")
def role_arrays_to_cells(spark, sf):
    o = table(spark, sf, "orders")
    rows = o.select(
        F.col("o_orderkey").alias("id"),
        F.array(F.array("o_orderpriority", "o_orderstatus"), F.array(F.col("o_custkey").cast("string"))).alias("x_data"),
        F.array(F.array(F.col("o_orderkey").cast("string"), "o_orderstatus")).alias("y_data"))
    return role_array_cells(rows).select("fid", "field_id", "ord", "is_x_or_y", "pos", "raw")


DATABASE = {"geo": {"nation": ("n_nationkey", ["n_nationkey", "n_name", "n_regionkey"]), "region": ("r_regionkey", ["r_regionkey", "r_name"])},
            "sales": {"customer": ("c_custkey", ["c_custkey", "c_name", "c_mktsegment"])}}


@query("csv_database_catalog", oracle=" UNION ALL ".join(
    f"SELECT '{db}' AS db_id, '{t}' AS table_name, '{c}' AS column_name, '{'string' if c.endswith(('name', 'segment')) else 'integer'}' AS data_type, "
    f"(SELECT CAST({c} AS VARCHAR) FROM {t} ORDER BY {key} LIMIT 1) AS example, count(*) AS cells, CAST(count(*) - 1 AS BIGINT) AS last_pos FROM {t}"
    for db, tables in DATABASE.items() for t, (key, cols) in tables.items() for c in cols))
def csv_database_catalog(spark, sf):
    root = scratch_path(spark, "database")
    for db, tables in DATABASE.items():
        for name, (key, cols) in tables.items():
            sinks.write_csv(table(spark, sf, name).select(*cols).orderBy(key), f"{root}/{db}/{name}.csv")
    cells = co.read_database_cells(spark, root)
    sizes = cells.groupBy("db_id", "fid", "field_name").agg(F.count(F.lit(1)).alias("cells"), F.max("pos").alias("last_pos"))
    shown = pt.column_examples(cells.withColumn("fid", F.concat_ws("/", "db_id", "fid")))
    shown = shown.select(F.substring_index("fid", "/", 1).alias("db_id"), F.substring_index("fid", "/", -1).alias("fid"), "field_name", "data_type", "example")
    return sizes.join(shown, ["db_id", "fid", "field_name"]).select(
        "db_id", F.col("fid").alias("table_name"), F.col("field_name").alias("column_name"), "data_type", "example", "cells", "last_pos")


TRAIN_EDGE = round(0.7 * (1 << 32))


@query("corpus_training_table", oracle=f"""
WITH {USABLE}, o AS (SELECT 'u' || user_id || ':' || uid AS field_id, fid, kind, broken, uid, i, value FROM ok, (SELECT 'a' AS uid, 1 AS i UNION ALL SELECT 'b', 2 UNION ALL SELECT 'c', 3)),
d AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY field_id ORDER BY fid) = 1),
t AS (SELECT *, CASE WHEN broken THEN CASE WHEN uid = 'c' THEN NULL ELSE kind END ELSE 'bar' END AS trace_type,
  CASE WHEN regexp_full_match(CAST(i * value AS VARCHAR), '(0|-?[1-9][0-9]*)') THEN i * value END AS m FROM d),
k AS (SELECT *, CASE WHEN ('0x' || substr(md5('train' || fid), 1, 8))::BIGINT < {TRAIN_EDGE} THEN 'train' ELSE 'test' END AS split FROM t
  WHERE trace_type IN ('bar', 'box', 'heatmap', 'histogram', 'line', 'scatter')),
b AS (SELECT coalesce(quantile_cont(m, 0.05), 0.0) AS lo, coalesce(quantile_cont(m, 0.95), 1.0) AS hi FROM k WHERE split = 'train')
SELECT split, trace_type, CASE WHEN broken THEN NULL WHEN uid = 'a' THEN 'x' ELSE 'y' END AS is_x_or_y, count(*) AS fields, CAST(sum(2) AS BIGINT) AS cells,
  CAST(count_if(m IS NOT NULL) AS BIGINT) AS whole, round(sum(CASE WHEN m BETWEEN lo AND hi THEN m WHEN m < lo THEN lo ELSE hi END), 4) AS mean_sum FROM k, b GROUP BY ALL""")
def corpus_training_table(spark, sf):
    features, outcomes = flows.corpus_features(event_charts(spread_events(spark, sf)), 25)
    train, test, _ = flows.prepare_training(features, outcomes, ["mean"], "train")
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return rounded(both.groupBy("split", "trace_type", "is_x_or_y").agg(
        F.count(F.lit(1)).alias("fields"), F.sum("length").alias("cells"), F.count_if("data_type_is_integer").alias("whole"), F.sum("mean").alias("mean_sum")), 4)


@query("score_unlabeled", oracle="""
SELECT f AS field_id, TRUE AS known, TRUE AS confident FROM (SELECT unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) AS f)""")
def score_unlabeled(spark, sf):
    inputs = ["length", "mean", "data_type_is_string"]
    features, outcomes = flows.corpus_features(event_charts(spread_events(spark, sf)), 25)
    train, _, bounds = flows.prepare_training(features, outcomes, ["length", "mean"], "train")
    path = scratch_path(spark, "bounds")
    prep.save_parameters(bounds, path)
    numbers = train.withColumn("data_type_is_string", F.col("data_type_is_string").cast("double"))
    model = ml.train_type_model(numbers, inputs)
    part = table(spark, sf, "part")
    scored = flows.score_tables(table_cells(part, part.columns, "p_partkey", "part"), model, prep.load_parameters(spark, path), inputs)
    return scored.select("field_id", F.col("predicted_trace_type").isin(*rl.TRACE_CODES).alias("known"),
                         ((F.col("top1_prob") >= F.col("top2_prob")) & F.col("confidence").between(0, 1)).alias("confident"))


@query("catalog_scan", oracle="""
SELECT 'demo' AS db_id, 'nation' AS "table", count(*) AS "rows" FROM nation UNION ALL SELECT 'demo', 'region', count(*) FROM region
UNION ALL SELECT 'sales', 'customer', count(*) FROM customer""")
def catalog_scan(spark, sf):
    root = scratch_path(spark, "databases")
    for db, name in (("demo", "nation"), ("demo", "region"), ("sales", "customer")):
        sinks.write_csv(table(spark, sf, name), f"{root}/{db}/{name}.csv")
    files = co.csv_catalog(spark, root)
    # A table written by Spark is a folder of files; count its rows from one scan of all.
    rows = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(root)
            .select(F.col("_metadata.file_path").alias("path"), "value"))
    data = rows.where(~F.col("value").rlike("^[nrc]_[a-z]+key,"))
    listed = files.select("db_id", "table", F.regexp_replace("path", "^file:/*", "/").alias("path"))
    counted = data.groupBy(F.regexp_replace("path", "^file:/*", "/").alias("path")).agg(F.count(F.lit(1)).alias("rows"))
    return listed.join(counted, "path").groupBy("db_id", "table").agg(F.sum("rows").alias("rows"))


@query("table_to_cells", oracle="""
SELECT field_id, CAST(ord AS INTEGER) AS ord, count(*) AS cells, min(pos) AS first_pos, max(raw) AS last_raw FROM (
  SELECT 'n_name' AS field_id, 0 AS ord, n_nationkey AS pos, n_name AS raw FROM nation
  UNION ALL SELECT 'n_regionkey', 1, n_nationkey, CAST(n_regionkey AS VARCHAR) FROM nation
  UNION ALL SELECT 'c_mktsegment', 0, c_custkey, c_mktsegment FROM customer) GROUP BY field_id, ord""")
def table_to_cells(spark, sf):
    path = scratch_path(spark, "nation_csv")
    sinks.write_csv(table(spark, sf, "nation"), path)
    a = table_cells(co.read_csv_table(spark, path), ["n_name", "n_regionkey"], "n_nationkey", "nation")
    b = table_cells(table(spark, sf, "customer"), ["c_mktsegment"], "c_custkey", "customer")
    return a.unionByName(b).groupBy("field_id", "ord").agg(
        F.count(F.lit(1)).alias("cells"), F.min("pos").alias("first_pos"), F.max("raw").alias("last_raw"))


DATE_SHAPES = ["yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy HH:mm:ss", "dd MMM yyyy", "yyyy/MM/dd", "dd-MM-yy"]


@query("date_parse", oracle="""
SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 7 = 6 THEN NULL ELSE o_orderdate END AS VARCHAR) AS parsed,
  TRUE AS is_time_text FROM orders""")
def date_parse(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("d"))
    shape = F.pmod("o_orderkey", F.lit(7))
    text = F.lit("31-31-31")
    for i, fmt in enumerate(DATE_SHAPES):
        text = F.when(shape == i, F.date_format("d", fmt)).otherwise(text)
    rows = o.select("o_orderkey", text.alias("raw"))
    return rows.select("o_orderkey", ty.parse_timestamp(F.col("raw")).cast("string").alias("parsed"),
                       ty.is_time_text(F.col("raw")).alias("is_time_text"))


@query("typed_parse", oracle="""
WITH c AS (SELECT o_orderkey, o_orderkey % 5 AS m FROM orders)
SELECT o_orderkey, CAST(CASE m WHEN 0 THEN o_orderkey WHEN 4 THEN o_orderkey END AS DOUBLE) AS as_integer,
  CASE m WHEN 0 THEN CAST(o_orderkey AS DOUBLE) WHEN 1 THEN o_orderkey + 0.5 WHEN 2 THEN o_orderkey * 1000.0 WHEN 4 THEN CAST(o_orderkey AS DOUBLE) END AS as_decimal,
  m = 0 AS integer_text, m <> 3 AS decimal_text FROM c""")
def typed_parse(spark, sf):
    key = F.col("o_orderkey").cast("string")
    m = F.pmod("o_orderkey", F.lit(5))
    raw = (F.when(m == 0, key).when(m == 1, F.concat(key, F.lit(".5"))).when(m == 2, F.concat(key, F.lit("e3")))
           .when(m == 3, F.concat(F.lit("n"), key)).otherwise(F.concat(F.lit(" +"), key, F.lit(" "))))
    rows = table(spark, sf, "orders").select("o_orderkey", raw.alias("raw"))
    c = F.col("raw")
    return rows.select("o_orderkey", ty.parse_integer(c).alias("as_integer"), ty.parse_decimal(c).alias("as_decimal"),
                       ty.is_integer_text(c).alias("integer_text"), ty.is_decimal_text(c).alias("decimal_text"))
