"""Labels, preparation, sampling, evaluation, sources, sinks and models on literal rows."""

import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from colscope.operators import charts as ch
from colscope.operators import evaluate as ev
from colscope.operators import labels as lb
from colscope.operators import models as ml
from colscope.operators import prep
from colscope.operators import profile as pr
from colscope.operators import prompts as pt
from colscope.operators import relational as rl
from colscope.operators import sampling as sm
from colscope.plans import flows
from colscope.sources import cells as ce
from colscope.sources import corpus as co
from colscope.sources import sinks
from colscope.streaming.intake import intake_corpus


def chart(fid, traces, uids=("a", "b", "c"), layout=None):
    table = {"t": {"cols": {f"col {u}": {"uid": u, "order": i, "data": [i, "x", None]} for i, u in enumerate(uids)}},
             "second": {"cols": {}}}
    return (fid, json.dumps(traces), json.dumps(layout or {}), json.dumps(table))


TRACES = [{"type": "scatter", "mode": "lines", "xsrc": "u:9:a", "ysrc": "u:9:b"}, {"type": "bar", "xsrc": "u:9:a", "ysrc": "u:9:c"}]
CHARTS = [
    chart("u:1", TRACES, layout={"xaxis": {}, "yaxis2": {}, "title": ""}),
    chart("u:2", [TRACES[0], {"type": "bar", "xsrc": "u:9:zz"}]),
    chart("u:3", [{"type": "scatter", "marker": {"line": {"color": "red"}}, "xsrc": "u:9:a"},
                  {"type": "scatter", "marker": {"line": {"color": "transparent"}}, "xsrc": "u:9:b"},
                  {"type": "scatter", "marker": {"line": {}}, "line": {}, "zsrc": "u:9:c"}, {"xsrc": "u:9:c"}]),
    ("u:4", "[{", "{}", "{}"), ("u:5", "[]", "{}", '{"t":{"cols":{}}}'), chart("u:6", TRACES, [str(i) for i in range(26)]),
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(CHARTS, co.CORPUS_SCHEMA)


@pytest.fixture(scope="module")
def charts(raw):
    return co.clean_corpus(co.parse_corpus(raw))


def test_cleaning(raw, charts):
    reasons = {r["fid"]: r["reason"] for r in co.parse_corpus(raw).collect()}
    assert reasons == {"u:1": None, "u:2": None, "u:3": None, "u:4": "unparsable", "u:5": "empty", "u:6": None}
    assert {r["fid"] for r in charts.collect()} == {"u:1", "u:2", "u:3", "u:6"}
    parsed = co.parse_corpus(raw)
    assert {r["fid"] for r in co.clean_corpus(parsed, 25).collect()} == {"u:1", "u:2", "u:3"}
    assert [(r["fid"], r["n_fields"]) for r in co.wide_charts(parsed, 25).collect()] == [("u:6", 26)]
    cells = co.corpus_cells(charts).where("fid = 'u:1' and ord = 1").orderBy("pos").collect()
    assert [(c["field_id"], c["field_name"], c["raw"]) for c in cells] == [("u:b", "col b", "1"), ("u:b", "col b", "x"), ("u:b", "col b", None)]


def test_outcomes(charts):
    ref = {(r["fid"], r["field_id"]): r for r in lb.field_outcomes(charts).collect()}
    own = {(r["fid"], r["field_id"]): r for r in lb.field_outcomes(charts, "own").collect()}
    kinds = lambda rows, fid: [rows[(fid, f"u:{u}")]["trace_type"] for u in "abc"]
    assert kinds(ref, "u:1") == ["bar", "bar", "bar"] and kinds(own, "u:1") == ["bar", "line", "bar"]
    a = ref[("u:1", "u:a")]
    assert (a["is_xsrc"], a["num_xsrc"], a["is_single_xsrc"], a["is_ysrc"], a["num_ysrc"]) == (True, 2, True, None, None)
    b = ref[("u:1", "u:b")]
    assert (b["is_xsrc"], b["is_ysrc"], b["num_ysrc"], b["is_single_ysrc"]) == (None, True, 1, None)
    broken = ref[("u:2", "u:a")]
    assert broken["has_unresolved"] and broken["is_xsrc"] is None and broken["trace_type"] == "line"
    assert kinds(ref, "u:3") == [None, None, None] and kinds(own, "u:3") == ["line", "scatter", None]
    assert ref[("u:3", "u:c")]["num_zsrc"] == 1
    with pytest.raises(ValueError):
        lb.field_outcomes(charts, "other")


def test_axes_and_roles(spark, charts):
    axes = {r["fid"]: r for r in lb.axis_inventory(charts).collect()}
    assert axes["u:1"]["x_layout_axes"] == ["xaxis"] and axes["u:1"]["y_layout_axes"] == ["yaxis2"]
    df = spark.createDataFrame([(True, None), (None, True), (True, True), (None, None)], "x boolean, y boolean")
    assert [r[0] for r in df.select(lb.axis_role(F.col("x"), F.col("y"))).collect()] == ["x", "y", None, None]


def test_clip_values(spark):
    df = spark.createDataFrame([(math.nan,), (None,), (math.inf,), (-math.inf,), (2.0,)], "x double")
    assert [r[0] for r in df.select(prep.clip(F.col("x"), 1.0, 3.0)).collect()] == [3.0, 3.0, 3.0, 1.0, 2.0]


def test_bounds_and_scales(spark):
    v = np.random.default_rng(2).normal(size=500)
    df = spark.createDataFrame([(float(x), None, 7.0) for x in v] + [(math.nan, None, 7.0)], "a double, b double, c double")
    bounds = {r["feature"]: (r["lo"], r["hi"]) for r in prep.fit_bounds(df, ["a", "b", "c"]).collect()}
    assert bounds["a"] == pytest.approx(tuple(np.quantile(v, [0.05, 0.95]))) and bounds["b"] == (0.0, 1.0)
    scales = {r["feature"]: (r["mean"], r["std"]) for r in prep.fit_scales(df.where("not isnan(a)"), ["a", "c"]).collect()}
    assert scales["a"] == pytest.approx((v.mean(), v.std())) and scales["c"] == (7.0, 1.0)


def test_splits_are_disjoint_and_complete(spark):
    df = spark.range(3000).withColumn("fid", F.col("id") % 300)
    marked = sm.assign_split(df, "fid", {"train": 0.7, "val": 0.15, "test": 0.15}, "x")
    assert marked.groupBy("fid").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    parts = sm.row_split(df, [0.7, 0.3], "id", "y")
    assert sum(p.count() for p in parts) == 3000
    assert parts[0].join(parts[1], "id").count() == 0


def test_samples(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") % 10 < 7, "hot").otherwise(F.col("id").cast("string")))
    for method in ("random", "systematic", "stratified"):
        drawn = sm.sample_examples(df, 60, "id", method, "g", "s")
        assert drawn.count() == drawn.select("id").distinct().count() == 60, method
    strat = sm.stratified_sample(df, 60, "g", "id", "s").where("g = 'hot'").count()
    assert strat >= 42
    ids = [r["id"] for r in sm.systematic_sample(df, 10, "id", start=3).orderBy("id").collect()]
    assert ids == [3 + 100 * i for i in range(10)]
    assert sm.sample_examples(df, None, "id").count() == 1000
    assert sm.sample_examples(df, 5, "id", "unknown").count() == 1000
    assert sm.sample_examples(df, 2000, "id", "systematic").count() == 1000


def test_stratified_keeps_null_stratum(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(100)], "id int, g string")
    rows = sm.stratified_sample(df, 20, "g", "id").collect()
    assert len(rows) == 20 and sum(r["g"] is None for r in rows) == 10


def test_keep_first_and_labels(spark):
    df = spark.createDataFrame([("a", 3, None), ("a", 1, "x"), ("b", 2, "y")], "k string, o int, v string")
    assert sorted(map(tuple, rl.keep_first(df, ["k"], "o").collect())) == [("a", 1, "x"), ("b", 2, "y")]
    mapping = prep.fit_labels(df, "v")
    coded = prep.encode_labels(spark.createDataFrame([("y",), ("q",), (None,)], "v string"), "v", mapping)
    assert sorted((r["v"] or "", r["v_n"]) for r in coded.collect()) == [("", -1), ("q", -1), ("y", 1)]
    hot = prep.one_hot_by(coded, "v_n", mapping, "h").collect()
    assert sorted(tuple(r["h"]) for r in hot) == [(0.0, 0.0), (0.0, 0.0), (0.0, 1.0)]


def test_long_sequences_continue_in_segments(spark):
    df = spark.createDataFrame([("long", i, float(i)) for i in range(60)] + [("short", i, float(i)) for i in range(3)], "k string, o int, x double")
    seqs = prep.pad_sequences(prep.field_sequences(df, "k", "o", ["x", "o"]))
    rows = {(r["k"], r["segment"]): r for r in seqs.collect()}
    assert sorted(rows) == [("long", 0), ("long", 1), ("long", 2), ("short", 0)]
    assert [v[0] for s in range(3) for v in rows[("long", s)]["x"][:rows[("long", s)]["n_valid"]]] == list(range(60))
    short = rows[("short", 0)]
    assert len(short["x"]) == len(short["mask"]) == 25 and sum(short["mask"]) == 3 and short["x"][3] == [0.0, 0.0]


RANKS = [(["Bar", "Pie", "Line"], "Bar", ("success", True, True, 1)), (["Bar", "Pie", "Line"], "Pie", ("success", False, True, 2)),
         (["Bar", "Pie", "Line"], "Scatter", ("success", False, False, 4)), ([], "Bar", ("error", None, None, None)),
         (["Bar"], "Pie", ("success", False, False, 2))]


def test_rank_cases(spark):
    df = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(RANKS)], "i int, predicted array<string>, expected string")
    ranked = ev.rank_cases(df)
    rows = ranked.orderBy("i").collect()
    assert [(r["status"], r["correct"], r["correct_hit2"], r["rank"]) for r in rows] == [w for _, _, w in RANKS]
    s = ev.rank_summary(ranked).first()
    assert (s["total_cases"], s["success_cases"], s["total_rank"]) == (5, 4, 9) and s["mean_rank"] == pytest.approx(9 / 4)
    failed = ev.rank_summary(ev.rank_cases(df, succeeded=F.col("i") != 1)).first()
    assert (failed["success_cases"], failed["total_rank"]) == (3, 9)


def test_recall(spark):
    df = spark.createDataFrame([(["Orders.csv"], ["orders"], {"Orders.CSV": ["A", "b"]}, {"orders": ["a"]}),
                                (["x"], ["orders"], {"x": ["a"]}, {"orders": ["a"]}), ([], [], {}, {})],
                               "p array<string>, t array<string>, pc map<string,array<string>>, tc map<string,array<string>>")
    rows = df.select(rl.table_recall(F.col("p"), F.col("t")), rl.column_recall(F.col("pc"), F.col("tc"))).collect()
    assert [tuple(r) for r in rows] == [(True, True), (False, False), (True, True)]


def test_reevaluation_errors_keep_the_old_verdict(spark):
    results = spark.createDataFrame([("1", [["1"]], [[None]], True), ("2", [["Mon"]], [["1"]], False)],
                                    "data_id string, expected array<array<string>>, predicted array<array<string>>, correct boolean")
    dataset = spark.createDataFrame([("1", None, None, None)], "id string, x_data array<array<string>>, y_data array<array<string>>, classify array<string>")
    rows = {r["data_id"]: r for r in ev.reevaluate(results, dataset).collect()}
    assert rows["1"]["new_correct"] is True and rows["2"]["new_correct"] is True


def test_corpus_files(spark, raw, tmp_path):
    path = str(tmp_path / "corpus")
    co.write_corpus_tsv(raw, path)
    assert sorted(map(tuple, co.read_corpus_tsv(spark, path).collect())) == sorted(CHARTS)
    keyed = tmp_path / "keyed.json"
    keyed.write_text(json.dumps({"b": {"chart": "Bar", "nl_queries": ["q"], "vis_obj": {"x_data": [["m"]], "y_data": [[1, 2.5]], "classify": []},
                                       "vis_query": {"data_part": {"sql_part": "s"}}}, "a": {"chart": "Pie"}}))
    cases = {r["id"]: r for r in co.case_rows(co.read_keyed_json(spark, str(keyed))).collect()}
    assert cases["b"]["vis_obj"]["y_data"] == [["1", "2.5"]] and cases["a"]["chart"] == "Pie"
    report = tmp_path / "results_batch_1.json"
    report.write_text(json.dumps({"batch_results": [{"data_id": "1", "status": "success", "correct": True, "input": {"hardness": "Easy"}}]}, indent=2))
    (tmp_path / "results_batch_2.json").write_text("{broken")
    rows = co.read_batch_reports(spark, str(tmp_path / "results_batch_*.json")).collect()
    assert [(r["file_name"], r["input"]["hardness"]) for r in rows] == [("results_batch_1.json", "Easy")]


def test_catalog(spark, tmp_path):
    for db, name in (("d1", "x"), ("d1", "y"), ("d2", "x")):
        os.makedirs(tmp_path / db, exist_ok=True)
        (tmp_path / db / f"{name}.csv").write_text("a,b\n1,2\n")
    rows = {(r["db_id"], r["table"]) for r in co.csv_catalog(spark, str(tmp_path)).collect()}
    assert rows == {("d1", "x"), ("d1", "y"), ("d2", "x")}
    listed = co.database_tables(spark.createDataFrame([("d1", ["x"])], "db_id string, tables array<string>"), "/r").first()
    assert listed["path"] == "/r/d1/x.csv"


def test_intake_takes_each_file_once(spark, raw, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    step = lambda df: co.corpus_cells(co.clean_corpus(co.parse_corpus(df)))
    co.write_corpus_tsv(raw.where("fid in ('u:1', 'u:4')").coalesce(1), source)
    intake_corpus(spark, source, target, state, step, 1)
    first = spark.read.parquet(target).count()
    co.write_corpus_tsv(raw.where("fid = 'u:2'").coalesce(1), source, "append")
    intake_corpus(spark, source, target, state, step, 1)
    intake_corpus(spark, source, target, state, step, 1)
    assert first == 9 and spark.read.parquet(target).count() == 18


def test_json_safe_reports(spark, tmp_path):
    df = spark.sql("select 1 a, binary('hi') b, date'2024-01-02' d, array(struct(timestamp'2024-01-02 03:04:05' t)) l, map(1, double('nan')) m, null n")
    text = json.loads(sinks.report_json(df).first()[0])
    assert text["b"] == "aGk=" and text["d"] == "2024-01-02" and text["l"][0]["t"].startswith("2024-01-02T03:04:05") and text["m"] == {"1": "NaN"}


def test_chart_data(spark):
    df = spark.sql("""select * from values (timestamp'2024-01-03', 'a', 1.0D), (timestamp'2024-03-01', 'a', 5.0D),
                      (timestamp'2025-01-09', 'b', null), (null, 'b', 2.0D) as t(d, g, v)""")
    rows = [(r["x"], r["y"]) for r in ch.sort_chart(ch.chart_data(df, "d", "v", "sum", "month", fill=0.0), None).orderBy("ord").collect()]
    assert rows == [("Jan", 1.0), ("Mar", 5.0)]
    desc = ch.sort_chart(ch.chart_data(df, "d", bin="year"), "x_desc").orderBy("ord").collect()
    assert [(r["x"], r["y"]) for r in desc] == [("2025", 1), ("2024", 2)]
    assert ch.chart_data(df, "d", "v", "max", "weekday", "g").count() == 2
    lists = ch.chart_lists(ch.sort_chart(ch.chart_data(df, "g"), "y_desc")).first()
    assert lists["x_data"] == ["a", "b"] and lists["y_data"] == [2, 2]
    with pytest.raises(ValueError):
        ch.chart_data(df, "d", bin="hour")


def test_schema_catalog_skips_empty_columns(spark):
    rows = [("t.csv", "a", "a", 0, 0, None), ("t.csv", "a", "a", 0, 1, "1.5"), ("t.csv", "b", "b", 1, 0, None), ("t.csv", "b", "b", 1, 7, "late"),
            ("u.csv", "c", "c", 0, 0, "2024-01-01")]
    cells = spark.createDataFrame(rows, "fid string, field_id string, field_name string, ord int, pos bigint, raw string")
    out = {r["fid"]: json.loads(r["schema_json"]) for r in pt.schema_catalog(cells).collect()}
    assert out["t.csv"]["columns"] == [{"name": "a", "data_type": "float", "example": "1.5"}]
    assert [r["fid"] for r in pt.schema_catalog(cells, ["u"]).collect()] == ["u.csv"]


def test_pairs_of_columns(spark):
    rows = [("a", 0.0), ("a", 10.0), ("b", 5.0), ("b", 25.0), ("c", 30.0), ("c", 31.0), ("d", 2.0), ("d", 3.0)]
    df = spark.createDataFrame([("t", f, v) for f, v in rows], "fid string, field_id string, v double")
    got = {(r["field_a"], r["field_b"]): (r["has_overlap"], r["overlap_percent"]) for r in pr.range_overlap(df, ["fid"]).collect()}
    assert got[("a", "b")] == (True, 0.5) and got[("a", "c")] == (False, 0.0) and got[("a", "d")] == (True, 1.0)


def test_unpivot_order(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "k int, a string, b double")
    rows = ce.table_cells(df, ["a", "b"], "k").orderBy("ord").collect()
    assert [(r["field_id"], r["ord"], r["pos"], r["raw"]) for r in rows] == [("a", 0, 1, "x"), ("b", 1, 1, "2.0")]


def test_corpus_to_training_flow(spark, raw):
    train, test, bounds = flows.training_tables(raw, ["length", "num_none"], seed="s")
    rows = train.unionByName(test)
    assert sorted((r["fid"], r["field_id"], r["trace_type"]) for r in rows.collect()) == [("u:1", f"u:{u}", "bar") for u in "abc"]
    assert {"is_x_or_y", "trace_type_n", "is_normal_5"} <= set(rows.columns)
    assert bounds.count() == 2


def test_models(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(float(rng.normal(c * 3)), float(rng.normal()), ["bar", "line", "scatter"][c], "x" if c else "y") for c in range(3) for _ in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, trace_type string, is_x_or_y string")
    for model in (ml.train_type_model(df, ["a", "b"], trees=10), ml.train_boosted_type_model(df, ["a", "b"], trees=3)):
        m = ml.evaluate_model(model, df).first()
        assert m["acc"] > 0.8 and 1 <= m["MR"] < 1.4 and m["hit_at_2"] >= m["hit_at_1"] == m["acc"]
    p = ml.predict(ml.train_axis_model(df, ["a", "b"], trees=5), df).first()
    assert p["predicted_trace_type"] in ("x", "y") and p["top1_prob"] >= p["top2_prob"]
    assert ml.top_importances(ml.importances(spark, ml.train_type_model(df, ["a", "b"], trees=5), ["a", "b"]), 1).first()["feature"] == "a"


def test_null_labels_can_be_a_class(spark):
    df = spark.createDataFrame([("x",), (None,), ("a",)], "v string")
    assert {r["label"]: r["idx"] for r in prep.fit_labels(df, "v", "nan").collect()} == {"a": 0, "nan": 1, "x": 2}
    wide = prep.one_hot_columns(df, "v", ["a", "x"]).collect()
    assert [(r["v_a"], r["v_x"]) for r in wide] == [(0.0, 1.0), (0.0, 0.0), (1.0, 0.0)]


def test_features_and_labels_split(spark):
    df = spark.createDataFrame([("f", "i", True, None, 1, "x", "bar", 2.0)],
                               "fid string, field_id string, is_xsrc boolean, is_ysrc boolean, trace_type_n int, is_x_or_y string, trace_type string, mean double")
    x, y = co.split_features_labels(df)
    assert x.columns == ["mean"] and set(y.columns) == {"fid", "field_id", "is_x_or_y", "trace_type"}
    assert co.split_features_labels(df, "predict")[1] is None
    with pytest.raises(ValueError):
        co.split_features_labels(df, "other")


def test_stage_and_batch_flow(spark, tmp_path):
    (tmp_path / "t.tpl").write_text("Ask {QUESTION} now")
    assert pt.read_template(spark, str(tmp_path / "t.tpl")) == "Ask {QUESTION} now"
    requests = spark.createDataFrame([(i, "db", f"pie of {i}", None, ["x"], "S") for i in range(6)],
                                     "id int, db_id string, query string, describe string, irrelevant_tables array<string>, schema_info string")

    def model(prompt):
        return {"content": '```json\n{"table_names": ["Orders.csv"]}\n```', "tokens": 7, "model": "m"}

    runs = flows.run_stage(requests, "table_selection", model)
    assert runs.where("valid").count() == 6
    tables = F.from_json("data", "struct<table_names:array<string>>")["table_names"]
    cases = runs.select(
        F.lit("r").alias("run_id"), F.col("id").alias("test_case_id"), F.lit(None).cast("string").alias("sort"), "tokens",
        F.array(F.array(F.lit("1"))).alias("expected"), F.array(F.array(F.when(F.col("id") < 4, "1.0").otherwise("2"))).alias("predicted"),
        tables.alias("predicted_tables"), F.array(F.lit("orders")).alias("tables"),
        F.create_map(F.lit("orders"), F.array(F.lit("a"))).alias("predicted_columns"), F.create_map(F.lit("orders"), F.array(F.lit("b"))).alias("columns"))
    judged, chunks, total = flows.evaluate_batch(cases, interval=4)
    assert judged.count() == 6
    assert sorted((r["chunk_number"], r["total_cases"], r["final_correct_cases"]) for r in chunks.collect()) == [(1, 4, 4), (2, 2, 0)]
    t = total.first()
    assert (t["final_correct_cases"], t["table_correct_cases"], t["column_correct_cases"], t["total_tokens"]) == (4, 6, 0, 42)


def test_scoring_new_columns(spark):
    cells = spark.createDataFrame([("u:1", f"u:{c}", c, i, p, v) for i, (c, vs) in enumerate({"a": ["1", "2", "9"], "b": ["x", "y", "z"]}.items())
                                   for p, v in enumerate(vs)], "fid string, field_id string, field_name string, ord int, pos bigint, raw string")
    train = spark.createDataFrame([(float(i % 2), 3.0, "bar" if i % 2 else "line") for i in range(20)], "data_type_is_string double, length double, trace_type string")
    inputs = ["data_type_is_string", "length"]
    model = ml.train_type_model(train, inputs, trees=3)
    bounds = spark.createDataFrame([("length", 1.0, 2.5)], "feature string, lo double, hi double")
    rows = {r["field_id"]: r for r in flows.score_tables(cells, model, bounds, inputs).collect()}
    assert rows["u:b"]["predicted_trace_type"] == "bar" and rows["u:a"]["predicted_trace_type"] == "line"
    assert rows["u:a"]["length"] == 2.5
