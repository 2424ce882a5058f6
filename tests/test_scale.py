"""Cases the queries' tables do not hold: wide, deep, rare, NULL and misread values."""

import json
import random

import pytest
from pyspark.sql import functions as F

from colscope import session
from colscope.functions import jsontext as js
from colscope.functions import values as va
from colscope.operators import charts as ch
from colscope.operators import prep
from colscope.operators import profile as pr
from colscope.operators import relational as rl
from colscope.operators import sampling as sm
from colscope.plans import all_queries, corpus_queries, flows
from colscope.sources import corpus as co


def test_every_label_is_encoded(spark):
    df = spark.range(1005).select(F.format_string("l%04d", "id").alias("label"))
    mapping = prep.fit_labels(df, "label")
    hot = prep.one_hot_by(prep.encode_labels(df, "label", mapping, "idx"), "idx", mapping, "hot")
    total = F.aggregate("hot", F.lit(0.0), lambda a, x: a + x)
    assert hot.agg(F.sum(total), F.min(F.size("hot"))).first()[:] == (1005.0, 1005)


def test_tiny_weights_get_their_rows(spark):
    marked = sm.assign_split(spark.range(100_000), "id", {"train": 0.9996, "test": 0.0004}, "w")
    n = marked.where("split = 'test'").count()
    assert 15 <= n <= 75


def test_first_row_of_a_key(spark):
    rows = [("a", None, "x"), ("b", 2, "p"), ("b", 1, "q"), ("b", 1, "q"), ("c", 1, "r"), ("c", 1, "s"), (None, None, "n")]
    df = spark.createDataFrame(rows, "k string, o int, v string")
    got = {r.k: r.v for r in rl.keep_first(df, ["k"], "o").collect()}
    assert len(got) == rl.keep_first(df, ["k"], "o").count() == 4
    assert got["a"] == "x" and got["b"] == "q" and got["c"] in "rs" and got[None] == "n"
    assert {r.k: r.v for r in rl.keep_first(df.orderBy(F.desc("v")).repartition(3), ["k"], "o").collect()} == got


def test_keys_in_long_lists_and_deep_documents(spark):
    deep = "[" * 300 + json.dumps({"k": "bottom", "z": None}) + "]" * 300
    long = json.dumps({"list": [{"i": i} for i in range(10_000)] + [{"k": None}, {"k": {"v": [1, "é"]}}]}, ensure_ascii=False)
    rows = [(1, deep), (2, long), (3, '{"k":'), (4, None), (5, '{"a":{"k":1},"k":2}'), (6, '{"k":{"k":3}}'), (7, '[] []')]
    df = spark.createDataFrame(rows, "i int, doc string")
    got = {r.i: (r.k, r.k_found) for r in js.find_keys(df, "doc", ["k"], suffix="_found").collect()}
    assert got == {1: ("bottom", "bottom"), 2: (None, '{"v": [1, "é"]}'), 3: (None, None), 4: (None, None), 5: ("1", "1"),
                   6: ('{"k":3}', '{"k":3}'), 7: (None, None)}


def test_answers_with_raw_breaks_and_nan(spark):
    texts = ['{"code": "a\n\tb"}', '{"x": NaN, "y": -Infinity, "t": "NaN"}', '{\n"a": 1\n}', '{"a": "it\'s NaN\r"}']
    got = js.parse_responses(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t").orderBy("i").collect()
    assert all(r.valid for r in got)
    assert [json.loads(r.data) for r in got] == [{"code": "a\n\tb"}, {"x": None, "y": None, "t": "NaN"}, {"a": 1}, {"a": "it's NaN\r"}]


def test_zero_as_text_is_kept(spark):
    df = spark.createDataFrame([('[["0", "5"]]', '[["5"]]'), ('[[0, 5]]', '[[5]]'), ('[["0", "5"]]', '[[5], ["5", "0"]]')], "a string, b string")
    match = va.list_match(va.json_lists(F.col("a")), va.json_lists(F.col("b")), False, "v3", quoted=True)
    assert [r[0] for r in df.select(match).collect()] == [False, True, True]


def test_descending_text_categories(spark):
    points = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3)], "x string, y int").withColumn("x_key", F.col("x"))
    assert [r.x for r in ch.sort_chart(points, "x_desc").orderBy("ord").collect()] == ["c", "b", "a"]


def test_bounds_default_only_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, float("nan"))], "a double, b double")
    assert {r.feature: (r.lo, r.hi) for r in prep.fit_bounds(df, ["a", "b"], 0.0, 1.0).collect()} == {"a": (1.0, 3.0), "b": (0.0, 1.0)}


def test_no_order_without_positions(spark):
    rows = [("f", None, 2.0), ("f", None, 1.0), ("g", 2, 5.0), ("g", 1, 4.0), ("g", 3, 4.5), ("h", 1, 1.0)]
    df = spark.createDataFrame(rows, "field_id string, pos int, v double")
    got = {r.field_id: (r.is_sorted, r.sortedness) for r in pr.sequence_stats(df, ["field_id"]).collect()}
    assert set(got) == {"g", "h"} and got["h"] == (True, 1.0) and not got["g"][0] and abs(got["g"][1] - 0.5) < 1e-9


def test_last_of_equal_column_names(spark):
    cell = lambda uid, o: '"a":{"uid":"%s","order":%d,"data":["1"]}' % (uid, o)
    raw = spark.createDataFrame([("u:1", '[{"type":"bar"}]', "{}", '{"t":{"cols":{%s,%s}}}' % (cell("p", 0), cell("q", 1)))], co.CORPUS_SCHEMA)
    fields = co.clean_corpus(co.parse_corpus(raw)).first().fields
    assert [f.uid for f in fields] == ["q"]


def test_csv_rows_keep_their_place(spark, tmp_path):
    (tmp_path / "db" / "t.csv").mkdir(parents=True)
    (tmp_path / "db" / "t.csv" / "part-0.csv").write_text('a,b\n1,"x, ""y"""\n2,\n')
    (tmp_path / "db" / "t.csv" / "part-1.csv").write_text("a,b\n3,z\n")
    (tmp_path / "db" / "u.csv").write_text("k\n" + "".join(f"{i}\n" for i in range(500)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    try:
        cells = co.read_database_cells(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    t = sorted((c.pos, c.field_name, c.raw) for c in cells if c.fid == "t" and c.raw is not None)
    assert t == [(0, "a", "1"), (0, "b", 'x, "y"'), (1, "a", "2"), (2, "a", "3"), (2, "b", "z")]
    assert all(int(c.raw) == c.pos for c in cells if c.fid == "u") and sum(c.fid == "u" for c in cells) == 500


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_dir(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs://shared/x/"}
    assert session.run_folder(Session()) == "hdfs://shared/x/colscope/app"


def test_overlap_of_a_wide_table_follows_the_meeting_pairs(spark):
    """5,000 fields of one table, each meeting its neighbours only: 20 million pairs are never formed."""
    rng = random.Random(7)
    spans = {f"f{i:04d}": (i * 10.0, i * 10.0 + rng.choice([0.0, 5.0, 10.0, 25.0])) for i in range(5000)}
    rows = [("t", f, v) for f, ends in spans.items() for v in ends] + [("t", "none", None), (None, "x", 1.0), (None, "y", 1.0)]
    got = pr.overlapping_fields(spark.createDataFrame(rows, "fid string, field_id string, v double"), ["fid"])
    names = sorted(spans)
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1:i + 5] if spans[a][1] >= spans[b][0] and spans[b][1] >= spans[a][0]}
    rows = got.collect()
    assert len(rows) == len(want) and {(r.field_a, r.field_b) for r in rows} == want and all(r.has_overlap for r in rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "block" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_overlapping_fields_equal_the_paired_ones(spark):
    rng = random.Random(8)
    rows = [(f"t{rng.randrange(3)}", f"f{rng.randrange(60):02d}", float(rng.choice([rng.randrange(50), rng.randrange(1000)]))) for _ in range(400)]
    hist = spark.createDataFrame(rows, "fid string, field_id string, v double")
    key = lambda r: (r.fid, r.field_a, r.field_b)
    want = {key(r): r.overlap_percent for r in pr.range_overlap(hist, ["fid"]).collect() if r.has_overlap}
    for block in (1, 4, 64):
        assert {key(r): r.overlap_percent for r in pr.overlapping_fields(hist, ["fid"], block=block).collect()} == want
    assert pr.overlapping_fields(hist.where("false"), ["fid"]).count() == 0


def test_chunks_are_whole_or_absent_and_replace_themselves(spark, tmp_path):
    from colscope.sources import sinks
    root = str(tmp_path / "chunks")
    rows = lambda *ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "id long, v string")
    read = lambda name="f": sorted((r.chunk, r.id) for r in sinks.read_chunks(spark, root, name, "id long, v string").collect())
    sinks.append_chunk({"f": rows(1, 2), "o": rows(1)}, root, 0)
    sinks.append_chunk({"f": rows(3), "o": rows(3)}, root, 1)
    sinks.append_chunk({"f": rows(1, 2), "o": rows(1)}, root, 0)
    assert read() == [(0, 1), (0, 2), (1, 3)] and read("o") == [(0, 1), (1, 3)]
    broken = rows(9).withColumn("v", F.raise_error(F.lit("stopped")).cast("string"))
    with pytest.raises(Exception, match="stopped"):
        sinks.append_chunk({"f": rows(7, 8), "o": broken}, root, 1)
    assert read() == [(0, 1), (0, 2), (1, 3)] and read("o") == [(0, 1), (1, 3)]
    sinks.append_chunk({"f": rows(4), "o": rows(4).where("false")}, root, 1)
    assert read() == [(0, 1), (0, 2), (1, 4)] and read("o") == [(0, 1)]
    plan = sinks.read_chunks(spark, root, "f", "id long, v string")._jdf.queryExecution().executedPlan().toString()
    assert "chunk" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_charts_of_one_small_file_are_made_in_many_tasks(spark, sf):
    assert len(corpus_queries.usable_charts(spark, sf).inputFiles()) >= spark.sparkContext.defaultParallelism


def test_features_and_outcomes_are_worked_out_once(spark, sf):
    raw = corpus_queries.event_charts(corpus_queries.events(spark, sf).where("event_id < 60"))
    for name, df in zip(("features", "outcomes"), flows.corpus_features(raw, 25)):
        assert df.inputFiles() and all(f"/{name}-" in f for f in df.inputFiles())


def test_references_are_picked_out_once_a_field(spark, sf):
    charts = corpus_queries.usable_charts(spark, sf)
    plan = corpus_queries.lb.field_outcomes(charts, "both")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(refs") <= len(corpus_queries.lb.SOURCES) + 2


def test_keyed_json_files_do_not_follow_the_users(spark, tmp_path, monkeypatch):
    ev = spark.range(600).select(
        F.col("id").alias("event_id"), (F.col("id") % 200).alias("user_id"), F.lit("view").alias("event_type"), (F.col("id") * 0.5).alias("value"))
    ev.write.parquet(f"{tmp_path}/events.parquet")
    read, seen = co.read_keyed_json, []

    def counted(spark, path):
        seen.append(spark.read.format("binaryFile").load(path).count())
        return read(spark, path)

    monkeypatch.setattr(co, "read_keyed_json", counted)
    got = {r.id: (r.points, r.total) for r in all_queries.QUERIES["json_map_scan"](spark, str(tmp_path)).collect()}
    assert got == {f"{u}-view": (3, 1.5 * u + 300) for u in range(200)}
    assert 0 < seen[0] <= 16
