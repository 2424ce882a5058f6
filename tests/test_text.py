"""Typing, names, JSON recovery, masking and prompts."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from colscope.functions import jsontext as js
from colscope.functions import names as fn
from colscope.functions import typing as ty
from colscope.operators import profile as pr
from colscope.operators import prompts as pt

VOTES = [
    (["1", "2", "-3"], (4, 12, 9, 0), "integer"), (["1.5", "2.5"], (3, 0, 6, 0), "decimal"),
    (["2024-01-01", "2024-01-02"], (3, 0, 0, 4), "time"), (["2024-01-01"], (2, 0, 0, 2), "string"),
    (["007", "-0"], (3, 0, 6, 0), "decimal"), (["a", "b", "7"], (4, 4, 3, 0), "string"),
    ([None, "", "5"], (2, 4, 3, 0), "integer"), (["1.2.3"] * 3, (4, 0, 0, 6), "time"),
    (["1e3", "inf", "NaN"], (4, 0, 9, 0), "decimal"),
]


@pytest.mark.parametrize("values,scores,kind", VOTES)
def test_votes(spark, values, scores, kind):
    cells = spark.createDataFrame([("f", "c", "c", 0, i, v) for i, v in enumerate(values)],
                                  "fid string, field_id string, field_name string, ord int, pos bigint, raw string")
    r = pr.field_basics(pr.raw_histogram(cells)).first()
    assert tuple(r[f"score_{t}"] for t in ty.TYPE_ORDER) == scores
    assert r["data_type"] == kind


ANSWERS = [
    ('```json\n{"a":1}\n```', True, '{"a":1}'), ('Sure: {"a":1} done', True, '{"a":1}'), ('{"a":1,}', True, '{"a":1}'),
    ('"a":1', True, '{"a":1}'), ("{'a':1}", True, '{"a":1}'), ("[1,2]", False, None), ("no json", False, None),
    ("{}", False, None), ('{"a":1}] x', True, '{"a":1}'), ('﻿{"a":[1,{"b":2}]}', True, '{"a":[1,{"b":2}]}'),
    ('{"a":1} {"b":2}', False, None), ("", False, None), ('text [1] {"a":1}', False, None),
]


def test_response_recovery(spark):
    df = spark.createDataFrame([(i, a[0]) for i, a in enumerate(ANSWERS)], "i int, t string")
    rows = js.parse_responses(df, "t").orderBy("i").collect()
    for r, (text, valid, data) in zip(rows, ANSWERS):
        assert r["valid"] == valid, text
        assert (r["data"] and json.loads(r["data"])) == (data and json.loads(data)), text
    assert rows[5]["errors"] == ["root is not an object"]
    assert rows[7]["errors"] == []


def test_masking(spark):
    texts = ["Show a STACKED BAR chart and a pie", "pipeline", "grouping line", "Grouping Scatter plot"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(js.mask_chart_terms(F.col("t"))).collect()] == [
        "Show a  chart and a ", "pipe", "grouping ", " plot"]


def _brute_find(doc, key, skip_null):
    stack = [doc]
    while stack:
        node = stack.pop(0)
        if isinstance(node, dict):
            expand = []
            for k, v in node.items():
                if k == key and not (skip_null and v is None):
                    expand.append(("hit", v))
                expand.append(v)
            for item in expand:
                if isinstance(item, tuple):
                    return True, item[1]
                found = _brute_find(item, key, skip_null)
                if found[0]:
                    return found
            return False, None
        if isinstance(node, list):
            stack = node + stack
    return False, None


def test_find_keys_in_reading_order(spark):
    docs = [
        {"z": {"k": 1}, "k": 2}, {"k": None, "a": {"k": 3}}, {"a": [[{"b": {"k": [1, 2]}}], {"k": 9}]},
        {"text": "{\"k\": 5}", "l": [1, "x", None, {"deep": {"deeper": {"k": {"q": 1}}}}]}, {"none": 1}, [{"k": 7}],
    ]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, doc string")
    for skip in (False, True):
        rows = js.find_keys(df, "doc", ["k"], skip).orderBy("i").collect()
        for r, d in zip(rows, docs):
            found, want = _brute_find(d, "k", skip)
            got = r["k"]
            assert (json.loads(got) if got is not None else None) == want, (d, got)


def test_key_scan_equals_the_walk(spark):
    rng = random.Random(4)

    def value(depth):
        kind = rng.randrange(9 if depth < 4 else 6)
        if kind < 6:
            return (None, True, -1.5e-7, 10 ** 25, 'q"k": \\ é\n', "k")[kind]
        if kind == 6:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        return {rng.choice(["k", "n", "a b", 'q"', "é", "\\"]): value(depth + 1) for _ in range(rng.randrange(4))}

    keys = ["k", "n", 'q"', "é", "\\", "absent"]
    texts = [json.dumps(value(0), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for _ in range(3000)]
    texts += [t[:rng.randrange(len(t) + 1)] + rng.choice(["", "}", "]", '"', ",", " ", "\ufeff"]) for t in texts]
    texts += ['{"k":NaN}', '{"k":1}{"k":2}', '{"k":1,}', '{"k":01}', '{"k":"a\nb"}', '[1 ,\t{"k" :\r\n {"n":[ ]} } ]', "", " ", "[" * 50_000 + '{"k":1}' + "]" * 50_000]
    def walked(text, keys):
        try:
            return js.walk_keys(text, keys)
        except json.JSONDecodeError:  # an escape that JSON does not have
            return None

    def scanned(text, keys):
        return js.scan_keys(text, keys, js.json_reader())

    for text in texts:
        assert scanned(text, keys) == walked(text, keys), text[:200]
    bad = spark.createDataFrame([('{"a":"\\x","k":1}',), ('{"k":"\\x"}',), ('{"k":1}',)], "doc string")
    assert [r.k for r in js.find_keys(bad, "doc", ["k"]).collect()] == [None, None, "1"]
    doc = json.dumps({"a": list(range(200)), "b": {str(i): "x" for i in range(200)}, "k": 1})
    times = []
    for search in (scanned, walked):
        start = time.process_time()
        assert all(search(doc, ["k", "z"])[0] == ["1", None] for _ in range(300))
        times.append(time.process_time() - start)
    assert times[0] < 0.5 * times[1]


def test_names(spark):
    df = spark.createDataFrame([("",), ("x Time id",), ("Größe €9",), ("timeId",)], "n string")
    rows = df.select(*[c.alias(k) for k, c in fn.name_features(F.col("n")).items()]).collect()
    assert rows[0]["field_name_length"] == 1 and rows[0]["space_in_name"]
    assert rows[1]["x_in_name"] and rows[1]["id_in_name"] and not rows[1]["time_in_name"]
    assert rows[1]["number_of_words_in_name"] == 3
    assert rows[2]["euro_in_name"] and rows[2]["digit_in_name"] and rows[2]["num_uppercase_characters"] == 1
    assert rows[3]["time_in_name"] and not rows[3]["first_char_uppercase_name"]


DATES = [
    ("2024-01-05", "2024-01-05 00:00:00", "2024-01-05 00:00:00"), ("05/01/2024", "2024-01-05 00:00:00", "2024-05-01 00:00:00"),
    ("5.1.24", "2024-01-05 00:00:00", "2024-05-01 00:00:00"), ("31-12-99", "1999-12-31 00:00:00", None),
    ("05 Jan 2024", "2024-01-05 00:00:00", "2024-01-05 00:00:00"), ("05/01/2024T10:11:12", "2024-01-05 10:11:12", "2024-05-01 10:11:12"),
    ("5-january-2024 10:11", "2024-01-05 10:11:00", "2024-01-05 10:11:00"), ("abc", None, None), ("2024", None, None), ("30/02/2024", None, None),
]


def test_dates(spark):
    df = spark.createDataFrame([(d[0],) for d in DATES], "t string")
    rows = df.select(*[ty.parse_timestamp(F.col("t"), d).cast("string").alias(str(d)) for d in (True, False)]).collect()
    assert [tuple(r) for r in rows] == [d[1:] for d in DATES]
    assert len(ty.date_formats()) == len(set(ty.date_formats())) == 20 + 20 * 9


def test_example_types(spark):
    cases = {"2024-01-01": "datetime", "1.5": "float", "7": "integer", "x": "string", None: "unknown", "2024": "datetime",
             "3024": "integer", "12:30": "datetime", "2024-05": "datetime", "January 5, 2024": "datetime", "Nation 5 2024": "string",
             "1e5": "integer", "13/05/2024": "datetime"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(ty.example_type(F.col("t"))).collect()] == list(cases.values())


def test_render_keeps_other_braces(spark):
    df = spark.createDataFrame([("{B}", "v"), (None, "v")], "a string, b string")
    got = [r[0] for r in df.select(pt.render('{"x": {A}} {B} {C}', {"A": F.col("a"), "B": F.col("b")})).collect()]
    assert got == ['{"x": {B}} v {C}', None]


def test_templates_fill_every_placeholder(spark):
    df = spark.createDataFrame([("d", "q", None, ["t"], "cols", [["1"]], "df", "names", "S")],
                               "db_id string, query string, describe string, irrelevant_tables array<string>, cols string,"
                               " data array<array<string>>, dataframe string, column_names string, schema_info string")
    for stage in pt.TEMPLATES:
        prompt = pt.stage_prompts(df, stage).first()["prompt"]
        assert prompt and "{QUESTION}" not in prompt and "{DATABASE_SCHEMA}" not in prompt and "{DATA}" not in prompt


def test_failed_calls_are_retried_and_recorded(spark):
    def model(prompt):
        if prompt == "bad":
            raise RuntimeError("down")
        return {"content": prompt.upper(), "tokens": 3, "model": "m"}
    df = spark.createDataFrame([(1, "ok"), (2, "bad")], "id int, prompt string")
    runs = {r["id"]: r for r in pt.batch_infer(df, model, stage="s").collect()}
    assert runs[1]["raw_response"] == "OK" and runs[1]["status"] == "success" and runs[1]["tokens"] == 3
    assert runs[2]["status"] == "failed" and runs[2]["error"] == "down" and runs[2]["tokens"] == 0
    assert pt.failed_stages(spark.createDataFrame(list(runs.values()))).count() == 1
