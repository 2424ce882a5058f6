"""CSV records and keyed JSON over file ranges; first rows and samples with odd columns."""

import io
import json
import random
from contextlib import contextmanager

import pandas as pd
import pytest
from pyspark.sql import functions as F

from colscope.functions import jsontext as js
from colscope.functions import names
from colscope.operators import profile as pr
from colscope.operators import relational as rl
from colscope.operators import sampling as sm
from colscope.sources import corpus as co


@contextmanager
def ranges(spark, size):
    keys = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def read_tables(spark, root):
    out = {}
    for c in co.read_database_cells(spark, str(root)).collect():
        out.setdefault(c.fid, {})[c.pos, c.ord] = (c.field_name, c.raw)
    return out


def pandas_cells(text):
    df = pd.read_csv(io.StringIO(text, newline=""), dtype=str, keep_default_na=False)
    return {(i, j): (name, df.iloc[i, j] or None) for i in range(len(df)) for j, name in enumerate(df.columns)}


def random_csv(seed, rows):
    rng = random.Random(seed)

    def cell():
        kind = rng.randrange(8)
        if kind == 0:
            return '"' + "".join(rng.choice(['""', "\n", ",", "x", "é", "\r\n", "\n\n"]) for _ in range(rng.randrange(12))) + '"'
        return ["", "plain", 'in"ner', "12", '"quoted"', '" a , b "', '"tail"end'][kind - 1]

    return "a,b,a,,c\n" + "".join("r," + ",".join(cell() for _ in range(4)) + "\n" for _ in range(rows))


@pytest.mark.parametrize("size", [17, 64, 100_000])
def test_csv_records_equal_pandas(spark, tmp_path, size):
    texts = {f"t{seed}": random_csv(seed, 60) for seed in range(4)}
    texts["crlf"] = 'k,v\r\n1,"two\r\nlines"\r\n2,x\r\n'
    texts["open"] = 'k,v\n1,"a"\n\n2,"never\nclosed, at all'
    (tmp_path / "db").mkdir()
    for name, text in texts.items():
        (tmp_path / "db" / f"{name}.csv").write_bytes(text.encode())
    with ranges(spark, size):
        got = read_tables(spark, tmp_path)
    for name, text in texts.items():
        if name == "open":  # pandas raises; here the cell runs to the end of the file
            assert got[name][0, 1] == ("v", "a") and got[name][1, 0] == ("k", "2")
            continue
        assert got[name] == pandas_cells(text), name


def test_names_as_pandas_reads_them(spark):
    for header in (["a", "b", "a"], ["a", "a", "a.1"], ["a", "a", "a.1", "a"], ["", "x", ""], ["a.1", "a", "a"]):
        want = list(pd.read_csv(io.StringIO(",".join(header) + "\n")).columns)
        df = spark.createDataFrame([([h or None for h in header],)], "h array<string>")
        assert df.select(names.unique_names(F.col("h"))).first()[0] == want, header


def test_long_quoted_cells(spark):
    cell = 'say ""hi"" ' * 20_000
    df = spark.createDataFrame([(f'1,"{cell}",2',)], "v string")
    assert df.select(co.csv_cells(F.col("v"))).first()[0] == ["1", cell.replace('""', '"'), "2"]


@pytest.mark.parametrize("size", [40, 1000, 1_000_000])
@pytest.mark.parametrize("indent", [None, 2])
def test_keyed_json_in_ranges(spark, tmp_path, size, indent):
    rng = random.Random(size)
    odd = ["}", "{", '"', "\\", "é", "a", "]", "[", ",", ":", "\n", "😀"]
    text = lambda: "".join(rng.choice(odd) for _ in range(rng.randrange(9)))
    docs = {f"{i}{text()}": rng.choice([{"a": text(), "b": [{"c": text()}, {}, []]}, {}, {"x": {"y": {text(): None}}}, [1, {"z": text()}], 5, text(), None, True]) for i in range(150)}
    (tmp_path / "k.json").write_text(json.dumps(docs, indent=indent, ensure_ascii=False))
    (tmp_path / "empty.json").write_text("{}")
    (tmp_path / "one.json").write_text('\n{"only": {"v": "}"}}\n')
    with ranges(spark, size):
        rows = co.read_keyed_json(spark, str(tmp_path)).collect()
        parts = spark.read.option("lineSep", "}").text(str(tmp_path / "k.json")).rdd.getNumPartitions()
    got = {r.id: r.value for r in rows}
    assert len(rows) == len(docs) + 1 and json.loads(got.pop("only")) == {"v": "}"} and (size > 999 or parts > 8)
    for k, v in docs.items():
        assert got[k] == v if isinstance(v, str) else (json.loads(got[k]) if got[k] is not None else None) == v


def test_first_rows_with_maps_and_other_orders(spark):
    rows = [("a", 2, {"x": 1}, "q", None), ("a", 1, {"x": 2}, "p", 1.5), ("a", 1, {"x": 2}, "p", 1.5), ("b", None, None, None, None), ("b", -2**63, {}, "z", 0.0), (None, None, {"y": 0}, None, None),
            ("c", 2**63 - 1, None, "w", 2.0), ("c", None, None, "v", 1.0)]
    df = spark.createDataFrame(rows, "k string, o bigint, m map<string,int>, s string, d double")
    got = {r.k: r for r in rl.keep_first(df, ["k"], "o").collect()}
    assert len(got) == 4 and (got["a"].o, got["a"].m, got["b"].o, got["b"].m, got["c"].o, got[None].m) == (1, {"x": 2}, -2**63, {}, 2**63 - 1, {"y": 0})
    assert rl.keep_first(df, ["k"], "o").count() == 4 and {r.k: r.s for r in rl.keep_first(df, ["k"], "s").collect()} == {"a": "p", "b": "z", "c": "v", None: None}
    assert {r.k: r.d for r in rl.keep_first(df, ["k"], "d").collect()} == {"a": 1.5, "b": 0.0, "c": 1.0, None: None}
    twins = spark.createDataFrame([(None, "a", 1), ("a", None, 1)], "x string, y string, o int")
    assert rl.keep_first(twins, ["x", "y"], "o").count() == 2


@pytest.mark.parametrize("n", [0, 1, 7, 103, 2999, 3000, 5000])
def test_samples_take_the_smallest_hashes(spark, n):
    rows = [(i, None if i % 5 == 0 else f"s{min(4, i % 50)}") for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, s string").repartition(6)
    hashed = sorted((r.h, r.k, r.s) for r in df.select("k", "s", sm.hash_order(F.col("k"), "z").alias("h")).collect())
    assert {r.k for r in sm.random_sample(df, n, "k", "z").collect()} == {k for _, k, _ in hashed[:n]}
    strata = {}
    for h, k, s in hashed:
        strata.setdefault(s, []).append(k)
    quota = {s: min(len(v), len(v) * n // 3000) for s, v in strata.items()}
    want = {k for s, v in strata.items() for k in v[:quota[s]]}
    want |= set([k for _, k, _ in hashed if k not in want][:max(0, n - len(want))])
    out = sm.stratified_sample(df, n, "s", "k", "z").collect()
    assert {r.k for r in out} == want and len(out) == len(want)


def test_equal_column_names_are_fields_of_their_own(spark):
    rows = [("t", "a", "a", 0, p, str(p)) for p in range(6)] + [("t", "a", "a", 1, p, str(30 * (p % 3))) for p in range(6)] + [("t", "b", "b", 2, p, "x") for p in range(6)]
    rows += [("u", "a", "a", 0, p, "7") for p in range(3)]
    cells = spark.createDataFrame(rows, "fid string, field_id string, field_name string, ord int, pos bigint, raw string")
    got = {(r.fid, r.field_id): (r.length, r.num_unique_elements, r.max) for r in pr.profile_columns(cells).collect()}
    assert got == {("t", "a"): (6, 6, 5.0), ("t", "a.1"): (6, 3, 60.0), ("t", "b"): (6, 1, None), ("u", "a"): (3, 1, 7.0)}


ANSWERS = ['{"a":1,"a":2}', '{"a":{"b":1,"b":[2]},"c":0}', '{"a":NaN,"b":-Infinity}', '{"a":"two\nlines"}', "{'a':'x'}", '"a":1', '"a":"raw\nbreak"', "{'a':'raw\nbreak'}",
           '{"a":1} trailing', '[{"a":1,"a":3}]', '{"a":01}', '{"a":.5}', '{"a":1,}', '{"a":"\\x"}', '{"a":"\\u00e9"}', "", "null", '{"a":1}{"a":2}', '1],[2', '1,"b":2', "{'a':\"it's\"}", '{"a":+1}', '"x', '{a:1}']


def test_answers_as_json_loads_reads_them(spark):
    def loads(text, strict):
        try:
            return json.loads(text, strict=strict), True
        except json.JSONDecodeError:
            return None, False

    df = spark.createDataFrame(list(enumerate(ANSWERS)), "i int, t string")
    got = {r.i: r for r in df.select("i", js.is_json(F.col("t")).alias("loose"), js.is_json(F.col("t"), True).alias("strict")).collect()}
    for i, text in enumerate(ANSWERS):
        assert (got[i].loose, got[i].strict) == (loads(text, False)[1], loads(text, True)[1]), text
    parsed = {r.t: r for r in js.parse_responses(df, "t").collect()}
    assert json.loads(parsed['{"a":1,"a":2}'].data) == {"a": 2} and json.loads(parsed[ANSWERS[1]].data) == {"a": {"b": [2]}, "c": 0}
    assert parsed["{'a':'x'}"].valid and parsed['"a":1'].valid and not parsed['"a":"raw\nbreak"'].valid and not parsed["{'a':'raw\nbreak'}"].valid
    assert parsed['{"a":"two\nlines"}'].valid and parsed['{"a":NaN,"b":-Infinity}'].valid
