"""Literal cases of value and list comparison."""

import random

import pytest
from pyspark.sql import functions as F

from colscope.functions import values as va
from colscope.operators import prep

PAIRS = [
    ("1.0", "1", True), ("1.00", "1", True), ("feb", "2", True), ("3.37", "3.3", True), ("100", "100", True),
    ("hello", "hello", True), (None, None, True), ("42", "42", True), ("42", "42.0", True), ("42", "43", False),
    ("3.1415", "3.14", True), ("3.140", "3.14", True), ("3.141", "3.142", False), ("monday", "1", True),
    ("Monday", "mon", True), ("friday", "5", True), ("monday", "tuesday", False), ("january", "1", True),
    ("JAN", "january", True), ("7", "july", True), ("december", "12", True), ("", "", True), ("", "0", False),
    ("abc", "123", False), ("8", "monday", False), ("13", "january", False), ("42", "42.9", True),
    (None, "1", None), (None, "a", False), ("-0.5", "0", True), ("1e2", "100", True), ("5", "5.999", True),
]


def test_variant_two_pairs(spark):
    rows = spark.createDataFrame(PAIRS, "a string, b string, want boolean")
    for a, b, want, got in rows.select("*", va.values_equal(F.col("a"), F.col("b"), "v2")).collect():
        assert got == want, (a, b)


def test_variants_differ(spark):
    rows = spark.createDataFrame([("3.141", "3.142"), ("42", "42.9"), (None, "1")], "a string, b string")
    got = rows.select(*[va.values_equal(F.col("a"), F.col("b"), v).alias(v) for v in ("v1", "v2", "v3")]).collect()
    assert [tuple(r) for r in got] == [(True, False, True), (False, True, True), (False, None, None)]
    with pytest.raises(ValueError):
        va.values_equal(F.col("a"), F.col("b"), "v9")


LISTS = [
    ([["Mon", "Tue", "Wed", "Thur", "Fri", "Sat", "Sun"], ["2", "1", "1", "1", "1", "1", "0"]],
     [["Monday", "Thursday", "Tuesday", "Wednesday", "Saturday", "Friday"], ["2", "1", "1", "1", "1", "1"]],
     "v3", False, "sorted", True),
    ([["bangla", "english"], ["7.5", "7"]], [["bangla", "english"], ["7.5", "7.0"], ["4", "2"]], "v1", True, "sorted", True),
    ([["a"], ["1"]], [["a"]], "v1", False, "sorted", False),
    ([["1", "2"]], [["2", "1"]], "v1", True, "sorted", False),
    ([["1", "2"]], [["2", "1"]], "v1", False, "sorted", True),
    ([["0.005", "0.0"]], [["0.0", "0.0125"]], "v1", False, "greedy", False),
    ([["0.005", "0.0"]], [["0.0", "0.0125"]], "v1", False, "sorted", True),
    ([["1"], ["1"]], [["1"], ["2"]], "v1", False, "sorted", False),
    ([[]], [[]], "v1", False, "sorted", True),
    ([], [["1"]], "v1", False, "sorted", True),
    ([["a", None]], [[None, "a"]], "v1", False, "sorted", True),
    ([["1", "x"]], [["1", None]], "v2", False, "sorted", False),
    ([["1"]], [[None]], "v2", False, "sorted", None),
]


@pytest.mark.parametrize("case", LISTS)
def test_lists(spark, case):
    expected, predicted, variant, ordered, pairing, want = case
    rows = spark.createDataFrame([(expected, predicted)], "e array<array<string>>, p array<array<string>>")
    got = rows.select(va.list_match(F.col("e"), F.col("p"), ordered, variant, pairing)).first()[0]
    assert got == want


def test_sorted_pairing_finds_every_matching(spark):
    """Against all pairings of small random bags."""
    from itertools import permutations
    rng = random.Random(5)
    rows, want = [], []
    for i in range(300):
        n = rng.randint(1, 4)
        a = [round(rng.randint(0, 8) * 0.004, 4) for _ in range(n)]
        b = [round(rng.randint(0, 8) * 0.004, 4) for _ in range(n)]
        rows.append((i, [str(x) for x in a], [str(x) for x in b]))
        want.append(any(all(abs(x - y) < 0.01 for x, y in zip(a, p)) for p in permutations(b)))
    df = spark.createDataFrame(rows, "i int, a array<string>, b array<string>")
    got = df.select("i", va.lists_equal(F.col("a"), F.col("b"))).orderBy("i").collect()
    assert [r[1] for r in got] == want


def test_drop_zero_positions(spark):
    df = spark.createDataFrame([([["a", "b", "c"], ["1", "0", "2"]],)], "l array<array<string>>")
    assert df.select(va.drop_zero_positions(F.col("l"))).first()[0] == [["a", "c"], ["1", "2"]]


def test_matrix_columns(spark):
    df = spark.createDataFrame(
        [(1, [["MW", "PW", "TW"]], [[0, 3, 0], [1, 2, 2], [4, 2, 1]], ["Electrical", "Mechanical", "TV, Video"])],
        "id int, x_data array<array<string>>, y_data array<array<int>>, classify array<string>")
    units, values, classes = df.select(
        prep.matrix_columns(F.col("x_data"), F.col("y_data"), F.col("classify"))).first()[0]
    assert units == ["MW", "PW", "TW"] * 3
    assert values == ["0", "3", "0", "1", "2", "2", "4", "2", "1"]
    assert classes == ["Electrical"] * 3 + ["Mechanical"] * 3 + ["TV, Video"] * 3
    rows = prep.matrix_rows(df, "id").orderBy("pos").collect()
    assert [(r["unit"], str(r["value"]), r["class"]) for r in rows] == list(zip(units, values, classes))


def test_lists_read_each_value_once(spark):
    odd = ["1", "+5", "-5", " 7 ", "May", "5", "99999999999", "1e3", "1000", "3.140", "3.1", "", None, "sun", "NaN", "1e400", "0.004", "x"]
    df = spark.createDataFrame([(a, b) for a in odd for b in odd], "a string, b string")
    for variant in ("v2", "v3"):
        got = df.select(va.values_equal(F.col("a"), F.col("b"), variant).alias("one"),
                        va.lists_equal(F.array("a"), F.array("b"), False, variant).alias("list"), "a", "b").collect()
        assert all(r.one == r["list"] or r.a is r.b is None for r in got)
    plan = df.select(va.lists_equal(F.array("a"), F.array("b"), False, "v3"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= 60  # 180 when each use of a number or name reads the text again
