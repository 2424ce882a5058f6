"""Numeric and sequence features against NumPy on small data, and exact ranks under skew."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colscope.operators import profile as pr
from colscope.operators import ranking as rk

SCHEMA = "fid string, field_id string, field_name string, ord int, pos bigint, raw string"


def fixture_columns():
    rng = random.Random(3)
    return {
        "ints": [str(rng.randint(-20, 20)) for _ in range(120)],
        "money": [f"{rng.uniform(0.5, 900):.2f}" for _ in range(90)],
        "constant": ["4.5"] * 12,
        "hot": ["7"] * 200 + [str(i) for i in range(40)],
        "sorted": [str(i * i + 1) for i in range(30)],
        "line": [str(3 * i + 2) for i in range(25)],
        "holes": [None if i % 4 == 0 else f"{i}.25" for i in range(40)] + ["bad"],
        "words": [rng.choice(["a", "bb", "ccc", "dddd"]) for _ in range(50)] + [None],
        "days": [f"2024-01-{d:02d}" for d in (3, 1, 2, 9, 8, 7, 5)],
    }


@pytest.fixture(scope="module")
def profiled(spark):
    rows = [("u:1", name, name, o, i, v) for o, (name, vs) in enumerate(fixture_columns().items()) for i, v in enumerate(vs)]
    out = pr.profile_columns(spark.createDataFrame(rows, SCHEMA)).collect()
    return {r["field_id"]: r.asDict() for r in out}


def numbers(values):
    out = []
    for v in values:
        try:
            out.append(float(v))
        except (TypeError, ValueError):
            continue
    return np.array(out)


@pytest.mark.parametrize("name", ["ints", "money", "hot", "sorted", "line", "holes"])
def test_numeric_features(profiled, name):
    got, v = profiled[name], numbers(fixture_columns()[name])
    n, mean, std = len(v), v.mean(), v.std()
    q25, q75 = np.percentile(v, [0.25, 0.75])
    x = np.sort(v - min(v.min(), 0)) + 1e-7
    ranks = np.arange(1, n + 1)
    s = np.sort(v)
    want = {
        "mean": mean, "median": np.median(v), "var": v.var(), "std": std, "min": v.min(), "max": v.max(),
        "range": v.max() - v.min(), "normalized_mean": mean / v.max(), "coeff_var": v.var() / mean,
        "q25": q25, "q75": q75, "med_abs_dev": np.median(np.abs(v - np.median(v))), "avg_abs_dev": np.mean(np.abs(v - mean)),
        "skewness": np.mean((v - mean) ** 3) / std ** 3, "kurtosis": np.mean((v - mean) ** 4) / std ** 4 - 3,
        "moment_5": np.mean((v - mean) ** 5), "moment_10": np.mean((v - mean) ** 10),
        "gini": np.sum((2 * ranks - n - 1) * x) / (n * x.sum()),
        "percent_outliers_3std": np.mean((v < mean - 3 * std) | (v > mean + 3 * std)),
        "percent_outliers_15iqr": np.mean((v < q25 - 1.5 * (q75 - q25)) | (v > q75 + 1.5 * (q75 - q25))),
        "lin_space_sequence_coeff": np.std(np.diff(s)) / np.mean(np.diff(s)),
        "sortedness": abs(np.corrcoef(v, s)[0, 1]),
    }
    for key, value in want.items():
        assert got[key] == pytest.approx(value, rel=1e-7, abs=1e-9), key
    assert got["is_sorted"] == bool(np.array_equal(v, s))
    if (v > 0).all():
        p = v / v.sum()
        assert got["entropy"] == pytest.approx(-np.sum(p * np.log(p)), rel=1e-9)
        ratio = s[:-1] / s[1:]
        assert got["log_space_sequence_coeff"] == pytest.approx(np.std(ratio) / np.mean(ratio), rel=1e-6)
    if (v < 0).any() and (v > 0).any():
        assert got["entropy"] is None


def test_flags_and_types(profiled):
    kinds = {k: r["data_type"] for k, r in profiled.items()}
    assert kinds == {"ints": "integer", "money": "decimal", "constant": "decimal", "hot": "integer", "sorted": "integer",
                     "line": "integer", "holes": "decimal", "words": "string", "days": "time"}
    assert profiled["line"]["is_lin_space"] and not profiled["ints"]["is_lin_space"]
    assert profiled["constant"]["skewness"] is None and profiled["constant"]["normality_p"] is None
    assert profiled["holes"]["num_none"] == 10 and profiled["holes"]["has_none"]
    assert profiled["words"]["mean"] is None and profiled["words"]["is_monotonic"] is False
    assert profiled["words"]["num_unique_elements"] == 4
    assert profiled["ints"]["num_unique_elements"] == len(set(fixture_columns()["ints"]))
    assert profiled["money"]["num_unique_elements"] is None and profiled["money"]["is_unique"] is False
    assert not profiled["days"]["is_sorted"] and profiled["days"]["is_monotonic"]
    assert not any(r["is_only_field"] for r in profiled.values())


def test_word_statistics(profiled):
    words = [w for w in fixture_columns()["words"] if w]
    counts = np.array([words.count(w) for w in set(words)])
    p = counts / counts.sum()
    assert profiled["words"]["list_entropy"] == pytest.approx(-np.sum(p * np.log(p)))
    assert profiled["words"]["percentage_of_mode"] == pytest.approx(counts.max() / len(words))
    lengths = [len(w) for w in words]
    assert profiled["words"]["std_value_length"] == pytest.approx(np.std(lengths))
    assert profiled["words"]["median_value_length"] == np.median(lengths)


def normality(spark, values):
    hist = pr.value_histogram(spark.createDataFrame([("c", float(v)) for v in values], "k string, v double"), ["k"])
    totals = pr.value_totals(hist, ["k"])
    return pr.add_normality(totals.join(pr.centered_stats(hist, totals, ["k"]), "k")).first()


def test_normality_parts(spark):
    assert normality(spark, [2, 8, 0, 4, 1, 9, 9, 0])["skew_z"] == pytest.approx(0.44626385374196975)
    assert normality(spark, range(1, 9))["skew_z"] == pytest.approx(1.0108048609177787)
    assert normality(spark, range(20))["kurtosis_z"] == pytest.approx(-1.7058104152122062)
    assert normality(spark, [1, 2, 3])["normality_p"] is None


def test_positions_of_a_hot_group(spark):
    """One key holds most rows; small partitions force it over many pieces."""
    df = spark.range(20000).select(
        F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        F.expr("(id * 7919) % 20011").alias("o"))
    spread = rk.range_stage(df.repartition(8), ["k"], ["o"])
    assert spread.where("k = 'hot'").select(rk.PART).distinct().count() >= 1
    rows = rk.row_positions(df, ["k"], ["o"]).toPandas()
    for _, g in rows.groupby("k"):
        g = g.sort_values("o")
        assert list(g["position"]) == list(range(len(g)))
        assert (g["total"] == len(g)).all()


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 3), ("a", 2)], "k string, o int")
    rows = sorted((r["k"] or "", r["o"], r["position"], r["total"]) for r in rk.row_positions(df, ["k"], ["o"]).collect())
    assert rows == [("", 1, 0, 2), ("", 3, 1, 2), ("a", 2, 0, 1)]


def test_positions_without_coalescing(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(5000).select(F.lit("one").alias("k"), F.expr("(id * 31) % 5003").alias("o"))
        staged = rk.range_stage(df, ["k"], ["o"])
        assert staged.select(rk.PART).distinct().count() == 8
        rows = rk.running_positions(df, ["k"], ["o"], lead_of="o").toPandas().sort_values("o")
        assert list(rows["before"]) == list(range(5000))
        assert list(rows["nxt"])[:-1] == list(rows["o"])[1:] and math.isnan(list(rows["nxt"])[-1])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("accuracy", [50, 10000])
def test_bracketed_quantiles_are_exact(spark, accuracy):
    rng = np.random.default_rng(1)
    data = {"normal": rng.normal(size=3000), "ties": rng.integers(0, 4, 2000).astype(float), "one": np.array([5.0]),
            "skewed": np.concatenate([np.zeros(1500), rng.exponential(size=700)])}
    df = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v], "k string, x double")
    probs = {"a": 0.05, "b": 0.5, "c": 0.95, "d": 0.0025, "e": 1.0}
    got = {r["k"]: r for r in rk.exact_quantiles(df, ["k"], "x", probs, accuracy).collect()}
    for k, v in data.items():
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(v, p), rel=1e-12, abs=1e-12), (k, name)


def small_tables():
    rng, rows = random.Random(5), []
    pools = [["1", "2", "3", "-4", "0", None], ["0", "0", "5"], ["0.5", "2.5", "1e400", "x"], ["2024-01-05", "2023-02-03", "31/12/1999", "bad"],
             ["a", "b", "bb", None, ""], [None], ["nan", "inf"], ["4.1"], ["1_0", "10", "1e1"], ["a", "x y", "5", "-0", "1e3", "é", "2", "2.0"]]
    for t in range(30):
        for f in range(rng.choice([1, 2, 5])):
            pool = rng.choice(pools) if rng.random() < 0.8 else [f"{rng.uniform(-50, 900):.2f}" for _ in range(30)]
            rows += [(f"u:{t}", f"u:c{f}", f"Col {f} time$", f, None if rng.random() < 0.05 else i, rng.choice(pool)) for i in range(rng.choice([1, 2, 3, 9, 40]))]
    return rows


def same(a, b, scale=1.0):
    return a == b or (isinstance(a, float) and isinstance(b, float) and (math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12 * scale) or (a != a and b != b)))


def features_of(df):
    return {(r.fid, r.field_id): r.asDict() for r in df.collect()}


def test_small_tables_need_no_ranks_and_give_the_same(spark, monkeypatch):
    cells = spark.createDataFrame(small_tables(), SCHEMA).repartition(3)
    monkeypatch.setattr(pr, "ROW_CELLS", 0, raising=False)
    long = pr.profile_columns(cells)
    monkeypatch.undo()
    monkeypatch.setattr(pr, "range_stage", None)
    monkeypatch.setattr(pr, "running_positions", None)
    rows = pr.profile_columns(cells)
    assert rows.dtypes == long.dtypes
    want, got = features_of(long), features_of(rows)
    assert set(want) == set(got)
    for key, r in want.items():
        # Odd moments of symmetric values are nothing but rounding.
        wrong = [c for c in r if not same(got[key][c], r[c], (1 + (r["std"] or 0)) ** int(c.split("_")[1]) if c.startswith("moment_") else 1.0)]
        assert not wrong, (key, [(c, got[key][c], r[c]) for c in wrong])


def test_small_and_large_and_odd_tables_together(spark, monkeypatch):
    monkeypatch.setattr(pr, "ROW_CELLS", 10, raising=False)
    rows = [("small", "a", "a", 0, i, str(i)) for i in range(3)] + [("large", "a", "a", 0, i, str(i)) for i in range(30)]
    rows += [("twice", "a", "a", o, i, str(i + o)) for o in (0, 1) for i in range(4)] + [("none", None, None, 0, 0, "1"), (None, "a", "a", 0, 0, "1")]
    got = features_of(pr.profile_columns(spark.createDataFrame(rows, SCHEMA)))
    assert {k: r["length"] for k, r in got.items()} == {("small", "a"): 3, ("large", "a"): 30, ("twice", "a"): 4, ("twice", "a.1"): 4, ("none", None): 1}
    assert got["large", "a"]["mean"] == 14.5 and got["twice", "a.1"]["mean"] == 2.5 and got["small", "a"]["is_only_field"]
