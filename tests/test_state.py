"""Merged profile states against exact values, and odd fields."""

import random

from pyspark.sql import functions as F

from colscope.operators import state as st
from colscope.plans import all_queries

SCHEMA = "fid string, field_id string, raw string"


def test_chunks_merge_to_the_state_of_all(spark, tmp_path):
    rng, root = random.Random(11), str(tmp_path / "states")
    rows = [("t", "few", str(min(rng.randrange(40), rng.randrange(40)))) for _ in range(6000)]
    rows += [("t", "many", f"{rng.random() * 1000:.6f}") for _ in range(6000)]
    rows += [("t", "null", None)] * 7 + [("t", "odd", v) for v in ("NaN", "Infinity", "", "2", "x" * 100_000, None)] + [(None, "few", "1")]
    rng.shuffle(rows)
    for chunk in range(5):
        st.add_chunk(spark.createDataFrame(rows[chunk::5], SCHEMA), root, chunk)
    st.add_chunk(spark.createDataFrame(rows[2::5], SCHEMA), root, 2)
    got = {(r.fid, r.field_id): r for r in st.state_profile(st.corpus_state(spark, root), common=3).collect()}
    assert set(got) == {("t", "few"), ("t", "many"), ("t", "null"), ("t", "odd"), (None, "few")}
    for name in ("few", "many"):
        values = [v for f, n, v in rows if f == "t" and n == name]
        numbers, r = sorted(map(float, values)), got["t", name]
        assert (r.n, r.nulls, r.numbers, r.lo, r.hi) == (6000, 0, 6000, numbers[0], numbers[-1])
        assert abs(r.mean - sum(numbers) / 6000) < 1e-6 and abs(r.n_distinct - len(set(values))) <= 0.07 * len(set(values))
        for q in (0.25, 0.5, 0.75):
            x = r[f"q{round(q * 100)}"]
            assert sum(v < x for v in numbers) / 6000 <= q + 0.02 and sum(v <= x for v in numbers) / 6000 >= q - 0.02
    few = [v for f, n, v in rows if f == "t" and n == "few"]
    top = sorted((few.count(v) for v in set(few)), reverse=True)[:3]
    assert [c["count"] for c in got["t", "few"].common] == top and all(few.count(c["item"]) == c["count"] for c in got["t", "few"].common)
    r = got["t", "null"]
    assert (r.n, r.nulls, r.numbers, r.n_distinct, r.q50, r.mean) == (7, 7, 0, 0, None, None) and not r.common
    r = got["t", "odd"]
    assert (r.n, r.nulls, r.numbers, r.lo, r.n_distinct, r.q50) == (6, 1, 1, 2.0, 5, 2.0)


def test_states_combine_before_the_shuffle(spark):
    assert st.field_state(spark.createDataFrame([], SCHEMA)).count() == 0
    plan = st.field_state(spark.range(10).select(F.lit("t").alias("fid"), F.lit("f").alias("field_id"), F.col("id").cast("string").alias("raw")))
    plan = plan._jdf.queryExecution().executedPlan().toString()
    assert "partial_hll_sketch_agg" in plan and "partial_kll" in plan


def test_a_long_flat_field_has_no_frequent_value(spark, tmp_path):
    orders = spark.range(240_000).select(
        F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit("F").alias("o_orderstatus"),
        (F.col("id") + 0.25).alias("o_totalprice"), F.lit("5-LOW").alias("o_orderpriority"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.field_id: r for r in all_queries.QUERIES["profile_states"](spark, str(tmp_path)).collect()}
    assert {k: (r.n, r.n_values, r.top_count) for k, r in got.items()} == {
        "o_orderstatus": (240_000, 1, 240_000), "o_orderpriority": (240_000, 1, 240_000),
        "o_custkey": (240_000, 240_000, None), "o_totalprice": (240_000, 240_000, None)}
    assert all(r.distinct_close and r.median_close for r in got.values())
