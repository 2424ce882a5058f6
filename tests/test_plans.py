"""Shapes of the physical plans: what must never appear, and what must be pushed down."""

import pytest

from colscope.operators import profile as pr
from colscope.operators import prompts, ranking
from colscope.plans import corpus_queries, flows, profile_queries
from colscope.plans.all_queries import QUERIES
from colscope.session import materialize

MODELS = {"train_type_model", "train_boosted_type_model", "predict_types", "train_axis_model", "train_network", "param_search", "importances", "score_unlabeled"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - MODELS))
def test_no_cross_join_and_no_global_window(spark, sf, name, monkeypatch):
    plans = []

    def recording(df, label="stage"):
        plans.append(plan_of(df))
        return materialize(df, label)

    for module in (pr, ranking, flows, corpus_queries, profile_queries):
        monkeypatch.setattr(module, "materialize", recording)
    plans.append(plan_of(QUERIES[name](spark, sf)))
    for plan in plans:
        assert "CartesianProduct" not in plan
        assert "BroadcastNestedLoopJoin" not in plan
        lines = plan.splitlines()
        for above, below in zip(lines, lines[1:]):
            assert not ("Sort [" in above and "Exchange SinglePartition" in below)


def test_filters_and_columns_reach_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_suppkey < 5")
    from colscope.sources.cells import numeric_values
    plan = plan_of(pr.value_totals(pr.value_histogram(numeric_values(df, ["l_tax"]), ["field_id"]), ["field_id"]))
    assert "PushedFilters: [IsNotNull(l_suppkey), LessThan(l_suppkey,5)]" in plan
    assert "l_extendedprice" not in plan


def test_histogram_combines_before_the_shuffle(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    from colscope.sources.cells import table_cells
    plan = plan_of(pr.raw_histogram(table_cells(df, ["o_orderstatus"], "o_orderkey")))
    assert "partial_count" in plan


def test_first_steps_hash_instead_of_sorting(spark, sf):
    from colscope.operators import relational as rl
    from colscope.operators.prompts import column_examples
    from colscope.sources.cells import table_cells
    cells = table_cells(spark.read.parquet(f"{sf}/orders.parquet"), ["o_orderstatus"], "o_orderkey")
    hist = pr.raw_histogram(cells)
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (hist, pr.field_basics(hist), column_examples(cells), rl.keep_first(documents, ["text"], "doc_id")):
        assert "HashAggregate" in plan_of(df) and "SortAggregate" not in plan_of(df)
    # Texts are compared as digests, and cross a shuffle only with their chosen row.
    assert "hashpartitioning(text" not in plan_of(rl.keep_first(documents, ["text"], "doc_id"))


@pytest.mark.parametrize("n", [103, 5000])
def test_samples_have_one_plan_at_every_size(spark, sf, n):
    from colscope.operators import sampling as sm
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type")
    shapes = []
    for size in (3, n):
        plan = plan_of(sm.stratified_sample(events, size, "event_type", "event_id"))
        assert "SinglePartition" not in plan and "Limit" not in plan
        shapes.append([line.strip(" :+-*()0123456789").split(" ")[0].split("(")[0] for line in plan.splitlines()])
    assert shapes[0] == shapes[1] and plan.count("events.parquet") == 1


def test_corpus_parse_stays_below_filters(spark, sf):
    raw = corpus_queries.event_charts(corpus_queries.events(spark, sf))
    plan = plan_of(corpus_queries.co.clean_corpus(corpus_queries.co.parse_corpus(raw)))
    assert plan.count("from_json(StructField(r,ArrayType") == 1


def test_stub_model_is_serializable():
    import pickle

    from colscope.plans.text_queries import stub_model
    assert pickle.loads(pickle.dumps(stub_model))("a b")["tokens"] == 3
    assert prompts.CHART_TYPES[0] == "Bar"
