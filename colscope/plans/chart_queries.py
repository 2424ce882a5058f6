"""Registered queries for chart data and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts as ch
from ..operators import models as ml
from ..operators import sampling as sm
from ..session import materialize
from .registry import query, rounded, table


@query("chart_data_month", oracle="""
WITH c AS (SELECT month(o_orderdate) AS k, count(*) AS y FROM orders GROUP BY 1)
SELECT ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][k] AS x, y, row_number() OVER (ORDER BY k) - 1 AS ord FROM c""")
def chart_data_month(spark, sf):
    return ch.sort_chart(ch.chart_data(table(spark, sf, "orders"), "o_orderdate", bin="month"), None).select("x", "y", "ord")


@query("chart_data_weekday", oracle="""
WITH c AS (SELECT isodow(l_shipdate) AS k, round(avg(l_quantity), 4) AS y, avg(l_quantity) AS raw FROM lineitem GROUP BY 1)
SELECT ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][k] AS x, y, row_number() OVER (ORDER BY raw DESC, k) - 1 AS ord FROM c""")
def chart_data_weekday(spark, sf):
    points = ch.chart_data(table(spark, sf, "lineitem"), "l_shipdate", "l_quantity", "avg", "weekday")
    return rounded(ch.sort_chart(points, "y_desc").select("x", "y", "ord"), 4)


@query("chart_data_text_desc", oracle="""
WITH c AS (SELECT strftime(o_orderdate, '%Y-%m') AS x, o_orderpriority AS "class", count(*) AS y FROM orders GROUP BY ALL)
SELECT x, "class", y, row_number() OVER (ORDER BY x DESC, "class") - 1 AS ord FROM c""")
def chart_data_text_desc(spark, sf):
    points = ch.chart_data(table(spark, sf, "orders"), "o_orderdate", bin="year_month", classify="o_orderpriority")
    return ch.sort_chart(points, "x_desc").select("x", "class", "y", "ord")


@query("chart_data_grouped", oracle="""
SELECT n.n_name AS x, c_mktsegment AS "class", round(sum(CASE WHEN c_custkey % 6 = 0 THEN 0 ELSE c_acctbal END), 2) AS y
FROM customer JOIN nation n ON c_nationkey = n_nationkey GROUP BY ALL""")
def chart_data_grouped(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.withColumn("bal", F.when(F.col("c_custkey") % 6 != 0, F.col("c_acctbal")))
    return rounded(ch.chart_data(c, "n_name", "bal", "sum", classify="c_mktsegment", fill=0.0).drop("x_key"), 2)


@query("chart_lists", oracle="""
WITH c AS (SELECT strftime(o_orderdate, '%Y-%m') AS x, o_orderpriority AS g, count(*) AS y FROM orders GROUP BY ALL),
o AS (SELECT *, row_number() OVER (ORDER BY x, g) - 1 AS ord FROM c)
SELECT CAST(ord // 100 AS INTEGER) AS segment, string_agg(x, ',' ORDER BY ord) AS x_data, string_agg(CAST(y AS VARCHAR), ',' ORDER BY ord) AS y_data,
  string_agg(g, ',' ORDER BY ord) AS classify FROM o GROUP BY 1""")
def chart_lists(spark, sf):
    points = ch.chart_data(table(spark, sf, "orders"), "o_orderdate", bin="year_month", classify="o_orderpriority")
    lists = ch.chart_lists(ch.sort_chart(points, None), 100)
    join = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c)
    return lists.select("segment", join("x_data"), join("y_data"), join("classify"))


DIMS = [f"d{i}" for i in range(64)]
BLOCKS = 4
SPLIT = {share: round(share * (1 << 32)) for share in (0.7, 0.8)}


def vectors(spark, sf):
    """All 64 values of each embedding; the class is the block of 16 values with the largest sum.

    The given labels do not depend on the vectors, so no model of them could beat the majority.
    """
    e = table(spark, sf, "embeddings")
    sums = F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda b: F.aggregate(
        F.slice("embedding", b * 16 + 1, 16), F.lit(0.0), lambda t, v: t + v.cast("double")))
    wide = e.select("vec_id", F.concat(F.lit("class_"), (F.array_position(sums, F.array_max(sums)) - 1).cast("string")).alias("trace_type"),
                    *[F.get("embedding", F.lit(i)).cast("double").alias(d) for i, d in enumerate(DIMS)])
    return materialize(sm.assign_split(wide, "vec_id", {"train": 0.8, "test": 0.2}, "ml"), "vectors")


VECTOR_SQL = f"""s AS (SELECT vec_id, b, sum(CAST(embedding[i] AS DOUBLE) ORDER BY i) AS t FROM embeddings, (SELECT unnest(range(1, 65)) AS i), LATERAL (SELECT (i - 1) // 16 AS b) GROUP BY vec_id, b),
v AS (SELECT vec_id, 'class_' || arg_max(b, t) AS trace_type, ('0x' || substr(md5('ml' || CAST(vec_id AS VARCHAR)), 1, 8))::BIGINT >= {SPLIT[0.8]} AS test FROM s GROUP BY vec_id)"""


def facts(model, test):
    """What must hold of a scored test set, beside its size and the share of its commonest class."""
    scored = ml.predict(model, test)
    n, hits = F.count(F.lit(1)), F.count_if(F.col("predicted_trace_type") == F.col("trace_type"))
    total = F.aggregate("probability", F.lit(0.0), lambda t, p: t + p)
    most = test.groupBy("trace_type").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return rounded(scored.agg(
        n.alias("tested"), F.countDistinct("trace_type").alias("classes"), (F.lit(most) / n).alias("majority"),
        F.bool_and(F.abs(total - 1) < 1e-6).alias("sums_to_one"), F.bool_and(F.col("top1_prob") >= F.col("top2_prob")).alias("ranked"),
        (hits > most).alias("beats_majority")))


FACTS_SQL = """SELECT count(*) AS tested, count(DISTINCT trace_type) AS classes, round((SELECT max(n) FROM (SELECT count(*) AS n FROM v WHERE test GROUP BY trace_type)) / count(*), 6) AS majority,
  TRUE AS sums_to_one, TRUE AS ranked, TRUE AS beats_majority FROM v WHERE test"""


@query("train_type_model", oracle=f"WITH {VECTOR_SQL} {FACTS_SQL}")
def train_type_model(spark, sf):
    v = vectors(spark, sf)
    return facts(ml.train_type_model(v.where("split = 'train'"), DIMS), v.where("split = 'test'"))


@query("train_boosted_type_model", oracle=f"WITH {VECTOR_SQL} {FACTS_SQL}")
def train_boosted_type_model(spark, sf):
    v = vectors(spark, sf)
    return facts(ml.train_boosted_type_model(v.where("split = 'train'"), DIMS), v.where("split = 'test'"))


@query("predict_types", oracle=f"""
WITH {VECTOR_SQL} SELECT vec_id, trace_type, TRUE AS known, TRUE AS confident FROM v WHERE test""")
def predict_types(spark, sf):
    v = vectors(spark, sf)
    out = ml.predict(ml.train_type_model(v.where("split = 'train'"), DIMS), v.where("split = 'test'"))
    names = [f"class_{b}" for b in range(BLOCKS)]
    return out.select("vec_id", "trace_type", (F.col("predicted_trace_type").isin(*names) & (F.col("predicted_trace_type") == F.col("top1_type"))).alias("known"),
                      ((F.col("confidence") == F.col("top1_prob")) & (F.col("top1_prob") >= F.col("top2_prob")) & (F.col("top1_prob") > 1 / BLOCKS - 1e-9)).alias("confident"))


@query("train_axis_model", oracle=f"""
WITH r AS (SELECT CASE WHEN l_quantity * 1000 > l_extendedprice / 2 THEN 'x' ELSE 'y' END AS role,
  ('0x' || substr(md5('axis' || CAST(l_orderkey AS VARCHAR)), 1, 8))::BIGINT >= {SPLIT[0.7]} AS test FROM lineitem)
SELECT count(*) AS tested, round(greatest(avg((role = 'x')::INT), avg((role = 'y')::INT)), 6) AS majority, TRUE AS beats_majority, TRUE AS follows_rule FROM r WHERE test""")
def train_axis_model(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = li.select("l_orderkey", F.when(F.col("l_quantity") * 1000 > F.col("l_extendedprice") / 2, "x").otherwise("y").alias("is_x_or_y"),
                     "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    rows = materialize(sm.assign_split(rows, "l_orderkey", {"train": 0.7, "test": 0.3}, "axis"), "axis")
    model = ml.train_axis_model(rows.where("split = 'train'"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    x = F.avg((F.col("is_x_or_y") == "x").cast("double"))
    scored = ml.score(model, rows.where("split = 'test'"))
    right = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    return rounded(scored.agg(F.count(F.lit(1)).alias("tested"), F.greatest(x, 1 - x).alias("majority"), (right >= F.greatest(x, 1 - x)).alias("beats_majority"),
                               (right >= 0.9).alias("follows_rule")))  # the role is a rule over two of the columns


@query("train_network", oracle=f"WITH {VECTOR_SQL} {FACTS_SQL}")
def train_network(spark, sf):
    v = vectors(spark, sf)
    return facts(ml.train_network(v.where("split = 'train'"), DIMS, BLOCKS), v.where("split = 'test'"))


@query("param_search", oracle="SELECT unnest([1.0, 2.0, 3.0, 4.0])::DOUBLE AS param, TRUE AS in_range, TRUE AS best_is_best")
def param_search(spark, sf):
    values = [int(v) for v in ml.value_range(1, 5, 1)]
    v = vectors(spark, sf)
    found = ml.parameter_search(v.where("split = 'train'"), DIMS, "trace_type", "maxDepth", values)
    scores = materialize(ml.search_table(found, values, v.where("split = 'test'")), "search")
    best = ml.best_parameter(scores).first()
    return scores.select("param", F.col("acc").between(0, 1).alias("in_range"), (F.col("acc") <= best.acc).alias("best_is_best"))


@query("importances", oracle="SELECT 5 AS listed, TRUE AS positive, TRUE AS falling")
def importances(spark, sf):
    model = ml.train_type_model(vectors(spark, sf), DIMS)
    top = ml.top_importances(ml.importances(spark, model, DIMS), 5)
    packed = F.collect_list("importance")
    return top.agg(F.count(F.lit(1)).cast("int").alias("listed"), F.bool_and(F.col("importance") > 0).alias("positive"),
                   (F.sort_array(packed, False) == packed).alias("falling"))
