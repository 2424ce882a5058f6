"""Registered queries for value matching, evaluation reports and score metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as va
from ..operators import evaluate as ev
from ..operators import relational as rl
from .registry import query, rounded, table

# Literal pairs with the verdict of each variant; they are checked next to the table rows.
PAIRS = [
    ("1.0", "1", True, True, True), ("feb", "2", False, True, True), ("3.37", "3.3", False, True, True),
    ("hello", "hello", True, True, True), (None, None, True, True, True), ("42", "43", False, False, False),
    ("3.1415", "3.14", True, True, True), ("3.141", "3.142", True, False, True), ("monday", "1", False, True, True),
    ("Monday", "mon", False, True, True), ("monday", "tuesday", False, False, False), ("JAN", "january", False, True, True),
    ("7", "july", False, True, True), ("december", "12", False, True, True), ("", "0", False, False, False),
    ("abc", "123", False, False, False), ("8", "monday", False, False, False), ("13", "january", False, False, False),
    ("42", "42.9", False, True, True), ("thur", "thursday", False, True, True),
]


def _sql_text(x):
    return "NULL" if x is None else f"'{x}'"


PAIR_SQL = " UNION ALL ".join(
    f"SELECT CAST(-{i + 1} AS BIGINT) AS id, {_sql_text(a)} AS a, {_sql_text(b)} AS b, {v1} AS v1, {v2} AS v2, {v3} AS v3"
    for i, (a, b, v1, v2, v3) in enumerate(PAIRS))


@query("value_equal", oracle=f"""
SELECT * FROM ({PAIR_SQL})
UNION ALL SELECT o_orderkey, CAST(o_orderkey AS VARCHAR), CASE o_orderkey % 4 WHEN 0 THEN o_orderkey || '.0' WHEN 1 THEN o_orderkey || '.009'
    WHEN 2 THEN o_orderkey || '.5' ELSE CAST(o_orderkey + 1 AS VARCHAR) END,
  o_orderkey % 4 IN (0, 1), o_orderkey % 4 <> 3, o_orderkey % 4 <> 3 FROM orders""")
def value_equal(spark, sf):
    key = F.col("o_orderkey").cast("string")
    m = F.pmod("o_orderkey", F.lit(4))
    b = (F.when(m == 0, F.concat(key, F.lit(".0"))).when(m == 1, F.concat(key, F.lit(".009")))
         .when(m == 2, F.concat(key, F.lit(".5"))).otherwise((F.col("o_orderkey") + 1).cast("string")))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), key.alias("a"), b.alias("b"))
    literal = spark.createDataFrame([(-i - 1, p[0], p[1]) for i, p in enumerate(PAIRS)], "id bigint, a string, b string")
    both = literal.unionByName(rows)
    return both.select("id", "a", "b", *[va.values_equal(F.col("a"), F.col("b"), v).alias(v) for v in ("v1", "v2", "v3")])


def order_lists(spark, sf):
    """Per order: expected lists, and predictions that are exact, shuffled, close or off."""
    o = table(spark, sf, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    num = lambda c: c.cast("string")
    m = F.pmod("o_orderkey", F.lit(6))
    names = F.array(F.lit("Mon"), F.lit("Tue"), F.lit("Wed"))
    nums = F.array(num(k), num(k + 5), num(k + 9))
    near = F.array(F.concat(num(k + 9), F.lit(".004")), num(k), F.concat(num(k + 5), F.lit(".0")))
    predicted = (F.when(m == 0, F.array(names, nums)).when(m == 1, F.array(near, names, nums))
                 .when(m == 2, F.array(F.array(F.lit("Monday"), F.lit("wednesday"), F.lit("tue")), near))
                 .when(m == 3, F.array(names)).when(m == 4, F.array(F.array(F.lit("Wed"), F.lit("Tue"), F.lit("Mon")), near))
                 .otherwise(F.array(names, F.array(num(k), num(k + 5), num(k + 8)))))
    return o.select("o_orderkey", m.alias("m"), F.array(names, nums).alias("expected"), predicted.alias("predicted"))


@query("list_match", oracle="""
SELECT o_orderkey, o_orderkey % 6 IN (0, 1, 4) AS v1_bag, o_orderkey % 6 IN (0, 1, 4) AS v1_greedy, o_orderkey % 6 IN (0, 1) AS v1_ordered,
  CASE WHEN o_orderkey % 6 = 3 THEN FALSE WHEN o_orderkey = 5 THEN FALSE ELSE o_orderkey % 6 IN (0, 1, 2, 4) END AS v3_bag FROM orders""")
def list_match(spark, sf):
    rows = order_lists(spark, sf)
    e, p = F.col("expected"), F.col("predicted")
    return rows.select("o_orderkey", va.list_match(e, p).alias("v1_bag"),
                       va.list_match(e, p, pairing="greedy").alias("v1_greedy"),
                       va.list_match(e, p, True).alias("v1_ordered"),
                       va.list_match(e, p, False, "v3").alias("v3_bag"))


@query("table_recall", oracle="""
SELECT o_orderkey, o_orderkey % 3 <> 2 AS correct FROM orders""")
def table_recall(spark, sf):
    m = F.pmod("o_orderkey", F.lit(3))
    predicted = F.when(m == 0, F.array(F.lit("Orders.csv"), F.lit("NATION"), F.lit("extra"))).when(
        m == 1, F.array(F.lit("nation.CSV"), F.lit("orders"))).otherwise(F.array(F.lit("nation")))
    return table(spark, sf, "orders").select(
        "o_orderkey", rl.table_recall(predicted, F.array(F.lit("orders"), F.lit("Nation"))).alias("correct"))


@query("column_recall", oracle="""
SELECT o_orderkey, o_orderkey % 4 IN (0, 1) AS correct FROM orders""")
def column_recall(spark, sf):
    m = F.pmod("o_orderkey", F.lit(4))
    cols = lambda *names: F.array(*[F.lit(n) for n in names])
    predicted = (F.when(m == 0, F.create_map(F.lit("Orders.csv"), cols("O_KEY", "o_status"), F.lit("x"), cols("y")))
                 .when(m == 1, F.create_map(F.lit("orders"), cols("o_status", "o_key", "more")))
                 .when(m == 2, F.create_map(F.lit("orders"), cols("o_key")))
                 .otherwise(F.create_map(F.lit("lineitem"), cols("o_key", "o_status"))))
    truth = F.create_map(F.lit("ORDERS"), cols("o_key", "O_Status"))
    return table(spark, sf, "orders").select("o_orderkey", rl.column_recall(predicted, truth).alias("correct"))


def result_log(spark, sf):
    """Events as an evaluation log: a user is a run, the type is the hardness."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("case_id"), F.col("event_type").alias("hardness"),
        F.when(k % 19 == 0, "error").otherwise("success").alias("status"),
        (k % 2 == 0).alias("final_correct"), (k % 3 != 0).alias("table_correct"),
        F.when(k % 5 != 0, k % 4 == 0).alias("column_correct"), (k % 2 == 0).alias("correct"),
        F.round("value").cast("bigint").alias("tokens"))


LOG_SQL = """l AS (SELECT user_id AS run_id, event_id AS case_id, event_type AS hardness, k % 19 = 0 AS failed, k % 2 = 0 AS f, k % 3 <> 0 AS t,
  k % 5 <> 0 AND k % 4 = 0 AS c, CAST(round(value) AS BIGINT) AS tokens FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events))"""
REPORT_SQL = """count(*) AS total_cases, CAST(sum(CASE WHEN f THEN 1 ELSE 0 END) AS BIGINT) AS final_correct_cases,
  round(avg(CASE WHEN f THEN 1.0 ELSE 0.0 END), 6) AS final_accuracy, CAST(sum(CASE WHEN t THEN 1 ELSE 0 END) AS BIGINT) AS table_correct_cases,
  round(avg(CASE WHEN t THEN 1.0 ELSE 0.0 END), 6) AS table_accuracy, CAST(sum(CASE WHEN c THEN 1 ELSE 0 END) AS BIGINT) AS column_correct_cases,
  round(avg(CASE WHEN c THEN 1.0 ELSE 0.0 END), 6) AS column_accuracy, CAST(sum(tokens) AS BIGINT) AS total_tokens"""


@query("eval_summary", oracle=f"WITH {LOG_SQL} SELECT {REPORT_SQL} FROM l")
def eval_summary(spark, sf):
    return rounded(ev.summary(result_log(spark, sf)))


@query("eval_chunks", oracle=f"""
WITH {LOG_SQL}, n AS (SELECT *, (row_number() OVER (PARTITION BY run_id ORDER BY case_id) - 1) // 10 + 1 AS chunk_number FROM l)
SELECT run_id, chunk_number, {REPORT_SQL} FROM n GROUP BY run_id, chunk_number""")
def eval_chunks(spark, sf):
    return rounded(ev.chunk_reports(result_log(spark, sf), "run_id", "case_id", 10))


@query("eval_rollup", oracle=f"""
WITH {LOG_SQL}, n AS (SELECT *, (row_number() OVER (PARTITION BY run_id ORDER BY case_id) - 1) // 50 + 1 AS chunk_number FROM l)
SELECT CAST(run_id AS DOUBLE) AS run_id, CAST(chunk_number AS DOUBLE) AS chunk_number, {REPORT_SQL} FROM n GROUP BY ROLLUP (run_id, chunk_number)""")
def eval_rollup(spark, sf):
    out = rounded(ev.chunk_rollup(result_log(spark, sf), "run_id", "case_id", 50))
    return out.withColumns({c: F.col(c).cast("double") for c in ("run_id", "chunk_number")})


@query("eval_merge", oracle=f"""
WITH {LOG_SQL} SELECT count(*) AS total_cases, CAST(sum(CASE WHEN f THEN 1 ELSE 0 END) AS BIGINT) AS final_correct_cases,
  CAST(sum(tokens) AS BIGINT) AS total_tokens, round(avg(CASE WHEN f THEN 1.0 ELSE 0.0 END), 6) AS final_correct_cases_share,
  round(sum(tokens) / count(*), 4) AS total_tokens_share FROM l""")
def eval_merge(spark, sf):
    parts = ev.summary(result_log(spark, sf), by=["run_id"])
    return rounded(ev.merge_reports(parts, ["final_correct_cases", "total_tokens"]), total_tokens_share=4)


@query("eval_by_hardness", oracle=f"""
WITH {LOG_SQL} SELECT hardness, count(*) AS cases, CAST(sum(CASE WHEN f THEN 1 ELSE 0 END) AS BIGINT) AS correct_cases,
  round(avg(CASE WHEN f THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM l WHERE NOT failed GROUP BY hardness""")
def eval_by_hardness(spark, sf):
    return rounded(ev.by_hardness(result_log(spark, sf)))


@query("evaluate_cases", oracle="""
SELECT o_orderkey % 2 = 1 AS sorted_case, count(*) AS n, CAST(sum(CASE WHEN o_orderkey % 2 = 1 THEN (o_orderkey % 6 = 1)::INT ELSE (o_orderkey % 6 IN (0, 4))::INT END) AS BIGINT) AS final_hits,
  CAST(sum((o_orderkey % 6 <> 3)::INT) AS BIGINT) AS table_hits, CAST(sum((o_orderkey % 6 <> 5)::INT) AS BIGINT) AS column_hits FROM orders GROUP BY 1""")
def evaluate_cases(spark, sf):
    rows = order_lists(spark, sf)
    m = F.col("m")
    cases = rows.select(
        "m", "expected", "predicted", F.when(m % 2 == 1, "asc").alias("sort"),
        F.when(m == 3, F.array(F.lit("x"))).otherwise(F.array(F.lit("Orders.csv"))).alias("predicted_tables"),
        F.array(F.lit("orders")).alias("tables"),
        F.create_map(F.lit("orders.csv"), F.when(m == 5, F.array(F.lit("z"))).otherwise(F.array(F.lit("A")))).alias("predicted_columns"),
        F.create_map(F.lit("Orders"), F.array(F.lit("a"))).alias("columns"))
    judged = ev.evaluate_cases(cases)
    return judged.groupBy((m % 2 == 1).alias("sorted_case")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("final_correct").alias("final_hits"),
        F.count_if("table_correct").alias("table_hits"), F.count_if("column_correct").alias("column_hits"))


@query("reeval_flips", oracle="""
SELECT count(*) AS total_cases, CAST(sum((m IN (0, 1, 2, 4) AND NOT old)::INT) AS BIGINT) AS wrong_to_right,
  CAST(sum((m = 3 AND rescue AND NOT old)::INT) AS BIGINT) AS rescued_by_merge, CAST(sum((m IN (3, 5) AND old)::INT) AS BIGINT) AS right_to_wrong,
  CAST(sum((m IN (0, 1, 2, 4) OR (m = 3 AND rescue AND NOT old))::INT) AS BIGINT) AS correct_cases,
  round(avg((m IN (0, 1, 2, 4) OR (m = 3 AND rescue AND NOT old))::INT), 6) AS accuracy
FROM (SELECT o_orderkey % 6 AS m, o_orderstatus = 'F' AS old, o_orderpriority = '5-LOW' AS rescue FROM orders)""")
def reeval_flips(spark, sf):
    lists = order_lists(spark, sf)
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    rescue = F.col("o_orderpriority") == "5-LOW"
    # A rescued case predicts the long form of its classes; its own lists never match.
    merged = F.array(F.array(F.lit("MW"), F.lit("PW"), F.lit("MW"), F.lit("PW")), F.array(F.lit("3"), F.lit("4"), F.lit("1"), F.lit("2")),
                     F.array(F.lit("e"), F.lit("e"), F.lit("m"), F.lit("m")))
    wrong = F.array(F.array(F.lit("none")), F.array(F.lit("none")))
    joined = lists.join(o, "o_orderkey")
    results = joined.select(
        F.col("o_orderkey").cast("string").alias("data_id"), "expected",
        F.when(F.col("m") == 3, F.when(rescue, merged).otherwise(wrong)).otherwise(F.col("predicted")).alias("predicted"),
        (F.col("o_orderstatus") == "F").alias("correct"))
    dataset = o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.array(F.array(F.lit("MW"), F.lit("PW"))).alias("x_data"),
        F.array(F.array(F.lit("3"), F.lit("4")), F.array(F.lit("1"), F.lit("2"))).alias("y_data"),
        F.when(rescue, F.array(F.lit("e"), F.lit("m"))).alias("classify"))
    return rounded(ev.flip_counts(ev.reevaluate(results, dataset)))


@query("manual_corrections", oracle="""
SELECT count(*) AS total_cases, CAST(sum((k % 2 <> 0 AND k % 3 = 0)::INT) AS BIGINT) AS reviewed,
  CAST(sum((k % 2 = 0 OR k % 6 = 3 AND k % 4 < 3)::INT) AS BIGINT) AS correct_cases, round(avg((k % 2 = 0 OR k % 6 = 3 AND k % 4 < 3)::INT), 6) AS accuracy
FROM (SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)""")
def manual_corrections(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    log = table(spark, sf, "events").select(F.col("event_id").alias("data_id"), (k % 2 == 0).alias("correct"), k.alias("k"))
    notes = log.where((F.col("k") % 2 != 0) & (F.col("k") % 3 == 0)).select(
        "data_id", F.when(F.col("k") % 4 < 3, "format").otherwise("keep").alias("reason"))
    return rounded(ev.corrected_accuracy(log.drop("k"), notes))


@query("rekey_results", oracle="""
WITH d AS (SELECT event_type, user_id, min(event_id) AS data_id FROM events GROUP BY ALL)
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(data_id AS VARCHAR) END AS data_id
FROM orders JOIN d ON event_type = 'view' AND user_id = o_orderkey % 10""")
def rekey_results(spark, sf):
    dataset = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.array("event_type").alias("nl_queries"),
        F.array(F.col("user_id").cast("string")).alias("irrelevant_tables"))
    odd = F.pmod("o_orderkey", F.lit(7)) == 0
    results = table(spark, sf, "orders").select(
        "o_orderkey", F.array(F.when(odd, "nobody asked").otherwise("view")).alias("nl_queries"),
        F.array((F.col("o_orderkey") % 10).cast("string")).alias("irrelevant_tables"))
    found, missing = rl.rekey_results(results, dataset)
    return found.select("o_orderkey", F.col("data_id").cast("string").alias("data_id")).unionByName(
        missing.select("o_orderkey", F.lit(None).cast("string").alias("data_id")))


@query("chart_rank_eval", oracle="""
WITH c AS (SELECT o_custkey, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, p) AS rk, count(*) OVER (PARTITION BY o_custkey) AS len FROM c),
v AS (SELECT i.o_custkey, i.o_custkey % 13 = 0 AS failed, coalesce(r.rk, i.len + 1) AS rk, r.rk <= 2 AS found FROM (SELECT o_custkey, max(len) AS len FROM r GROUP BY 1) i
  LEFT JOIN r ON r.o_custkey = i.o_custkey AND r.p = CASE i.o_custkey % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '5-LOW' ELSE 'NONE' END)
SELECT count(*) AS total_cases, CAST(sum((NOT failed)::INT) AS BIGINT) AS success_cases, CAST(sum((NOT failed AND rk = 1)::INT) AS BIGINT) AS correct_cases,
  CAST(sum((NOT failed AND coalesce(found, FALSE))::INT) AS BIGINT) AS hit2_cases, round(avg((NOT failed AND rk = 1)::INT), 6) AS accuracy, round(avg((NOT failed AND coalesce(found, FALSE))::INT), 6) AS hit_at_2,
  CAST(sum(CASE WHEN failed THEN 0 ELSE rk END) AS BIGINT) AS total_rank, round(sum(CASE WHEN failed THEN 0 ELSE rk END) / sum((NOT failed)::INT), 6) AS mean_rank FROM v""")
def chart_rank_eval(spark, sf):
    counts = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    # One entry per priority code, five at most.
    ranked = counts.groupBy("o_custkey").agg(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "o_orderpriority"))),
        lambda s: s["o_orderpriority"]).alias("predicted"))
    m = F.pmod("o_custkey", F.lit(3))
    cases = ranked.select(
        "o_custkey", F.when(F.pmod("o_custkey", F.lit(13)) != 0, F.col("predicted"))
        .otherwise(F.array().cast("array<string>")).alias("predicted"),
        F.when(m == 0, "1-URGENT").when(m == 1, "5-LOW").otherwise("NONE").alias("expected"))
    return rounded(ev.rank_summary(ev.rank_cases(cases)))


def class_scores(spark, sf):
    """Embeddings with probabilities of their classes, from the likeness to each class's mean vector."""
    e = table(spark, sf, "embeddings")
    means = (e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
             .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("mean")).orderBy("label").collect())
    # One vector per class: fitted parameters.
    centers = F.array(*[F.array(*[F.lit(x.m) for x in r["mean"]]) for r in means])
    likeness = F.transform(centers, lambda c: F.exp(F.aggregate(
        F.zip_with(F.col("embedding"), c, lambda v, m: v.cast("double") * m), F.lit(0.0), lambda t, x: t + x)))
    scored = e.select("vec_id", "label", likeness.alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    return scored.select("vec_id", "label", F.transform("p", lambda x: x / total).alias("probability"))


SCORE_SQL = """x AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
m AS (SELECT label AS cls, i, avg(v) AS m FROM x GROUP BY label, i),
s AS (SELECT vec_id, any_value(label) AS label, cls, exp(sum(v * m)) AS e FROM x JOIN m USING (i) GROUP BY vec_id, cls),
p AS (SELECT vec_id, label, cls, e / sum(e) OVER (PARTITION BY vec_id) AS prob FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, cls) - 1 AS rk FROM p)"""


@query("rank_metrics", oracle=f"""
WITH {SCORE_SQL} SELECT round(avg((rk = 0)::INT), 6) AS acc, round(avg((rk = 0)::INT), 6) AS hit_at_1, round(avg((rk <= 1)::INT), 6) AS hit_at_2,
  round(avg(rk) + 1, 6) AS "MR" FROM r WHERE cls = label""")
def rank_metrics(spark, sf):
    return rounded(ev.rank_metrics(class_scores(spark, sf), "probability", "label"))


@query("topk_classes", oracle=f"""
WITH {SCORE_SQL}, n AS (SELECT vec_id, rk, CASE WHEN cls < 8 THEN 'class_' || cls ELSE 'unknown' END AS name, prob FROM r)
SELECT a.vec_id, a.name AS predicted_trace_type, round(a.prob, 6) AS confidence, a.name AS top1_type, round(a.prob, 6) AS top1_prob,
  b.name AS top2_type, round(b.prob, 6) AS top2_prob FROM n a JOIN n b ON a.vec_id = b.vec_id WHERE a.rk = 0 AND b.rk = 1""")
def topk_classes(spark, sf):
    labels = F.array(*[F.lit(f"class_{i}") for i in range(8)])
    return rounded(ev.top_k(class_scores(spark, sf), "probability", labels).drop("probability", "label"))


@query("macro_prf", oracle="""
WITH x AS (SELECT d.source, CASE WHEN least(n_chars, 4000) / 4000.0 > 0.5 THEN 1 ELSE 0 END AS p, l.quality AS y FROM labels l JOIN documents d USING (doc_id)
  UNION ALL SELECT d.source, CASE WHEN 1 - least(n_chars, 4000) / 4000.0 > 0.5 THEN 1 ELSE 0 END, l.toxic FROM labels l JOIN documents d USING (doc_id)),
c AS (SELECT source, CAST(sum(p * y) AS DOUBLE) AS tp, CAST(sum((1-p) * (1-y)) AS DOUBLE) AS tn, CAST(sum(p * (1-y)) AS DOUBLE) AS fp, CAST(sum((1-p) * y) AS DOUBLE) AS fn FROM x GROUP BY source),
h AS (SELECT *, (tp + fp + fn > 0)::INT AS h1, (tn + fp + fn > 0)::INT AS h0 FROM c)
SELECT source, round((coalesce(tp / nullif(tp + fp, 0), 0) * h1 + coalesce(tn / nullif(tn + fn, 0), 0) * h0) / (h1 + h0), 6) AS "precision",
  round((coalesce(tp / nullif(tp + fn, 0), 0) * h1 + coalesce(tn / nullif(tn + fp, 0), 0) * h0) / (h1 + h0), 6) AS recall,
  round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) * h1 + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) * h0) / (h1 + h0), 6) AS f1,
  round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM h""")
def macro_prf(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    s = F.least("n_chars", F.lit(4000)) / 4000.0
    rows = table(spark, sf, "labels").join(d, "doc_id").select(
        "source", F.array(s, 1 - s).alias("scores"), F.array("quality", "toxic").alias("truth"))
    long = rows.select("source", F.explode(F.arrays_zip("scores", "truth")).alias("z")).select(
        "source", F.col("z.scores").alias("score"), F.col("z.truth").alias("y"))
    return rounded(ev.macro_scores(long, by=["source"]))


@query("bce", oracle="""
WITH x AS (SELECT d.lang, (n_chars % 2000 - 1000) / 250.0 AS x, l.quality AS y FROM labels l JOIN documents d USING (doc_id))
SELECT lang, round(avg(greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))), 6) AS loss FROM x GROUP BY lang""")
def bce(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", ((F.col("n_chars") % 2000 - 1000) / 250.0).alias("x"))
    rows = table(spark, sf, "labels").join(d, "doc_id")
    return rounded(rows.groupBy("lang").agg(ev.logit_loss(F.col("x"), F.col("quality")).alias("loss")))


@query("class_distribution", oracle="SELECT quality, count(*) AS n FROM labels GROUP BY quality")
def class_distribution(spark, sf):
    return ev.class_distribution(table(spark, sf, "labels"), "quality")


@query("argmax_accuracy", oracle=f"""
WITH {SCORE_SQL}, t AS (SELECT vec_id, label, cls AS a FROM r WHERE rk = 0),
w AS (SELECT vec_id, (sum(v) FILTER (i > 32) > sum(v) FILTER (i <= 32))::INT AS a2 FROM x GROUP BY vec_id)
SELECT round(avg((a2 = label % 2)::INT), 6) AS xy, round(avg((a = label)::INT), 6) AS trace, round((avg((a2 = label % 2)::INT) + avg((a = label)::INT)) / 2, 6) AS avg
FROM t JOIN w USING (vec_id)""")
def argmax_accuracy(spark, sf):
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, v: t + v.cast("double"))
    halves = table(spark, sf, "embeddings").select("vec_id", F.array(total(F.slice("embedding", 1, 32)), total(F.slice("embedding", 33, 32))).alias("pr"))
    hot = lambda n, c: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == c, 1.0).otherwise(0.0))
    rows = class_scores(spark, sf).join(halves, "vec_id").select(
        F.col("probability").alias("ps"), "pr", hot(10, F.col("label")).alias("ys"), hot(2, F.col("label") % 2).alias("yr"))
    return rounded(ev.argmax_accuracy(rows, {"xy": ("pr", "yr"), "trace": ("ps", "ys")}))
