"""Registered profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as fn
from ..operators import profile as pr
from ..operators import state as st
from ..session import materialize, scratch_path
from ..sources.cells import numeric_values, table_cells
from .registry import query, rounded, table

LINE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FIELD = ["field_id"]


def unpivot_sql(tbl: str, cols: list[str], cast: str = "DOUBLE", extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS field_id, CAST({c} AS {cast}) AS v{extra} FROM {tbl}" for c in cols)


LINE = unpivot_sql("lineitem", LINE_COLS)


def line_hist(spark, sf):
    rows = numeric_values(table(spark, sf, "lineitem"), LINE_COLS)
    return pr.stage_values(pr.value_histogram(rows, FIELD), FIELD)


# Quantile probabilities of both scales; stated twice here because the check
# must not share code with what it checks.
Q_REF = (0.0001, 0.0025, 0.0075, 0.0099)
Q_QUART = (0.01, 0.25, 0.75, 0.99)


@query("profile_basic", oracle=f"""
WITH c AS ({unpivot_sql('orders', ['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_orderpriority'], 'VARCHAR')}),
m AS (SELECT field_id, CASE WHEN v IN ('F', '1-URGENT', '7') THEN NULL ELSE v END AS v FROM c)
SELECT field_id, count(*) AS length, TRUE AS "exists", FALSE AS is_only_field,
       CAST(sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS num_none,
       round(sum(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) / count(*), 6) AS percentage_none,
       max(CASE WHEN v IS NULL THEN 1 ELSE 0 END) = 1 AS has_none
FROM m GROUP BY field_id""")
def profile_basic(spark, sf):
    cells = table_cells(table(spark, sf, "orders"),
                        ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], "o_orderkey", "orders")
    blanked = cells.withColumn("raw", F.when(~F.col("raw").isin("F", "1-URGENT", "7"), F.col("raw")))
    out = pr.only_field(pr.field_basics(materialize(pr.raw_histogram(blanked), "hist")))
    return rounded(out.select("field_id", "length", "exists", "is_only_field",
                              "num_none", "percentage_none", "has_none"))


VOTE_SQL = """
votes AS (SELECT field_id, v,
  CASE WHEN v IS NOT NULL AND v <> '' THEN 1 ELSE 0 END AS s,
  CASE WHEN v <> '' AND regexp_full_match(v, '(0|-?[1-9][0-9]*)') THEN 4 ELSE 0 END AS i,
  CASE WHEN v <> '' AND regexp_full_match(v, '(?i)\\s*[+-]?((([0-9][0-9_]*(\\.[0-9_]*)?)|(\\.[0-9][0-9_]*))(e[+-]?[0-9][0-9_]*)?|inf|infinity|s?nan[0-9]*)\\s*') THEN 3 ELSE 0 END AS d,
  CASE WHEN v <> '' AND regexp_matches(v, '^[0-9]{1,4}[-/.\\s]\\S+[-/.\\s]\\S+') THEN 2 ELSE 0 END AS t
  FROM c),
sums AS (SELECT field_id, CAST(1 + sum(s) AS BIGINT) AS score_string, CAST(sum(i) AS BIGINT) AS score_integer,
  CAST(sum(d) AS BIGINT) AS score_decimal, CAST(sum(t) AS BIGINT) AS score_time FROM votes GROUP BY field_id),
typed AS (SELECT *, CASE WHEN score_string >= greatest(score_integer, score_decimal, score_time) THEN 'string'
  WHEN score_integer >= greatest(score_decimal, score_time) THEN 'integer'
  WHEN score_decimal >= score_time THEN 'decimal' ELSE 'time' END AS data_type FROM sums)"""


@query("profile_types", oracle=f"""
WITH c AS ({unpivot_sql('orders', ['o_orderkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority'], 'VARCHAR')}
  UNION ALL {unpivot_sql('part', ['p_name', 'p_brand', 'p_size', 'p_retailprice'], 'VARCHAR')}), {VOTE_SQL}
SELECT field_id, score_string, score_integer, score_decimal, score_time, data_type,
  CASE data_type WHEN 'string' THEN 'c' WHEN 'time' THEN 't' ELSE 'q' END AS general_type FROM typed""")
def profile_types(spark, sf):
    a = table_cells(table(spark, sf, "orders"),
                    ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], "o_orderkey", "orders")
    b = table_cells(table(spark, sf, "part"), ["p_name", "p_brand", "p_size", "p_retailprice"], "p_partkey", "part")
    out = pr.field_basics(pr.raw_histogram(a.unionByName(b)))
    return out.select("field_id", "score_string", "score_integer", "score_decimal", "score_time",
                      "data_type", "general_type")


@query("profile_uniqueness", oracle=f"""
WITH c AS ({unpivot_sql('orders', ['o_orderkey', 'o_custkey', 'o_orderpriority'], 'VARCHAR')}
  UNION ALL {unpivot_sql('part', ['p_name', 'p_size'], 'VARCHAR')}
  UNION ALL {unpivot_sql('customer', ['c_name', 'c_mktsegment'], 'VARCHAR')})
SELECT field_id, count(DISTINCT v) AS num_unique_elements, round(count(DISTINCT v) / count(v), 6) AS unique_percent,
  count(DISTINCT v) = count(v) AS is_unique, count(DISTINCT v) / count(v) >= 0.95 AS is_unique_list
FROM c GROUP BY field_id""")
def profile_uniqueness(spark, sf):
    cells = table_cells(table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderpriority"])
    for name, cols in (("part", ["p_name", "p_size"]), ("customer", ["c_name", "c_mktsegment"])):
        cells = cells.unionByName(table_cells(table(spark, sf, name), cols))
    return rounded(pr.uniqueness(pr.value_histogram(cells, FIELD, "raw"), FIELD))


@query("profile_categorical", oracle=f"""
WITH c AS ({unpivot_sql('part', ['p_name', 'p_type'], 'VARCHAR')}
  UNION ALL {unpivot_sql('customer', ['c_name', 'c_mktsegment'], 'VARCHAR')}
  UNION ALL {unpivot_sql('events', ['event_type', 'props'], 'VARCHAR')}),
h AS (SELECT field_id, v, count(*) AS cnt FROM c GROUP BY field_id, v),
n AS (SELECT field_id, sum(cnt) AS n, max(cnt) AS mode FROM h GROUP BY field_id),
e AS (SELECT h.field_id, -sum(h.cnt / n.n * ln(h.cnt / n.n)) AS list_entropy, max(n.mode / n.n) AS percentage_of_mode
  FROM h JOIN n USING (field_id) GROUP BY h.field_id)
SELECT c.field_id, round(max(e.list_entropy), 6) AS list_entropy, round(max(e.percentage_of_mode), 6) AS percentage_of_mode,
  round(avg(length(v)), 6) AS mean_value_length, round(quantile_cont(CAST(length(v) AS DOUBLE), 0.5), 6) AS median_value_length,
  CAST(min(length(v)) AS DOUBLE) AS min_value_length, CAST(max(length(v)) AS DOUBLE) AS max_value_length,
  round(stddev_pop(length(v)), 6) AS std_value_length
FROM c JOIN e ON c.field_id = e.field_id GROUP BY c.field_id""")
def profile_categorical(spark, sf):
    cells = table_cells(table(spark, sf, "part"), ["p_name", "p_type"])
    for name, cols in (("customer", ["c_name", "c_mktsegment"]), ("events", ["event_type", "props"])):
        cells = cells.unionByName(table_cells(table(spark, sf, name), cols))
    return rounded(pr.categorical_stats(pr.raw_histogram(cells, FIELD), FIELD))


@query("profile_numeric", oracle=f"""
WITH c AS ({LINE}),
q AS (SELECT field_id, count(v) AS n, avg(v) AS mean, quantile_cont(v, 0.5) AS median, var_pop(v) AS var,
  stddev_pop(v) AS std, min(v) AS lo, max(v) AS hi, sum(abs(v)) AS s,
  sum(CASE WHEN v = 0 THEN 0 ELSE abs(v) * ln(abs(v)) END) AS xl,
  quantile_cont(v, 0.0025) AS q25, quantile_cont(v, 0.0075) AS q75 FROM c GROUP BY field_id)
SELECT field_id, n, round(mean, 5) AS mean, round(median, 6) AS median, round(var / 1000000, 6) AS var_millions,
  round(std, 5) AS std, lo AS "min", hi AS "max", round(hi - lo, 6) AS "range", round(mean / hi, 6) AS normalized_mean,
  round(median / hi, 6) AS normalized_median, round((hi - lo) / mean, 6) AS normalized_range,
  round(var / mean, 4) AS coeff_var, round(ln(s) - xl / s, 6) AS entropy,
  round(q25, 6) AS q25, round(q75, 6) AS q75, round((q75 - q25) / nullif(q75 + q25, 0), 6) AS quant_coeff_disp FROM q""")
def profile_numeric(spark, sf):
    hist = line_hist(spark, sf)
    totals = pr.value_totals(hist, FIELD)
    stats = (totals.join(pr.centered_stats(hist, totals, FIELD), FIELD)
             .join(pr.order_stats(pr.ranked_values(hist, FIELD), FIELD), FIELD))
    span = F.col("max") - F.col("min")
    out = stats.select(
        "field_id", "n", "mean", "median", (F.col("var") / 1000000).alias("var_millions"), "std", "min", "max",
        span.alias("range"), F.try_divide("mean", "max").alias("normalized_mean"),
        F.try_divide("median", "max").alias("normalized_median"), F.try_divide(span, "mean").alias("normalized_range"),
        F.try_divide("var", "mean").alias("coeff_var"), "entropy", "q25", "q75", "quant_coeff_disp")
    return rounded(out, mean=5, std=5, coeff_var=4)


@query("profile_dispersion", oracle=f"""
WITH c AS ({LINE}),
q AS (SELECT field_id, quantile_cont(v, 0.5) AS med, avg(v) AS mean, min(v) AS lo, max(v) AS hi, var_pop(v) AS var,
  quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.75) AS q75 FROM c GROUP BY field_id)
SELECT c.field_id, round(quantile_cont(abs(v - med), 0.5), 6) AS v_madm, round(avg(abs(v - mean)), 5) AS avg_abs_dev,
  max(lo) AS v_min, round(max(med), 6) AS v_median, max(hi) AS v_max, round(max(var / mean), 4) AS v_cv,
  round(max((q75 - q25) / nullif(q75 + q25, 0)), 6) AS v_qcd, round(max((hi - lo) / hi), 6) AS v_normalized_field_length_range
FROM c JOIN q ON c.field_id = q.field_id GROUP BY c.field_id""")
def profile_dispersion(spark, sf):
    hist = line_hist(spark, sf)
    vector = pr.summary_vector(hist, "v", FIELD, "quartile").drop("v_mean", "v_var")
    return rounded(vector.withColumnRenamed("v_avg_abs_dev", "avg_abs_dev"), avg_abs_dev=5, v_cv=4)


@query("profile_gini", oracle=f"""
WITH c AS ({unpivot_sql('orders', ['o_totalprice'])} UNION ALL {unpivot_sql('customer', ['c_acctbal'])}),
s AS (SELECT field_id, v - CASE WHEN min(v) OVER (PARTITION BY field_id) < 0 THEN min(v) OVER (PARTITION BY field_id) ELSE 0 END + 1e-7 AS x FROM c),
r AS (SELECT field_id, x, row_number() OVER (PARTITION BY field_id ORDER BY x) AS i, count(*) OVER (PARTITION BY field_id) AS n FROM s)
SELECT field_id, round(sum((2 * i - n - 1) * x) / (max(n) * sum(x)), 6) AS gini FROM r GROUP BY field_id""")
def profile_gini(spark, sf):
    rows = (numeric_values(table(spark, sf, "orders"), ["o_totalprice"])
            .unionByName(numeric_values(table(spark, sf, "customer"), ["c_acctbal"])))
    ranked = pr.ranked_values(pr.stage_values(pr.value_histogram(rows, FIELD), FIELD), FIELD)
    return rounded(pr.order_stats(ranked, FIELD).select("field_id", "gini"))


MOMENT_SRC = LINE + " UNION ALL " + unpivot_sql("events", ["value"])


def moment_hist(spark, sf):
    rows = (numeric_values(table(spark, sf, "lineitem"), LINE_COLS)
            .unionByName(numeric_values(table(spark, sf, "events"), ["value"])))
    return materialize(pr.value_histogram(rows, FIELD), "hist")


@query("profile_moments", oracle=f"""
WITH c AS ({MOMENT_SRC}), m AS (SELECT field_id, avg(v) AS mean, stddev_pop(v) AS std FROM c GROUP BY field_id)
SELECT c.field_id, round(avg(pow((v - mean) / std, 3)), 5) + 0.0 AS skewness, round(avg(pow((v - mean) / std, 4)) - 3, 5) + 0.0 AS kurtosis,
  {', '.join(f'round(avg(pow((v - mean) / std, {k})), 4) + 0.0 AS moment_{k}_std' for k in range(5, 8))},
  {', '.join(f'round(avg(pow((v - mean) / std, {k})) / 1000000, 6) + 0.0 AS moment_{k}_std' for k in range(8, 11))}
FROM c JOIN m ON c.field_id = m.field_id GROUP BY c.field_id""")
def profile_moments(spark, sf):
    hist = moment_hist(spark, sf)
    stats = pr.centered_stats(hist, pr.value_totals(hist, FIELD), FIELD)
    scaled = {k: F.col(f"moment_{k}") / F.pow("std", F.lit(k)) for k in range(5, 11)}
    return stats.select(
        "field_id", (F.round("skewness", 5) + F.lit(0.0)).alias("skewness"), (F.round("kurtosis", 5) + F.lit(0.0)).alias("kurtosis"),
        *[(F.round(c if k < 8 else c / 1000000, 4 if k < 8 else 6) + F.lit(0.0)).alias(f"moment_{k}_std") for k, c in scaled.items()])


@query("profile_normality", oracle=f"""
WITH c AS ({MOMENT_SRC}), m AS (SELECT field_id, CAST(count(v) AS DOUBLE) AS n, avg(v) AS mean, stddev_pop(v) AS std FROM c GROUP BY field_id),
g AS (SELECT c.field_id, max(n) AS n, avg(pow((v - mean) / std, 3)) AS g, avg(pow((v - mean) / std, 4)) AS b
  FROM c JOIN m ON c.field_id = m.field_id GROUP BY c.field_id),
p AS (SELECT *, g * sqrt((n+1)*(n+3)/(6*(n-2))) AS y,
  sqrt(2*(3*(n*n+27*n-70)*(n+1)*(n+3)/((n-2)*(n+5)*(n+7)*(n+9)) - 1)) - 1 AS w2,
  (b - 3*(n-1)/(n+1)) / sqrt(24*n*(n-2)*(n-3)/((n+1)*(n+1)*(n+3)*(n+5))) AS x,
  6*(n*n-5*n+2)/((n+7)*(n+9)) * sqrt(6*(n+3)*(n+5)/(n*(n-2)*(n-3))) AS s FROM g),
z AS (SELECT *, sqrt(2/(w2-1)) AS alpha, 6 + 8/s*(2/s + sqrt(1+4/(s*s))) AS a FROM p),
k AS (SELECT *, ln(y/alpha + sqrt((y/alpha)*(y/alpha)+1)) / sqrt(0.5*ln(w2)) AS z1,
  (1 - 2/(9*a) - sign(1 + x*sqrt(2/(a-4))) * cbrt((1-2/a)/abs(1 + x*sqrt(2/(a-4))))) / sqrt(2/(9*a)) AS z2 FROM z)
SELECT field_id, round(z1*z1 + z2*z2, 3) AS normality_statistic, round(exp(-(z1*z1+z2*z2)/2), 6) AS normality_p,
  exp(-(z1*z1+z2*z2)/2) < 0.05 AS is_normal_5, exp(-(z1*z1+z2*z2)/2) < 0.01 AS is_normal_1 FROM k""")
def profile_normality(spark, sf):
    hist = moment_hist(spark, sf)
    totals = pr.value_totals(hist, FIELD)
    stats = totals.join(pr.centered_stats(hist, totals, FIELD), FIELD)
    out = pr.add_normality(stats).select(
        "field_id", "normality_statistic", "normality_p", "is_normal_5", "is_normal_1")
    return rounded(out, normality_statistic=3)


def outlier_sql(scale: str, probs: tuple[float, ...]) -> str:
    tests = {"15iqr": "v < q25 - 1.5*(q75-q25) OR v > q75 + 1.5*(q75-q25)",
             "3iqr": "v < q25 - 3*(q75-q25) OR v > q75 + 3*(q75-q25)",
             "1_99": "v < q1 OR v > q99", "3std": "v < mean - 3*std OR v > mean + 3*std"}
    shares = ", ".join(f"round(avg(CASE WHEN {t} THEN 1.0 ELSE 0.0 END), 6) AS percent_outliers_{k}, "
                       f"max(CASE WHEN {t} THEN 1 ELSE 0 END) = 1 AS has_outliers_{k}" for k, t in tests.items())
    q = ", ".join(f"quantile_cont(v, {p}) AS {n}" for n, p in zip(("q1", "q25", "q75", "q99"), probs))
    return f"""SELECT '{scale}' AS quantile_scale, c.field_id, {shares} FROM c JOIN
      (SELECT field_id, {q}, avg(v) AS mean, stddev_pop(v) AS std FROM c GROUP BY field_id) s
      ON c.field_id = s.field_id GROUP BY c.field_id"""


@query("profile_outliers", oracle=f"""
WITH c AS ({LINE}) {outlier_sql('reference', Q_REF)} UNION ALL {outlier_sql('quartile', Q_QUART)}""")
def profile_outliers(spark, sf):
    hist = line_hist(spark, sf)
    totals = pr.value_totals(hist, FIELD)
    base = totals.join(pr.centered_stats(hist, totals, FIELD), FIELD).select("field_id", "mean", "std")
    stats = base.join(pr.order_stats(pr.ranked_values(hist, FIELD), FIELD, "reference", also=["quartile"]), FIELD)
    both = pr.outlier_stats(hist, stats, FIELD, also=["quartile"])
    kinds = [f"{what}_outliers_" for what in ("percent", "has")]
    scales = [F.struct(F.lit(scale).alias("quantile_scale"), *[
        F.col(f"{kind}{prefix}{test}").alias(f"{kind}{test}") for test in ("15iqr", "3iqr", "1_99", "3std") for kind in kinds])
        for scale, prefix in (("reference", ""), ("quartile", "quartile_"))]
    return rounded(both.select("field_id", F.explode(F.array(*scales)).alias("s")).select("field_id", "s.*"))


@query("profile_sequence", oracle="""
WITH c AS (SELECT 'o_totalprice' AS field_id, o_orderkey AS pos, o_totalprice AS v FROM orders
  UNION ALL SELECT 'o_orderkey', o_orderkey, CAST(o_orderkey AS DOUBLE) FROM orders
  UNION ALL SELECT 'value', event_id, value FROM events),
r AS (SELECT field_id, v, row_number() OVER (PARTITION BY field_id ORDER BY pos) AS i,
  row_number() OVER (PARTITION BY field_id ORDER BY v, pos) AS j FROM c),
p AS (SELECT a.field_id, a.v AS x, b.v AS y FROM r a JOIN r b ON a.field_id = b.field_id AND a.i = b.j),
s AS (SELECT field_id, v, lead(v) OVER (PARTITION BY field_id ORDER BY v) AS nxt FROM c),
g AS (SELECT field_id, stddev_pop(nxt - v) / nullif(avg(nxt - v), 0) AS lin, stddev_pop(v / nullif(nxt, 0)) / nullif(avg(v / nullif(nxt, 0)), 0) AS lg,
  max(CASE WHEN nxt = 0 THEN 1 ELSE 0 END) AS blocked FROM s WHERE nxt IS NOT NULL GROUP BY field_id)
SELECT p.field_id, min(CASE WHEN x = y THEN 1 ELSE 0 END) = 1 AS is_sorted, TRUE AS is_monotonic,
  round(abs(corr(x, y)), 6) AS sortedness, round(max(lin), 5) AS lin_space_sequence_coeff,
  round(max(CASE WHEN blocked = 0 THEN lg END), 6) AS log_space_sequence_coeff,
  coalesce(max(lin) <= 0.001, FALSE) AS is_lin_space, coalesce(max(CASE WHEN blocked = 0 THEN lg END) <= 0.001, FALSE) AS is_log_space
FROM p JOIN g ON p.field_id = g.field_id GROUP BY p.field_id""")
def profile_sequence(spark, sf):
    rows = (numeric_values(table(spark, sf, "orders"), ["o_totalprice", "o_orderkey"], "o_orderkey")
            .unionByName(numeric_values(table(spark, sf, "events"), ["value"], "event_id")))
    seq = pr.sequence_stats(rows, FIELD)
    space = pr.order_stats(
        pr.ranked_values(pr.stage_values(pr.value_histogram(rows, FIELD), FIELD), FIELD), FIELD).select(
        "field_id", "lin_space_sequence_coeff", "log_space_sequence_coeff", "is_lin_space", "is_log_space")
    return rounded(seq.join(space, FIELD), lin_space_sequence_coeff=5)


NAME_SQL = """length(n) AS field_name_length, n LIKE 'x%' OR n LIKE '%x' AS x_in_name, n LIKE 'y%' OR n LIKE '%y' AS y_in_name,
  n LIKE 'id%' OR n LIKE '%id' AS id_in_name, contains(n, 'time') AS time_in_name, regexp_matches(n, '[0-9]') AS digit_in_name,
  contains(n, '$') AS dollar_in_name, contains(n, '£') AS pound_in_name, contains(n, '€') AS euro_in_name, contains(n, '¥') AS yen_in_name,
  n[1] = upper(n[1]) AS first_char_uppercase_name, length(regexp_replace(n, '[^A-Z]', '', 'g')) AS num_uppercase_characters,
  contains(n, ' ') AS space_in_name, len(string_split(n, ' ')) AS number_of_words_in_name"""


def name_rows(rows, name: str = "n"):
    cols = fn.name_features(F.col(name))
    ints = {"field_name_length", "num_uppercase_characters", "number_of_words_in_name"}
    return rows.select("*", *[(c.cast("bigint") if k in ints else c).alias(k) for k, c in cols.items()])


@query("name_features", oracle=f"""
WITH s AS (SELECT DISTINCT c_name AS n, 'user:9:' || CAST(c_custkey AS VARCHAR) AS src FROM customer
  UNION ALL SELECT DISTINCT p_name || '.CSV', 'part:7:' || p_name FROM part)
SELECT n, split_part(src, ':', 1) || ':' || split_part(src, ':', 3) AS field_id, regexp_replace(lower(n), '\\.csv$', '') AS bare_name,
  {NAME_SQL} FROM s""")
def name_features(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_name").alias("n"), F.concat(F.lit("user:9:"), F.col("c_custkey").cast("string")).alias("src"))
    p = table(spark, sf, "part").select(
        F.concat("p_name", F.lit(".CSV")).alias("n"), F.concat(F.lit("part:7:"), F.col("p_name")).alias("src"))
    rows = c.unionByName(p.distinct())
    return name_rows(rows.select("n", fn.source_field_id(F.col("src")).alias("field_id"),
                                 fn.bare_table_name(F.col("n")).alias("bare_name")))


NAMED_TABLES = ["nation", "customer", "part", "orders", "lineitem", "events"]


@query("profile_names", oracle=f"""
WITH s AS (""" + " UNION ALL ".join(
    f"SELECT table_id, n, count(*) AS length FROM (SELECT '{t}' AS table_id, unnest(json_keys(to_json({t}))) AS n FROM {t}) GROUP BY ALL"
    for t in NAMED_TABLES) + f") SELECT table_id, n, length, {NAME_SQL} FROM s")
def profile_names(spark, sf):
    cells = None
    for name in NAMED_TABLES:
        df = table(spark, sf, name)
        part = table_cells(df, df.columns, fid=name)
        cells = part if cells is None else cells.unionByName(part)
    counted = cells.groupBy(F.col("fid").alias("table_id"), F.col("field_name").alias("n")).agg(
        F.count(F.lit(1)).alias("length"))
    return name_rows(counted)


@query("profile_overlap", oracle=f"""
WITH c AS ({LINE} UNION ALL {unpivot_sql('lineitem', ['l_linenumber', 'l_suppkey'])}),
e AS (SELECT field_id, min(v) AS lo, max(v) AS hi FROM c GROUP BY field_id),
p AS (SELECT a.field_id AS field_a, b.field_id AS field_b, a.lo AS a_lo, a.hi AS a_hi, b.lo AS b_lo, b.hi AS b_hi
  FROM e a JOIN e b ON a.field_id < b.field_id),
o AS (SELECT *, a_hi >= b_lo AND b_hi >= a_lo AS meets,
  CASE WHEN b_lo >= a_lo THEN a_hi - b_lo ELSE b_hi - a_lo END AS w FROM p)
SELECT field_a, field_b, meets AS has_overlap,
  round(CASE WHEN (b_hi >= a_hi AND b_lo <= a_lo) OR (a_hi >= b_hi AND a_lo <= b_lo) THEN 1.0
    WHEN meets THEN greatest(w / (a_hi - a_lo), w / (b_hi - b_lo)) ELSE 0.0 END, 6) AS overlap_percent FROM o""")
def profile_overlap(spark, sf):
    rows = numeric_values(table(spark, sf, "lineitem"), [*LINE_COLS, "l_linenumber", "l_suppkey"], fid="lineitem")
    out = pr.range_overlap(rows, ["fid"])
    return rounded(out.drop("fid"))


@query("overlapping_ranges", oracle="""
WITH e AS (SELECT o_custkey AS fid, l_orderkey AS field_id, CAST(min(epoch(l_shipdate) // 86400) AS DOUBLE) AS lo, CAST(max(epoch(l_shipdate) // 86400) AS DOUBLE) AS hi
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
p AS (SELECT a.fid, a.field_id AS field_a, b.field_id AS field_b, a.lo AS a_lo, a.hi AS a_hi, b.lo AS b_lo, b.hi AS b_hi,
  CASE WHEN b.lo >= a.lo THEN a.hi - b.lo ELSE b.hi - a.lo END AS w
  FROM e a JOIN e b ON a.fid = b.fid AND a.field_id < b.field_id AND a.hi >= b.lo AND b.hi >= a.lo)
SELECT fid, field_a, field_b, round(CASE WHEN (b_hi >= a_hi AND b_lo <= a_lo) OR (a_hi >= b_hi AND a_lo <= b_lo) THEN 1.0
  ELSE greatest(w / (a_hi - a_lo), w / (b_hi - b_lo)) END, 6) AS overlap_percent FROM p""")
def overlapping_ranges(spark, sf):
    """Orders of a customer whose shipping days overlap."""
    day = F.unix_date(F.col("l_shipdate").cast("date")).cast("double")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("field_id"), day.alias("v"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("field_id"), F.col("o_custkey").alias("fid"))
    return rounded(pr.overlapping_fields(lines.join(orders, "field_id"), ["fid"]).drop("has_overlap"))


@query("shared_values", oracle="""
SELECT DISTINCT CAST(o_orderkey AS DOUBLE) AS v FROM orders WHERE o_orderkey IN (SELECT l_partkey FROM lineitem)""")
def shared_values(spark, sf):
    rows = (numeric_values(table(spark, sf, "orders"), ["o_orderkey"])
            .unionByName(numeric_values(table(spark, sf, "lineitem"), ["l_partkey"])))
    return pr.shared_elements(rows, "o_orderkey", "l_partkey")


STATE_COLS = ["o_orderstatus", "o_orderpriority", "o_custkey", "o_totalprice"]


@query("profile_states", oracle=f"""
WITH c AS ({unpivot_sql('orders', STATE_COLS, 'VARCHAR')}), x AS (SELECT field_id, v, try_cast(v AS DOUBLE) AS d FROM c),
t AS (SELECT field_id, v, count(*) AS cnt FROM x WHERE v IS NOT NULL GROUP BY 1, 2), m AS (SELECT field_id, max(cnt) AS top, count(*) AS u FROM t GROUP BY 1)
SELECT x.field_id, count(*) AS n, count(*) - count(v) AS nulls, count(d) AS numbers, round(min(d), 6) AS lo, round(max(d), 6) AS hi, max(u) AS n_values,
  CASE WHEN max(u) <= 1000 THEN max(top) END AS top_count, true AS distinct_close, true AS median_close
FROM x JOIN m ON x.field_id = m.field_id GROUP BY x.field_id""")
def profile_states(spark, sf):
    """States of four chunks, the third kept twice, merged and held against the exact values."""
    cells = table_cells(table(spark, sf, "orders"), STATE_COLS, "o_orderkey", fid="orders")
    root = scratch_path(spark, "states")
    for chunk in (0, 1, 2, 2, 3):
        st.add_chunk(cells.where(F.pmod("pos", F.lit(4)) == chunk), root, chunk)
    got = materialize(st.state_profile(st.corpus_state(spark, root), common=1), "states")
    number = F.expr("try_cast(raw as double)")
    exact = cells.join(got.select("field_id", "q50"), "field_id").groupBy("field_id").agg(
        F.count_distinct("raw").alias("n_values"), F.avg((number <= F.col("q50")).cast("int")).alias("upto"), F.avg((number < F.col("q50")).cast("int")).alias("below"))
    out = got.join(exact, "field_id")
    return rounded(out.select(
        "field_id", "n", "nulls", "numbers", "lo", "hi", "n_values", F.when(F.col("n_values") <= 1000, F.get("common", F.lit(0))["count"]).alias("top_count"),
        (F.abs(F.col("n_distinct") - F.col("n_values")) <= 0.07 * F.col("n_values")).alias("distinct_close"),
        F.when(F.col("numbers") > 0, (F.col("upto") >= 0.48) & (F.col("below") <= 0.52)).otherwise(F.col("q50").isNull()).alias("median_close")))


PART_COLS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@query("profile_full", oracle=f"""
WITH c AS ({unpivot_sql('part', PART_COLS, 'VARCHAR', ', p_partkey AS pos')}), {VOTE_SQL},
x AS (SELECT c.field_id, pos, v, data_type, CASE WHEN data_type IN ('integer', 'decimal') THEN CAST(v AS DOUBLE) END AS d
  FROM c JOIN typed ON c.field_id = typed.field_id),
b AS (SELECT field_id, max(data_type) AS data_type, count(*) AS length, avg(d) AS mean, stddev_pop(d) AS std, quantile_cont(d, 0.5) AS med,
  quantile_cont(d, 0.0025) AS q25, quantile_cont(d, 0.0075) AS q75, min(d) AS lo, max(d) AS hi, count(DISTINCT v) AS u FROM x GROUP BY field_id),
m AS (SELECT x.field_id, quantile_cont(abs(d - med), 0.5) AS mad, avg(pow((d - mean) / nullif(std, 0), 3)) AS skew,
  avg(CASE WHEN d < q25 - 3*(q75-q25) OR d > q75 + 3*(q75-q25) THEN 1.0 ELSE 0.0 END) AS o3 FROM x JOIN b ON x.field_id = b.field_id GROUP BY x.field_id),
r AS (SELECT field_id, v, d, row_number() OVER (PARTITION BY field_id ORDER BY pos) AS i,
  row_number() OVER (PARTITION BY field_id ORDER BY d, CASE WHEN d IS NULL THEN v END, pos) AS j FROM x),
s AS (SELECT p.field_id, min(CASE WHEN p.v = q.v THEN 1 ELSE 0 END) = 1 AS is_sorted, corr(p.d, q.d) AS r
  FROM r p JOIN r q ON p.field_id = q.field_id AND p.i = q.j GROUP BY p.field_id),
h AS (SELECT field_id, v, count(*) AS k FROM c GROUP BY field_id, v),
e AS (SELECT h.field_id, -sum(k / length * ln(k / length)) AS ent, max(k / length) AS mode FROM h JOIN b ON h.field_id = b.field_id GROUP BY h.field_id)
SELECT b.field_id, data_type, length, FALSE AS has_none, FALSE AS is_only_field,
  CASE WHEN data_type <> 'decimal' THEN CAST(u AS DOUBLE) END AS num_unique_elements, data_type <> 'decimal' AND u = length AS is_unique,
  CASE WHEN data_type = 'string' THEN round(ent, 6) END AS list_entropy, CASE WHEN data_type = 'string' THEN round(mode, 6) END AS percentage_of_mode,
  round(mean, 6) AS mean, round(std, 6) AS std, round(med, 6) AS median, lo AS "min", hi AS "max", round(q25, 6) AS q25, round(mad, 6) AS med_abs_dev,
  round(skew, 6) + 0.0 AS skewness, round(CASE WHEN data_type <> 'string' THEN o3 END, 6) AS percent_outliers_3iqr,
  s.is_sorted, data_type <> 'string' AS is_monotonic, round(abs(CASE WHEN data_type <> 'string' THEN r END), 6) AS sortedness,
  CAST(length(b.field_id) AS BIGINT) AS field_name_length
FROM b JOIN m ON b.field_id = m.field_id JOIN s ON b.field_id = s.field_id JOIN e ON b.field_id = e.field_id""")
def profile_full(spark, sf):
    cells = table_cells(table(spark, sf, "part"), PART_COLS, "p_partkey", "part")
    out = pr.profile_columns(cells)
    return rounded(out.select(
        "field_id", "data_type", "length", "has_none", "is_only_field",
        F.col("num_unique_elements").cast("double").alias("num_unique_elements"), "is_unique", "list_entropy",
        "percentage_of_mode", "mean", "std", "median", "min", "max", "q25", "med_abs_dev", "skewness",
        "percent_outliers_3iqr", "is_sorted", "is_monotonic", "sortedness",
        F.col("field_name_length").cast("bigint").alias("field_name_length")))
