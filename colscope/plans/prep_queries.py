"""Registered queries for dedup, splits, samples and feature preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as fn
from ..operators import prep
from ..operators import relational as rl
from ..operators import sampling as sm
from ..session import materialize, scratch_path
from ..sources import corpus as co
from .registry import query, rounded, table


@query("dedup_keep_first", oracle="""
SELECT doc_id, lang, n_chars, md5(text) AS text_md5 FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""")
def dedup_keep_first(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars", "text")
    first = rl.keep_first(docs, ["text"], "doc_id")
    return first.select("doc_id", "lang", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


NUMBER = "(('0x' || substr(md5({key}), 1, 8))::BIGINT)"
EDGE = {share: round(share * (1 << 32)) for share in (0.7, 0.8, 0.85)}


@query("split_by_id", oracle=f"""
WITH b AS (SELECT *, {NUMBER.format(key="'s' || CAST(o_custkey AS VARCHAR)")} AS bc, {NUMBER.format(key="'r' || CAST(o_orderkey AS VARCHAR)")} AS br FROM orders)
SELECT o_orderkey, CASE WHEN bc < {EDGE[0.7]} THEN 'train' WHEN bc < {EDGE[0.85]} THEN 'val' ELSE 'test' END AS by_customer,
  CASE WHEN br < {EDGE[0.8]} THEN 'train' ELSE 'test' END AS by_row FROM b""")
def split_by_id(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    out = sm.assign_split(o, "o_custkey", {"train": 0.7, "val": 0.15, "test": 0.15}, "s", "by_customer")
    out = sm.assign_split(out, "o_orderkey", {"train": 0.8, "test": 0.2}, "r", "by_row")
    return out.drop("o_custkey")


HASH = "md5('7' || CAST(event_id AS VARCHAR))"


@query("split_members", oracle=f"""
WITH b AS (SELECT DISTINCT o_custkey FROM orders WHERE {NUMBER.format(key="'m' || CAST(o_custkey AS VARCHAR)")} < {EDGE[0.7]})
SELECT c_mktsegment AS trace_type, count(*) AS orders, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey IN (SELECT o_custkey FROM b) GROUP BY c_mktsegment""")
def split_members(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("fid"), "o_orderkey")
    train = sm.assign_split(o, "fid", {"train": 0.7, "test": 0.3}, "m").where("split = 'train'").select("fid").distinct()
    cases = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("chart"))
    typed = rl.with_chart_type(rl.member_rows(o, train), cases)
    return typed.groupBy("trace_type").agg(F.count(F.lit(1)).alias("orders"), F.countDistinct("fid").alias("customers"))


@query("sample_random", oracle=f"SELECT event_id, event_type FROM events ORDER BY {HASH}, event_id LIMIT 100")
def sample_random(spark, sf):
    return sm.sample_examples(table(spark, sf, "events").select("event_id", "event_type"), 100, "event_id", "random", seed="7")


@query("sample_stratified", oracle=f"""
WITH h AS (SELECT event_id, event_type, {HASH} AS h FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY h, event_id) AS rk,
  floor(count(*) OVER (PARTITION BY event_type) * 103 / count(*) OVER ()) AS quota FROM h),
c AS (SELECT * FROM r WHERE rk <= quota),
f AS (SELECT *, row_number() OVER (ORDER BY h, event_id) AS place FROM r WHERE rk > quota)
SELECT event_id, event_type FROM c UNION ALL SELECT event_id, event_type FROM f WHERE place <= 103 - (SELECT count(*) FROM c)""")
def sample_stratified(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type")
    return sm.sample_examples(ev, 103, "event_id", "stratified", "event_type", "7")


@query("sample_stratified_large", oracle=f"""
WITH h AS (SELECT event_id, event_type, {HASH} AS h FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY h, event_id) AS rk,
  least(floor(count(*) OVER (PARTITION BY event_type) * 5000 / count(*) OVER ()), count(*) OVER (PARTITION BY event_type)) AS quota FROM h),
c AS (SELECT * FROM r WHERE rk <= quota),
f AS (SELECT *, row_number() OVER (ORDER BY h, event_id) AS place FROM r WHERE rk > quota)
SELECT event_id, event_type FROM c UNION ALL SELECT event_id, event_type FROM f WHERE place <= 5000 - (SELECT count(*) FROM c)""")
def sample_stratified_large(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type")
    return sm.sample_examples(ev, 5000, "event_id", "stratified", "event_type", "7")


@query("sample_systematic", oracle="""
WITH p AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS pos, count(*) OVER () // 97 AS step FROM events),
s AS (SELECT *, pos - ('0x' || substr(md5('start7'), 1, 8))::BIGINT % step AS gap FROM p)
SELECT event_id, event_type FROM s WHERE gap >= 0 AND gap % step = 0 AND gap // step < 97""")
def sample_systematic(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type")
    return sm.sample_examples(ev, 97, "event_id", "systematic", seed="7")


FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def line_features(spark, sf):
    """Measures with some values missing or not finite, split by order."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", *FEATURES)
    m = F.pmod(F.col("l_suppkey") + F.col("l_linenumber"), F.lit(23))
    dirty = (li.withColumn("l_quantity", F.when(m != 0, F.col("l_quantity")))
             .withColumn("l_tax", F.when(m == 1, float("inf")).when(m == 2, float("nan")).otherwise(F.col("l_tax"))))
    return materialize(sm.assign_split(dirty, "l_orderkey", {"train": 0.7, "test": 0.3}, "c"), "line_features")


DIRTY_SQL = f"""d AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_discount,
  CASE WHEN (l_suppkey + l_linenumber) % 23 <> 0 THEN l_quantity END AS l_quantity,
  CASE (l_suppkey + l_linenumber) % 23 WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN 'nan'::DOUBLE ELSE l_tax END AS l_tax,
  CASE WHEN {NUMBER.format(key="'c' || CAST(l_orderkey AS VARCHAR)")} < {EDGE[0.7]} THEN 'train' ELSE 'test' END AS split FROM lineitem),
b AS (SELECT {', '.join(f"quantile_cont(CASE WHEN isfinite({c}) THEN {c} END, 0.05) AS {c}_lo, quantile_cont(CASE WHEN isfinite({c}) THEN {c} END, 0.95) AS {c}_hi" for c in FEATURES)}
  FROM d WHERE split = 'train'),
k AS (SELECT l_orderkey, l_linenumber, l_suppkey, split, {', '.join(f"CASE WHEN {c} BETWEEN {c}_lo AND {c}_hi THEN {c} WHEN {c} < {c}_lo THEN {c}_lo ELSE {c}_hi END AS {c}" for c in FEATURES)} FROM d, b)"""


@query("clip_fit_apply", oracle=f"""
WITH {DIRTY_SQL} SELECT split, {', '.join(f"round(avg({c}), 4) AS {c}_avg, round(min({c}), 6) AS {c}_min, round(max({c}), 6) AS {c}_max" for c in FEATURES)},
  count(*) AS n FROM k GROUP BY split""")
def clip_fit_apply(spark, sf):
    rows = line_features(spark, sf)
    path = scratch_path(spark, "bounds")
    prep.save_parameters(prep.fit_bounds(rows.where("split = 'train'"), FEATURES), path)
    clipped = prep.apply_bounds(rows, prep.load_parameters(spark, path))
    aggs = [a for c in FEATURES for a in (F.round(F.avg(c), 4).alias(f"{c}_avg"), F.round(F.min(c), 6).alias(f"{c}_min"),
                                          F.round(F.max(c), 6).alias(f"{c}_max"))]
    return clipped.groupBy("split").agg(*aggs, F.count(F.lit(1)).alias("n"))


@query("zscore", oracle=f"""
WITH {DIRTY_SQL}, s AS (SELECT {', '.join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in FEATURES)} FROM k WHERE split = 'train')
SELECT split, {', '.join(f"round(avg(({c} - {c}_m) / {c}_s), 5) + 0.0 AS {c}_mean, round(stddev_pop(({c} - {c}_m) / {c}_s), 5) AS {c}_std" for c in FEATURES)}
FROM k, s GROUP BY split""")
def zscore(spark, sf):
    rows = line_features(spark, sf)
    clipped = prep.apply_bounds(rows, prep.fit_bounds(rows.where("split = 'train'"), FEATURES))
    scaled = prep.apply_scales(clipped, prep.fit_scales(clipped.where("split = 'train'"), FEATURES))
    aggs = [a for c in FEATURES for a in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))]
    return rounded(scaled.groupBy("split").agg(*aggs), 5)


@query("label_encode", oracle="""
WITH m AS (SELECT c_mktsegment AS label, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS idx FROM (SELECT DISTINCT c_mktsegment FROM customer))
SELECT c_custkey, coalesce(idx, -1) AS segment_n, coalesce(label, 'unknown') AS decoded
FROM customer c LEFT JOIN m ON m.label = CASE WHEN c_custkey % 11 = 0 THEN 'OTHER' ELSE c_mktsegment END""")
def label_encode(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    path = scratch_path(spark, "mapping")
    prep.save_parameters(prep.fit_labels(c, "c_mktsegment"), path)
    mapping = prep.load_parameters(spark, path)
    fresh = c.withColumn("segment", F.when(F.col("c_custkey") % 11 == 0, "OTHER").otherwise(F.col("c_mktsegment")))
    coded = prep.encode_labels(fresh, "segment", mapping)
    return prep.decode_labels(coded, "segment_n", mapping, "decoded").select("c_custkey", "segment_n", "decoded")


@query("one_hot", oracle="""
WITH m AS (SELECT c_mktsegment AS label, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS idx FROM (SELECT DISTINCT c_mktsegment FROM customer)),
r AS (SELECT c_nationkey, coalesce(idx, -1) AS i, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal > 0 END AS flag
  FROM customer c LEFT JOIN m ON m.label = CASE WHEN c_custkey % 7 = 0 THEN 'OTHER' ELSE c_mktsegment END)
SELECT c_nationkey, CAST(sum(CASE i WHEN 0 THEN 1 ELSE 0 END) AS DOUBLE) AS hot_0, CAST(sum(CASE i WHEN 1 THEN 1 ELSE 0 END) AS DOUBLE) AS hot_1,
  CAST(sum(CASE i WHEN 2 THEN 1 ELSE 0 END) AS DOUBLE) AS hot_2, CAST(sum(CASE WHEN i >= 3 THEN 1 ELSE 0 END) AS DOUBLE) AS hot_rest,
  CAST(sum(CASE WHEN flag THEN 1 ELSE 0 END) AS DOUBLE) AS flagged FROM r GROUP BY c_nationkey""")
def one_hot(spark, sf):
    c = table(spark, sf, "customer")
    mapping = prep.fit_labels(c, "c_mktsegment")
    fresh = c.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 == 0, "OTHER").otherwise(F.col("c_mktsegment")))
    coded = prep.encode_labels(fresh, "c_mktsegment", mapping, "idx")
    hot = prep.one_hot_by(coded, "idx", mapping, "hot")
    flagged = prep.fill_flags(hot.withColumn("flag", F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal") > 0)),
                              ["flag"], as_number=True)
    rest = F.aggregate("hot", F.lit(0.0), lambda a, x: a + x) - sum(F.get("hot", F.lit(i)) for i in range(3))
    return flagged.groupBy("c_nationkey").agg(
        *[F.sum(F.get("hot", F.lit(i))).alias(f"hot_{i}") for i in range(3)],
        F.sum(rest).alias("hot_rest"), F.sum("flag").alias("flagged"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("one_hot_columns", oracle="SELECT c_nationkey, " + ", ".join(
    f"CAST(sum(CASE WHEN c_mktsegment = '{x}' THEN 1 ELSE 0 END) AS DOUBLE) AS c_mktsegment_{x}" for x in SEGMENTS) + " FROM customer GROUP BY c_nationkey")
def one_hot_columns(spark, sf):
    wide = prep.one_hot_columns(table(spark, sf, "customer"), "c_mktsegment", SEGMENTS)
    return wide.groupBy("c_nationkey").agg(*[F.sum(f"c_mktsegment_{x}").alias(f"c_mktsegment_{x}") for x in SEGMENTS])


@query("split_features_labels", oracle="""
SELECT p_brand AS trace_type, CASE WHEN p_size % 2 = 0 THEN 'x' ELSE 'y' END AS is_x_or_y, 'p_size,p_retailprice' AS inputs, count(*) AS n,
  (SELECT CAST(sum(p_size) AS BIGINT) FROM part) AS size_sum FROM part GROUP BY 1, 2""")
def split_features_labels(spark, sf):
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("field_id"), F.lit("part").alias("fid"), F.col("p_brand").alias("trace_type"),
        F.when(F.col("p_size") % 2 == 0, "x").otherwise("y").alias("is_x_or_y"), "p_size", "p_retailprice")
    inputs, labels = co.split_features_labels(rows)
    total = inputs.agg(F.sum("p_size").cast("bigint").alias("size_sum")).scalar()
    return labels.groupBy("trace_type", "is_x_or_y").agg(F.count(F.lit(1)).alias("n")).select(
        "trace_type", "is_x_or_y", F.lit(",".join(inputs.columns)).alias("inputs"), "n", total.alias("size_sum"))


@query("sequences_padded", oracle="""
WITH p AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events),
s AS (SELECT user_id, CAST(pos // 25 AS INTEGER) AS segment, count(*) AS n, sum(value * (pos % 25 + 1)) AS weighted FROM p GROUP BY 1, 2)
SELECT user_id, segment, CAST(n AS INTEGER) AS n_valid, (SELECT CAST(max(n) AS INTEGER) FROM s) AS width, round(weighted, 4) AS weighted,
  CAST(n AS INTEGER) AS mask_true FROM s""")
def sequences_padded(spark, sf):
    seqs = prep.pad_sequences(prep.field_sequences(table(spark, sf, "events"), "user_id", "event_id", ["value", "event_id"]))
    places = F.transform("x", lambda v, i: v[0] * (i + 1))
    weighted = F.aggregate(places, F.lit(0.0), lambda a, x: a + x)
    return seqs.select("user_id", "segment", "n_valid", F.size("x").alias("width"), F.round(weighted, 4).alias("weighted"),
                       F.size(F.filter("mask", lambda m: m)).alias("mask_true"))


@query("matrix_to_long", oracle="""
WITH c AS (SELECT o_custkey AS id, o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2, 3),
u AS (SELECT DISTINCT o_orderpriority AS p FROM orders), k AS (SELECT DISTINCT o_orderstatus AS s FROM orders), i AS (SELECT DISTINCT o_custkey AS id FROM orders)
SELECT i.id, (dense_rank() OVER (ORDER BY k.s) - 1) * 5 + dense_rank() OVER (ORDER BY u.p) - 1 AS pos, u.p AS unit,
  coalesce(c.n, 0) AS value, k.s AS "class" FROM i CROSS JOIN u CROSS JOIN k LEFT JOIN c ON c.id = i.id AND c.p = u.p AND c.s = k.s""")
def matrix_to_long(spark, sf):
    # Status and priority are closed code lists of the orders table.
    priorities = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    statuses = ["F", "O", "P"]
    o = table(spark, sf, "orders")
    counts = [F.array(*[F.count_if((F.col("o_orderstatus") == s) & (F.col("o_orderpriority") == p)) for p in priorities])
              for s in statuses]
    wide = o.groupBy(F.col("o_custkey").alias("id")).agg(F.array(*counts).alias("y_data"))
    wide = (wide.withColumn("x_data", F.array(F.array(*[F.lit(p) for p in priorities])))
            .withColumn("classify", F.array(*[F.lit(s) for s in statuses])))
    return prep.matrix_rows(wide, "id").withColumn("pos", F.col("pos").cast("bigint"))


@query("columns_to_lists", oracle="""
WITH p AS (SELECT o_custkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders)
SELECT o_custkey, 'o_orderstatus' AS "column", CAST(pos // 8 AS INTEGER) AS segment, string_agg(o_orderstatus, ',' ORDER BY pos) AS vals, count(*) AS n FROM p GROUP BY ALL
UNION ALL SELECT o_custkey, 'o_orderpriority', CAST(pos // 8 AS INTEGER), string_agg(o_orderpriority, ',' ORDER BY pos), count(*) FROM p GROUP BY ALL""")
def columns_to_lists(spark, sf):
    lists = prep.column_lists(table(spark, sf, "orders"), "o_custkey", "o_orderkey", ["o_orderstatus", "o_orderpriority"], 8)
    return lists.select("o_custkey", "column", "segment", F.array_join("values", ",").alias("vals"),
                        F.size("values").cast("bigint").alias("n"))


@query("csv_blocks", oracle="""
WITH p AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos,
  CAST(o_orderkey AS VARCHAR) || ',' || CASE WHEN o_orderstatus = 'F' THEN 'nan' ELSE o_orderstatus END || ',"' || o_orderpriority || ', x"' AS line FROM orders)
SELECT o_custkey, CAST(pos // 8 AS INTEGER) AS segment, md5(CASE WHEN pos // 8 = 0 THEN 'o_orderkey,status,priority' || chr(10) ELSE '' END || string_agg(line, chr(10) ORDER BY pos) || chr(10)) AS csv_md5
FROM p GROUP BY o_custkey, pos // 8""")
def csv_blocks(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("status"),
        F.concat("o_orderpriority", F.lit(", x")).alias("priority"))
    out = prep.csv_text(o, "o_custkey", "o_orderkey", ["o_orderkey", "status", "priority"], segment=8)
    return out.select("o_custkey", "segment", F.md5(F.col("csv").cast("binary")).alias("csv_md5"))


@query("distinct_ordered", oracle="""
SELECT p_brand, min(p_partkey) AS first_at FROM part GROUP BY p_brand""")
def distinct_ordered(spark, sf):
    return rl.distinct_ordered(table(spark, sf, "part"), "p_brand", "p_partkey")


@query("union_chunks", oracle="""
SELECT event_type, count(*) AS n, round(sum(CASE WHEN event_type <> 'view' THEN value END), 3) AS total,
  count(CASE WHEN event_type <> 'view' THEN value END) AS with_value FROM events GROUP BY event_type""")
def union_chunks(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type", "value")
    parts = [ev.where("event_type = 'view'").drop("value"), ev.where("event_type = 'click'"),
             ev.where("event_type is null or event_type not in ('view', 'click')")]
    return rounded(rl.union_chunks(parts).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.count("value").alias("with_value")), 3)


@query("label_listing", oracle="""
SELECT p_type AS label, dense_rank() OVER (ORDER BY p_type) - 1 AS idx FROM (SELECT DISTINCT p_type FROM part)""")
def label_listing(spark, sf):
    return prep.fit_labels(table(spark, sf, "part"), "p_type").orderBy("idx")


@query("feature_select", oracle="""
SELECT p_partkey, p_size, p_retailprice, 'unknown' AS trace_type, 'x' AS is_x_or_y FROM part ORDER BY p_partkey LIMIT 150""")
def feature_select(spark, sf):
    p = table(spark, sf, "part")
    rows = p.select(F.col("p_partkey").cast("string").alias("p_partkey"), "p_size", "p_retailprice", F.lit("true").alias("exists"),
                    F.lit("f").alias("fid"), F.col("p_name").alias("field_id"), F.lit("bar").alias("trace_type_n"))
    headers = rows.where("p_size = 1").withColumn("exists", F.lit("exists"))
    clean = co.feature_rows(rows.unionByName(headers))
    inputs = co.model_inputs(clean).drop("exists").withColumn("p_partkey", F.col("p_partkey").cast("bigint"))
    return co.with_default_labels(co.first_cases(inputs, 150, "p_partkey"))


@query("table_filter", oracle="""
SELECT n_name, regexp_replace(lower(n_name || '.CSV'), '\\.csv$', '') AS bare FROM nation""")
def table_filter(spark, sf):
    names = table(spark, sf, "nation").select("n_name", F.concat("n_name", F.lit(".CSV")).alias("file"))
    return names.select("n_name", fn.bare_table_name(F.col("file")).alias("bare"))
