"""Feature preparation and text forms on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import overlaps, sorted_insert, sorted_union
from ..functions.scalar import log2_choose_col, norm_value, split_dummy, to_utility
from ..operators.gain import (
    attribute_constants,
    attribute_modes,
    connected,
    language_size,
    literal_grid,
)
from ..operators.prep import (
    CaseTable,
    binary_target,
    domains,
    drop_cols,
    encode_alphabetical,
    encode_label,
    from_facts,
    impute_const,
    impute_mean,
    one_hot,
    qcut,
    remap,
    to_facts,
)
from ..operators.ranks import _quantiles_by_rank, running_sums
from .datasets import FLAGS, ORDER_FLAG_FACTS, ORDERS, orders_cases, orders_raw, table
from .registry import query

PRIORITY_CODES = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4, "5-LOW": 5}

RAW = """
raw AS (SELECT o_orderkey AS case_id, o_orderstatus AS status, o_totalprice AS price,
    o_orderpriority AS priority, c_mktsegment AS segment, r_name AS region
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""


@query("p01_encode_label", """SELECT o_orderkey AS case_id,
  CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS status,
  CAST(o_orderstatus = 'P' AS INTEGER) AS is_pos FROM orders""")
def p01(spark, sf):
    raw = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("status"))
    marked = binary_target(encode_label(raw, "status", ["F", "O"]), "status", 2)
    return marked.withColumn("is_pos", F.col("is_pos").cast("int"))


@query("p01_encode_alphabetical", """SELECT c_custkey, CAST((SELECT count(DISTINCT d.c_mktsegment)
  FROM customer d WHERE d.c_mktsegment < c.c_mktsegment) AS INTEGER) AS c_mktsegment FROM customer c""")
def p01b(spark, sf):
    return encode_alphabetical(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query("p02_drop_cols", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def p02(spark, sf):
    return drop_cols(table(spark, sf, "orders"), ["o_custkey", "o_orderdate", "o_orderpriority"])


@query("p03_remap", """SELECT o_orderkey,
  CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3
    WHEN '4-NOT SPECIFIED' THEN 4 WHEN '5-LOW' THEN 5 END AS o_orderpriority,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus
  FROM orders""")
def p03(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return remap(orders, {"o_orderpriority": PRIORITY_CODES, "o_orderstatus": {"F": "done", "O": "open"}})


@query("p04_impute_mean", """WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS bal
  FROM customer) SELECT c_custkey, round(coalesce(bal, (SELECT avg(bal) FROM c)), 6) AS bal FROM c""")
def p04(spark, sf):
    bal = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("bal")
    filled = impute_mean(table(spark, sf, "customer").select("c_custkey", bal), ["bal"])
    return filled.withColumn("bal", F.round("bal", 6))


@query("p05_impute_const", """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'unknown'
  ELSE c_mktsegment END AS segment, CASE WHEN c_acctbal >= 0 THEN c_acctbal ELSE 0.0 END AS bal FROM customer""")
def p05(spark, sf):
    customer = table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("bal"),
    )
    return impute_const(customer, {"segment": "unknown", "bal": 0.0})


@query("p06_quartile_codes", f"WITH {ORDERS} SELECT case_id, CAST(price_q AS INTEGER) AS price FROM cases")
def p06(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.col("o_totalprice").alias("price")
    )
    return qcut(orders, ["price"])


@query("p06_quartile_counts_lineitem", """WITH e AS (SELECT
    quantile_cont(l_quantity, [0.0, 0.25, 0.5, 0.75, 1.0]) AS eq,
    quantile_cont(l_discount, [0.0, 0.25, 0.5, 0.75, 1.0]) AS ed,
    quantile_cont(l_extendedprice, [0.0, 0.25, 0.5, 0.75, 1.0]) AS ep FROM lineitem),
  coded AS (SELECT
    CAST(greatest(len(list_filter(list_distinct(eq), lambda x: x < l_quantity)) - 1, 0) AS INTEGER) AS l_quantity,
    CAST(greatest(len(list_filter(list_distinct(ed), lambda x: x < l_discount)) - 1, 0) AS INTEGER) AS l_discount,
    CAST(greatest(len(list_filter(list_distinct(ep), lambda x: x < l_extendedprice)) - 1, 0) AS INTEGER) AS l_extendedprice
    FROM lineitem, e)
  SELECT l_quantity, l_discount, l_extendedprice, count(*) AS cnt FROM coded GROUP BY ALL""")
def p06b(spark, sf):
    cols = ["l_quantity", "l_discount", "l_extendedprice"]
    coded = qcut(table(spark, sf, "lineitem").select(*cols), cols)
    return coded.groupBy(*cols).agg(F.count(F.lit(1)).alias("cnt"))


@query("p06_quantiles_by_rank", """SELECT unnest(['l_extendedprice', 'l_quantity']) AS attr,
  unnest([round(quantile_cont(l_extendedprice, 0.1), 4), round(quantile_cont(l_quantity, 0.1), 4)]) AS q10,
  unnest([round(quantile_cont(l_extendedprice, 0.5), 4), round(quantile_cont(l_quantity, 0.5), 4)]) AS q50,
  unnest([round(quantile_cont(l_extendedprice, 0.9), 4), round(quantile_cont(l_quantity, 0.9), 4)]) AS q90
  FROM lineitem""")
def p06c(spark, sf):
    cols = ["l_extendedprice", "l_quantity"]
    qs = _quantiles_by_rank(table(spark, sf, "lineitem").select(*cols), cols, [0.1, 0.5, 0.9], parts=16)
    rows = [(c, *[round(v, 4) for v in qs[c]]) for c in cols]
    return spark.createDataFrame(rows, "attr string, q10 double, q50 double, q90 double")


@query("p07_domains", f"WITH {RAW} SELECT DISTINCT 'priority' AS pred, priority AS val FROM raw UNION ALL "
       "SELECT DISTINCT 'segment', segment FROM raw UNION ALL SELECT DISTINCT 'region', region FROM raw")
def p07(spark, sf):
    return domains(orders_raw(spark, sf), ["priority", "segment", "region"])


@query("p08_one_hot", """SELECT c_custkey,
  CAST(c_mktsegment = 'AUTOMOBILE' AS INTEGER) AS "c_mktsegment_AUTOMOBILE",
  CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS "c_mktsegment_BUILDING",
  CAST(c_mktsegment = 'FURNITURE' AS INTEGER) AS "c_mktsegment_FURNITURE",
  CAST(c_mktsegment = 'HOUSEHOLD' AS INTEGER) AS "c_mktsegment_HOUSEHOLD",
  CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS "c_mktsegment_MACHINERY" FROM customer""")
def p08(spark, sf):
    return one_hot(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


@query("p08_one_hot_drop_first", """SELECT o_orderkey,
  CAST(o_orderstatus = 'O' AS INTEGER) AS "o_orderstatus_O",
  CAST(o_orderstatus = 'P' AS INTEGER) AS "o_orderstatus_P" FROM orders""")
def p08b(spark, sf):
    return one_hot(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], drop_first=True)


@query("p09_drop_binary_low", """SELECT 'quality' AS pred, doc_id AS case_id, '1' AS val FROM labels WHERE quality = 1
  UNION ALL SELECT 'toxic', doc_id, '1' FROM labels WHERE toxic = 1
  UNION ALL SELECT 'parity', doc_id, CAST(doc_id % 3 AS VARCHAR) FROM labels""")
def p09(spark, sf):
    labels = table(spark, sf, "labels").select(
        F.col("doc_id").alias("case_id"), "quality", "toxic", (F.col("doc_id") % 3).alias("parity")
    )
    return to_facts(CaseTable(labels, ("quality", "toxic", "parity")), drop_binary_low=True)


@query("p10_to_facts", f"WITH {ORDER_FLAG_FACTS} SELECT pred, case_id, val FROM facts")
def p10(spark, sf):
    return to_facts(orders_cases(spark, sf, flags=True))


@query("p10_from_facts", f"""WITH {ORDER_FLAG_FACTS} SELECT case_id, CAST(is_pos AS INTEGER) AS is_pos,
  max(val) FILTER (pred = 'priority') AS priority, max(val) FILTER (pred = 'region') AS region,
  coalesce(string_agg(val, ',' ORDER BY val) FILTER (pred = 'has_flag'), '') AS has_flag
  FROM cases LEFT JOIN facts USING (case_id) GROUP BY 1, 2""")
def p10b(spark, sf):
    cases = orders_cases(spark, sf, flags=True)
    back = from_facts(to_facts(cases), cases.df, single=["priority", "region"], multi=["has_flag"])
    flags = F.coalesce(F.array_join("has_flag", ","), F.lit(""))
    return back.df.select("case_id", F.col("is_pos").cast("int").alias("is_pos"), "priority", "region", flags.alias("has_flag"))


@query("p11_norm_value", """SELECT p_partkey, 'part_name' AS pred,
  replace(lower(p_name || '.' || p_size), '.', '') AS val,
  replace(lower(CAST(p_retailprice AS VARCHAR)), '.', '') AS price FROM part""")
def p11(spark, sf):
    name = F.concat(F.lit("part_name_"), "p_name", F.lit("."), F.col("p_size").cast("string"))
    pred, val = split_dummy(name)
    return table(spark, sf, "part").select(
        "p_partkey", pred.alias("pred"), val.alias("val"), norm_value("p_retailprice").alias("price")
    )


@query("p12_to_utility", """SELECT event_id,
  CAST(abs(round((value - 50) / 17 * 1000)) AS BIGINT) AS util,
  CAST(abs(trunc(round((value - 50) / 17, 3) * 1000)) AS BIGINT) AS util_cut FROM events""")
def p12(spark, sf):
    phi = (F.col("value") - 50) / 17
    return table(spark, sf, "events").select(
        "event_id", to_utility(phi).alias("util"), to_utility(phi, truncate=True).alias("util_cut")
    )


@query("p14_log2_choose", """WITH g AS (SELECT l_suppkey, count(*) AS n,
    count(*) FILTER (WHERE l_returnflag = 'A') AS k FROM lineitem GROUP BY 1)
  SELECT l_suppkey, round((lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)) / ln(2), 6) AS bits,
    round(lgamma(n + 1) / ln(2), 6) AS fact_bits FROM g""")
def p14(spark, sf):
    from ..functions.scalar import lgamma_col

    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "A").alias("k")
    )
    return g.select(
        "l_suppkey",
        F.round(log2_choose_col("n", "k"), 6).alias("bits"),
        F.round(lgamma_col(F.col("n") + 1) / F.log(F.lit(2.0)), 6).alias("fact_bits"),
    )


@query("e03_overlaps", f"""WITH {FLAGS}, f AS (SELECT case_id, list(has_flag) AS fl FROM flags GROUP BY 1)
  SELECT case_id, CAST(list_has_any(fl, ['A', 'R']) AS INTEGER) AS hit FROM f""")
def e03(spark, sf):
    flags = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(
        F.collect_set("l_returnflag").alias("fl")
    )
    wanted = F.array(F.lit("A"), F.lit("R"))
    return flags.select("case_id", overlaps("fl", wanted).cast("int").alias("hit"))


@query("e04_sorted_union", """WITH f AS (SELECT l_orderkey AS case_id, list_distinct(list(l_returnflag)) AS fl,
    list_distinct(list(l_linestatus)) AS st FROM lineitem GROUP BY 1)
  SELECT case_id, array_to_string(list_sort(list_distinct(list_concat(fl, st))), ',') AS both_sets,
    array_to_string(list_sort(list_distinct(list_append(fl, 'M'))), ',') AS with_m FROM f""")
def e04(spark, sf):
    sets = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(
        F.collect_set("l_returnflag").alias("fl"), F.collect_set("l_linestatus").alias("st")
    )
    return sets.select(
        "case_id",
        F.array_join(sorted_union("fl", "st"), ",").alias("both_sets"),
        F.array_join(sorted_insert("fl", F.lit("M")), ",").alias("with_m"),
    )


@query("w03_cumulative_counts", """WITH s AS (SELECT round(value, 1) AS score, count(*) AS cnt,
    count(*) FILTER (WHERE event_type = 'purchase') AS hits FROM events GROUP BY 1)
  SELECT score, cnt, hits,
    CAST(sum(cnt) OVER (ORDER BY score DESC) AS BIGINT) AS cum_cnt,
    CAST(sum(hits) OVER (ORDER BY score DESC) AS BIGINT) AS cum_hits FROM s""")
def w03(spark, sf):
    scores = table(spark, sf, "events").groupBy(F.round("value", 1).alias("score")).agg(
        F.count(F.lit(1)).alias("cnt"), F.count_if(F.col("event_type") == "purchase").alias("hits")
    )
    return running_sums(scores, "score", ["cnt", "hits"], parts=20)


# ---------------------------------------------------------------- modes and literal grids

ATTRS = ["priority", "segment", "region"]


@query("s09_derive_bias", f"WITH {RAW} SELECT DISTINCT 'args_priority' AS type, priority AS val FROM raw UNION ALL "
       "SELECT DISTINCT 'args_segment', segment FROM raw UNION ALL SELECT DISTINCT 'args_region', region FROM raw")
def s09(spark, sf):
    return attribute_constants(orders_raw(spark, sf), ATTRS)


@query("a08_language_size", f"""WITH {RAW}, s AS (SELECT count(DISTINCT priority) + count(DISTINCT segment)
    + count(DISTINCT region) AS literals FROM raw)
  SELECT literals, ceil(log2(literals)) AS bits FROM s""")
def a08(spark, sf):
    raw = orders_raw(spark, sf)
    return language_size(attribute_modes(raw, ATTRS), attribute_constants(raw, ATTRS))


@query("j06_literal_grid", f"""WITH {RAW}, d AS (SELECT DISTINCT 'priority' AS pred, priority AS val FROM raw UNION ALL
    SELECT DISTINCT 'segment', segment FROM raw UNION ALL SELECT DISTINCT 'region', region FROM raw)
  SELECT pred, v || ',' || val AS args FROM d, (VALUES ('A'), ('_')) AS t(v)""")
def j06(spark, sf):
    raw = orders_raw(spark, sf)
    variables = spark.createDataFrame([("A", "case")], "name string, type string")
    grid = literal_grid(attribute_modes(raw, ATTRS), attribute_constants(raw, ATTRS), variables)
    return grid.select("pred", F.array_join("args", ",").alias("args"))


@query("c08_connected_candidates", f"""WITH {RAW}, d AS (SELECT DISTINCT 'priority' AS pred, priority AS val FROM raw UNION ALL
    SELECT DISTINCT 'segment', segment FROM raw UNION ALL SELECT DISTINCT 'region', region FROM raw)
  SELECT pred, 'A,' || val AS args FROM d""")
def c08(spark, sf):
    raw = orders_raw(spark, sf)
    variables = spark.createDataFrame([("A", "case")], "name string, type string")
    grid = literal_grid(attribute_modes(raw, ATTRS), attribute_constants(raw, ATTRS), variables)
    return connected(grid, ["A"]).select("pred", F.array_join("args", ",").alias("args"))


