"""Text forms of the driver tables: lines written, and the same lines read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.attribution import item_dictionary
from ..operators.gain import attribute_constants, attribute_modes, literals_in
from ..operators.prep import to_facts
from ..operators.utility import merged_items, top_k_utility_itemsets
from ..sources import readers as rd
from ..sources import writers as wr
from .coverage_queries import FIRED, HIT, THEORY, cases
from .datasets import (
    ATTRIBUTIONS,
    ORDER_FLAG_FACTS,
    SUBSETS,
    WIDE_ORDERS,
    baskets,
    order_attributions,
    orders_cases,
    orders_raw,
    table,
)
from .prep_queries import ATTRS, RAW
from .registry import query

NORM = "replace(lower(val), '.', '')"


@query("s01_case_table", "SELECT o_orderkey AS id, round(o_totalprice, 2) AS price, nullif(o_orderpriority, '5-LOW') AS priority, o_orderstatus AS label FROM orders")
def s01(spark, sf):
    """Orders as CSV text with ``?`` for missing values, read as a case table."""
    import uuid

    from ..session import shared_dir

    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.round("o_totalprice", 2).alias("price"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("priority"),
        F.col("o_orderstatus").alias("label"),
    )
    path = f"{shared_dir(spark)}/cases-{uuid.uuid4().hex}"
    orders.write.csv(path, header=True, nullValue="?")
    return rd.read_cases(spark, path, "id bigint, price double, priority string, label string")


@query("s02_parse_facts", f"WITH {ORDER_FLAG_FACTS} SELECT pred, 'p' || case_id AS case_id, {NORM} AS val FROM facts")
def s02(spark, sf):
    """Facts written as text among directives and comments, and parsed again."""
    facts = to_facts(cases(spark, sf))
    noise = spark.createDataFrame(
        [(":-style_check(-discontiguous).",), ("foil_cwa(true).",), ("% positive(p1).",), ("h_positive(A):-segment(A,x).",)], "value string"
    )
    return rd.parse_facts(wr.render_facts(facts).unionByName(noise))


@query("s08_render_facts", f"WITH {ORDER_FLAG_FACTS} SELECT pred || '(p' || case_id || ',' || {NORM} || ').' AS value FROM facts"
       " UNION ALL SELECT CASE WHEN is_pos THEN 'positive' ELSE 'negative' END || '(p' || case_id || ').' FROM cases")
def s08(spark, sf):
    c = cases(spark, sf)
    return wr.render_examples(c.df).unionByName(wr.render_facts(to_facts(c)))


MODES = f"""{RAW}, d AS (SELECT DISTINCT 'priority' AS pred, priority AS val FROM raw UNION ALL
    SELECT DISTINCT 'segment', segment FROM raw UNION ALL SELECT DISTINCT 'region', region FROM raw)"""


@query("s09_render_bias", f"""WITH {MODES} SELECT '#constant(args_' || pred || ',' || {NORM} || ')' AS value FROM d
  UNION ALL SELECT DISTINCT '#modeb(1,' || pred || '(var(case),const(args_' || pred || ')))' FROM d
  UNION ALL SELECT '#modeh(positive(var(case)))'""")
def s09(spark, sf):
    raw = orders_raw(spark, sf)
    modes = wr.render_modes(attribute_modes(raw, ATTRS))
    return modes.unionByName(wr.render_constants(attribute_constants(raw, ATTRS)))


@query("s03_parse_bias", f"""WITH {MODES} SELECT DISTINCT 'mode' AS kind, pred, 'const args_' || pred AS detail FROM d
  UNION ALL SELECT DISTINCT 'mode', pred, 'var case' FROM d UNION ALL SELECT 'head', 'positive', 'var case'
  UNION ALL SELECT 'constant', 'args_' || pred, {NORM} FROM d""")
def s03(spark, sf):
    lines = s09(spark, sf)
    modes = rd.parse_modes(lines).select(
        F.when(F.col("is_head"), "head").otherwise("mode").alias("kind"), "pred",
        F.concat_ws(" ", "kind", "type").alias("detail"),
    )
    constants = rd.parse_constants(lines).select(
        F.lit("constant").alias("kind"), F.col("type").alias("pred"), F.col("val").alias("detail")
    )
    return modes.unionByName(constants)


ITEM_SQL = f"""{ORDER_FLAG_FACTS}, items AS (SELECT CAST(row_number() OVER (ORDER BY pred, val) - 1 AS INTEGER) AS item_id, pred, val
  FROM (SELECT DISTINCT pred, val FROM facts))"""


@query("s12_render_items", f"WITH {ITEM_SQL} SELECT item_id || '->' || pred || '(A,' || {NORM} || ')' AS value FROM items")
def s12(spark, sf):
    return wr.render_items(item_dictionary(literals_in(cases(spark, sf))))


@query("s04_parse_items", f"WITH {ITEM_SQL} SELECT item_id, pred, {NORM} AS val FROM items")
def s04(spark, sf):
    return rd.parse_items(s12(spark, sf))


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]

USER_TX = f"""tx AS (SELECT user_id AS tid, list_position({EVENT_TYPES}, event_type) AS item,
    CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS util
  FROM events GROUP BY 1, 2)"""


def coded_tx(spark, sf):
    kinds = F.array(*[F.lit(t) for t in EVENT_TYPES])
    return merged_items(
        table(spark, sf, "events").select(
            F.col("user_id").alias("tid"), F.array_position(kinds, F.col("event_type")).cast("int").alias("item"),
            F.round(F.col("value") * 100).cast("bigint").alias("util"),
        )
    )


@query("s11_render_transactions", f"""WITH {USER_TX} SELECT 'positive(p' || tid || ')::' || string_agg(CAST(item AS VARCHAR), ' ' ORDER BY util DESC, item)
  || ':' || CAST(sum(util) AS BIGINT) || ':' || string_agg(CAST(util AS VARCHAR), ' ' ORDER BY util DESC, item) AS value FROM tx GROUP BY tid""")
def s11(spark, sf):
    return wr.render_transactions(coded_tx(spark, sf))


@query("s05_parse_transactions", f"WITH {USER_TX} SELECT 'p' || tid AS tid, item, util FROM tx")
def s05(spark, sf):
    noise = spark.createDataFrame([("# comment",), ("@meta",), ("",), ("positive(p1):::0:",)], "value string")
    return rd.parse_transactions(s11(spark, sf).unionByName(noise))


@query("s10_attribution_lines", f"WITH {ATTRIBUTIONS} SELECT 'p' || case_id AS case_id, pred, {NORM} AS val, round(phi, 6) AS phi FROM attributions")
def s10(spark, sf):
    """Attribution lines, written and parsed; spelled-out doubles are compared rounded."""
    lines = wr.render_attributions(order_attributions(orders_cases(spark, sf)))
    return rd.parse_attributions(lines).withColumn("phi", F.round("phi", 6))


@query("s06_parse_attributions", """SELECT 'p' || event_id AS case_id, event_type AS pred, replace(CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR), '.', '') AS val,
  CAST(event_id AS DOUBLE) / 8 AS phi FROM events""")
def s06(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("case_id"), F.col("event_type").alias("pred"),
        F.col("value").cast("decimal(12,2)").cast("string").alias("val"),
        (F.col("event_id").cast("double") / 8).alias("phi"),
    )
    return rd.parse_attributions(wr.render_attributions(rows))


@query("s13_rule_lines_with_coverage", f"""WITH {WIDE_ORDERS} SELECT 0 AS rule_id, 'positive(A):-has_flag(A,''A''),not(ab0(A)).' AS value,
    count(*) FILTER (list_contains(string_split({FIRED}, ','), '0')) AS covered FROM wide
  UNION ALL SELECT 1, 'positive(A):-priority(A,1-URGENT),price_q(A,3).', count(*) FILTER (list_contains(string_split({FIRED}, ','), '1')) FROM wide
  UNION ALL SELECT 2, 'positive(A):-segment(A,''BUILDING''),region(A,''ASIA''),not(ab1(A)).', count(*) FILTER (list_contains(string_split({FIRED}, ','), '2')) FROM wide
  UNION ALL SELECT 3, 'positive(A):-priority(A,2-HIGH),price_q(A,0),has_flag(A,''R'').', count(*) FILTER (list_contains(string_split({FIRED}, ','), '3')) FROM wide""")
def s13(spark, sf):
    """Rule texts next to how many orders each rule covers."""
    from ..operators.coverage import score

    fired = score(cases(spark, sf).df, THEORY).select(F.explode("fired").alias("rule_id"))
    counts = fired.groupBy("rule_id").agg(F.count(F.lit(1)).alias("covered"))
    return wr.render_rules(THEORY.to_df(spark)).join(counts, "rule_id")


@query("s07_parsed_rules_score", f"WITH {WIDE_ORDERS} SELECT case_id, CAST({HIT} AS INTEGER) AS pred FROM wide")
def s07(spark, sf):
    """Rules rendered, parsed from their text, and used to score all orders."""
    from ..operators.coverage import score
    from ..rules import theory_from_rows

    texts = wr.render_rules(THEORY.to_df(spark))
    parsed = rd.parse_rules(texts).join(texts.withColumnRenamed("value", "rule_text"), "rule_text")
    theory = theory_from_rows(parsed.collect(), "positive")
    return score(cases(spark, sf).df, theory).select("case_id", F.col("pred").cast("int").alias("pred"))


@query("s14_render_itemsets", f"""WITH {SUBSETS}, best AS (SELECT list_sort(itemset) AS itemset, util FROM mined WHERE len(itemset) >= 2
    ORDER BY util DESC, len(itemset), list_sort(itemset) LIMIT 5)
  SELECT array_to_string(itemset, ' ') || ' #UTIL: ' || util AS value FROM best""")
def s14(spark, sf):
    return wr.render_itemsets(top_k_utility_itemsets(baskets(spark, sf), 5, min_len=2))
