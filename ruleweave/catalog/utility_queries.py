"""Utility mining on order baskets, and learners on attributions of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribution as at
from ..operators import utility as ut
from ..operators.gain import literals_in
from ..operators.prep import CaseTable, to_facts
from .datasets import ATTRIBUTIONS, BASKETS, SUBSETS, baskets, order_attributions, orders_cases, table
from .registry import query

ITEMS = "array_to_string(list_sort(itemset), ' ') AS itemset"


def named(df):
    return df.withColumn("itemset", F.array_join(F.array_sort("itemset"), " "))


@query("a09_twu", f"WITH {BASKETS} SELECT item, twu FROM twus")
def a09(spark, sf):
    return ut.twu(ut.merged_items(baskets(spark, sf)))


@query("a11_transaction_utility", f"WITH {BASKETS} SELECT tid, total FROM totals")
def a11(spark, sf):
    return ut.transaction_utility(baskets(spark, sf))


LISTS = f"""{BASKETS}, ordered AS (SELECT tid, item, util, twu,
  coalesce(CAST(sum(util) OVER (PARTITION BY tid ORDER BY twu, item ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
    AS BIGINT), 0) AS rutil FROM tx JOIN twus USING (item))"""


@query("u01_utility_lists", f"WITH {LISTS} SELECT item, tid, util AS iutil, rutil FROM ordered")
def u01(spark, sf):
    return ut.utility_lists(baskets(spark, sf))


@query("a10_itemset_utilities", f"WITH {LISTS} SELECT item, CAST(sum(util) AS BIGINT) AS util, CAST(sum(rutil) AS BIGINT) AS rutil FROM ordered GROUP BY 1")
def a10(spark, sf):
    return ut.itemset_utilities(ut.utility_lists(baskets(spark, sf)), "item")


@query("w01_remaining_utility", """WITH tx AS (SELECT user_id AS tid, event_type AS item,
    CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS util FROM events GROUP BY ALL)
  SELECT tid, item, util, coalesce(CAST(sum(util) OVER (PARTITION BY tid ORDER BY item
    ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS BIGINT), 0) AS rutil FROM tx""")
def w01(spark, sf):
    return ut.remaining_utility(ut.merged_items(user_tx(spark, sf)), order=["item"])


def user_tx(spark, sf):
    """Events as transactions of their users: (tid, item, util)."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("tid"), F.col("event_type").alias("item"),
        F.round(F.col("value") * 100).cast("bigint").alias("util"),
    )


@query("w02_top_per_case", f"""WITH {BASKETS} SELECT tid, item, util FROM tx
  QUALIFY row_number() OVER (PARTITION BY tid ORDER BY util DESC, item) <= 3""")
def w02(spark, sf):
    return ut.top_per_case(ut.merged_items(baskets(spark, sf)), 3, key="tid")


@query("t01_top_k", f"WITH {BASKETS} SELECT tid, total AS util FROM totals ORDER BY total DESC, tid LIMIT 10")
def t01(spark, sf):
    totals = ut.transaction_utility(baskets(spark, sf)).withColumnRenamed("total", "util")
    return ut.top_k(totals, 10, ties=["tid"])


@query("j04_extend_lists", f"""WITH {LISTS}, m AS (SELECT CAST(sum(util) AS BIGINT) // 7 AS least FROM tx),
  one AS (SELECT item FROM ordered GROUP BY 1 HAVING sum(util) + sum(rutil) >= (SELECT least FROM m)),
  two AS (SELECT a.tid, a.item AS i, b.item AS j, a.util + b.util AS util, b.rutil, b.twu
    FROM ordered a JOIN ordered b ON a.tid = b.tid AND (b.twu, b.item) > (a.twu, a.item)
    WHERE a.item IN (SELECT item FROM one)),
  pairs AS (SELECT i, j, i || ' ' || j AS itemset, CAST(sum(util) AS BIGINT) AS util, CAST(sum(rutil) AS BIGINT) AS rutil,
    count(*) AS transactions FROM two GROUP BY ALL),
  three AS (SELECT i || ' ' || j || ' ' || c.item AS itemset, two.util + c.util AS util, c.rutil
    FROM two JOIN pairs USING (i, j) JOIN ordered c ON c.tid = two.tid AND (c.twu, c.item) > (two.twu, two.j)
    WHERE pairs.util + pairs.rutil >= (SELECT least FROM m) // 10)
  SELECT itemset, util, rutil, transactions FROM pairs
  UNION ALL SELECT itemset, CAST(sum(util) AS BIGINT), CAST(sum(rutil) AS BIGINT), count(*) FROM three GROUP BY 1""")
def j04(spark, sf):
    """Utility lists of pairs and then of triples, of every prefix that can reach the threshold, summed up."""
    tx = baskets(spark, sf)
    least = tx.agg(F.sum("util")).first()[0] // 7
    pairs = ut.extend_all_lists(ut.single_lists(tx), least)
    both = pairs.unionByName(ut.extend_all_lists(pairs, least // 10))
    return both.groupBy(F.array_join("itemset", " ").alias("itemset")).agg(
        F.sum("iutil").alias("util"), F.sum("rutil").alias("rutil"), F.count(F.lit(1)).alias("transactions")
    )


@query("u02_top_k_itemsets", f"WITH {SUBSETS} SELECT {ITEMS}, util FROM mined ORDER BY util DESC, len(mined.itemset), list_sort(mined.itemset) LIMIT 20")
def u02(spark, sf):
    return named(ut.top_k_utility_itemsets(baskets(spark, sf), 20))


@query("u02_top_k_longer_itemsets", f"WITH {SUBSETS} SELECT {ITEMS}, util FROM mined WHERE len(mined.itemset) >= 2 ORDER BY util DESC, len(mined.itemset), list_sort(mined.itemset) LIMIT 10")
def u02b(spark, sf):
    return named(ut.top_k_utility_itemsets(baskets(spark, sf), 10, min_len=2))


COMPLETE = """WITH RECURSIVE tx AS (SELECT user_id AS tid, event_type AS item,
    CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS util FROM events GROUP BY ALL),
  subsets AS (SELECT tid, [item] AS itemset, item AS last, util FROM tx UNION ALL
    SELECT s.tid, list_append(s.itemset, tx.item), tx.item, s.util + tx.util FROM subsets s
    JOIN tx ON s.tid = tx.tid AND tx.item > s.last),
  mined AS (SELECT itemset, CAST(sum(util) AS BIGINT) AS util FROM subsets GROUP BY 1)"""


@query("u02_top_k_dense", f"{COMPLETE} SELECT {ITEMS}, util FROM mined ORDER BY util DESC, len(mined.itemset), list_sort(mined.itemset) LIMIT 7")
def u02c(spark, sf):
    """Every user has every event type: the best itemset is the longest one."""
    return named(ut.top_k_utility_itemsets(user_tx(spark, sf), 7))


@query("u03_top_k_with_ties", f"""WITH RECURSIVE {BASKETS.lstrip()}, coarse AS (SELECT tid, item, util // 10000000 AS util FROM tx),
  subsets AS (SELECT tid, [item] AS itemset, item AS last, util FROM coarse UNION ALL
    SELECT s.tid, list_append(s.itemset, c.item), c.item, s.util + c.util FROM subsets s
    JOIN coarse c ON s.tid = c.tid AND c.item > s.last),
  mined AS (SELECT itemset, CAST(sum(util) AS BIGINT) AS util FROM subsets GROUP BY 1)
  SELECT {ITEMS}, util FROM mined QUALIFY rank() OVER (ORDER BY util DESC) <= 60""")
def u03(spark, sf):
    """The best itemsets of every length in coarse units, with all that equal the last of them."""
    coarse = ut.merged_items(baskets(spark, sf)).withColumn("util", F.expr("util div 10000000"))
    return named(ut.top_k_utility_itemsets(coarse, 60, with_ties=True, items_once=True))


@query("u04_next_unused", f"""WITH {SUBSETS}, ranked AS (SELECT itemset, util, row_number() OVER (ORDER BY util DESC, len(itemset), list_sort(itemset)) AS nth FROM mined)
  SELECT {ITEMS}, util FROM ranked WHERE nth NOT IN (1, 2, 4) ORDER BY nth LIMIT 1""")
def u04(spark, sf):
    tx = baskets(spark, sf)
    rows = ut.mining_rows(tx, 4)
    best = ut.top_k_utility_itemsets(tx, 4, rows=rows).orderBy(F.desc("util")).collect()
    used = spark.createDataFrame([(best[i]["itemset"],) for i in (0, 1, 3)], "itemset array<string>")
    return named(ut.next_itemset(tx, used, rows))


@query("u05_threshold_itemsets", f"""WITH {SUBSETS} SELECT {ITEMS}, util FROM mined WHERE util >=
  (SELECT CAST(sum(util) AS BIGINT) // 80 FROM tx)""")
def u05(spark, sf):
    tx = baskets(spark, sf)
    total = tx.agg(F.sum("util")).first()[0]
    return named(ut.utility_itemsets(tx, total // 80))


# ---------------------------------------------------------------- attributions


def guided_cases(spark, sf) -> tuple[CaseTable, object]:
    """Order cases and their attributions in long form."""
    cases = orders_cases(spark, sf)
    return cases, order_attributions(cases)


def with_phi(cases: CaseTable, attributions) -> CaseTable:
    """Case table with one attribution column per attribute."""
    wide = attributions.groupBy("case_id").agg(
        *[F.max(F.when(F.col("pred") == a, F.col("phi"))).alias(f"phi_{a}") for a in cases.attrs]
    )
    return CaseTable(cases.df.join(wide, "case_id", "left"), cases.attrs)


@query("m09_attributions_to_facts", f"WITH {ATTRIBUTIONS} SELECT case_id, pred, val, round(phi, 6) AS phi FROM attributions WHERE pred <> 'region'")
def m09(spark, sf):
    """Attributions of all literals, cut down to the facts of the cases."""
    cases, phi = guided_cases(spark, sf)
    facts = to_facts(CaseTable(cases.df, ("priority", "price_q", "segment")))
    return at.attributions_to_facts(phi, facts).withColumn("phi", F.round("phi", 6))


@query("a12_signed_attribution", f"""WITH {ATTRIBUTIONS} SELECT pred, val, round(sum(CASE WHEN is_pos THEN phi ELSE -phi END), 5) AS total
  FROM attributions JOIN cases USING (case_id) GROUP BY 1, 2""")
def a12(spark, sf):
    cases, phi = guided_cases(spark, sf)
    return at.signed_attribution(phi, cases.df).withColumn("total", F.round("total", 5))


@query("t02_top_literals", f"""WITH {ATTRIBUTIONS}, s AS (SELECT pred, val, sum(CASE WHEN is_pos THEN phi ELSE -phi END) AS total
  FROM attributions JOIN cases USING (case_id) GROUP BY 1, 2) SELECT pred, val, round(total, 5) AS total FROM s ORDER BY s.total DESC, pred, val LIMIT 6""")
def t02(spark, sf):
    cases, phi = guided_cases(spark, sf)
    return at.top_literals(at.signed_attribution(phi, cases.df)).withColumn("total", F.round("total", 5))


DICTIONARY = """items AS (SELECT CAST(row_number() OVER (ORDER BY pred, val) - 1 AS INTEGER) AS item_id, pred, val
  FROM (SELECT DISTINCT pred, val FROM facts))"""


@query("u07_item_dictionary", f"WITH {ATTRIBUTIONS}, {DICTIONARY} SELECT item_id, pred, val FROM items")
def u07(spark, sf):
    return at.item_dictionary(literals_in(orders_cases(spark, sf)))


ORDER_TX = f"""{ATTRIBUTIONS}, {DICTIONARY},
  kept AS (SELECT case_id, pred, val, is_pos, CAST(abs(round(phi * 1000)) AS BIGINT) AS util
    FROM attributions JOIN cases USING (case_id) WHERE (is_pos AND phi > 0) OR (NOT is_pos AND phi < 0))"""


@query("u06_attributions_to_tx", f"""WITH {ORDER_TX} SELECT case_id AS tid, item_id AS item, util FROM kept JOIN items USING (pred, val)""")
def u06(spark, sf):
    cases, phi = guided_cases(spark, sf)
    items = at.item_dictionary(literals_in(cases))
    return at.attributions_to_tx(phi, cases.df, items).select("tid", "item", "util")


@query("r08_utility_clause", f"""WITH RECURSIVE {ORDER_TX}, pk AS (SELECT case_id AS tid, pred || '=' || val AS item, util FROM kept WHERE is_pos),
  subsets AS (SELECT tid, [item] AS itemset, item AS last, util FROM pk UNION ALL
    SELECT s.tid, list_append(s.itemset, pk.item), pk.item, s.util + pk.util FROM subsets s JOIN pk ON s.tid = pk.tid AND pk.item > s.last),
  best AS (SELECT itemset, sum(util) AS util FROM subsets GROUP BY 1 ORDER BY 2 DESC, len(itemset), itemset LIMIT 1),
  tot AS (SELECT tid, sum(util) AS total FROM pk GROUP BY 1),
  tw AS (SELECT item, sum(total) AS twu FROM pk JOIN tot USING (tid) GROUP BY 1),
  body AS (SELECT row_number() OVER (ORDER BY twu, item) - 1 AS lit_no, item FROM tw, best WHERE list_contains(itemset, item)),
  neg AS (SELECT case_id, pred || '=' || val AS item FROM facts JOIN cases USING (case_id) WHERE NOT is_pos),
  hits AS (SELECT case_id, min(lit_no) FILTER (has IS NULL) AS failing FROM
    (SELECT c.case_id, b.lit_no, n.item AS has FROM (SELECT case_id FROM cases WHERE NOT is_pos) c CROSS JOIN body b
      LEFT JOIN neg n ON n.case_id = c.case_id AND n.item = b.item) GROUP BY 1),
  size AS (SELECT count(*) AS m FROM body),
  cover AS (SELECT l.lit_no + 1 AS len, (SELECT count(*) FROM hits WHERE coalesce(failing, (SELECT m FROM size)) >= l.lit_no + 1) AS n_cov FROM body l),
  keep AS (SELECT min(len) AS len FROM cover WHERE n_cov <= (SELECT n_cov FROM cover, size WHERE len = m))
  SELECT CAST(lit_no AS INTEGER) AS lit_no, split_part(item, '=', 1) AS pred, split_part(item, '=', 2) AS val FROM body, keep WHERE lit_no < len""")
def r08(spark, sf):
    """The first rule body of the utility learner, after trimming."""
    from ..plans.utility_learn import first_clause

    cases, phi = guided_cases(spark, sf)
    body = first_clause(with_phi(cases, phi))
    rows = [(i, lit.pred, lit.val) for i, lit in enumerate(body)]
    return spark.createDataFrame(rows, "lit_no int, pred string, val string")


@query("r10_guided_first_literal", f"""WITH {ATTRIBUTIONS},
  s AS (SELECT pred, val, sum(CAST(round(phi * 1000000) AS BIGINT)) AS total FROM attributions JOIN cases USING (case_id) WHERE is_pos GROUP BY 1, 2),
  top6 AS (SELECT pred, val FROM s ORDER BY total DESC, pred, val LIMIT 6),
  counts AS (SELECT pred, val, count(*) FILTER (is_pos) AS p_cov, count(*) FILTER (NOT is_pos) AS n_cov FROM facts JOIN cases USING (case_id) GROUP BY 1, 2),
  g AS (SELECT c.pred, c.val, p_cov, n_cov, p_cov * (-log2(p_all / (p_all + n_all)) + log2(p_cov / (p_cov + n_cov))) AS gain
    FROM counts c JOIN top6 t ON c.pred = t.pred AND c.val = t.val, priors WHERE p_cov > 0)
  SELECT pred, val, p_cov, n_cov, round(gain, 6) AS gain FROM g WHERE gain > 0""")
def r10(spark, sf):
    """Candidates of the guided learner's first step with their gain."""
    from ..operators.gain import derive_bias, rank_literals
    from ..plans.guided import GuidedSearch, weigh_guided
    from ..plans.learn import LearnSettings, Side

    cases, phi = guided_cases(spark, sf)
    guided = with_phi(cases, phi)
    search = GuidedSearch(weigh_guided(guided), derive_bias(cases), LearnSettings(), top=6)
    pos, neg = Side("p_w", F.lit(True)), Side("n_w", F.lit(True))
    n_pos, n_neg = search.count(pos, neg)
    gains = rank_literals(search.gains([], pos, neg, n_pos, n_neg))
    return gains.withColumn("gain", F.round("gain", 6))
