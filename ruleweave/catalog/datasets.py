"""The driver tables seen as case tables, transactions, attributions and relations.

Every Spark dataset has a SQL twin of the same name, to be used as a common table
expression in oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.gain import candidate_counts, case_weights
from ..operators.prep import CaseTable, bin_code, to_facts
from ..operators.ranks import exact_quantiles

QUARTERS = [0.0, 0.25, 0.5, 0.75, 1.0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- orders as cases


def orders_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with customer segment and region, before discretizing."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("case_id"),
        "o_custkey",
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderpriority").alias("priority"),
    )
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"),
        "c_nationkey",
        F.col("c_mktsegment").alias("segment"),
    )
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"
    )
    region = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region")
    )
    return (
        orders.join(customer, "o_custkey", "left")
        .join(nation, "c_nationkey", "left")
        .join(region, "n_regionkey", "left")
        .select("case_id", "status", "price", "priority", "segment", "region")
    )


def orders_cases(spark: SparkSession, sf_dir: str, flags: bool = False) -> CaseTable:
    """Orders; positive when finished. With ``flags``, also the set of return flags of
    the order's lines (orders without lines have none).
    """
    prices = table(spark, sf_dir, "orders")
    edges = exact_quantiles(prices, ["o_totalprice"], QUARTERS)["o_totalprice"]
    raw = orders_raw(spark, sf_dir)
    df = raw.select(
        "case_id",
        (F.col("status") == "F").alias("is_pos"),
        "priority",
        bin_code(F.col("price"), edges).cast("string").alias("price_q"),
        "segment",
        "region",
    )
    attrs = ("priority", "price_q", "segment", "region")
    if flags:
        lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(
            F.array_sort(F.collect_set("l_returnflag")).alias("has_flag")
        )
        df = df.join(lines, "case_id", "left")
        attrs = (*attrs, "has_flag")
    return CaseTable(df, attrs)


ORDERS = """
edges AS (SELECT quantile_cont(o_totalprice, [0.0, 0.25, 0.5, 0.75, 1.0]) AS e FROM orders),
cases AS (
  SELECT o_orderkey AS case_id, o_orderstatus = 'F' AS is_pos, o_orderpriority AS priority,
    CAST(greatest(len(list_filter(list_distinct(e), lambda x: x < o_totalprice)) - 1, 0)
      AS VARCHAR) AS price_q,
    c_mktsegment AS segment, r_name AS region
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey CROSS JOIN edges)"""

FLAGS = """
flags AS (SELECT DISTINCT l_orderkey AS case_id, l_returnflag AS has_flag FROM lineitem)"""

ORDER_FACTS = ORDERS + """,
facts AS (
  SELECT 'priority' AS pred, case_id, priority AS val FROM cases WHERE priority IS NOT NULL
  UNION ALL SELECT 'price_q', case_id, price_q FROM cases WHERE price_q IS NOT NULL
  UNION ALL SELECT 'segment', case_id, segment FROM cases WHERE segment IS NOT NULL
  UNION ALL SELECT 'region', case_id, region FROM cases WHERE region IS NOT NULL)"""

ORDER_FLAG_FACTS = ORDERS + "," + FLAGS + """,
facts AS (
  SELECT 'priority' AS pred, case_id, priority AS val FROM cases WHERE priority IS NOT NULL
  UNION ALL SELECT 'price_q', case_id, price_q FROM cases WHERE price_q IS NOT NULL
  UNION ALL SELECT 'segment', case_id, segment FROM cases WHERE segment IS NOT NULL
  UNION ALL SELECT 'region', case_id, region FROM cases WHERE region IS NOT NULL
  UNION ALL SELECT 'has_flag', case_id, has_flag FROM flags
    WHERE case_id IN (SELECT case_id FROM cases))"""

WIDE_ORDERS = ORDERS + """,
flagged AS (
  SELECT l_orderkey AS case_id, bool_or(l_returnflag = 'A') AS fa, bool_or(l_returnflag = 'N') AS fn,
    bool_or(l_returnflag = 'R') AS fr FROM lineitem GROUP BY 1),
wide AS (
  SELECT cases.*, coalesce(fa, false) AS has_a, coalesce(fn, false) AS has_n,
    coalesce(fr, false) AS has_r FROM cases LEFT JOIN flagged USING (case_id))"""


# ---------------------------------------------------------------- documents as cases


def document_cases(spark: SparkSession, sf_dir: str) -> CaseTable:
    """Labelled documents; positive when of good quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    edges = exact_quantiles(docs, ["n_chars"], QUARTERS)["n_chars"]
    labels = table(spark, sf_dir, "labels")
    df = docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("case_id"),
        (F.col("quality") == 1).alias("is_pos"),
        "lang",
        "source",
        bin_code(F.col("n_chars").cast("double"), edges).cast("string").alias("chars_q"),
        F.col("toxic").cast("string").alias("toxic"),
    )
    return CaseTable(df, ("lang", "source", "chars_q", "toxic"))


DOCUMENTS = """
edges AS (SELECT quantile_cont(n_chars, [0.0, 0.25, 0.5, 0.75, 1.0]) AS e FROM documents),
cases AS (
  SELECT doc_id AS case_id, quality = 1 AS is_pos, lang, source,
    CAST(greatest(len(list_filter(list_distinct(e), lambda x: x < n_chars)) - 1, 0)
      AS VARCHAR) AS chars_q, CAST(toxic AS VARCHAR) AS toxic
  FROM documents JOIN labels USING (doc_id) CROSS JOIN edges)"""


# ---------------------------------------------------------------- order baskets


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utility transactions: brands bought per order, in cents: (tid, item, util)."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    return lines.join(part, lines["l_partkey"] == part["p_partkey"]).select(
        F.col("l_orderkey").alias("tid"),
        F.col("p_brand").alias("item"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("util"),
    )


BASKETS = """
tx AS (
  SELECT l_orderkey AS tid, p_brand AS item,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS util
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
totals AS (SELECT tid, CAST(sum(util) AS BIGINT) AS total FROM tx GROUP BY 1),
twus AS (SELECT item, CAST(sum(total) AS BIGINT) AS twu FROM tx JOIN totals USING (tid) GROUP BY 1)"""

SUBSETS = """RECURSIVE """ + BASKETS.lstrip() + """,
subsets AS (
  SELECT tid, [item] AS itemset, item AS last, util FROM tx
  UNION ALL
  SELECT s.tid, list_append(s.itemset, tx.item), tx.item, s.util + tx.util
  FROM subsets s JOIN tx ON s.tid = tx.tid AND tx.item > s.last),
mined AS (SELECT itemset, CAST(sum(util) AS BIGINT) AS util FROM subsets GROUP BY 1)"""


# ---------------------------------------------------------------- attributions of orders


def order_attributions(cases: CaseTable) -> DataFrame:
    """Attributions of the linear model whose weights are the log-odds of each literal.

    With weight w and share m of the cases having the literal, a case that has it gets
    w (1 - m): (case_id, pred, val, phi).
    """
    p, n = case_weights()
    counts = candidate_counts(cases.df, cases.attrs, p, n, cases.unary)
    totals = cases.df.agg(F.count_if("is_pos").alias("p_all"), F.count_if(~F.col("is_pos")).alias("n_all"))
    t = totals.first()
    odds = F.log((F.col("p_cov") + 1) / (F.col("n_cov") + 1))
    prior = F.log(F.lit((t["p_all"] + 1) / (t["n_all"] + 1)))
    share = (F.col("p_cov") + F.col("n_cov")) / F.lit(t["p_all"] + t["n_all"])
    weights = counts.select("pred", "val", ((odds - prior) * (1 - share)).alias("phi"))
    return to_facts(cases).join(weights, ["pred", "val"]).select("case_id", "pred", "val", "phi")


ATTRIBUTIONS = ORDER_FACTS + """,
priors AS (SELECT count(*) FILTER (WHERE is_pos) AS p_all, count(*) FILTER (WHERE NOT is_pos) AS n_all
  FROM cases),
weights AS (
  SELECT pred, val, (ln((count(*) FILTER (WHERE is_pos) + 1.0::DOUBLE)
      / (count(*) FILTER (WHERE NOT is_pos) + 1.0::DOUBLE))
    - ln((max(p_all) + 1.0::DOUBLE) / (max(n_all) + 1.0::DOUBLE)))
    * (1 - count(*)::DOUBLE / (max(p_all) + max(n_all))::DOUBLE) AS phi
  FROM facts JOIN cases USING (case_id) CROSS JOIN priors GROUP BY 1, 2),
attributions AS (SELECT case_id, pred, val, phi FROM facts JOIN weights USING (pred, val))"""


# ---------------------------------------------------------------- relations


def relations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Orders as examples (O, is_pos), and the tables around them as predicates."""
    orders = table(spark, sf_dir, "orders")
    examples = orders.select(F.col("o_orderkey").alias("O"), (F.col("o_orderstatus") == "F").alias("is_pos"))
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    lines = table(spark, sf_dir, "lineitem")
    tables = {
        "ordered_by": orders.select(F.col("o_orderkey").alias("a0"), F.col("o_custkey").alias("a1")),
        "in_nation": customer.select(F.col("c_custkey").alias("a0"), F.col("c_nationkey").alias("a1")),
        "segment": customer.select(F.col("c_custkey").alias("a0"), F.col("c_mktsegment").alias("a1")),
        "in_region": nation.select(F.col("n_nationkey").alias("a0"), F.col("n_regionkey").alias("a1")),
        "region_name": region.select(F.col("r_regionkey").alias("a0"), F.col("r_name").alias("a1")),
        "has_part": lines.select(F.col("l_orderkey").alias("a0"), F.col("l_partkey").alias("a1")),
        "has_flag": lines.select(F.col("l_orderkey").alias("a0"), F.col("l_returnflag").alias("a1")),
        "ship_status": lines.select(F.col("l_orderkey").alias("a0"), F.col("l_linestatus").alias("a1")),
        "brand": table(spark, sf_dir, "part").select(
            F.col("p_partkey").alias("a0"), F.col("p_brand").alias("a1")
        ),
    }
    return examples, tables
