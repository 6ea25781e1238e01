"""Clauses over orders, customers, nations and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as rel
from ..operators.gain import candidate_counts, case_weights
from ..operators.relational import Atom
from .datasets import relations, table
from .registry import query

BY = Atom("ordered_by", ("O", "C"))
NATION = Atom("in_nation", ("C", "N"))
REGION = Atom("in_region", ("N", "R"))


@query("j02_bind", """SELECT o_orderkey AS o, o_custkey AS c, c_nationkey AS n, l_partkey AS p FROM orders
  JOIN customer ON o_custkey = c_custkey
  JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey""")
def j02(spark, sf):
    examples, tables = relations(spark, sf)
    bound = rel.bind(examples, [BY, NATION, Atom("has_part", ("O", "P"))], tables)
    return bound.select(F.col("O").alias("o"), F.col("C").alias("c"), F.col("N").alias("n"), F.col("P").alias("p"))


@query("j02_bind_negated", """SELECT o_orderkey AS o, o_custkey AS c FROM orders WHERE NOT EXISTS
  (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A')""")
def j02b(spark, sf):
    examples, tables = relations(spark, sf)
    flagged = {**tables, "flag_a": tables["has_flag"].where("a1 = 'A'").select("a0")}
    bound = rel.bind(examples, [BY, Atom("flag_a", ("O",), True)], flagged)
    return bound.select(F.col("O").alias("o"), F.col("C").alias("c"))


@query("c01_covered_relational", """SELECT o_orderkey AS o, o_orderstatus = 'F' AS is_pos FROM orders WHERE EXISTS
  (SELECT 1 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = o_custkey AND n_regionkey = 2)
  AND EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE l_orderkey = o_orderkey AND p_brand = 'Brand#4')""")
def c01r(spark, sf):
    """Orders whose customer lives in region 2 and that contain a part of one brand."""
    examples, tables = relations(spark, sf)
    brand = {**tables, "brand_4": tables["brand"].where("a1 = 'Brand#4'").select("a0"),
             "asia": tables["in_region"].where("a1 = 2").select("a0")}
    body = [BY, NATION, Atom("asia", ("N",)), Atom("has_part", ("O", "P")), Atom("brand_4", ("P",))]
    hits = rel.covered_bindings(examples, ["O"], body, brand)
    return hits.select(F.col("O").alias("o"), "is_pos")


@query("j07_unify", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey % 100 = l_suppkey")
def j07(spark, sf):
    """Lines in which two places hold the same value."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", (F.col("l_partkey") % 100).alias("home")
    )
    return rel.unify(lines, "home", "l_suppkey").select("l_orderkey", "l_partkey", "l_suppkey")


@query("a04_relational_counts", """WITH b AS (SELECT DISTINCT o_orderkey, l_partkey, o_orderstatus = 'F' AS is_pos
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
  SELECT count(DISTINCT o_orderkey) FILTER (is_pos) AS p_cases, count(*) FILTER (is_pos) AS p_tuples,
    count(*) FILTER (NOT is_pos) AS n_tuples FROM b""")
def a04r(spark, sf):
    examples, tables = relations(spark, sf)
    return rel.clause_counts(examples, ["O"], [Atom("has_part", ("O", "P"))], tables)


@query("r01_relational_candidates", """WITH b AS (SELECT DISTINCT o_orderkey, l_partkey, o_orderstatus = 'F' AS is_pos
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
  SELECT 'brand' AS pred, p_brand AS val, count(DISTINCT o_orderkey) FILTER (is_pos) AS p_cases,
    count(*) FILTER (is_pos) AS p_tuples, count(*) FILTER (NOT is_pos) AS n_tuples
  FROM b JOIN part ON l_partkey = p_partkey GROUP BY 2""")
def r01r(spark, sf):
    """Counts of has_part(O,P), brand(P,v) for every brand v."""
    examples, tables = relations(spark, sf)
    bound = rel.bind(examples, [Atom("has_part", ("O", "P"))], tables)
    return rel.constant_candidates(bound, "brand", "P", tables, "O")


@query("r11_determinacy", """WITH w AS (SELECT o_orderkey, o_orderstatus = 'F' AS is_pos,
    (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey) AS ways FROM orders)
  SELECT 'has_part' AS pred, min(ways) FILTER (is_pos) AS p_min, max(ways) FILTER (is_pos) AS p_max,
    max(ways) FILTER (NOT is_pos) AS n_max FROM w
  UNION ALL SELECT 'ordered_by', 1, 1, 1""")
def r11(spark, sf):
    examples, tables = relations(spark, sf)
    parts = rel.determinacy(examples, Atom("has_part", ("O", "P")), tables).select(F.lit("has_part").alias("pred"), "*")
    by = rel.determinacy(examples, BY, tables).select(F.lit("ordered_by").alias("pred"), "*")
    return parts.unionByName(by)


@query("r11_determinate_literals", """SELECT o_orderkey AS o, o_custkey AS c, c_nationkey AS n, n_regionkey AS r FROM orders
  LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def r11b(spark, sf):
    """Tables reachable from an order by determinate literals; parts are not among them."""
    examples, tables = relations(spark, sf)
    candidates = [Atom("has_part", ("O", "P")), BY, NATION, REGION]
    bound, _ = rel.determinate_literals(examples, candidates, tables, bound=3)
    return bound.select(F.col("O").alias("o"), F.col("C").alias("c"), F.col("N").alias("n"), F.col("R").alias("r"))


@query("r11_relational_literals", """WITH c AS (SELECT o_orderkey AS case_id, o_orderstatus = 'F' AS is_pos, c_mktsegment AS segment,
    r_name AS region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey),
  f AS (SELECT 'segment' AS pred, case_id, segment AS val FROM c UNION ALL SELECT 'region', case_id, region FROM c
    UNION ALL SELECT DISTINCT 'flag', l_orderkey, l_returnflag FROM lineitem)
  SELECT pred, val, count(*) FILTER (is_pos) AS p_cov, count(*) FILTER (NOT is_pos) AS n_cov FROM f JOIN c USING (case_id) GROUP BY 1, 2""")
def r11c(spark, sf):
    """Candidate counts of attributes found in the reached tables."""
    examples, tables = relations(spark, sf)
    bound, _ = rel.determinate_literals(examples, [BY, NATION, REGION], tables, bound=3)
    attributes = {"segment": ("segment", "C"), "region": ("region_name", "R"), "flag": ("has_flag", "O")}
    cases = rel.relational_cases(bound, "O", attributes, tables)
    return candidate_counts(cases.df, cases.attrs, *case_weights())


@query("a06_closed_world_pairs", """WITH cov AS (SELECT count(DISTINCT c_custkey) * (SELECT count(*) FROM nation) AS cov FROM customer
    WHERE c_mktsegment = 'BUILDING'),
  p AS (SELECT count(*) AS p_cov FROM customer WHERE c_mktsegment = 'BUILDING')
  SELECT p_cov, cov - p_cov AS n_cov FROM cov, p""")
def a06n(spark, sf):
    """Covered pairs of a two-place head in a closed world, counted without the pairs."""
    customer = table(spark, sf, "customer")
    positives = customer.select(F.col("c_custkey").alias("C"), F.col("c_nationkey").alias("N"))
    proved = customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("C"))
    sizes = {"C": customer.count(), "N": table(spark, sf, "nation").count()}
    return rel.closed_world_counts(positives, proved, ["C", "N"], sizes)
