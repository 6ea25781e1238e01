"""Coverage, scoring, gain and quality on the order and document cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import clause_bits, explicit_bits
from ..operators import coverage as cov
from ..operators import evaluate as ev
from ..operators.gain import (
    argmax_literal,
    candidate_counts,
    case_weights,
    derive_bias,
    facts_candidate_counts,
    literals_in,
    rank_literals,
    weigh,
    with_gain,
)
from ..operators.prep import to_facts
from ..plans.learn import LearnSettings, grow_steps
from ..plans.prune import coverage_of
from ..rules import Literal, Rule, Theory, rule_condition
from .datasets import (
    DOCUMENTS,
    ORDER_FACTS,
    ORDER_FLAG_FACTS,
    WIDE_ORDERS,
    document_cases,
    orders_cases,
    table,
)
from .registry import query


def lit(pred: str, val: str) -> Literal:
    return Literal(pred, val)


def no(name: str) -> Literal:
    return Literal(name, None, True)


# A fixed theory about orders, with a nested exception and one exception nothing uses.
RULES = (
    Rule("positive", (lit("has_flag", "A"), no("ab0"))),
    Rule("positive", (lit("priority", "1-URGENT"), lit("price_q", "3"))),
    Rule("positive", (lit("segment", "BUILDING"), lit("region", "ASIA"), no("ab1"))),
    Rule("positive", (lit("priority", "2-HIGH"), lit("price_q", "0"), lit("has_flag", "R"))),
)
EXCEPTIONS = (
    Rule("ab0", (lit("has_flag", "N"), lit("price_q", "0"))),
    Rule("ab0", (lit("region", "ASIA"), no("ab2"))),
    Rule("ab1", (lit("has_flag", "R"),)),
    Rule("ab2", (lit("priority", "5-LOW"),)),
    Rule("ab3", (lit("priority", "3-MEDIUM"),)),
)
THEORY = Theory("positive", RULES, EXCEPTIONS)

AB2 = "(priority = '5-LOW')"
AB1 = "(has_r)"
AB0 = f"((has_n AND price_q = '0') OR (region = 'ASIA' AND NOT {AB2}))"
R0 = f"(has_a AND NOT {AB0})"
R1 = "(priority = '1-URGENT' AND price_q = '3')"
R2 = f"(segment = 'BUILDING' AND region = 'ASIA' AND NOT {AB1})"
R3 = "(priority = '2-HIGH' AND price_q = '0' AND has_r)"
HIT = f"({R0} OR {R1} OR {R2} OR {R3})"
FIRED = (
    f"concat_ws(',', CASE WHEN {R0} THEN '0' END, CASE WHEN {R1} THEN '1' END, "
    f"CASE WHEN {R2} THEN '2' END, CASE WHEN {R3} THEN '3' END)"
)


def cases(spark, sf):
    return orders_cases(spark, sf, flags=True)


@query("c01_covered", f"WITH {WIDE_ORDERS} SELECT case_id, CAST(is_pos AS INTEGER) AS is_pos FROM wide WHERE {R1}")
def c01(spark, sf):
    hits = cov.covered(orders_cases(spark, sf).df, RULES[1])
    return hits.select("case_id", F.col("is_pos").cast("int").alias("is_pos"))


@query("c02_uncovered", f"WITH {WIDE_ORDERS} SELECT case_id FROM wide WHERE NOT coalesce({R3}, false)")
def c02(spark, sf):
    return cov.uncovered(cases(spark, sf).df, RULES[3]).select("case_id")


@query("c03_negated_literal", f"WITH {WIDE_ORDERS} SELECT case_id FROM wide WHERE {R2}")
def c03(spark, sf):
    return cov.covered(cases(spark, sf).df, RULES[2], THEORY).select("case_id")


@query("c04_nested_exceptions", f"WITH {WIDE_ORDERS} SELECT case_id FROM wide WHERE {R0}")
def c04(spark, sf):
    return cov.covered(cases(spark, sf).df, RULES[0], THEORY).select("case_id")


SCORED = f"""WITH {WIDE_ORDERS} SELECT case_id, CAST({HIT} AS INTEGER) AS pred, {FIRED} AS fired FROM wide"""


@query("c05_score", SCORED)
def c05(spark, sf):
    scored = cov.score(cases(spark, sf).df, THEORY)
    return scored.select("case_id", F.col("pred").cast("int").alias("pred"), F.array_join("fired", ",").alias("fired"))


@query("c05_score_facts", SCORED)
def c05b(spark, sf):
    table_ = cases(spark, sf)
    scored = cov.score_facts(table_.df.select("case_id"), to_facts(table_), THEORY)
    return scored.select("case_id", F.col("pred").cast("int").alias("pred"), F.array_join("fired", ",").alias("fired"))


@query("c06_drop_alternatives", f"""WITH {WIDE_ORDERS}, a AS (
  SELECT -1 AS dropped, is_pos FROM wide WHERE {R3}
  UNION ALL SELECT 0, is_pos FROM wide WHERE price_q = '0' AND has_r
  UNION ALL SELECT 1, is_pos FROM wide WHERE priority = '2-HIGH' AND has_r
  UNION ALL SELECT 2, is_pos FROM wide WHERE priority = '2-HIGH' AND price_q = '0')
  SELECT dropped, count(*) FILTER (is_pos) AS p_cov, count(*) FILTER (NOT is_pos) AS n_cov FROM a GROUP BY 1""")
def c06(spark, sf):
    return cov.drop_alternatives(cases(spark, sf).df, RULES[3])


@query("c07_recall_bound", f"""WITH {ORDER_FLAG_FACTS} SELECT pred, val,
    count(*) FILTER (is_pos) AS p_cov, count(*) FILTER (NOT is_pos) AS n_cov
  FROM facts JOIN cases USING (case_id) WHERE pred <> 'priority' AND case_id IN
    (SELECT case_id FROM facts WHERE pred = 'priority' AND val = '1-URGENT') GROUP BY ALL""")
def c07(spark, sf):
    """Candidates after priority has been used up by the clause."""
    c = cases(spark, sf)
    body = (lit("priority", "1-URGENT"),)
    p, n = case_weights()
    active = cov.covered(c.df, Rule("positive", body))
    return candidate_counts(active, derive_bias(c).open_attrs(body), p, n)


@query("j01_match_all", f"""WITH {ORDER_FLAG_FACTS} SELECT case_id FROM facts WHERE pred = 'has_flag' AND val = 'A'
  INTERSECT SELECT case_id FROM facts WHERE pred = 'has_flag' AND val = 'R'
  INTERSECT SELECT case_id FROM facts WHERE pred = 'region' AND val = 'EUROPE'""")
def j01(spark, sf):
    wanted = [lit("has_flag", "A"), lit("has_flag", "R"), lit("region", "EUROPE")]
    return cov.match_all(to_facts(cases(spark, sf)), wanted)


@query("j03_semi_anti", """SELECT o_orderkey AS case_id FROM orders WHERE
  EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
  AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A')""")
def j03(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id"), "l_returnflag")
    has_r = orders.join(lines.where("l_returnflag = 'R'"), "case_id", "left_semi")
    return cov.minus(has_r, lines.where("l_returnflag = 'A'"))


# ---------------------------------------------------------------- counting and gain


@query("a01_coverage_counts", f"""WITH {WIDE_ORDERS} SELECT count(*) FILTER (is_pos) AS p_cov,
  count(*) FILTER (NOT is_pos) AS n_cov FROM wide WHERE {R0}""")
def a01(spark, sf):
    return cov.coverage_counts(cases(spark, sf).df, RULES[0], THEORY)


COUNTS = """SELECT pred, val, count(*) FILTER (is_pos) AS p_cov, count(*) FILTER (NOT is_pos) AS n_cov
  FROM facts JOIN cases USING (case_id) GROUP BY 1, 2"""


@query("a02_candidate_counts", f"WITH {ORDER_FLAG_FACTS} {COUNTS}")
def a02(spark, sf):
    c = cases(spark, sf)
    p, n = case_weights()
    return candidate_counts(c.df, c.attrs, p, n)


@query("a02_candidate_counts_grouped", f"WITH {ORDER_FLAG_FACTS} {COUNTS}")
def a02b(spark, sf):
    """The same counts from cases grouped by equal attributes, as learners use them."""
    base = weigh(cases(spark, sf))
    return candidate_counts(base.df, base.attrs, F.col("p_w"), F.col("n_w"))


@query("s03_bias_candidates", f"""WITH {ORDER_FLAG_FACTS}, c AS ({COUNTS})
  SELECT * FROM c WHERE pred IN ('priority', 'price_q') OR (pred = 'region' AND val IN ('ASIA', 'EUROPE'))""")
def s03_bias(spark, sf):
    """Candidates under declarations read from text: no segment or flag, two regions."""
    from ..operators.gain import attribute_modes, bias_filter, bias_from_tables
    from ..sources import readers as rd
    from ..sources import writers as wr

    c = cases(spark, sf)
    constants = spark.createDataFrame([("args_region", "ASIA"), ("args_region", "EUROPE")], "type string, val string")
    lines = wr.render_modes(attribute_modes(c.df, ["priority", "price_q", "region"])).unionByName(
        wr.render_constants(constants, normalize=False)
    )
    bias = bias_from_tables(rd.parse_modes(lines), rd.parse_constants(lines))
    base = weigh(c)
    counts = candidate_counts(base.df, bias.open_attrs([]), F.col("p_w"), F.col("n_w"))
    return bias_filter(counts, bias)


@query("a02_candidate_counts_facts", f"WITH {ORDER_FLAG_FACTS} {COUNTS}")
def a02c(spark, sf):
    """The same counts from raw, repeated facts."""
    c = cases(spark, sf)
    lines = table(spark, sf, "lineitem").select(
        F.lit("has_flag").alias("pred"), F.col("l_orderkey").alias("case_id"), F.col("l_returnflag").alias("val")
    )
    plain = to_facts(orders_cases(spark, sf))
    return facts_candidate_counts(c.df.select("case_id", "is_pos"), plain.unionByName(lines))


GAINS = f"""{ORDER_FLAG_FACTS}, counts AS ({COUNTS}),
tot AS (SELECT count(*) FILTER (is_pos) AS p, count(*) FILTER (NOT is_pos) AS n FROM cases),
gains AS (SELECT pred, val, p_cov, n_cov, CASE WHEN p_cov = 0 THEN 0.0 ELSE
    p_cov * (-log2(p / (p + n)) + log2(p_cov / (p_cov + n_cov))) END AS gain FROM counts, tot)"""


@query("a03_info_value", f"""WITH {GAINS} SELECT pred, val,
  round(CASE WHEN p_cov = 0 THEN 0.0 ELSE -log2(p_cov / (p_cov + n_cov)) END, 6) AS info FROM counts""")
def a03(spark, sf):
    from ..functions.scalar import info_value

    c = cases(spark, sf)
    counts = candidate_counts(c.df, c.attrs, *case_weights())
    return counts.select("pred", "val", F.round(info_value(F.col("p_cov"), F.col("n_cov")), 6).alias("info"))


def order_gains(c):
    counts = candidate_counts(c.df, c.attrs, *case_weights())
    t = c.df.agg(F.count_if("is_pos").alias("p"), F.count_if(~F.col("is_pos")).alias("n")).first()
    return with_gain(counts, t["p"], t["n"])


@query("a04_gain", f"WITH {GAINS} SELECT pred, val, p_cov, n_cov, round(gain, 6) AS gain FROM gains")
def a04(spark, sf):
    return order_gains(cases(spark, sf)).withColumn("gain", F.round("gain", 6))


@query("r02_ranked_literals", f"WITH {GAINS} SELECT pred, val, p_cov, n_cov, round(gain, 6) AS gain FROM gains WHERE gain > 0")
def r02_ranked(spark, sf):
    return rank_literals(order_gains(cases(spark, sf))).withColumn("gain", F.round("gain", 6))


@query("r02_best_literal", f"""WITH {GAINS} SELECT pred, val, p_cov, n_cov, round(gain, 6) AS gain FROM gains
  WHERE gain > 0 ORDER BY gains.gain DESC, pred, val LIMIT 1""")
def r02(spark, sf):
    return argmax_literal(order_gains(cases(spark, sf))).withColumn("gain", F.round("gain", 6))


@query("t04_argmax_documents", f"""WITH {DOCUMENTS}, facts AS (
    SELECT 'lang' AS pred, case_id, lang AS val FROM cases UNION ALL SELECT 'source', case_id, source FROM cases
    UNION ALL SELECT 'chars_q', case_id, chars_q FROM cases UNION ALL SELECT 'toxic', case_id, toxic FROM cases),
  counts AS ({COUNTS}), tot AS (SELECT count(*) FILTER (is_pos) AS p, count(*) FILTER (NOT is_pos) AS n FROM cases),
  gains AS (SELECT pred, val, p_cov, n_cov, CASE WHEN p_cov = 0 THEN 0.0 ELSE
    p_cov * (-log2(p / (p + n)) + log2(p_cov / (p_cov + n_cov))) END AS gain FROM counts, tot)
  SELECT pred, val, p_cov, n_cov, round(gain, 6) AS gain FROM gains WHERE gain > 0
  ORDER BY gains.gain DESC, pred, val LIMIT 1""")
def t04(spark, sf):
    return argmax_literal(order_gains(document_cases(spark, sf))).withColumn("gain", F.round("gain", 6))


@query("a05_rule_accuracy", f"WITH {WIDE_ORDERS} SELECT round(avg(CAST({R1} = is_pos AS INTEGER)), 6) AS accuracy FROM wide")
def a05(spark, sf):
    return cov.rule_accuracy(orders_cases(spark, sf).df, RULES[1]).withColumn("accuracy", F.round("accuracy", 6))


POSITIVES = """positives AS (SELECT DISTINCT l_orderkey AS case_id FROM lineitem WHERE l_returnflag = 'R')"""


@query("a06_closed_world_negatives", f"WITH {POSITIVES} SELECT o_orderkey AS case_id FROM orders WHERE o_orderkey NOT IN (SELECT case_id FROM positives)")
def a06(spark, sf):
    lines = table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    domain = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"))
    return cov.closed_world_negatives(domain, lines.select(F.col("l_orderkey").alias("case_id")))


@query("a06_closed_world_examples", f"""WITH {POSITIVES} SELECT o_orderkey AS case_id,
  CAST(o_orderkey IN (SELECT case_id FROM positives) AS INTEGER) AS is_pos FROM orders""")
def a06b(spark, sf):
    lines = table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    domain = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"))
    examples = cov.closed_world_examples(domain, lines.select(F.col("l_orderkey").alias("case_id")))
    return examples.select("case_id", F.col("is_pos").cast("int").alias("is_pos"))


@query("a07_explicit_negatives", f"WITH {DOCUMENTS} SELECT case_id FROM cases WHERE NOT is_pos")
def a07(spark, sf):
    return cov.explicit_negatives(document_cases(spark, sf).df)


@query("a08_mdl_bits", f"""WITH {GAINS}, lits AS (SELECT count(*) AS n_lit FROM counts)
  SELECT pred, val, round(log2(p + n) + (lgamma(p + n + 1) - lgamma(p_cov + 1) - lgamma(p + n - p_cov + 1)) / ln(2), 4)
    AS explicit, ceil(log2(n_lit)) + 1 AS clause FROM gains, tot, lits WHERE gain > 0 AND p_cov > 0""")
def a08(spark, sf):
    """Both sides of the length test for every gaining one-literal clause."""
    c = cases(spark, sf)
    bits = derive_bias(c).literal_bits
    total = c.df.count()
    rows = [
        (r["pred"], r["val"], round(explicit_bits(total, r["p_cov"]), 4), clause_bits(bits, 1))
        for r in rank_literals(order_gains(c)).collect()  # at most one row per literal
    ]
    return spark.createDataFrame(rows, "pred string, val string, explicit double, clause double")


@query("a13_total_coverage", f"WITH {WIDE_ORDERS} SELECT count(*) FILTER ({HIT} AND is_pos) AS covered, count(*) FILTER (is_pos) AS positives FROM wide")
def a13(spark, sf):
    return cov.total_coverage(cases(spark, sf).df, THEORY)


METRICS = """m AS (SELECT count(*) FILTER (pred AND is_pos) AS tp, count(*) FILTER (NOT pred AND NOT is_pos) AS tn,
    count(*) FILTER (pred AND NOT is_pos) AS fp, count(*) FILTER (NOT pred AND is_pos) AS fn FROM s)
  SELECT tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
    round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision,
    round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
    round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM m"""


@query("a14_evaluate", f"WITH {WIDE_ORDERS}, s AS (SELECT {HIT} AS pred, is_pos FROM wide), {METRICS}")
def a14(spark, sf):
    quality = ev.evaluate(cov.score(cases(spark, sf).df, THEORY))
    return quality.select("tp", "tn", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


# A document classifier by length, to have predictions of several classes.
@query("a15_confusion_matrix", """SELECT o_orderstatus AS label, CASE WHEN o_totalprice < 100000 THEN 'F'
    WHEN o_totalprice < 300000 THEN 'O' ELSE 'P' END AS pred, count(*) AS cnt FROM orders GROUP BY ALL""")
def a15(spark, sf):
    return ev.confusion_matrix(price_guess(spark, sf), "status", "guess")


def price_guess(spark, sf):
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("status"),
        F.when(price < 100000, "F").when(price < 300000, "O").otherwise("P").alias("guess"),
    )


@query("a15_classification_report", """WITH g AS (SELECT o_orderstatus AS label, CASE WHEN o_totalprice < 100000 THEN 'F'
    WHEN o_totalprice < 300000 THEN 'O' ELSE 'P' END AS pred FROM orders),
  k AS (SELECT DISTINCT label AS cls FROM g UNION SELECT DISTINCT pred FROM g),
  c AS (SELECT cls, (SELECT count(*) FROM g WHERE label = cls) AS support,
    (SELECT count(*) FROM g WHERE pred = cls) AS predicted,
    (SELECT count(*) FROM g WHERE pred = cls AND label = cls) AS hit FROM k)
  SELECT cls, round(CASE WHEN predicted = 0 THEN 0 ELSE hit / predicted END, 6) AS precision,
    round(CASE WHEN support = 0 THEN 0 ELSE hit / support END, 6) AS recall,
    round(CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * hit / (support + predicted) END, 6) AS f1, support FROM c""")
def a15b(spark, sf):
    report = ev.classification_report(price_guess(spark, sf), "status", "guess")
    return report.select("cls", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("a16_roc_points", """WITH s AS (SELECT value AS threshold, count(*) FILTER (event_type = 'purchase') AS pos,
    count(*) FILTER (event_type <> 'purchase') AS neg FROM events GROUP BY 1)
  SELECT threshold, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
    round(sum(pos) OVER w / (SELECT sum(pos) FROM s), 6) AS tpr, round(sum(neg) OVER w / (SELECT sum(neg) FROM s), 6) AS fpr
  FROM s WINDOW w AS (ORDER BY threshold DESC)""")
def a16(spark, sf):
    events = table(spark, sf, "events").select("value", (F.col("event_type") == "purchase").alias("is_pos"))
    points = ev.roc_points(events, "value")
    return points.select("threshold", "tp", "fp", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query("a16_auc", """WITH s AS (SELECT value AS s, count(*) FILTER (event_type = 'purchase') AS pos,
    count(*) FILTER (event_type <> 'purchase') AS neg FROM events GROUP BY 1),
  c AS (SELECT pos, neg, sum(neg) OVER (ORDER BY s) AS cum FROM s)
  SELECT round(sum(pos * (cum - neg / 2)) / (sum(pos)::DOUBLE * sum(neg)), 6) AS auc FROM c""")
def a16b(spark, sf):
    events = table(spark, sf, "events").select("value", (F.col("event_type") == "purchase").alias("is_pos"))
    return ev.auc(events, "value").withColumn("auc", F.round("auc", 6))


@query("a17_collect_sets", """SELECT l_orderkey, count(*) AS n, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags
  FROM lineitem GROUP BY 1""")
def a17(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("flags")
    )


# ---------------------------------------------------------------- growing and pruning


@query("r01_refine", f"""WITH {ORDER_FLAG_FACTS}, active AS (SELECT case_id FROM facts WHERE pred = 'has_flag' AND val = 'A')
  SELECT 'has_flag(A,A),' || pred || '(A,' || val || ')' AS body, count(*) FILTER (is_pos) AS p_cov,
    count(*) FILTER (NOT is_pos) AS n_cov FROM facts JOIN cases USING (case_id) JOIN active USING (case_id) GROUP BY 1""")
def r01(spark, sf):
    """All one-literal specializations of a clause with what they cover."""
    c = cases(spark, sf)
    body = (lit("has_flag", "A"),)
    active = cov.covered(c.df, Rule("positive", body))
    counts = candidate_counts(active, derive_bias(c).open_attrs(body), *case_weights())
    text = F.concat(F.lit("has_flag(A,A),"), "pred", F.lit("(A,"), "val", F.lit(")"))
    return counts.select(text.alias("body"), "p_cov", "n_cov")


@query("r03_grow_two_steps", f"""WITH {ORDER_FACTS}, counts AS ({COUNTS}),
  tot AS (SELECT count(*) FILTER (is_pos) AS p, count(*) FILTER (NOT is_pos) AS n FROM cases),
  step1 AS (SELECT pred, val, p_cov, n_cov FROM counts, tot WHERE p_cov > 0 AND
      p_cov * (-log2(p / (p + n)) + log2(p_cov / (p_cov + n_cov))) > 0
    ORDER BY p_cov * (-log2(p / (p + n)) + log2(p_cov / (p_cov + n_cov))) DESC, pred, val LIMIT 1),
  active AS (SELECT f.case_id FROM facts f JOIN step1 s ON f.pred = s.pred AND f.val = s.val),
  counts2 AS (SELECT f.pred, f.val, count(*) FILTER (is_pos) AS p_cov, count(*) FILTER (NOT is_pos) AS n_cov
    FROM facts f JOIN cases USING (case_id) JOIN active USING (case_id)
    WHERE f.pred <> (SELECT pred FROM step1) GROUP BY 1, 2),
  step2 AS (SELECT c.pred, c.val, c.p_cov, c.n_cov FROM counts2 c, step1 t WHERE c.p_cov > 0 AND
      c.p_cov * (-log2(t.p_cov / (t.p_cov + t.n_cov)) + log2(c.p_cov / (c.p_cov + c.n_cov))) > 0
    ORDER BY c.p_cov * (-log2(t.p_cov / (t.p_cov + t.n_cov)) + log2(c.p_cov / (c.p_cov + c.n_cov))) DESC, 1, 2 LIMIT 1)
  SELECT 1 AS step, * FROM step1 UNION ALL SELECT 2, * FROM step2""")
def r03(spark, sf):
    c = orders_cases(spark, sf)
    steps = grow_steps(c, derive_bias(c), 2, LearnSettings(use_mdl=False))
    rows = [(i + 1, l.pred, l.val, p, n) for i, (l, p, n) in enumerate(steps)]
    return spark.createDataFrame(rows, "step int, pred string, val string, p_cov bigint, n_cov bigint")


@query("r05b_enumerated_exceptions", f"""WITH {WIDE_ORDERS} SELECT case_id, CAST(coalesce({R1}, false) AND is_pos AS INTEGER) AS pred FROM wide""")
def r05b(spark, sf):
    """A rule whose covered negatives are listed as its exceptions."""
    c = orders_cases(spark, sf)
    theory = cov.add_enumerated_exceptions(c, RULES[1])
    return cov.score(c.df, theory).select("case_id", F.col("pred").cast("int").alias("pred"))


@query("r06_prune_counts", f"""WITH {WIDE_ORDERS}, v AS (
  SELECT 0 AS variant, count(*) FILTER ({R3} AND is_pos) AS p_cov, count(*) FILTER ({R3} AND NOT is_pos) AS n_cov FROM wide
  UNION ALL SELECT 1, count(*) FILTER (price_q = '0' AND has_r AND is_pos), count(*) FILTER (price_q = '0' AND has_r AND NOT is_pos) FROM wide
  UNION ALL SELECT 2, count(*) FILTER (priority = '2-HIGH' AND has_r AND is_pos), count(*) FILTER (priority = '2-HIGH' AND has_r AND NOT is_pos) FROM wide
  UNION ALL SELECT 3, count(*) FILTER (priority = '2-HIGH' AND price_q = '0' AND is_pos), count(*) FILTER (priority = '2-HIGH' AND price_q = '0' AND NOT is_pos) FROM wide)
  SELECT * FROM v""")
def r06(spark, sf):
    """A rule and its one-literal removals, counted together on grouped cases."""
    base = weigh(cases(spark, sf))
    rule = RULES[3]
    variants = [rule, *[rule.without(i) for i in range(len(rule.body))]]
    rows = [(i, p, n) for i, (p, n) in enumerate(coverage_of(base.df, variants, THEORY))]
    return spark.createDataFrame(rows, "variant int, p_cov bigint, n_cov bigint")


@query("r07_firing_groups", f"""WITH {WIDE_ORDERS} SELECT {FIRED} AS fired, count(*) AS p_w FROM wide
  WHERE is_pos AND {HIT} GROUP BY 1""")
def r07(spark, sf):
    scored = cov.score(cases(spark, sf).df.where("is_pos"), THEORY).where("pred")
    return scored.groupBy(F.array_join("fired", ",").alias("fired")).agg(F.count(F.lit(1)).alias("p_w"))


@query("t03_rules_by_coverage", f"""WITH {WIDE_ORDERS}, r AS (
  SELECT 0 AS rule_id, count(*) FILTER ({R0}) AS covered FROM wide WHERE is_pos
  UNION ALL SELECT 1, count(*) FILTER ({R1}) FROM wide WHERE is_pos UNION ALL SELECT 2, count(*) FILTER ({R2}) FROM wide WHERE is_pos
  UNION ALL SELECT 3, count(*) FILTER ({R3}) FROM wide WHERE is_pos)
  SELECT rule_id, covered, row_number() OVER (ORDER BY covered, rule_id) AS place FROM r""")
def t03(spark, sf):
    df = cases(spark, sf).df.where("is_pos")
    hits = df.agg(*[F.count_if(rule_condition(r, df, THEORY)).alias(str(i)) for i, r in enumerate(RULES)])
    by_rule = hits.unpivot([], [str(i) for i in range(len(RULES))], "rule_id", "covered")
    from pyspark.sql import Window as W

    # One row per rule.
    place = F.row_number().over(W.orderBy("covered", "rule_id"))
    return by_rule.select(F.col("rule_id").cast("int").alias("rule_id"), "covered", place.cast("bigint").alias("place"))


@query("e01_minus", "SELECT o_orderkey AS case_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def e01(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"))
    return cov.minus(orders, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id")))


@query("e02_union_views", """SELECT l_orderkey AS case_id FROM lineitem WHERE l_returnflag = 'R'
  UNION SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'""")
def e02(spark, sf):
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("case_id"))
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("case_id"))
    return cov.union_all([returned, urgent])


@query("e06_member_of", """SELECT l_returnflag AS flag, o_orderstatus = 'F' AS is_pos, count(*) AS cnt
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def e06(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_returnflag").alias("flag"))
    examples = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("case_id"), (F.col("o_orderstatus") == "F").alias("is_pos")
    )
    return cov.member_of(lines, examples).groupBy("flag", "is_pos").agg(F.count(F.lit(1)).alias("cnt"))


@query("j05_lookup", f"""WITH {ORDER_FACTS}, d AS (SELECT DISTINCT pred, val FROM facts),
    n AS (SELECT CAST(row_number() OVER (ORDER BY pred, val) - 1 AS INTEGER) AS item_id, pred, val FROM d)
  SELECT case_id, item_id FROM facts JOIN n USING (pred, val)""")
def j05(spark, sf):
    from ..operators.attribution import item_dictionary

    c = orders_cases(spark, sf)
    items = item_dictionary(literals_in(c))
    return to_facts(c).join(items, ["pred", "val"]).select("case_id", "item_id")
