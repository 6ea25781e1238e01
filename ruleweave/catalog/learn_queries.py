"""Full learners on labels planted in the tables, so that SQL knows what they must learn."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coverage as cov
from ..operators import evaluate as ev
from ..operators import relational as rel
from ..operators.prep import CaseTable
from ..operators.relational import Atom
from ..plans.guided import learn_guided_rules
from ..plans.learn import LearnSettings, learn_rules
from ..plans.prune import prune_rules
from ..plans.utility_learn import UtilitySettings, learn_utility_rules
from ..operators.gain import weigh
from ..rules import Literal, Rule, Theory
from .coverage_queries import METRICS, THEORY, cases
from .datasets import DOCUMENTS, ORDERS, document_cases, order_attributions, orders_cases, relations, table
from .registry import query
from .utility_queries import with_phi


def rule_report(spark: SparkSession, df: DataFrame, theory: Theory) -> DataFrame:
    """One row per rule with its text and what it covers; exceptions without counts."""
    counts = df.agg(
        *[F.count_if(c & F.col("is_pos")).alias(f"p{i}") for i, c in enumerate(conditions(df, theory))],
        *[F.count_if(c & ~F.col("is_pos")).alias(f"n{i}") for i, c in enumerate(conditions(df, theory))],
    ).first() if theory.rules else {}
    rows = [(i, r.text(), counts[f"p{i}"], counts[f"n{i}"]) for i, r in enumerate(theory.rules)]
    rows += [(len(theory.rules) + i, r.text(), None, None) for i, r in enumerate(theory.exceptions)]
    return spark.createDataFrame(rows, "rule_id int, rule string, p_cov bigint, n_cov bigint")


def conditions(df: DataFrame, theory: Theory):
    from ..rules import rule_condition

    return [rule_condition(r, df, theory) for r in theory.rules]


def planted(c: CaseTable, label) -> CaseTable:
    """The cases with a label that follows their attributes; unknown counts as not held."""
    return CaseTable(c.df.withColumn("is_pos", F.coalesce(label, F.lit(False))), c.attrs, c.unary)


def planted_orders(spark, sf) -> CaseTable:
    """Urgent orders, but not those from Asia unless for buildings."""
    asia = (F.col("region") == "ASIA") & (F.col("segment") != "BUILDING")
    return planted(orders_cases(spark, sf), (F.col("priority") == "1-URGENT") & ~asia)


PLANTED_ORDERS = f"""{ORDERS}, planted AS (SELECT priority, segment, region, coalesce(
    priority = '1-URGENT' AND NOT (region = 'ASIA' AND segment <> 'BUILDING'), false) AS is_pos FROM cases)"""
#: Confusion counts of rules that are exactly the planted label.
PERFECT = "SELECT count(*) FILTER (is_pos) AS tp, count(*) FILTER (NOT is_pos) AS tn, 0::BIGINT AS fp, 0::BIGINT AS fn FROM planted"


def planted_documents(spark, sf) -> CaseTable:
    """English documents, but not the toxic ones."""
    return planted(document_cases(spark, sf), (F.col("lang") == "en") & ~(F.col("toxic") == "1"))


PLANTED_DOCUMENTS = f"""{DOCUMENTS}, planted AS (SELECT coalesce(lang = 'en' AND NOT (toxic = '1'), false) AS is_pos FROM cases)"""


#: Labelled documents that are long or come from five of the sources, or both.
ODD_DOCUMENTS = f"""{DOCUMENTS}, odd AS (SELECT case_id, lang, chars_q = '3' AS long, source IN ('src0', 'src3', 'src5', 'src8', 'src9') AS few FROM cases)"""


def odd_documents(spark, sf, both_only: bool) -> CaseTable:
    """English documents are positive unless long or from few sources: if they are just one
    of the two, or with ``both_only`` if they are both."""
    c = document_cases(spark, sf)
    df = c.df.select(
        "case_id", "lang",
        F.when(F.col("chars_q") == "3", "yes").alias("long"),
        F.when(F.col("source").isin("src0", "src3", "src5", "src8", "src9"), "yes").alias("few"),
    )
    long, few = F.col("long").isNotNull(), F.col("few").isNotNull()
    bad = long & few if both_only else long != few
    label = F.coalesce((F.col("lang") == "en") & ~bad, F.lit(False))
    return CaseTable(df.withColumn("is_pos", label), ("lang", "long", "few"))


def quality(df: DataFrame, theory: Theory) -> DataFrame:
    return ev.evaluate(cov.score(df, theory)).select("tp", "tn", "fp", "fn")


@query("r04_learn_orders", f"""WITH {PLANTED_ORDERS}, r(rule_id, rule, region, segment) AS (VALUES
    (0, 'positive(A):-priority(A,1-URGENT),region(A,''MIDDLE EAST'').', 'MIDDLE EAST', NULL),
    (1, 'positive(A):-priority(A,1-URGENT),region(A,''EUROPE'').', 'EUROPE', NULL),
    (2, 'positive(A):-priority(A,1-URGENT),region(A,''AMERICA'').', 'AMERICA', NULL),
    (3, 'positive(A):-priority(A,1-URGENT),region(A,''AFRICA'').', 'AFRICA', NULL),
    (4, 'positive(A):-priority(A,1-URGENT),segment(A,''BUILDING'').', NULL, 'BUILDING'))
  SELECT rule, count(*) FILTER (is_pos) AS p_cov, count(*) FILTER (NOT is_pos) AS n_cov
  FROM r JOIN planted c ON c.priority = '1-URGENT' AND (c.region = r.region OR c.segment = r.segment) GROUP BY rule""")
def r04(spark, sf):
    """All rules for a planted label, with code lengths and without any bound."""
    c = planted_orders(spark, sf)
    return rule_report(spark, c.df, learn_rules(c)).select("rule", "p_cov", "n_cov")


@query("r04_learned_quality", f"WITH {PLANTED_ORDERS} {PERFECT}")
def r04b(spark, sf):
    """Confusion counts of the learned rules: they are the planted label."""
    c = planted_orders(spark, sf)
    return quality(c.df, learn_rules(c))


@query("s03_bias_learn", f"""WITH {ORDERS}, planted AS (SELECT coalesce(priority = '1-URGENT' AND region = 'ASIA', false) AS is_pos
    FROM cases) {PERFECT}""")
def s03_learn(spark, sf):
    """Rules learned under declarations read from text, which leave two attributes."""
    from ..operators.gain import attribute_constants, attribute_modes, bias_from_tables
    from ..sources import readers as rd
    from ..sources import writers as wr

    c = orders_cases(spark, sf)
    p = planted(c, (F.col("priority") == "1-URGENT") & (F.col("region") == "ASIA"))
    some = ["priority", "region"]
    lines = wr.render_modes(attribute_modes(c.df, some)).unionByName(
        wr.render_constants(attribute_constants(c.df, some), normalize=False)
    )
    theory = learn_rules(p, bias_from_tables(rd.parse_modes(lines), rd.parse_constants(lines)))
    used = {lit.pred for r in theory.rules for lit in r.body}
    if used != set(some):
        raise AssertionError(f"the rules use {sorted(used)}")
    return quality(p.df, theory)


@query("r05_learn_documents_with_exceptions", f"""WITH {ODD_DOCUMENTS},
    n AS (SELECT count(*) FILTER (long AND NOT few) AS l, count(*) FILTER (few AND NOT long) AS f,
      count(*) FILTER (long = few) AS p FROM odd WHERE lang = 'en'),
    o AS (SELECT p, CASE WHEN l > f THEN ['long', 'few'] ELSE ['few', 'long'] END AS v FROM n)
  SELECT 'positive(A):-lang(A,en),not(ab2(A)).' AS rule, p AS p_cov, 0::BIGINT AS n_cov FROM o
  UNION ALL SELECT 'ab2(A):-' || v[1] || '(A,yes),not(ab0(A)).', NULL, NULL FROM o
  UNION ALL SELECT 'ab0(A):-' || v[2] || '(A,yes).', NULL, NULL FROM o
  UNION ALL SELECT 'ab2(A):-' || v[2] || '(A,yes),not(ab1(A)).', NULL, NULL FROM o
  UNION ALL SELECT 'ab1(A):-' || v[1] || '(A,yes).', NULL, NULL FROM o""")
def r05(spark, sf):
    """Exceptions of exceptions: a label that no conjunction of literals tells."""
    c = odd_documents(spark, sf, both_only=False)
    return rule_report(spark, c.df, learn_rules(c)).select("rule", "p_cov", "n_cov")


@query("r05_separable_documents", f"WITH {PLANTED_DOCUMENTS} {PERFECT}")
def r05_plain(spark, sf):
    """Rules for a planted label on documents that conjunctions tell, without any bound."""
    c = planted_documents(spark, sf)
    return quality(c.df, learn_rules(c))


@query("r03_learn_all_but", f"""WITH {ODD_DOCUMENTS} SELECT 'positive(A):-not(ab0(A)).' AS rule,
    count(*) FILTER (NOT (long OR few)) AS p_cov, 0::BIGINT AS n_cov FROM odd
  UNION ALL SELECT 'ab0(A):-long(A,yes).', NULL, NULL UNION ALL SELECT 'ab0(A):-few(A,yes).', NULL, NULL""")
def r03_all_but(spark, sf):
    """A rule of exceptions alone: no literal tells the positives."""
    c = odd_documents(spark, sf, both_only=True)
    label = F.col("long").isNull() & F.col("few").isNull()
    c = CaseTable(c.df.withColumn("is_pos", label), ("long", "few"))
    return rule_report(spark, c.df, learn_rules(c, settings=LearnSettings(exceptions_alone=True))).select("rule", "p_cov", "n_cov")


@query("c03_learn_negated_literal", f"""WITH {ORDERS} SELECT 'positive(A):-not(region(A,''ASIA'')).' AS rule,
    count(*) FILTER (region IS DISTINCT FROM 'ASIA') AS p_cov, 0::BIGINT AS n_cov FROM cases""")
def c03_negated(spark, sf):
    """All regions but one, learned as one negated literal."""
    c = planted(orders_cases(spark, sf), ~F.coalesce(F.col("region") == "ASIA", F.lit(False)))
    return rule_report(spark, c.df, learn_rules(c, settings=LearnSettings(negation=True))).select("rule", "p_cov", "n_cov")


@query("r05b_learn_with_lists", f"""WITH {DOCUMENTS}, planted AS (SELECT case_id, lang = 'en' AND case_id % 5 <> 0 AS is_pos, lang FROM cases)
  SELECT 'listed' AS kind, CAST(case_id AS VARCHAR) AS detail, 1::BIGINT AS n FROM planted WHERE lang = 'en' AND NOT is_pos
  UNION ALL SELECT 'rule', 'positive(A):-lang(A,en),not(ab0(A)).', 1
  UNION ALL SELECT 'tp', '', count(*) FILTER (is_pos) FROM planted UNION ALL SELECT 'tn', '', count(*) FILTER (NOT is_pos) FROM planted
  UNION ALL SELECT 'fp', '', 0 UNION ALL SELECT 'fn', '', 0""")
def r05b_lists(spark, sf):
    """Negatives without a pattern are listed by id; with the lists no case is wrong."""
    c = document_cases(spark, sf)
    c = CaseTable(
        c.df.select("case_id", "lang", ((F.col("lang") == "en") & (F.col("case_id") % 5 != 0)).alias("is_pos")), ("lang",)
    )
    theory = learn_rules(c, settings=LearnSettings(listed=True))
    scored = quality(c.df, theory)
    report = scored.unpivot([], ["tp", "tn", "fp", "fn"], "kind", "n").select("kind", F.lit("").alias("detail"), "n")
    for ids in theory.listed.values():
        report = report.unionByName(
            ids.select(F.lit("listed").alias("kind"), F.col("case_id").cast("string").alias("detail"), F.lit(1).cast("bigint").alias("n"))
        )
    rules = spark.createDataFrame([("rule", r.text(), 1) for r in theory.rules], "kind string, detail string, n bigint")
    return report.unionByName(rules)


@query("r07_prune_rules")
def r07b(spark, sf):
    """The fixed theory after rule pruning with a generous loss."""
    c = cases(spark, sf)
    pruned = prune_rules(weigh(c).df, THEORY, max_loss=0.15).reachable()
    return rule_report(spark, c.df, pruned)


@query("r13_reachable_rules", f"WITH {PLANTED_ORDERS} {PERFECT}")
def r13(spark, sf):
    """A learned theory with an exception nothing leads to: dropping it changes no case."""
    c = planted_orders(spark, sf)
    learned = learn_rules(c)
    stray = Rule("ab99", (Literal("region", "ASIA"),))
    kept = replace(learned, exceptions=(*learned.exceptions, stray)).reachable()
    if stray in kept.exceptions or len(kept.rules) != len(learned.rules):
        raise AssertionError("an exception that no rule leads to was kept")
    return quality(c.df, kept)


@query("r09_learn_utility_rules", f"WITH {PLANTED_ORDERS} {PERFECT}")
def r09(spark, sf):
    """Rules from utility itemsets of a planted label, learned without any bound."""
    c = planted_orders(spark, sf)
    theory = learn_utility_rules(with_phi(c, order_attributions(c)), UtilitySettings(min_accuracy=1.0))
    return quality(c.df, theory)


@query("r09_learn_utility_rules_documents", f"WITH {PLANTED_DOCUMENTS} {PERFECT}")
def r09b(spark, sf):
    """The same on documents."""
    c = planted_documents(spark, sf)
    theory = learn_utility_rules(with_phi(c, order_attributions(c)), UtilitySettings(min_accuracy=1.0))
    return quality(c.df, theory)


@query("r09_learn_utility_exceptions", f"""WITH {ODD_DOCUMENTS} SELECT 'positive(A):-lang(A,en),not(ab0(A)).' AS rule,
    count(*) FILTER (lang = 'en' AND NOT (long AND few)) AS p_cov, 0::BIGINT AS n_cov FROM odd
  UNION ALL SELECT 'ab0(A):-few(A,yes),long(A,yes).', NULL, NULL""")
def r09c(spark, sf):
    """Utility rules with an exception, which is an itemset of the covered negatives."""
    c = odd_documents(spark, sf, both_only=True)
    theory = learn_utility_rules(with_phi(c, order_attributions(c)), UtilitySettings(min_accuracy=1.0, leftover=0.0))
    return rule_report(spark, c.df, theory).select("rule", "p_cov", "n_cov")


@query("r10_learn_guided_rules", f"WITH {PLANTED_DOCUMENTS} {PERFECT}")
def r10b(spark, sf):
    """Greedy rules whose literals are led by attributions."""
    c = planted_documents(spark, sf)
    return quality(c.df, learn_guided_rules(with_phi(c, order_attributions(c)), top=6, settings=LearnSettings()))


@query("r11_learn_relational", f"""WITH {ORDERS}, planted AS (SELECT coalesce(segment = 'BUILDING' AND region = 'ASIA', false) AS is_pos
    FROM cases) {PERFECT}""")
def r11(spark, sf):
    """Rules over attributes of customers, regions and lines reached from an order."""
    examples, tables = relations(spark, sf)
    atoms = [Atom("ordered_by", ("O", "C")), Atom("in_nation", ("C", "N")), Atom("in_region", ("N", "R"))]
    bound, _ = rel.determinate_literals(examples, atoms, tables, bound=3)
    attributes = {"segment": ("segment", "C"), "region": ("region_name", "R"), "flag": ("has_flag", "O"),
                  "status": ("ship_status", "O"), "brand": ("has_brand", "O")}
    brands = tables["has_part"].join(tables["brand"].toDF("a1", "brand"), "a1").select("a0", F.col("brand").alias("a1"))
    tables = {**tables, "has_brand": brands.distinct()}
    c: CaseTable = rel.relational_cases(bound, "O", attributes, tables)
    label = F.array_contains("segment", "BUILDING") & F.array_contains("region", "ASIA")
    p = planted(c, label)
    return quality(p.df, learn_rules(p))


@query("r05b_listed_exceptions_quality", f"""WITH {DOCUMENTS}, s AS (SELECT lang = 'en' AND is_pos AS pred, is_pos FROM cases), {METRICS}""")
def r05c(spark, sf):
    """A rule whose covered negatives are all listed has no false positives."""
    c = document_cases(spark, sf)
    theory = cov.add_enumerated_exceptions(c, Rule("positive", (Literal("lang", "en"),)))
    quality = ev.evaluate(cov.score(c.df, theory))
    return quality.select("tp", "tn", "fp", "fn", *[F.round(m, 6).alias(m) for m in ("accuracy", "precision", "recall", "f1")])


#: Large events are purchases, unless they are views.
EVENT_THEORY = Theory(
    "positive", (Rule("positive", (Literal("size", "high"), Literal("ab0", None, True))),),
    (Rule("ab0", (Literal("event_type", "view"),)),),
)


@query("x02_windowed_quality", """WITH s AS (SELECT date_trunc('hour', ts) AS start, value > 60 AND event_type <> 'view' AS pred,
    event_type = 'purchase' AS is_pos FROM events)
  SELECT CAST(epoch(start) AS BIGINT) AS start_sec, count(*) FILTER (pred AND is_pos) AS tp, count(*) FILTER (NOT pred AND NOT is_pos) AS tn,
    count(*) FILTER (pred AND NOT is_pos) AS fp, count(*) FILTER (NOT pred AND is_pos) AS fn FROM s GROUP BY start""")
def x02(spark, sf):
    """Hourly confusion counts of a rule on events, in batch form."""
    from ..streaming.scoring import score_stream, windowed_quality

    events = table(spark, sf, "events").select(
        "ts", (F.col("event_type") == "purchase").alias("is_pos"), "event_type",
        F.when(F.col("value") > 60, "high").otherwise("low").alias("size"),
    )
    quality = windowed_quality(score_stream(events, EVENT_THEORY))
    return quality.select(F.unix_timestamp("start").alias("start_sec"), "tp", "tn", "fp", "fn")


@query("x01_stream_quality", """WITH e AS (SELECT ts, date_trunc('hour', ts) AS start, value > 60 AND event_type <> 'view' AS pred, event_type = 'purchase' AS is_pos,
    least(3, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 1 WHEN ts < TIMESTAMP '2024-01-21' THEN 2 ELSE 3 END
      + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) AS arrival FROM events),
  m AS (SELECT max(ts) FILTER (arrival = 1) - INTERVAL 10 MINUTE AS w1, max(ts) FILTER (arrival <= 2) - INTERVAL 10 MINUTE AS w2,
    max(ts) - INTERVAL 10 MINUTE AS w3 FROM e),
  k AS (SELECT e.* FROM e, m WHERE start + INTERVAL 1 HOUR <= w3
    AND (arrival = 1 OR (arrival = 2 AND start + INTERVAL 1 HOUR > w1) OR (arrival = 3 AND start + INTERVAL 1 HOUR > w2)))
  SELECT CAST(epoch(start) AS BIGINT) AS start_sec, count(*) FILTER (pred AND is_pos) AS tp, count(*) FILTER (NOT pred AND NOT is_pos) AS tn,
    count(*) FILTER (pred AND NOT is_pos) AS fp, count(*) FILTER (NOT pred AND is_pos) AS fn FROM k GROUP BY start""")
def x01(spark, sf):
    """A stream over the events in three arrivals, a tenth of them late by one: open windows
    wait in the state, closed ones are appended once, what is too late is dropped."""
    import uuid

    from ..session import shared_dir
    from ..streaming.scoring import append_quality

    period = F.when(F.col("ts") < "2024-01-11", 1).when(F.col("ts") < "2024-01-21", 2).otherwise(3)
    late = (F.col("event_id") % 10 == 0).cast("int")
    events = table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "purchase").alias("is_pos"), "event_type",
        F.when(F.col("value") > 60, "high").otherwise("low").alias("size"),
        F.least(period + late, F.lit(3)).alias("arrival"),
    )
    folder = f"{shared_dir(spark).rstrip('/')}/events-{uuid.uuid4().hex}"
    for arrival in (1, 2, 3):
        events.where(F.col("arrival") == arrival).drop("arrival").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(events.drop("arrival").schema).parquet(f"{folder}/in")
        append_quality(stream, EVENT_THEORY, f"{folder}/out", f"{folder}/checkpoint")
    quality = spark.read.parquet(f"{folder}/out")
    return quality.select(F.unix_timestamp("start").alias("start_sec"), "tp", "tn", "fp", "fn")


@query("a13_learned_total_coverage", f"WITH {ORDERS} SELECT count(*) FILTER (priority = '1-URGENT' OR segment = 'BUILDING') AS covered FROM cases WHERE is_pos")
def a13b(spark, sf):
    """Distinct positives of two overlapping rules, from grouped cases."""
    from ..rules import any_of, rule_condition

    base = weigh(orders_cases(spark, sf))
    rules = [Rule("positive", (Literal("priority", "1-URGENT"),)), Rule("positive", (Literal("segment", "BUILDING"),))]
    hit = any_of([rule_condition(r, base.df) for r in rules])
    return base.df.where(hit).agg(F.sum("p_w").alias("covered"))
