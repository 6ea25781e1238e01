"""Clauses over several tables: learned on planted labels, read from text, scored in strata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators.clauses import Program, clauses_from_rows
from ..operators.relational import Atom, bind, covered_bindings
from ..plans import relational_learn as rl
from ..plans.relational_learn import Place, RelationalModes, RelationalSettings
from ..session import materialize
from ..sources import readers as rd
from ..sources import writers as wr
from .datasets import relations, table
from .registry import query

ORDER, CUSTOMER, NATION, REGION, PART = "order", "customer", "nation", "region", "part"

#: Argument places of the relations around an order.
PLACES = {
    "ordered_by": (Place("var", ORDER), Place("var", CUSTOMER)),
    "in_nation": (Place("var", CUSTOMER), Place("var", NATION)),
    "in_region": (Place("var", NATION), Place("var", REGION)),
    "region_name": (Place("var", REGION), Place("const", "name")),
    "has_part": (Place("var", ORDER), Place("var", PART)),
    "brand": (Place("var", PART), Place("const", "brand")),
    "has_flag": (Place("var", ORDER), Place("const", "flag")),
    "home": (Place("var", ORDER), Place("const", "name")),
    "from_asia": (Place("var", ORDER),),
    "builds": (Place("var", ORDER),),
}

#: Orders with what the planted labels look at.
SEEN = """p AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
seen AS (SELECT o_orderkey, coalesce(has_brand, false) AS has_brand, r_name AS region, c_mktsegment = 'BUILDING' AS builds
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT l_orderkey, bool_or(p_brand = 'Brand#4') AS has_brand FROM p JOIN part ON l_partkey = p_partkey GROUP BY 1)
    ON l_orderkey = o_orderkey)"""

#: The views the queries use, as a person writes them.
VIEWS = [
    "home(O,N) :- ordered_by(O,C), in_nation(C,M), in_region(M,R), region_name(R,N).",
    "from_asia(O) :- home(O,'ASIA').",
    "builds(O) :- ordered_by(O,C), segment(C,'BUILDING').",
    "fine(O) :- has_part(O,P), brand(P,'Brand#4').",
]


def modes(*preds: str) -> RelationalModes:
    return RelationalModes((ORDER,), {p: PLACES[p] for p in preds})


def as_text(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {p: t.select(*[F.col(c).cast("string").alias(c) for c in t.columns]) for p, t in tables.items()}


def with_views(spark, tables: dict[str, DataFrame], lines: list[str] = VIEWS) -> dict[str, DataFrame]:
    """The relations and the views written in ``lines``."""
    texts = spark.createDataFrame([(line,) for line in lines], "value string")
    return Program(tuple(clauses_from_rows(rd.parse_clauses(texts).collect()))).derive(as_text(tables))


def planted(spark, sf, tables: dict[str, DataFrame], *positive: DataFrame) -> DataFrame:
    """Orders (O, is_pos), positive where all relations of orders name them; written once."""
    cases = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("O"))
    for i, rel in enumerate(positive):
        keys = rel.select(F.col("a0").alias("O"), F.lit(True).alias(f"p{i}")).distinct()
        cases = cases.join(keys, "O", "left")
    held = reduce(lambda a, b: a & b, [F.coalesce(f"p{i}", F.lit(False)) for i in range(len(positive))])
    return materialize(cases.select("O", held.alias("is_pos")))


def clause_report(theory: rl.RelationalTheory, cases: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """One row per clause and exception with its text; clauses with the cases they cover."""
    spark, rows = cases.sparkSession, []
    domain = cases.select(*theory.head_vars)
    known = Program(theory.exceptions).derive(
        {**tables, **theory.listed}, {c.head.pred: domain for c in theory.exceptions}
    )
    for clause in theory.clauses:
        hit = covered_bindings(cases, list(theory.head_vars), clause.body, known)
        n = hit.agg(F.count_if("is_pos").alias("p"), F.count_if(~F.col("is_pos")).alias("n")).first()
        rows.append((clause.text(), n["p"], n["n"]))
    rows += [(c.text(), None, None) for c in theory.exceptions]
    return spark.createDataFrame(rows, "rule string, p_cov bigint, n_cov bigint")


GAIN = """round(CASE WHEN p_tuples = 0 THEN 0.0 ELSE p_cases * (log2(p_tuples::DOUBLE / (p_tuples + n_tuples))
  - log2(p0::DOUBLE / (p0 + n0))) END, 6) AS gain"""


@query("r01_relational_steps", f"""WITH {SEEN}, flags AS (SELECT DISTINCT l_orderkey, l_returnflag AS v FROM lineitem),
  one AS (SELECT 'has_part(O,A)' AS literal, count(DISTINCT o_orderkey) FILTER (has_brand) AS p_cases,
      count(*) FILTER (has_brand) AS p_tuples, count(*) FILTER (NOT has_brand) AS n_tuples
    FROM seen JOIN p ON l_orderkey = o_orderkey
    UNION ALL SELECT 'has_flag(O,''' || v || ''')', count(*) FILTER (has_brand), count(*) FILTER (has_brand), count(*) FILTER (NOT has_brand)
    FROM seen JOIN flags ON l_orderkey = o_orderkey GROUP BY v),
  t1 AS (SELECT count(*) FILTER (has_brand) AS p0, count(*) FILTER (NOT has_brand) AS n0 FROM seen),
  b AS (SELECT o_orderkey, has_brand, l_partkey FROM seen JOIN p ON l_orderkey = o_orderkey),
  t2 AS (SELECT count(*) FILTER (has_brand) AS p0, count(*) FILTER (NOT has_brand) AS n0 FROM b),
  two AS (SELECT 'brand(A,''' || p_brand || ''')' AS literal, count(DISTINCT o_orderkey) FILTER (has_brand) AS p_cases,
      count(*) FILTER (has_brand) AS p_tuples, count(*) FILTER (NOT has_brand) AS n_tuples
    FROM b JOIN part ON l_partkey = p_partkey GROUP BY p_brand
    UNION ALL SELECT 'has_part(O,B)', count(DISTINCT b.o_orderkey) FILTER (has_brand), count(*) FILTER (has_brand), count(*) FILTER (NOT has_brand)
    FROM b JOIN p ON p.l_orderkey = b.o_orderkey
    UNION ALL SELECT 'has_part(B,A)', count(DISTINCT b.o_orderkey) FILTER (has_brand), count(*) FILTER (has_brand), count(*) FILTER (NOT has_brand)
    FROM b JOIN p ON p.l_partkey = b.l_partkey
    UNION ALL SELECT 'has_flag(O,''' || v || ''')', count(DISTINCT b.o_orderkey) FILTER (has_brand), count(*) FILTER (has_brand), count(*) FILTER (NOT has_brand)
    FROM b JOIN flags ON flags.l_orderkey = b.o_orderkey GROUP BY v),
  g AS (SELECT 1 AS step, literal, p_cases, p_tuples, n_tuples, {GAIN} FROM one, t1
    UNION ALL SELECT 2, literal, p_cases, p_tuples, n_tuples, {GAIN} FROM two, t2)
  SELECT * FROM g WHERE gain > 0""")
def r01_steps(spark, sf):
    """All literals that gain for the empty clause, and after has_part(O,A): constants, old
    and new variables; proofs are counted where a clause has new variables."""
    _, tables = relations(spark, sf)
    tables = with_views(spark, tables)
    cases = planted(spark, sf, tables, tables["fine"])
    bias = modes("has_part", "brand", "has_flag")
    tables = rl.prepared_tables(tables, bias)
    out = []
    variables = {"O": ORDER}
    bound, body = cases, []
    for step, atom in ((1, Atom("has_part", ("O", "A"))), (2, None)):
        names = [v for v in "ABCDE" if v not in variables]
        ranked = rl.ranked_extensions(bound, ["O"], rl.patterns(bias, variables, names, body=body), tables)
        out.append(ranked.select(
            F.lit(step).alias("step"), "literal", "p_cases", "p_tuples", "n_tuples", F.round("gain", 6).alias("gain")
        ).where("gain > 0"))
        if atom is not None:
            bound, variables = materialize(bind(bound, [atom], tables)), {**variables, "A": PART}
            body.append(atom)
    return out[0].unionByName(out[1])


@query("r04_learn_clause_new_variable", f"""WITH {SEEN} SELECT 'positive(O):-has_part(O,A),brand(A,''Brand#4'').' AS rule,
    count(*) FILTER (has_brand) AS p_cov, 0::BIGINT AS n_cov FROM seen""")
def r04_clause(spark, sf):
    """A whole rule whose second literal speaks about a variable that the first one binds."""
    _, tables = relations(spark, sf)
    tables = with_views(spark, tables)
    cases = planted(spark, sf, tables, tables["fine"])
    theory = rl.learn_clauses(cases, ["O"], tables, modes("has_part", "brand", "has_flag"))
    return clause_report(theory, cases, tables)


@query("r11_learn_determinate", f"""WITH {SEEN} SELECT 4 AS det_bound,
    'positive(O):-ordered_by(O,A),in_nation(A,B),in_region(B,C),region_name(C,''ASIA'').' AS rule,
    count(*) FILTER (region = 'ASIA') AS p_cov, 0::BIGINT AS n_cov FROM seen""")
def r11_determinate(spark, sf):
    """A label that only a table three joins away tells: nothing is learned without
    determinate literals, and the rule with them."""
    _, tables = relations(spark, sf)
    tables = with_views(spark, tables)
    cases = planted(spark, sf, tables, tables["from_asia"])
    bias = modes("ordered_by", "in_nation", "in_region", "region_name")
    parts, prepared = [], rl.Prepared(cases, ["O"], tables, bias)
    for bound in (0, 4):
        theory = rl.learn_clauses(cases, ["O"], tables, bias, RelationalSettings(det_bound=bound), prepared)
        parts.append(clause_report(theory, cases, tables).select(F.lit(bound).alias("det_bound"), "*"))
    return parts[0].unionByName(parts[1])


@query("c03_learn_negated", f"""WITH {SEEN} SELECT 'positive(O):-not(home(O,''ASIA'')).' AS rule,
    count(*) FILTER (region <> 'ASIA') AS p_cov, 0::BIGINT AS n_cov FROM seen""")
def c03_learned(spark, sf):
    """A negated literal over a many-valued relation, learned as one literal."""
    _, tables = relations(spark, sf)
    tables = with_views(spark, tables)
    asian = tables["from_asia"]
    cases = planted(spark, sf, tables, tables["home"].join(asian, "a0", "left_anti"))
    theory = rl.learn_clauses(
        cases, ["O"], tables, modes("home", "has_flag"), RelationalSettings(negation=True)
    )
    return clause_report(theory, cases, tables)


@query("c04_learn_relational_exceptions", f"""WITH {SEEN} SELECT rule, p_cov, n_cov FROM (
    SELECT 'positive(O):-has_part(O,A),brand(A,''Brand#4''),not(ab1(O)).' AS rule,
      count(*) FILTER (has_brand AND NOT (region = 'ASIA' AND NOT builds)) AS p_cov, 0::BIGINT AS n_cov FROM seen
    UNION ALL SELECT 'ab0(O):-builds(O).', NULL, NULL
    UNION ALL SELECT 'ab1(O):-from_asia(O),not(ab0(O)).', NULL, NULL)""")
def c04_learned(spark, sf):
    """Exceptions of exceptions over several tables, learned with the sides swapped."""
    _, tables = relations(spark, sf)
    tables = with_views(spark, tables)
    spared = tables["from_asia"].join(tables["builds"], "a0", "left_anti")
    cases = planted(spark, sf, tables, tables["fine"].join(spared, "a0", "left_anti"))
    theory = rl.learn_clauses(cases, ["O"], tables, modes("has_part", "brand", "from_asia", "builds"))
    return clause_report(theory, cases, tables)


#: A theory with exceptions of exceptions over several tables.
NESTED = [
    "positive(O):-has_part(O,P),brand(P,'Brand#4'),not(ab0(O)).",
    "positive(O):-home(O,'EUROPE'),not(fine(O)),not(ab2(O)).",
    "ab0(O):-from_asia(O),not(ab1(O)).",
    "ab1(O):-ordered_by(O,C),segment(C,'BUILDING').",
    "ab2(O):-ordered_by(O,C),segment(C,S),in_nation(C,N),not(ab0(O)),seldom(S).",
]


@query("c04_relational_strata", f"""WITH {SEEN}, seg AS (SELECT o_orderkey, c_mktsegment AS s FROM orders JOIN customer ON o_custkey = c_custkey),
  s AS (SELECT seen.o_orderkey, (has_brand AND NOT (region = 'ASIA' AND NOT builds))
      OR (region = 'EUROPE' AND NOT has_brand AND NOT (NOT (region = 'ASIA' AND NOT builds) AND s IN ('MACHINERY', 'FURNITURE'))) AS pred,
    o_orderstatus = 'F' AS is_pos FROM seen JOIN seg USING (o_orderkey) JOIN orders USING (o_orderkey))
  SELECT count(*) FILTER (pred AND is_pos) AS tp, count(*) FILTER (NOT pred AND NOT is_pos) AS tn,
    count(*) FILTER (pred AND NOT is_pos) AS fp, count(*) FILTER (NOT pred AND is_pos) AS fn FROM s""")
def c04_strata(spark, sf):
    """Nested exceptions read from text, derived stratum by stratum and used to score orders."""
    _, tables = relations(spark, sf)
    seldom = spark.createDataFrame([("MACHINERY",), ("FURNITURE",)], "a0 string")
    tables = with_views(spark, {**tables, "seldom": seldom})
    rules = clauses_from_rows(
        rd.parse_clauses(spark.createDataFrame([(line,) for line in NESTED], "value string")).collect()
    )
    theory = rl.RelationalTheory(
        "positive", ("O",), tuple(c for c in rules if c.head.pred == "positive"),
        tuple(c for c in rules if c.head.pred != "positive"),
    )
    cases = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("O"), (F.col("o_orderstatus") == "F").alias("is_pos")
    )
    hits = theory.covered(cases, tables).select("O", F.lit(True).alias("hit"))
    scored = cases.join(hits, "O", "left").withColumn("pred", F.coalesce("hit", F.lit(False)))
    return ev.evaluate(scored).select("tp", "tn", "fp", "fn")


@query("s02_learn_from_text", f"""WITH {SEEN} SELECT CASE WHEN count(*) FILTER (has_brand) < count(*) FILTER (region = 'ASIA')
      THEN 'positive(O):-fine(O),from_asia(O).' ELSE 'positive(O):-from_asia(O),fine(O).' END AS rule,
    count(*) FILTER (region = 'ASIA' AND has_brand) AS p_cov, 0::BIGINT AS n_cov FROM seen
  UNION ALL SELECT 'from_asia', count(*) FILTER (region = 'ASIA'), NULL FROM seen
  UNION ALL SELECT 'fine', count(*) FILTER (has_brand), NULL FROM seen""")
def s02_learned(spark, sf):
    """Facts of any arity and views with joined bodies, read from text and learned from."""
    _, tables = relations(spark, sf)
    used = ["ordered_by", "in_nation", "in_region", "region_name", "has_part", "brand", "segment"]
    lines = reduce(DataFrame.unionByName, [wr.render_relation(p, tables[p]) for p in used])
    lines = lines.unionByName(spark.createDataFrame([(v,) for v in VIEWS] + [("% a comment",)], "value string"))
    read = rd.relation_tables(rd.parse_atoms(lines), {p: 2 for p in used})
    views = Program(tuple(clauses_from_rows(rd.parse_clauses(lines).collect())))
    known = views.derive(read)
    known |= {v: materialize(known[v]) for v in ("from_asia", "fine")}
    cases = planted(spark, sf, known, known["from_asia"], known["fine"])
    bias = RelationalModes((ORDER,), {"from_asia": (Place("var", ORDER),), "fine": (Place("var", ORDER),)})
    report = clause_report(
        rl.learn_clauses(cases, ["O"], known, bias, RelationalSettings(rising=False)), cases, known
    )
    sizes = [known[v].agg(F.lit(v).alias("rule"), F.count(F.lit(1)).alias("p_cov"), F.lit(None).cast("bigint").alias("n_cov"))
             for v in ("from_asia", "fine")]
    return reduce(DataFrame.unionByName, [report, *sizes])
