"""Which cases a rule or a theory covers, on wide case tables and on long facts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import Literal, Rule, Theory, any_of, literal_condition, rule_condition
from ..session import BROADCAST_ROWS, materialize
from .prep import CaseTable

#: Literals whose matches are kept as bits of one number.
WORD_BITS = 62

# ---------------------------------------------------------------- wide case tables


def with_listed(df: DataFrame, theory: Theory) -> DataFrame:
    """Add one boolean column per exception that is a list of case ids.

    A list can hold as many ids as there are cases, so it is joined without a hint.
    """
    for name, ids in theory.listed.items():
        marked = ids.select("case_id").distinct().withColumn(name, F.lit(True))
        df = df.join(marked, "case_id", "left")
    return df


def covered(df: DataFrame, rule: Rule, theory: Theory | None = None) -> DataFrame:
    """Cases for which the body of ``rule`` holds."""
    if theory is not None and theory.listed:
        kept = with_listed(df, theory)
        return kept.where(rule_condition(rule, kept, theory)).select(*df.columns)
    return df.where(rule_condition(rule, df, theory))


def uncovered(df: DataFrame, rule: Rule, theory: Theory | None = None) -> DataFrame:
    """Cases for which the body does not hold; missing values count as not holding."""
    if theory is not None and theory.listed:
        kept = with_listed(df, theory)
        return kept.where(~rule_condition(rule, kept, theory)).select(*df.columns)
    return df.where(~rule_condition(rule, df, theory))


def score(df: DataFrame, theory: Theory) -> DataFrame:
    """Add ``pred`` (any rule fires) and ``fired`` (ids of the rules that fire).

    A projection when no exception is a list of ids, so it also runs on streams.
    """
    wide = with_listed(df, theory)
    conditions = [rule_condition(r, wide, theory) for r in theory.rules]
    fired = F.array_compact(
        F.array(*[F.when(cond, F.lit(i)) for i, cond in enumerate(conditions)])
    ) if conditions else F.array().cast("array<int>")
    return wide.select(*df.columns, fired.alias("fired")).withColumn(
        "pred", F.size("fired") > 0
    )


def coverage_counts(df: DataFrame, rule: Rule, theory: Theory | None = None) -> DataFrame:
    """Positives and negatives covered by one rule: (p_cov, n_cov)."""
    hit = rule_condition(rule, df, theory)
    return df.agg(
        F.count_if(hit & F.col("is_pos")).alias("p_cov"),
        F.count_if(hit & ~F.col("is_pos")).alias("n_cov"),
    )


def rule_accuracy(df: DataFrame, rule: Rule, theory: Theory | None = None) -> DataFrame:
    """(TP + TN) / total of one rule: (accuracy)."""
    hit = rule_condition(rule, df, theory)
    return df.agg(F.avg((hit == F.col("is_pos")).cast("int")).alias("accuracy"))


def total_coverage(df: DataFrame, theory: Theory) -> DataFrame:
    """Distinct positives covered by any rule: (covered, positives)."""
    hit = any_of([rule_condition(r, df, theory) for r in theory.rules])
    return df.agg(
        F.count_if(hit & F.col("is_pos")).alias("covered"),
        F.count_if("is_pos").alias("positives"),
    )


def drop_alternatives(df: DataFrame, rule: Rule, theory: Theory | None = None) -> DataFrame:
    """Coverage of the rule and of the rule without each literal: (dropped, p_cov, n_cov).

    ``dropped`` is -1 for the full rule. One scan: a case is covered without literal i
    exactly when no literal other than i is unsatisfied.
    """
    missed = F.array_compact(
        F.array(
            *[
                F.when(~literal_condition(lit, df, theory), F.lit(i))
                for i, lit in enumerate(rule.body)
            ]
        )
    )
    variants = F.when(
        F.size(missed) == 0, F.sequence(F.lit(-1), F.lit(len(rule.body) - 1))
    ).when(F.size(missed) == 1, missed)
    if len(rule.body) == 1:
        variants = F.when(F.size(missed) == 0, F.array(F.lit(-1)))
    hits = df.select("is_pos", F.explode(variants).alias("dropped"))
    return hits.groupBy("dropped").agg(
        F.count_if("is_pos").alias("p_cov"), F.count_if(~F.col("is_pos")).alias("n_cov")
    )


# ---------------------------------------------------------------- long facts


def match_all(facts: DataFrame, literals: Sequence[Literal]) -> DataFrame:
    """Case ids that have every one of the (positive) literals, in one grouping."""
    wanted = list(dict.fromkeys((lit.pred, lit.val) for lit in literals))
    tests = [
        (F.col("pred") == p) & (F.col("val").isNull() if v is None else F.col("val") == v)
        for p, v in wanted
    ]
    flags = [F.max(t).alias(f"hit_{i}") for i, t in enumerate(tests)]
    grouped = facts.where(any_of(tests)).groupBy("case_id").agg(*flags)
    for i in range(len(wanted)):
        grouped = grouped.where(F.coalesce(F.col(f"hit_{i}"), F.lit(False)))
    return grouped.select("case_id")


def fired_rules(facts: DataFrame, rule_literals: DataFrame) -> DataFrame:
    """(case_id, rule_id) for rules whose positive literals a case has.

    ``rule_literals`` is small (bounded by the rules). The different literals are numbered and
    become bits of words: a case is one row per word however many facts and rules match.
    """
    positive = rule_literals.where("not negated").select("rule_id", "pred", "val").distinct().collect()
    numbers = {lit: i for i, lit in enumerate(dict.fromkeys((r["pred"], r["val"]) for r in positive))}
    needs: dict[tuple[int, int], int] = {}
    for r in positive:
        word, bit = divmod(numbers[r["pred"], r["val"]], WORD_BITS)
        needs[r["rule_id"], word] = needs.get((r["rule_id"], word), 0) | 1 << bit
    words = Counter(rule_id for rule_id, _ in needs)
    spark, kind = facts.sparkSession, rule_literals.schema["rule_id"].dataType.simpleString()
    bits = spark.createDataFrame(
        [(p, v, n // WORD_BITS, 1 << n % WORD_BITS) for (p, v), n in numbers.items()],
        "pred string, val string, word int, bit bigint",
    )
    wanted = spark.createDataFrame(
        [(w, rule_id, need, words[rule_id]) for (rule_id, w), need in needs.items()],
        f"word int, rule_id {kind}, need bigint, words int",
    )
    if len(positive) <= BROADCAST_ROWS:
        bits, wanted = F.broadcast(bits), F.broadcast(wanted)
    same = (facts["pred"] == bits["pred"]) & facts["val"].eqNullSafe(bits["val"])
    held = facts.join(bits, same).groupBy("case_id", "word").agg(F.bit_or("bit").alias("held"))
    met = held.join(wanted, "word").where(F.col("held").bitwiseAND(F.col("need")) == F.col("need"))
    if all(n == 1 for n in words.values()):
        return met.select("case_id", "rule_id")
    counts = met.groupBy("case_id", "rule_id", "words").agg(F.count(F.lit(1)).alias("hits"))
    return counts.where("hits = words").select("case_id", "rule_id")


def score_facts(
    cases: DataFrame, facts: DataFrame, theory: Theory
) -> DataFrame:
    """Membership for many rules: join the facts with the rule table, then take away
    the cases of the exceptions, innermost first. Returns cases with ``pred``, ``fired``.
    """
    literals = theory.to_df(cases.sparkSession)
    # Read once per exception level, so the matches are written out.
    fired = materialize(fired_rules(facts, literals))
    all_rules = (*theory.rules, *theory.exceptions)
    blocked_by = {
        rule_id: [lit.pred for lit in rule.body if lit.negated]
        for rule_id, rule in enumerate(all_rules)
    }

    holds: dict[str, DataFrame] = {
        h: ids.select("case_id").distinct() for h, ids in theory.listed.items()
    }

    def holding(rule_ids: list[int]) -> DataFrame:
        """(case_id, rule_id) of these rules after their exceptions."""
        rows = fired.where(F.col("rule_id").isin(rule_ids)).select("case_id", "rule_id")
        for name in sorted({n for i in rule_ids for n in blocked_by[i]}):
            users = [i for i in rule_ids if name in blocked_by[i]]
            if name not in holds:
                inner = [i for i, r in enumerate(all_rules) if r.head == name]
                holds[name] = holding(inner).select("case_id").distinct()
            blocked = minus(rows.where(F.col("rule_id").isin(users)), holds[name])
            rows = rows.where(~F.col("rule_id").isin(users)).unionByName(blocked)
        return rows

    hits = holding(list(range(len(theory.rules))))
    per_case = hits.groupBy("case_id").agg(
        F.array_sort(F.collect_set("rule_id")).alias("fired")
    )  # at most one entry per rule
    joined = cases.join(per_case, "case_id", "left")
    return joined.withColumn(
        "fired", F.coalesce("fired", F.array().cast("array<int>"))
    ).withColumn("pred", F.size("fired") > 0)


# ---------------------------------------------------------------- sets of cases


def minus(a: DataFrame, b: DataFrame, on: Sequence[str] = ("case_id",)) -> DataFrame:
    """Rows of ``a`` without a partner in ``b``.

    Keys of ``b`` are made distinct, which shrinks a hot key before it is shuffled.
    """
    return a.join(b.select(*on).distinct(), list(on), "left_anti")


def union_all(views: Sequence[DataFrame]) -> DataFrame:
    """A predicate defined by several sources: their distinct union."""
    result = views[0]
    for view in views[1:]:
        result = result.unionByName(view)
    return result.distinct()


def member_of(df: DataFrame, examples: DataFrame) -> DataFrame:
    """Keep the rows of known examples and add whether they are positive."""
    return df.join(examples.select("case_id", "is_pos"), "case_id")


def closed_world_negatives(domain: DataFrame, positives: DataFrame) -> DataFrame:
    """All case ids of the domain that are not positive."""
    return minus(domain.select("case_id").distinct(), positives)


def closed_world_examples(domain: DataFrame, positives: DataFrame) -> DataFrame:
    """Positives and closed-world negatives: (case_id, is_pos)."""
    negatives = closed_world_negatives(domain, positives).withColumn("is_pos", F.lit(False))
    marked = positives.select("case_id").distinct().withColumn("is_pos", F.lit(True))
    return marked.unionByName(negatives)


def explicit_negatives(examples: DataFrame) -> DataFrame:
    """Case ids that are labelled negative."""
    return examples.where(~F.col("is_pos")).select("case_id")


def enumerated_exceptions(cases: CaseTable, rule: Rule, theory: Theory | None = None) -> DataFrame:
    """The negatives a rule covers, as a list of exceptions: (case_id)."""
    return covered(cases.df.where(~F.col("is_pos")), rule, theory).select("case_id")


def add_enumerated_exceptions(
    cases: CaseTable, rule: Rule, head: str = "ab0"
) -> Theory:
    """The rule with its covered negatives listed as exceptions."""
    listed = enumerated_exceptions(cases, rule)
    limited = Rule(rule.head, (*rule.body, Literal(head, None, True)))
    return Theory(rule.head, (limited,), (), {head: listed})


def prefix_coverage(df: DataFrame, rule: Rule, weight: Column) -> DataFrame:
    """Weight of cases covered by each prefix of the body: (len, weight), one scan."""
    failing = F.coalesce(
        *[
            F.when(~literal_condition(lit, df), F.lit(i))
            for i, lit in enumerate(rule.body)
        ],
        F.lit(len(rule.body)),
    )
    by_first = df.groupBy(failing.alias("len")).agg(F.sum(weight).alias("weight"))
    return by_first
