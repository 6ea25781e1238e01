"""Learners, pruning and rule evaluation on small data with known answers."""

import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from ruleweave.functions.scalar import clause_bits, explicit_bits, log2_choose, log2_factorial
from ruleweave.operators import coverage as cov
from ruleweave.operators.gain import (
    Bias,
    bias_filter,
    candidate_counts,
    case_weights,
    derive_bias,
    rank_literals,
    weigh,
    with_gain,
)
from ruleweave.operators.prep import CaseTable, to_facts
from ruleweave.plans.guided import learn_guided_rules
from ruleweave.plans.learn import LearnSettings, learn_rules
from ruleweave.plans.prune import prune, prune_literals, prune_rules
from ruleweave.plans.utility_learn import (
    UtilitySearch,
    UtilitySettings,
    learn_utility_rules,
    trim_length,
    utility_base,
)
from ruleweave.rules import Literal, Rule, Theory, rule_condition, theory_from_rows

from .fixtures import FLY, cars, flying

EASY = LearnSettings(use_mdl=False)


def ids(df):
    return {r["case_id"] for r in df.select("case_id").collect()}


def test_flying_gains(spark):
    c = flying(spark)
    gains = with_gain(candidate_counts(c.df, c.attrs, *case_weights(), c.unary), 6, 5)
    got = {r["pred"]: round(r["gain"], 3) for r in gains.collect()}
    assert got["superpenguin"] == 1.749
    assert got["bird"] == pytest.approx(4 * (0.8745 - 0.5850), abs=2e-3)
    assert got["penguin"] < 0 and got["plane"] < 0 and got["damaged"] == 0
    assert rank_literals(gains).first()["pred"] == "superpenguin"


def test_flying_theory(spark):
    theory = learn_rules(flying(spark), settings=LearnSettings(target="flies"))
    assert theory.lines() == [
        "flies(A):-superpenguin(A).",
        "flies(A):-bird(A),not(ab0(A)).",
        "flies(A):-plane(A),not(ab1(A)).",
        "",
        "ab0(A):-penguin(A).",
        "ab1(A):-damaged(A).",
    ]


@pytest.mark.parametrize("parts", [1, 5])
def test_flying_is_perfect_for_any_partitioning(spark, parts):
    c = flying(spark)
    c = replace(c, df=c.df.repartition(parts))
    theory = learn_rules(c, settings=LearnSettings(target="flies"))
    scored = cov.score(c.df, theory)
    assert ids(scored.where("pred")) == set(FLY)
    assert scored.where("pred <> is_pos").count() == 0


def test_nested_exceptions_are_learned(spark):
    c = cars(spark)
    theory = learn_rules(c, settings=EASY)
    scored = cov.score(c.df, theory)
    assert scored.where("pred <> is_pos").count() == 0
    facts = to_facts(c)
    long = cov.score_facts(c.df.select("case_id"), facts, theory)
    assert ids(long.where("pred")) == ids(scored.where("pred"))


def test_depth_bound_and_inseparable_cases(spark):
    rows = [(i, i % 2 == 0, "x", "y") for i in range(20)]
    df = spark.createDataFrame(rows, "case_id int, is_pos boolean, a string, b string")
    assert learn_rules(CaseTable(df, ("a", "b")), settings=EASY).rules == ()


def test_no_positives(spark):
    df = spark.createDataFrame([(1, False, "x")], "case_id int, is_pos boolean, a string")
    assert learn_rules(CaseTable(df, ("a",)), settings=EASY).rules == ()


def test_bias_limits_values_and_recall(spark):
    c = cars(spark)
    counts = candidate_counts(c.df, c.attrs, *case_weights())
    bias = Bias({"safety": 1, "seats": 2}, 6, {"safety": frozenset({"high"})})
    kept = {(r["pred"], r["val"]) for r in bias_filter(counts, bias).collect()}
    assert ("safety", "low") not in kept and ("safety", "high") in kept and ("price", "low") in kept
    assert bias.open_attrs([Literal("safety", "high")]) == ["seats"]
    assert bias.open_attrs([Literal("seats", "2")] * 2) == ["safety"]


def test_every_added_literal_gains_and_coverage_splits(spark):
    c = cars(spark)
    theory = learn_rules(c, settings=EASY, post_prune=False)
    for rule in theory.rules:
        inside, outside = cov.covered(c.df, rule, theory), cov.uncovered(c.df, rule, theory)
        assert inside.count() + outside.count() == c.df.count()
        assert not ids(inside) & ids(outside)
        plain = [lit for lit in rule.body if not lit.negated]
        accuracy = []
        for i in range(len(plain) + 1):
            row = cov.coverage_counts(c.df, Rule("positive", tuple(plain[:i])), theory).first()
            accuracy.append(row["p_cov"] / (row["p_cov"] + row["n_cov"]))
        assert accuracy == sorted(accuracy)


def test_grouping_equal_cases_keeps_counts(spark):
    c = cars(spark, copies=7)
    base = weigh(c)
    assert base.df.count() == 18
    a = candidate_counts(c.df, c.attrs, *case_weights()).collect()
    b = candidate_counts(base.df, base.attrs, F.col("p_w"), F.col("n_w")).collect()
    assert {tuple(r) for r in a} == {tuple(r) for r in b}


def test_missing_values_never_hold_and_negation_is_failure(spark):
    df = spark.createDataFrame(
        [(1, True, None, None), (2, False, "x", ["u", "v"])],
        "case_id int, is_pos boolean, a string, m array<string>",
    )
    yes = Rule("positive", (Literal("a", "x"),))
    no = Rule("positive", (Literal("ab0", None, True),))
    theory = Theory("positive", (no,), (Rule("ab0", (Literal("m", "u"),)),))
    assert ids(cov.covered(df, yes)) == {2} and ids(cov.uncovered(df, yes)) == {1}
    assert ids(cov.covered(df, no, theory)) == {1}


def test_drop_alternatives_match_direct_counts(spark):
    c = cars(spark)
    rule = Rule("positive", (Literal("safety", "high"), Literal("seats", "4"), Literal("price", "low")))
    got = {r["dropped"]: (r["p_cov"], r["n_cov"]) for r in cov.drop_alternatives(c.df, rule).collect()}
    for i in range(-1, 3):
        direct = cov.coverage_counts(c.df, rule if i < 0 else rule.without(i)).first()
        assert got.get(i, (0, 0)) == tuple(direct)
    single = Rule("positive", (Literal("safety", "high"),))
    assert [r["dropped"] for r in cov.drop_alternatives(c.df, single).collect()] == [-1]


def test_prune_literals_and_rules(spark):
    c = cars(spark)
    base = weigh(c).df
    useless = Rule("positive", (Literal("safety", "high"), Literal("seats", "4"), Literal("safety", "high")))
    small = Rule("positive", (Literal("safety", "high"), Literal("seats", "4"), Literal("price", "low")))
    other = Rule("positive", (Literal("safety", "high"), Literal("seats", "more")))
    theory = Theory("positive", (useless, small, other))
    slim = prune_literals(base, theory)
    # The first body literal is repeated later, so it goes; the next removal is not made.
    assert slim.rules[0].body == (Literal("seats", "4"), Literal("safety", "high"))
    kept = prune_rules(base, theory, max_loss=0.03)
    assert small not in kept.rules and useless in kept.rules and other in kept.rules
    before = cov.total_coverage(c.df, theory).first()["covered"]
    after = cov.total_coverage(c.df, kept).first()["covered"]
    assert (before - after) / before <= 0.03
    assert prune(base, Theory("positive", ())).rules == ()


def test_unreachable_exceptions_are_dropped():
    r = Rule("positive", (Literal("a", "x"), Literal("ab1", None, True)))
    exceptions = (
        Rule("ab0", (Literal("b", "y"),)),
        Rule("ab1", (Literal("c", "z"), Literal("ab2", None, True))),
        Rule("ab2", (Literal("d", "w"),)),
    )
    assert [e.head for e in Theory("positive", (r,), exceptions).reachable().exceptions] == ["ab1", "ab2"]


def test_listed_exceptions(spark):
    c = cars(spark)
    rule = Rule("positive", (Literal("safety", "high"),))
    theory = cov.add_enumerated_exceptions(c, rule)
    scored = cov.score(c.df, theory)
    assert scored.where("pred <> is_pos").count() == 0
    long = cov.score_facts(c.df.select("case_id"), to_facts(c), theory)
    assert ids(long.where("pred")) == ids(scored.where("pred"))


def test_theory_survives_its_table_form(spark):
    theory = learn_rules(cars(spark), settings=EASY)
    again = theory_from_rows(theory.to_df(spark).collect(), "positive")
    assert again.rules == theory.rules and again.exceptions == theory.exceptions


def test_code_lengths():
    assert log2_factorial(13) == pytest.approx(math.log2(math.factorial(13)))
    assert log2_choose(20, 7) == pytest.approx(math.log2(math.comb(20, 7)))
    assert math.isfinite(log2_choose(10**12, 10**11))
    assert explicit_bits(11, 2) == pytest.approx(math.log2(11) + math.log2(55))
    assert explicit_bits(11, 0) == 0
    assert clause_bits(3, 2) == pytest.approx(8 - 1)


# ---------------------------------------------------------------- attributions


def with_effects(spark) -> CaseTable:
    c = cars(spark)
    df = c.df.withColumns(
        {
            "phi_safety": F.when(F.col("safety") == "high", 0.9).otherwise(-0.7),
            "phi_seats": F.when(F.col("seats") == "2", -0.4).otherwise(0.2),
            "phi_price": F.when(F.col("price") == "low", 0.1).otherwise(-0.1),
        }
    )
    return CaseTable(df, c.attrs)


def test_guided_rules_use_only_leading_literals(spark):
    c = with_effects(spark)
    wide = learn_guided_rules(c, top=6, settings=replace(EASY, min_accuracy=0.8, stop_accuracy=0.95))
    assert cov.score(c.df, wide).where("pred <> is_pos").count() == 0
    narrow = learn_guided_rules(c, top=1, settings=replace(EASY, min_accuracy=0.5, stop_accuracy=0.95, max_depth=0))
    assert [r.text() for r in narrow.rules] == ["positive(A):-safety(A,high)."]


def test_utility_rules_explain_cars(spark):
    c = with_effects(spark)
    theory = learn_utility_rules(c, UtilitySettings(min_accuracy=0.9, leftover=0.0))
    scored = cov.score(c.df, theory)
    assert scored.where("is_pos and not pred").count() == 0
    assert scored.where("pred and not is_pos").count() / scored.where("pred").count() <= 0.1


def test_utility_base_sums_and_items(spark):
    c = with_effects(spark)
    base = utility_base(c)
    direct = c.df.where("is_pos").agg(F.sum(F.round(F.col("phi_safety") * 1000))).first()[0]
    assert base.where("is_pos").agg(F.sum("u_safety")).first()[0] == direct
    assert base.where("is_pos and seats = '2' and has_seats").count() == 0
    top = utility_base(c, top=1)
    held = top.select(sum(F.col(f"has_{a}").cast("int") for a in c.attrs).alias("n"))
    assert held.agg(F.max("n")).first()[0] == 1


def test_used_itemsets_are_not_returned_again(spark):
    c = with_effects(spark)
    search = UtilitySearch(utility_base(c), c.attrs, UtilitySettings(lookahead=1))
    from ruleweave.plans.learn import Side

    pos = Side("p_w", F.lit(True))
    seen = [search.next_body(pos, 0) for _ in range(4)]
    assert len({frozenset(s) for s in seen}) == 4
    search.close()


def test_trim_length():
    # first failing position -> negatives; size 3 covers 2, dropping the last brings none
    assert trim_length({3: 2, 1: 5, 0: 9}, 3) == 2
    assert trim_length({3: 2, 2: 1}, 3) == 3
    assert trim_length({}, 3) == 1


def test_rule_condition_has_no_nulls(spark):
    df = spark.createDataFrame([(None,), ("x",)], "a string")
    cond = rule_condition(Rule("h", (Literal("a", "x"),)), df)
    assert [r[0] for r in df.select(cond).collect()] == [False, True]


def test_derive_bias_counts_literals(spark):
    bias = derive_bias(cars(spark))
    assert bias.literal_count == 8 and bias.literal_bits == 3.0


def test_fired_rules_keep_a_row_per_case_and_word(spark):
    """Many literals, repeated facts and shared literals: bits of a case, not a row per match."""
    wide = [(0, i, "p", str(i), False) for i in range(130)]
    more = [(1, 0, "p", "3", False), (1, 1, "p", "3", False), (1, 2, "ab0", None, True)]
    more += [(2, 0, "flag", None, False), (2, 1, "p", "129", False), (3, 0, "ab0", None, True)]
    literals = spark.createDataFrame(wide + more, "rule_id int, lit_no int, pred string, val string, negated boolean")
    rows = [(1, "p", str(i)) for i in range(130)] * 2 + [(2, "p", str(i)) for i in range(129)]
    rows += [(2, "flag", None), (3, "flag", None), (3, "p", "129"), (4, "flag", "x"), (None, "p", "3")]
    fired = cov.fired_rules(spark.createDataFrame(rows, "case_id int, pred string, val string"), literals)
    assert "lit_no" not in fired._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, fired.collect()), key=str) == [(1, 0), (1, 1), (2, 1), (3, 2), (None, 1)]
