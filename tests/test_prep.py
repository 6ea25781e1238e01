"""Cleaning, discretizing, melting, ranks and splits."""

import random

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ruleweave.functions.arrays import overlaps, sorted_insert, sorted_union
from ruleweave.functions.scalar import split_dummy, to_utility
from ruleweave.operators import evaluate as ev
from ruleweave.operators.gain import language_size, literal_grid, connected
from ruleweave.operators.model import stratified_split
from ruleweave.operators.prep import (
    CaseTable,
    from_facts,
    impute_mean,
    one_hot,
    qcut,
    redundant_binary_values,
    remap,
    to_facts,
)
from ruleweave.operators.ranks import _quantiles_by_rank, exact_quantiles, numbered, running_sums


def column(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "case_id int, x double")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(0, 12).map(float), min_size=1, max_size=40))
def test_qcut_matches_pandas(spark, values):
    got = [r["x"] for r in qcut(column(spark, values), ["x"]).orderBy("case_id").collect()]
    if len(set(values)) == 1:
        assert got == [0] * len(values)
    else:
        assert got == list(pd.qcut(pd.Series(values), 4, labels=False, duplicates="drop"))


def test_both_quantile_ways_agree_on_skewed_values(spark):
    r = random.Random(3)
    values = [7.0] * 700 + [r.expovariate(0.1) for _ in range(1300)]
    df = column(spark, values)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    small = exact_quantiles(df, ["x"], probs)["x"]
    large = _quantiles_by_rank(df, ["x"], probs, parts=16)["x"]
    expected = list(pd.Series(values).quantile(probs))
    assert small == pytest.approx(expected) and large == pytest.approx(expected)
    assert exact_quantiles(df, ["x"], probs, small=10)["x"] == pytest.approx(expected)


def test_nulls_get_no_bin_and_no_fact(spark):
    df = column(spark, [1.0, None, 3.0, 4.0])
    coded = qcut(df, ["x"])
    assert coded.where("case_id = 1").first()["x"] is None
    assert to_facts(CaseTable(coded, ("x",))).count() == 3


def test_running_sums(spark):
    rows = [(float(i), i % 3, 1) for i in range(500)]
    df = spark.createDataFrame(rows, "s double, a int, b int")
    got = running_sums(df, "s", ["a", "b"], parts=7).toPandas().sort_values("s", ascending=False)
    assert list(got["cum_a"]) == list(got["a"].cumsum()) and list(got["cum_b"]) == list(range(1, 501))


def test_numbering_is_gapless_and_ordered(spark):
    rows = [(chr(97 + i % 3), i if i else None) for i in range(200)]
    df = spark.createDataFrame(rows, "a string, b int").repartition(6)
    got = [(r["a"], r["b"]) for r in numbered(df, "a", "b", parts=5).orderBy("nth").collect()]
    assert got == sorted(rows, key=lambda r: (r[0], -1 if r[1] is None else r[1]))
    assert [r["nth"] for r in numbered(df, "a", "b").orderBy("nth").collect()] == list(range(200))


def test_one_hot_and_redundant_values(spark):
    df = spark.createDataFrame(
        [(1, 0, "b_x", 5), (2, 1, None, 6), (3, 1, "a.1", 7)], "case_id int, sex int, kind string, n int"
    )
    hot = one_hot(df, ["kind"])
    assert hot.columns == ["case_id", "sex", "n", "kind_a.1", "kind_b_x"]
    assert [tuple(r)[3:] for r in hot.orderBy("case_id").collect()] == [(0, 1), (0, 0), (1, 0)]
    assert [tuple(r) for r in redundant_binary_values(df, ["sex", "n"]).collect()] == [("sex", "0")]
    facts = to_facts(CaseTable(df, ("sex", "kind", "n")), drop_binary_low=True)
    assert {r["case_id"] for r in facts.where("pred = 'sex'").collect()} == {2, 3}
    with pytest.raises(ValueError):
        one_hot(df, ["kind"], max_values=1)


def test_facts_and_back(spark):
    df = spark.createDataFrame(
        [(1, True, "x", ["u", "v"]), (2, False, None, None)],
        "case_id int, is_pos boolean, a string, m array<string>",
    )
    facts = to_facts(CaseTable(df, ("a", "m")))
    back = from_facts(facts.unionAll(facts), df, single=["a"], multi=["m"])
    assert [tuple(r) for r in back.df.orderBy("case_id").collect()] == [tuple(r) for r in df.orderBy("case_id").collect()]


def test_value_spelling_and_utilities(spark):
    df = spark.createDataFrame([("tumor_size_Big.1", 1.001), ("sg_1.01", -0.0155)], "n string, phi double")
    pred, val = split_dummy("n")
    rows = df.select(pred, val, to_utility("phi"), to_utility("phi", truncate=True)).collect()
    assert [tuple(r) for r in rows] == [("tumor_size", "big1", 1001, 1000), ("sg", "101", 16, 16)]


def test_remap_and_impute(spark):
    df = spark.createDataFrame([("lo", 1.0), ("hi", None), ("7", 3.0)], "a string, b double")
    got = impute_mean(remap(df, {"a": {"lo": 1, "hi": 2}}), ["b"]).collect()
    assert [tuple(r) for r in got] == [(1, 1.0), (2, 2.0), (7, 3.0)]


def test_sets(spark):
    df = spark.createDataFrame([(["b", "a"], ["c", "a"]), (["x", None], ["y", None])], "a array<string>, b array<string>")
    rows = df.select(overlaps("a", "b"), sorted_union("a", "b"), sorted_insert("a", F.lit("m"))).collect()
    assert rows[0][0] and not rows[1][0]
    assert rows[0][1] == ["a", "b", "c"] and rows[0][2] == ["a", "b", "m"]


def test_literal_grid(spark):
    modes = spark.createDataFrame(
        [("goal", 0, "var", "person", 1, True), ("likes", 0, "var", "person", 1, False),
         ("likes", 1, "const", "food", 1, False), ("tall", 0, "var", "person", 1, False)],
        "pred string, arg_no int, kind string, type string, recall int, is_head boolean",
    )
    constants = spark.createDataFrame([("food", "pie"), ("food", "rice")], "type string, val string")
    variables = spark.createDataFrame([("A", "person")], "name string, type string")
    grid = literal_grid(modes, constants, variables)
    got = {(r["pred"], *r["args"]) for r in grid.collect()}
    assert got == {("likes", v, f) for v in "A_" for f in ("pie", "rice")} | {("tall", "A"), ("tall", "_")}
    assert connected(grid, ["A"]).count() == 3
    assert tuple(language_size(modes, constants).first()) == (3, 2.0)


def test_stratified_split_is_exact_and_stable(spark):
    df = spark.createDataFrame([(i, "a" if i % 10 else "b") for i in range(1000)], "case_id int, y string")
    one = stratified_split(df.repartition(3), "y", 0.8, seed=5)
    two = stratified_split(df.repartition(8), "y", 0.8, seed=5)
    sizes = {(r["y"], r["is_train"]): r["count"] for r in one.groupBy("y", "is_train").count().collect()}
    assert sizes == {("a", True): 720, ("a", False): 180, ("b", True): 80, ("b", False): 20}
    pick = lambda d: {r["case_id"] for r in d.where("is_train").collect()}
    assert pick(one) == pick(two) != pick(stratified_split(df, "y", 0.8, seed=6))


def test_metrics_are_safe_for_perfect_and_empty_results(spark):
    perfect = spark.createDataFrame([(True, True), (False, False)], "pred boolean, is_pos boolean")
    row = ev.evaluate(perfect).first()
    assert (row["fp"], row["fn"], row["accuracy"], row["f1"]) == (0, 0, 1.0, 1.0)
    nothing = ev.evaluate(perfect.where("pred is null")).first()
    assert nothing["accuracy"] == 0.0 and nothing["f1"] == 0.0


def test_roc_and_auc(spark):
    r = random.Random(2)
    rows = [(r.randint(0, 9) / 10, r.random() < 0.4) for _ in range(300)]
    df = spark.createDataFrame(rows, "s double, is_pos boolean")
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert ev.auc(df, "s").first()["auc"] == pytest.approx(wins)
    for p in ev.roc_points(df, "s").collect():
        assert p["tp"] == sum(s >= p["threshold"] for s in pos)
        assert p["fp"] == sum(s >= p["threshold"] for s in neg)


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,), (float("nan"),)], "x double")
    assert sorted(r.x for r in impute_mean(df, ["x"]).collect()) == [1.0, 2.0, 2.0, 3.0]
    codes = [r.x for r in qcut(df, ["x"]).collect()]
    assert codes.count(None) == 2 and sorted(c for c in codes if c is not None) == [0, 3]
