"""Clauses with variables over several tables."""

import pytest

from ruleweave.operators import relational as rel
from ruleweave.operators.gain import rank_literals, candidate_counts, case_weights, with_gain
from ruleweave.operators.relational import Atom


@pytest.fixture(scope="module")
def world(spark):
    def table(rows, n):
        return spark.createDataFrame(rows, ", ".join(f"a{i} string" for i in range(n)))

    tables = {
        "by": table([("o1", "c1"), ("o2", "c1"), ("o3", "c2"), ("o4", "c3")], 2),
        "city": table([("c1", "x"), ("c2", "y"), ("c2", "z")], 2),
        "part": table([("o1", "p1"), ("o1", "p2"), ("o1", "p2"), ("o3", "p1"), ("o4", "p3")], 2),
        "red": table([("p2",), ("p3",)], 1),
        "same": table([("o1", "o1"), ("o2", "o1")], 2),
    }
    examples = spark.createDataFrame(
        [("o1", True), ("o2", True), ("o3", False), ("o4", False)], "O string, is_pos boolean"
    )
    return examples, tables


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_bindings(world):
    examples, tables = world
    bound = rel.bind(examples, [Atom("by", ("O", "C")), Atom("part", ("O", "P"))], tables)
    assert values(bound, "O", "C", "P") == [("o1", "c1", "p1"), ("o1", "c1", "p2"), ("o3", "c2", "p1"), ("o4", "c3", "p3")]
    negated = rel.bind(examples, [Atom("part", ("O", "P"), True)], tables)
    assert values(negated, "O") == [("o2",)]
    constant = rel.bind(examples, [Atom("part", ("O", "p1"))], tables)
    assert values(constant, "O") == [("o1",), ("o3",)]
    assert values(rel.bind(examples, [Atom("same", ("O", "O"))], tables), "O") == [("o1",)]
    with pytest.raises(ValueError):
        rel.bind(examples, [Atom("red", ("Q",))], tables)


@pytest.mark.parametrize(
    "body, expected",
    [
        ([Atom("part", ("O", "P")), Atom("red", ("P",))], ["o1", "o4"]),
        ([Atom("by", ("O", "C")), Atom("city", ("C", "x"))], ["o1", "o2"]),
        ([Atom("part", ("O", "P")), Atom("red", ("P",), True)], ["o1", "o3"]),
        ([Atom("by", ("O", "C")), Atom("part", ("O", "P")), Atom("red", ("P",))], ["o1", "o4"]),
    ],
)
def test_covered_without_multiplying_cases(world, body, expected):
    examples, tables = world
    assert values(rel.covered_bindings(examples, ["O"], body, tables), "O") == [(e,) for e in expected]
    bound = rel.bind(examples, body, tables).select("O").distinct()
    assert values(bound, "O") == [(e,) for e in expected]


def test_counts_of_cases_and_proofs(world):
    examples, tables = world
    row = rel.clause_counts(examples, ["O"], [Atom("part", ("O", "P"))], tables).first()
    assert tuple(row) == (1, 2, 2)
    bound = rel.bind(examples, [Atom("by", ("O", "C"))], tables)
    got = rel.constant_candidates(bound, "city", "C", tables, "O")
    assert values(got, "val", "p_cases", "p_tuples", "n_tuples") == [("x", 2, 2, 0), ("y", 0, 0, 1), ("z", 0, 0, 1)]


def test_determinate_literals(world):
    examples, tables = world
    by, city, part = Atom("by", ("O", "C")), Atom("city", ("C", "T")), Atom("part", ("O", "P"))
    assert rel.is_determinate(examples, by, tables)
    assert not rel.is_determinate(examples, part, tables)
    bound, added = rel.determinate_literals(examples, [city, part, by], tables, bound=1)
    assert added == [by] and bound.count() == 4
    # A city is unique for the positives, but one negative has two of them.
    _, deeper = rel.determinate_literals(examples, [city, part, by], tables, bound=3)
    assert deeper == [by]
    one_city = {**tables, "city": tables["city"].where("a1 <> 'z'")}
    bound, deeper = rel.determinate_literals(examples, [city, part, by], one_city, bound=3)
    assert deeper == [by, city]
    assert values(bound.na.fill("-"), "O", "T") == [("o1", "x"), ("o2", "x"), ("o3", "y"), ("o4", "-")]


def test_learning_on_reached_attributes(world):
    examples, tables = world
    bound, _ = rel.determinate_literals(examples, [Atom("by", ("O", "C"))], tables, bound=2)
    cases = rel.relational_cases(bound, "O", {"city": ("city", "C"), "part": ("part", "O")}, tables)
    counts = candidate_counts(cases.df, cases.attrs, *case_weights())
    best = rank_literals(with_gain(counts, 2, 2)).first()
    assert (best["pred"], best["val"], best["p_cov"], best["n_cov"]) == ("city", "x", 2, 0)


def test_closed_world_pairs_equal_the_full_product(spark):
    people, foods = list("abcd"), list("xyz")
    likes = {("a", "x"), ("a", "y"), ("b", "x")}
    positives = spark.createDataFrame(sorted(likes), "A string, B string")
    tall = spark.createDataFrame([("a",), ("c",)], "A string")
    row = rel.closed_world_counts(positives, tall, ["A", "B"], {"A": 4, "B": 3}).first()
    pairs = [(p, f) for p in people for f in foods if p in "ac"]
    assert tuple(row) == (sum(p in likes for p in pairs), sum(p not in likes for p in pairs))
