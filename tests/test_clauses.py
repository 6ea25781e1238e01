"""Relational learner, programs of clauses, and the settings of the greedy learner."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from ruleweave.operators import coverage as cov
from ruleweave.operators.clauses import Clause, Program, clauses_from_rows, joinable
from ruleweave.operators.prep import CaseTable
from ruleweave.operators.relational import Atom, bind
from ruleweave.plans import relational_learn as rl
from ruleweave.plans.learn import LearnSettings, learn_rules
from ruleweave.plans.relational_learn import Place, RelationalModes, RelationalSettings
from ruleweave.sources import readers as rd


def table(spark, rows, arity=2):
    return spark.createDataFrame(rows, ", ".join(f"a{i} string" for i in range(arity)))


def program(spark, *lines):
    texts = spark.createDataFrame([(line,) for line in lines], "value string")
    return Program(tuple(clauses_from_rows(rd.parse_clauses(texts).collect())))


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def test_views_joins_negation_and_constants(spark):
    tables = {
        "parent": table(spark, [("ann", "bob"), ("bob", "carl"), ("bob", "dora"), ("eve", "carl"), (None, "x")]),
        "male": table(spark, [("bob",), ("carl",)], 1),
    }
    known = program(
        spark,
        "grand(X,Z) :- parent(X,Y), parent(Y,Z).",
        "aunt(X,'Z') :- parent(X,Y), not(male(X)).",
        "lonely(X) :- grand(Y,X), \\+ male(X).",
        "male(X) :- parent(X,dora).",
    ).derive(tables)
    assert rows_of(known["grand"]) == {("ann", "carl"), ("ann", "dora")}
    assert rows_of(known["aunt"]) == {("ann", "Z"), ("eve", "Z")}
    assert rows_of(known["lonely"]) == {("dora",)}
    assert rows_of(known["male"]) == {("bob",), ("carl",)}


def test_programs_that_are_refused(spark):
    tables = {"p": table(spark, [("a", "b")]), "q": table(spark, [("c", "d")])}
    with pytest.raises(ValueError, match="themselves"):
        program(spark, "x(A):-p(A,B),not(y(A)).", "y(A):-x(A).").derive(tables)
    with pytest.raises(ValueError, match="no shared variable"):
        program(spark, "x(A):-p(A,B),q(C,D).").derive(tables)
    with pytest.raises(ValueError, match="open"):
        program(spark, "x(A,Z):-p(A,B).").derive(tables)
    with pytest.raises(ValueError):
        joinable([Atom("p", ("A",), True)])


ANIMALS = ["tweety", "polly", "et", "kiwi", "bat", "cat"]


def animals(spark):
    return {
        "bird": table(spark, [("tweety",), ("polly",), ("et",), ("kiwi",)], 1),
        "penguin": table(spark, [("et",)], 1),
        "sort": table(spark, [("kiwi", "ratite"), ("tweety", "finch"), ("polly", "parrot"), ("et", "spheniscid"), ("bat", "mammal"), ("cat", "mammal")]),
        "carries": table(spark, [(a, "rucksack" if a == "et" else "nothing") for a in ANIMALS]),
    }


MODES = RelationalModes(("animal",), {
    "bird": (Place("var", "animal"),), "penguin": (Place("var", "animal"),), "sort": (Place("var", "animal"), Place("const", "kind")),
})


def learned(spark, positive, modes=MODES, tables=None, **settings):
    tables = tables or animals(spark)
    examples = spark.createDataFrame([(a, a in positive) for a in ANIMALS], "X string, is_pos boolean")
    theory = rl.learn_clauses(examples, ["X"], tables, modes, RelationalSettings(**settings))
    return theory, {r["X"] for r in theory.covered(examples, tables).collect()}


def test_default_with_exceptions(spark):
    modes = RelationalModes(("animal",), {p: MODES.predicates[p] for p in ("bird", "penguin")})
    theory, covered = learned(spark, {"tweety", "polly", "kiwi"}, modes)
    assert theory.lines() == ["positive(X):-bird(X),not(ab0(X)).", "", "ab0(X):-penguin(X)."]
    assert covered == {"tweety", "polly", "kiwi"}


def test_negation_and_lists(spark):
    modes = RelationalModes(("animal",), {"sort": MODES.predicates["sort"]})
    theory, covered = learned(spark, set(ANIMALS) - {"bat", "cat"}, modes, negation=True)
    assert theory.lines()[0] == "positive(X):-not(sort(X,mammal))." and covered == set(ANIMALS) - {"bat", "cat"}
    modes = RelationalModes(("animal",), {"bird": MODES.predicates["bird"]})
    theory, covered = learned(spark, {"tweety", "polly", "kiwi"}, modes, listed=True)
    assert theory.lines()[0] == "positive(X):-bird(X),not(ab0(X))." and rows_of(theory.listed["ab0"]) == {("et",)}
    assert covered == {"tweety", "polly", "kiwi"}
    assert learned(spark, {"tweety", "polly", "kiwi"}, modes)[0].clauses == ()


def test_nothing_to_learn(spark):
    theory, covered = learned(spark, set())
    assert theory.clauses == () and covered == set()
    empty = {p: t.limit(0) for p, t in animals(spark).items()}
    assert learned(spark, {"et"}, tables=empty)[0].clauses == ()


def test_counts_equal_brute_force(spark):
    rng = random.Random(3)
    cases = [(f"c{i}", rng.random() < 0.4) for i in range(25)]
    owns = list({(c, f"t{rng.randrange(12)}") for c, _ in cases for _ in range(rng.randrange(4))})
    color = list({(f"t{i}", rng.choice("rgb")) for i in range(12) for _ in range(2)})
    tables = {"owns": table(spark, owns), "color": table(spark, [*color, (None, "r")])}
    modes = RelationalModes(("case",), {
        "owns": (Place("var", "case"), Place("var", "thing")), "color": (Place("var", "thing"), Place("const", "color")),
    })
    examples = spark.createDataFrame(cases, "X string, is_pos boolean")
    bound = bind(examples, [Atom("owns", ("X", "A"))], tables)
    found = rl.patterns(modes, {"X": "case", "A": "thing"}, ["B", "C"])
    ranked = rl.ranked_extensions(bound, ["X"], found, rl.prepared_tables(tables, modes), negation=True)
    got = {r["literal"]: (r["p_cases"], r["p_tuples"], r["n_tuples"], r["gain"]) for r in ranked.collect()}
    proofs = [(c, t, pos) for c, pos in cases for c2, t in owns if c2 == c]
    p0, n0 = sum(p[2] for p in proofs), sum(not p[2] for p in proofs)
    want = {}

    def add(name, kept):  # kept: (case, is_pos) per proof
        p, n = sum(k[1] for k in kept), sum(not k[1] for k in kept)
        if p:
            r = len({c for c, pos in kept if pos})
            gain = round(r * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))), 9)
            if gain > 0:
                want[name] = (r, p, n, gain)

    for v in "rgb":
        add(f"color(A,{v})", [(c, pos) for c, t, pos in proofs if (t, v) in color])
        add(f"not(color(A,{v}))", [(c, pos) for c, t, pos in proofs if (t, v) not in color])
    add("owns(X,B)", [(c, pos) for (c, _, pos), (c2, _) in itertools.product(proofs, owns) if c2 == c])
    add("owns(B,A)", [(c, pos) for (c, t, pos), (_, t2) in itertools.product(proofs, owns) if t2 == t])
    # Every proof has its own fact, so owns(X,A) takes nothing away and owns(...) is never false.
    assert {k: v[:3] for k, v in got.items()} == {k: v[:3] for k, v in want.items()}
    assert all(abs(got[k][3] - want[k][3]) < 1e-6 for k in want)


def test_determinate_literals_lead_on(spark):
    tables = {
        "lives": table(spark, [(a, f"h{i}") for i, a in enumerate(ANIMALS)]),
        "in_town": table(spark, [(f"h{i}", f"t{i % 3}") for i in range(6)]),
        "rainy": table(spark, [("t1",)], 1),
    }
    modes = RelationalModes(("animal",), {
        "lives": (Place("var", "animal"), Place("var", "house")), "in_town": (Place("var", "house"), Place("var", "town")),
        "rainy": (Place("var", "town"),),
    })
    wet = {"polly", "bat"}
    assert learned(spark, wet, modes, tables)[0].clauses == ()
    theory, covered = learned(spark, wet, modes, tables, det_bound=2)
    assert theory.lines()[0] == "positive(X):-lives(X,A),in_town(A,B),rainy(B)." and covered == wet


def cases_of(spark, rows):
    df = spark.createDataFrame(rows, "case_id int, is_pos boolean, color string, size string")
    return CaseTable(df, ("color", "size"))


def test_lists_in_the_greedy_learner(spark):
    rows = [(i, i % 4 != 0, "red", "s" if i % 2 else None) for i in range(16)] + [(50 + i, False, "blue", "s") for i in range(8)]
    c = cases_of(spark, rows)
    theory = learn_rules(c, settings=LearnSettings(listed=True, use_mdl=False))
    assert cov.score(c.df, theory).where("pred <> is_pos").count() == 0
    assert theory.listed and all(ids.join(c.df, "case_id").where("is_pos").count() == 0 for ids in theory.listed.values())
    plain = learn_rules(c, settings=LearnSettings(use_mdl=False))
    assert not plain.listed
    with pytest.raises(ValueError):
        from ruleweave.operators.gain import weigh

        learn_rules(weigh(c), settings=LearnSettings(listed=True))


def test_negated_literals_in_the_greedy_learner(spark):
    rows = [(i, color != "red", color, None) for i, color in enumerate(["red", "blue", "green", None] * 5)]
    c = cases_of(spark, rows)
    theory = learn_rules(c, settings=LearnSettings(negation=True, use_mdl=False))
    assert [r.text() for r in theory.rules] == ["positive(A):-not(color(A,red))."]
    assert cov.score(c.df, theory).where("pred <> is_pos").count() == 0


def test_all_but_in_the_greedy_learner(spark):
    rows = [(i, i % 5 != 0, "red" if i % 5 == 0 else None, None) for i in range(20)]
    c = cases_of(spark, rows)
    theory = learn_rules(c, settings=LearnSettings(exceptions_alone=True, use_mdl=False))
    assert theory.lines() == ["positive(A):-not(ab0(A)).", "", "ab0(A):-color(A,red)."]
    assert learn_rules(c, settings=LearnSettings(use_mdl=False)).rules == ()


def test_clause_text():
    clause = Clause(Atom("h", ("X",)), (Atom("p", ("X", "'A'")), Atom("q", ("X",), True)))
    assert clause.text() == "h(X):-p(X,'A'),not(q(X))." and Clause(Atom("h", ("X",)), ()).text() == "h(X):-true."


def test_candidates_skip_the_body_and_count_only_positive_cases(spark):
    """Atoms of the body are no candidates; proofs of negatives meet a key in one row."""
    bias = rl.RelationalModes(("case",), {"has": (rl.Place("var", "case"), rl.Place("var", "part")),
                                          "kind": (rl.Place("var", "part"), rl.Place("const", "kind"))})
    cases = [(f"c{i}", i % 4 == 0) for i in range(40)]
    has = [(f"c{i}", f"p{j}") for i in range(40) for j in range(3) if (i + j) % 2]
    kind = [("p0", "x"), ("p1", "y"), ("p2", "x")]
    tables = {"has": spark.createDataFrame(has, "a0 string, a1 string"), "kind": spark.createDataFrame(kind, "a0 string, a1 string")}
    bound = spark.createDataFrame(cases, "O string, is_pos boolean").join(tables["has"].toDF("O", "A"), "O")
    found = rl.patterns(bias, {"O": "case", "A": "part"}, ["B", "C"], body=[rl.Atom("has", ("O", "A"))])
    assert ("has", ("O", "A")) not in {(p.pred, p.args) for p in found}
    sides = dict(cases)
    for negation in (False, True):
        got = {(found[r["pattern"]].args, tuple(r["consts"]), r["negated"]): (r["p_cases"], r["p_tuples"], r["n_tuples"])
               for r in rl.extension_counts(bound, ["O"], found, tables, negation).collect()}
        for value in "xy":
            for negated in {False, negation}:
                met = [o for o, a in has if ((a, value) in kind) != negated]
                pos = [o for o in met if sides[o]]
                want = (len(set(pos)), len(pos), len(met) - len(pos))
                assert got.get((("A", None), (value,), negated), (0, 0, 0)) == want
    other = [i for i, p in enumerate(found) if p.args == ("O", "B")]
    twice = [(o, a, b) for o, a in has for o2, b in has if o == o2]
    row = rl.extension_counts(bound, ["O"], [found[other[0]]], tables).first()
    assert (row["p_tuples"], row["n_tuples"]) == (sum(sides[o] for o, *_ in twice), sum(not sides[o] for o, *_ in twice))


def test_a_search_counts_once_and_regroups_no_cases(spark, monkeypatch):
    """Ways to fill a shape are counted once, also for several searches; no first literal is
    looked for twice; cases that meet facts are not grouped again."""
    bias = rl.RelationalModes(("case",), {"has": (rl.Place("var", "case"), rl.Place("var", "part")),
                                          "kind": (rl.Place("var", "part"), rl.Place("const", "kind")),
                                          "old": (rl.Place("var", "case"),)})
    cases = spark.createDataFrame([(f"c{i}", i % 2 == 0 and i % 6 != 0) for i in range(24)], "O string, is_pos boolean")
    tables = {
        "has": spark.createDataFrame([(f"c{i}", p) for i in range(24) for p in (("p1",) if i % 2 else ("p0", "p2"))] * 2, "a0 string, a1 string"),
        "kind": spark.createDataFrame([("p0", "x"), ("p1", "y")], "a0 string, a1 string"),
        "old": spark.createDataFrame([(f"c{i}",) for i in range(0, 24, 6)], "a0 string"),
    }
    counted, looked = [], []
    count, best = rl.ways_to_fill, rl.RelationalSearch.best
    monkeypatch.setattr(rl, "ways_to_fill", lambda shape, t: counted.append(shape) or count(shape, t))
    monkeypatch.setattr(rl.RelationalSearch, "best", lambda self, state, least=0.0: looked.append((self, state)) or best(self, state, least))
    prepared = rl.Prepared(cases, ["O"], tables, bias)
    lines = [rl.learn_clauses(cases, ["O"], tables, bias, prepared=prepared).lines() for _ in range(2)]
    assert lines[0] == lines[1] == ["positive(O):-has(O,A),kind(A,x),not(ab0(O)).", "", "ab0(O):-old(O)."]
    still_open = [s for s in counted if rl.is_open(s)]
    assert still_open and len(still_open) == len(set(still_open))
    firsts = [(id(search), id(s.bindings)) for search, s in looked if not s.body]
    assert len(firsts) == len(set(firsts))
    found = rl.patterns(bias, {"O": "case"}, ["A", "B"])
    flags = [p for p in found if p.pred == "old"]
    plan = rl.extension_counts(prepared.examples, ["O"], flags, prepared.tables, cases=prepared.examples.withColumn(
        "proofs", F.lit(1).cast("bigint")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_keys_of_several_places_are_told_apart(spark):
    """A pattern over two old variables meets only facts that agree in both."""
    bias = rl.RelationalModes(("a", "a"), {"link": (rl.Place("var", "a"), rl.Place("var", "a"), rl.Place("const", "c"))})
    rows = [("1", "11", True), ("11", "1", False), ("1:1", "1", True), (None, "1", True)]
    cases = spark.createDataFrame(rows, "X string, Y string, is_pos boolean")
    facts = [("1", "11", "u"), ("1:1", "1", "u"), ("11", "1", "v")]
    tables = {"link": spark.createDataFrame(facts, "a0 string, a1 string, a2 string")}
    found = [p for p in rl.patterns(bias, {"X": "a", "Y": "a"}, ["A", "B", "C"]) if p.args == ("X", "Y", None)]
    got = {tuple(r["consts"]): (r["p_cases"], r["p_tuples"], r["n_tuples"])
           for r in rl.extension_counts(cases, ["X", "Y"], found, tables).collect()}
    assert got == {("u",): (2, 2, 0), ("v",): (0, 0, 1)}
