"""Text files written and read back, and odd lines in them."""

from pyspark.sql import functions as F

from ruleweave.operators import coverage as cov
from ruleweave.plans.learn import LearnSettings, learn_rules
from ruleweave.rules import Literal, Rule, Theory, theory_from_rows
from ruleweave.sources import readers as rd
from ruleweave.sources import writers as wr

from .fixtures import cars


def write(path, text):
    path.write_text(text)
    return str(path)


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_case_table(spark, tmp_path):
    path = write(tmp_path / "c.csv", "id,age,kind,label\n1,3.5,a,yes\n2,?,?,no\n")
    df = rd.read_cases(spark, path, "id bigint, age double, kind string, label string")
    assert rows(df) == {(1, 3.5, "a", "yes"), (2, None, None, "no")}


def test_fact_file(spark, tmp_path):
    path = write(tmp_path / "f.pl", (
        ":-style_check(-discontiguous).\nfoil_cwa(true).\nfoil_predicates([a1/2,positive/1]).\n"
        "positive(p1).\nnegative(p2).\na1(p1,0).\nkind(p2, big box).\n% a1(p3,1).\n\n"
        "h_positive(A):-a1(A,0).\nbird(X) :- penguin(X).\n"
    ))
    facts, examples = rd.split_labels(rd.read_facts(spark, path))
    assert rows(facts) == {("a1", "p1", "0"), ("kind", "p2", "big box")}
    assert rows(examples) == {("p1", True), ("p2", False)}


def test_bias_file(spark, tmp_path):
    path = write(tmp_path / "b.txt", (
        "#modeh(positive(var(case))) \n#modeb(2,a1(var(case),const(num0_3))) \n#modeb(1,bird(var(case)))\n"
        "#constant(num0_3,0) \n#constant(num0_3,1) \n#constant(args_x,nan) \n"
    ))
    modes, constants = rd.read_bias(spark, path)
    assert rows(modes) == {
        ("positive", 0, "var", "case", 1, True), ("a1", 0, "var", "case", 2, False),
        ("a1", 1, "const", "num0_3", 2, False), ("bird", 0, "var", "case", 1, False),
    }
    assert rows(constants) == {("num0_3", "0"), ("num0_3", "1")}


def test_items_transactions_attributions(spark, tmp_path):
    items = write(tmp_path / "i.txt", "0->a1(A,0) \n12->kind(A,big) \n")
    assert rows(rd.read_items(spark, items)) == {(0, "a1", "0"), (12, "kind", "big")}
    tx = write(tmp_path / "t.txt", "positive(p14)::0 2:3261:906 1046\n# note\n@x\n\npositive(p9)::12:5:5\npositive(p3)::: 0:\npositive(p4):::0:\n")
    assert rows(rd.read_transactions(spark, tx)) == {("p14", 0, 906), ("p14", 2, 1046), ("p9", 12, 5)}
    phi = write(tmp_path / "s.txt", "data(p14):a1(A,0):0.906 \ndata(p14):a2(A,no):-0.003E-1 \n")
    assert rows(rd.read_attributions(spark, phi)) == {("p14", "a1", "0", 0.906), ("p14", "a2", "no", -0.0003)}


def test_round_trips_through_files(spark, tmp_path):
    c = cars(spark)
    from ruleweave.operators.gain import attribute_constants, attribute_modes
    from ruleweave.operators.prep import to_facts

    facts = to_facts(c)
    wr.write_facts(facts, c.df, str(tmp_path / "facts"))
    back, examples = rd.split_labels(rd.read_facts(spark, str(tmp_path / "facts")))
    assert back.count() == facts.count() and examples.where("is_pos").count() == c.df.where("is_pos").count()

    modes, constants = attribute_modes(c.df, c.attrs), attribute_constants(c.df, c.attrs)
    wr.write_bias(modes, constants, str(tmp_path / "bias"))
    m, k = rd.read_bias(spark, str(tmp_path / "bias"))
    assert rows(m) == rows(modes) and rows(k) == rows(constants)

    tx = spark.createDataFrame([("1", 3, 5), ("1", 4, 9), ("2", 3, 0)], "tid string, item int, util bigint")
    ids = spark.createDataFrame([("1",), ("2",), ("3",)], "tid string")
    wr.write_transactions(tx, str(tmp_path / "tx"), cases=ids)
    lines = {r["value"] for r in spark.read.text(str(tmp_path / "tx")).collect()}
    assert lines == {"positive(p1)::4 3:14:9 5", "positive(p2)::3:0:0", "positive(p3):::0:"}
    assert rd.read_transactions(spark, str(tmp_path / "tx")).count() == 3

    items = spark.createDataFrame([(0, "a", "x")], "item_id int, pred string, val string")
    wr.write_items(items, str(tmp_path / "items"))
    assert rows(rd.read_items(spark, str(tmp_path / "items"))) == rows(items)

    phi = spark.createDataFrame([("1", "a", "x", -0.25)], "case_id string, pred string, val string, phi double")
    wr.write_attributions(phi, str(tmp_path / "phi"))
    assert rows(rd.read_attributions(spark, str(tmp_path / "phi"))) == {("p1", "a", "x", -0.25)}

    sets = spark.createDataFrame([([1, 2], 9)], "itemset array<int>, util bigint")
    wr.write_itemsets(sets, str(tmp_path / "sets"))
    assert spark.read.text(str(tmp_path / "sets")).first()["value"] == "1 2 #UTIL: 9"


def test_rules_through_text(spark, tmp_path):
    c = cars(spark)
    theory = learn_rules(c, settings=LearnSettings(use_mdl=False))
    wr.write_rules(spark, theory, str(tmp_path / "rules"), covered=15, positives=15)
    text = [r["value"] for r in spark.read.text(str(tmp_path / "rules")).collect()]
    assert text[: len(theory.rules)] == [r.text() for r in theory.rules]
    assert text[-1] == "Total Coverage: 15 out of 15"
    again = theory_from_rows(rd.read_rules(spark, str(tmp_path / "rules")).collect(), "positive")
    assert again.rules == theory.rules and again.exceptions == theory.exceptions
    assert cov.score(c.df, again).where("pred <> is_pos").count() == 0


def test_rule_spellings(spark):
    lines = spark.createDataFrame(
        [("h(A):-a(A,x_1),not(ab0(A)).",), ("h(X) :- b(X), \\+ ab1(X).",), ("%h(A):-c(A).",), ("c(p1).",)], "value string"
    )
    got = {(r["head"], r["lit_no"], r["pred"], r["val"], r["negated"]) for r in rd.parse_rules(lines).collect()}
    assert got == {("h", 0, "a", "x_1", False), ("h", 1, "ab0", None, True), ("h", 0, "b", None, False), ("h", 1, "ab1", None, True)}


def test_atoms_views_and_rejected_lines(spark):
    lines = spark.createDataFrame(
        [("parent(ann,bob,carl).",), ("age(p-1,2). age(p2, 3).",), ("name('John S.',x).",), ("% no(x).",), (":-dynamic(a/1).",),
         ("bird(X) :- penguin(X).",), ("bird(X) :- penguin(Y).",), ("broken(a",), ("",), ("flies(tweety). % yes",)], "value string")
    atoms = {(r["pred"], tuple(r["args"])) for r in rd.parse_atoms(lines).collect()}
    assert atoms == {("parent", ("ann", "bob", "carl")), ("age", ("p-1", "2")), ("age", ("p2", "3")),
                     ("name", ("John S.", "x")), ("flies", ("tweety",))}
    assert [r["value"] for r in rd.rejected_lines(lines).collect()] == ["broken(a"]
    assert [tuple(r) for r in rd.parse_views(lines).collect()] == [("bird", "penguin")]
    tables = rd.relation_tables(rd.parse_atoms(lines), {"age": 2, "flies": 1})
    assert tables["age"].count() == 2 and tables["flies"].columns == ["a0"]


def test_relations_read_the_text_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def watched(line):
        seen.add(1)
        return line

    lines = spark.createDataFrame([("age(p1,2).",), ("flies(p1).",), ("age(p1).",), ("other(x).",)], "value string")
    tables = rd.relation_tables(rd.parse_atoms(lines.select(watched("value").alias("value"))), {"age": 2, "flies": 1})
    before = seen.value
    assert [tuple(r) for r in tables["age"].collect()] == [("p1", "2")]
    assert [tuple(r) for r in tables["flies"].collect()] == [("p1",)]
    assert seen.value == before


def test_rules_with_joins_are_not_attribute_rules(spark):
    lines = spark.createDataFrame([("h(A):-c(A,B),d(B,x).",), ("h(A):-c(A,y),not(ab0(A)).",)], "value string")
    assert {r["pred"] for r in rd.parse_rules(lines).collect()} == {"c", "ab0"}
    assert [r["value"] for r in rd.joined_rules(lines).collect()] == ["h(A):-c(A,B),d(B,x)."]


def test_quoted_constants_go_through_text(spark):
    values = ["A", "MIDDLE EAST", "a,b", "f(x)", "it's", "", "_x", "1-URGENT", "low", "x y", "Ä"]
    rules = tuple(Rule("positive", (Literal("c", v), Literal("d", v, True), Literal("ab0", None, True))) for v in values)
    theory = Theory("positive", rules, (Rule("ab0", (Literal("e", "Q"),)),))
    texts = wr.render_rules(theory.to_df(spark))
    assert {r["value"] for r in texts.collect()} == {r.text() for r in (*theory.rules, *theory.exceptions)}
    got = {(r["rule_text"], r["lit_no"], r["pred"], r["val"], r["negated"]) for r in rd.parse_rules(texts.select("value")).collect()}
    want = {(r.text(), i, x.pred, x.val, x.negated) for r in (*theory.rules, *theory.exceptions) for i, x in enumerate(r.body)}
    assert got == want and rd.joined_rules(texts).count() == 0


def test_every_rule_is_read_or_named(spark):
    lines = spark.createDataFrame(
        [("h(A):-c(A,b),d(A,'B').",), ("h(A):-c(A,B).",), ("h(A,B):-c(A),d(B).",), ("h(A):-c(A), A > 3.",), ("h(a):-c(a).",),
         ("% h(A):-c(A).",), ("c(p1).",)], "value string")
    read = {r["rule_text"] for r in rd.parse_rules(lines).collect()}
    joined = {r["value"] for r in rd.joined_rules(lines).collect()}
    assert joined == {"h(A):-c(A,B).", "h(A,B):-c(A),d(B)."} and "h(A):-c(A,b),d(A,'B')." in read and not read & joined
    assert {r["value"] for r in rd.rejected_rules(lines).collect()} == {"h(A):-c(A), A > 3.", "h(a):-c(a)."}
    args = {tuple(r["args"]) for r in rd.parse_clauses(lines).where("pred = 'd'").collect()}
    assert args == {("A", "'B'"), ("B",)}
