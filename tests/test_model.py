"""Models and their Shapley attributions against brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from ruleweave.operators import attribution as at
from ruleweave.operators import model as md

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(4)
    rows = []
    for i in range(200):
        a, b, c = r.random(), r.random(), float(r.randint(0, 2))
        rows.append((i, a, b, c, int((a + b * c > 1.0) != (r.random() < 0.1))))
    return rows, spark.createDataFrame(rows, "case_id int, a double, b double, c double, label int").cache()


def brute(value, n):
    phi = []
    for f in range(n):
        total = 0.0
        for k in range(n):
            for s in itertools.combinations([g for g in range(n) if g != f], k):
                weight = math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n)
                total += weight * (value({*s, f}) - value(set(s)))
        phi.append(total)
    return phi


@pytest.mark.parametrize("kind, params", [("gbt", {"maxIter": 3, "maxDepth": 3}), ("rf", {"numTrees": 4, "maxDepth": 3})])
def test_tree_attributions(data, kind, params):
    rows, df = data
    model = md.fit_model(df, FEATURES, kind, **params)
    leaves = md.model_leaves(model)
    probs = {r["case_id"]: r["prob"] for r in md.predict(model, df, FEATURES).collect()}
    for background in (None, df):
        phi, base = md.tree_attributions(model, df.drop("label"), FEATURES, background)
        got = {r["case_id"]: [r[f"phi_{f}"] for f in FEATURES] for r in phi.collect()}
        for row in rows:
            out = md.model_output(leaves, row[1:4])
            assert base + sum(got[row[0]]) == pytest.approx(out)
            assert probs[row[0]] == pytest.approx(1 / (1 + math.exp(-2 * out)) if kind == "gbt" else out)
        for row in rows[:5]:
            x = row[1:4]
            if background is None:
                def value(s):
                    return sum(
                        leaf.value * math.prod(
                            float(lo < x[f] <= hi) if f in s else cover
                            for f, lo, hi, cover in zip(leaf.features, leaf.low, leaf.high, leaf.cover)
                        )
                        for leaf in leaves
                    )
            else:
                def value(s):
                    return sum(
                        md.model_output(leaves, [x[f] if f in s else b[1 + f] for f in range(3)]) for b in rows
                    ) / len(rows)
            assert got[row[0]] == pytest.approx(brute(value, 3), abs=1e-9)


def test_background_counts_do_not_depend_on_partitions(data):
    _, df = data
    leaves = md.model_leaves(md.fit_model(df, FEATURES, "rf", numTrees=2, maxDepth=3))
    one = sorted(md.background_patterns(leaves, df.repartition(1), FEATURES).collect())
    many = sorted(md.background_patterns(leaves, df.repartition(6), FEATURES).collect())
    assert one == many
    for i in range(len(leaves)):
        assert sum(r["cnt"] for r in one if r["leaf"] == i) == df.count()


def random_leaf(r, features):
    low = [r.choice([-math.inf, r.random() / 2]) for _ in features]
    return md.Leaf(
        r.uniform(-2, 2), tuple(features), tuple(low), tuple(r.choice([math.inf, 0.5 + r.random() / 2]) for _ in low),
        tuple(r.choice([0.0, 1.0, r.random()]) for _ in low),
    )


@pytest.mark.parametrize("patterns", [100_000, 7])
def test_attributions_of_deep_leaves(spark, monkeypatch, patterns):
    """Every number of features on a path, repeated and missing values, several passes over a background."""
    monkeypatch.setattr(md, "BACKGROUND_PATTERNS", patterns)
    r = random.Random(5)
    names = [f"f{i}" for i in range(9)]
    leaves = [random_leaf(r, sorted(r.sample(range(9), m))) for m in (0, 1, 2, 5, 6, 9)]
    rows = [tuple(r.choice([None, 0.0, 0.5, r.random()]) for _ in names) for _ in range(4)]
    behind = [tuple(r.choice([0.5, r.random()]) for _ in names) for _ in range(12)]
    rows += rows[:1] + [tuple(0.5 for _ in names)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], ["id", *names])
    background = spark.createDataFrame(behind, names)

    def passes(leaf, x):
        return [x[f] is not None and lo < x[f] <= hi for f, lo, hi in zip(leaf.features, leaf.low, leaf.high)]

    def by_cover(x):
        def value(s):
            return sum(
                leaf.value * math.prod(
                    float(ok) if f in s else cover for f, ok, cover in zip(leaf.features, passes(leaf, x), leaf.cover)
                ) for leaf in leaves
            )
        return value

    def by_rows(x):
        def value(s):
            mixed = [[x[f] if f in s else b[f] for f in range(9)] for b in behind]
            return sum(leaf.value * sum(all(passes(leaf, m)) for m in mixed) for leaf in leaves) / len(behind)
        return value

    for chosen, game in ((None, by_cover), (background, by_rows)):
        phi, base = md.tree_attributions(None, df, names, chosen, leaves)
        assert phi.columns == [*df.columns, *[f"phi_{f}" for f in names]]
        got = sorted(phi.collect())
        assert base == pytest.approx(game(rows[0])(set()))
        for row, x in zip(got, rows, strict=True):
            assert list(row)[10:] == pytest.approx(brute(game(x), 9), abs=1e-12)


def test_attributions_of_long_paths_and_empty_tables(spark):
    """30 features on a path: no table of patterns; values add up to the output."""
    r = random.Random(6)
    names = [f"f{i}" for i in range(30)]
    leaves = [random_leaf(r, range(30)) for _ in range(3)]
    wide = md.Leaf(1.0, tuple(range(30)), (-1.0,) * 30, (2.0,) * 30, (0.5,) * 30)
    df = spark.createDataFrame([tuple(r.random() for _ in names) for _ in range(20)], names)
    for background in (None, df):
        phi, base = md.tree_attributions(None, df, names, background, [*leaves, wide])
        for row in phi.collect():
            assert base + sum(row[30:]) == pytest.approx(md.model_output([*leaves, wide], row[:30]))
    phi, base = md.tree_attributions(None, df, names, df.limit(0), leaves)
    assert base == 0 and all(set(row[30:]) == {0.0} for row in phi.collect())
    assert md.tree_attributions(None, df.limit(0), names, df, leaves)[0].collect() == []


def test_grid_search(data):
    _, df = data
    model, table = md.grid_search(df, FEATURES, "lr", {"regParam": [0.0, 10.0]}, folds=5)
    scores = {r["params"]: r["accuracy"] for r in table.collect()}
    assert scores["regParam=0.0"] > scores["regParam=10.0"]
    assert model.transform(md.assemble(df, FEATURES)).count() == 200


def test_grid_search_derives_its_input_once(spark, data):
    rows, df = data
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def watched(x):
        seen.add(1)
        return x

    slow = df.withColumn("a", watched("a"))
    md.grid_search(slow, FEATURES, "lr", {"regParam": [0.0, 0.1]}, folds=3)
    assert seen.value == len(rows)


def test_linear_attributions_add_up(data):
    rows, df = data
    coefs = {"a": 2.0, "b": -1.0, "c": 0.5}
    phi = at.linear_attributions(df, coefs).join(df, "case_id")
    mean = sum(2 * r[1] - r[2] + r[3] / 2 for r in rows) / len(rows)
    total = F.col("phi_a") + F.col("phi_b") + F.col("phi_c") + mean
    wrong = phi.where(F.abs(total - (2 * F.col("a") - F.col("b") + F.col("c") / 2)) > 1e-9)
    assert wrong.count() == 0


def test_item_dictionary_and_items(spark):
    phi = spark.createDataFrame(
        [(1, "a", "x", 0.5), (1, "b", "y", -0.2), (1, "c", "z", 0.7), (2, "a", "x", 0.3), (2, "b", "y", -0.9)],
        "case_id int, pred string, val string, phi double",
    )
    examples = spark.createDataFrame([(1, True), (2, False)], "case_id int, is_pos boolean")
    items = at.item_dictionary(phi)
    assert sorted(map(tuple, items.collect())) == [(0, "a", "x"), (1, "b", "y"), (2, "c", "z")]
    tx = at.attributions_to_tx(phi, examples, items)
    assert sorted(map(tuple, tx.collect())) == [(1, True, 0, 500), (1, True, 2, 700), (2, False, 1, 900)]
    top = at.attributions_to_tx(phi, examples, items, top=1)
    assert sorted(map(tuple, top.collect())) == [(1, True, 2, 700), (2, False, 1, 900)]
    totals = at.signed_attribution(phi, examples)
    assert {(r["pred"], round(r["total"], 6)) for r in totals.collect()} == {("a", 0.2), ("b", 0.7), ("c", 0.7)}
    assert [r["pred"] for r in at.top_literals(totals, 2).collect()] == ["b", "c"]
    assert [r["pred"] for r in at.explain_case(phi, 1).collect()] == ["c", "a", "b"]


def test_attribution_summary_with_constant_feature(spark):
    df = spark.createDataFrame([("a", 1.0, 0.5), ("a", 2.0, 1.0), ("b", 1.0, 0.2), ("b", 1.0, -0.2)], "feature string, x double, phi double")
    got = {r["feature"]: (round(r["mean_abs_phi"], 6), r["direction"]) for r in at.attribution_summary(df).collect()}
    assert got["a"][0] == 0.75 and got["a"][1] == pytest.approx(1.0) and got["b"] == (0.2, None)


def test_models_share_one_encoded_table(spark, data, monkeypatch):
    from ruleweave.catalog import model_queries as mq

    rows, df = data
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def watched(x):
        seen.add(1)
        return x

    monkeypatch.setattr(mq, "encoded", lambda *_: (df.withColumn("a", watched("a")), FEATURES))
    assert {r["model"] for r in mq.m03(spark, "").collect()} == {"rf", "lr"}
    assert seen.value == len(rows)
