"""Splits, models and attributions on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribution as at
from ..operators import evaluate as ev
from ..operators import model as md
from ..operators.prep import one_hot
from ..session import materialize
from .datasets import orders_cases, table
from .registry import query

# Added before rounding, so that exact halves round the same way everywhere.
NUDGE = 1e-8
EVENT_COEFS = {"click": 0.5, "error": -1.25, "purchase": 2.0, "signup": 0.75, "view": -0.1}


def user_features(spark, sf):
    """Per user: how much of each event type, in hundreds."""
    events = table(spark, sf, "events")
    return events.groupBy(F.col("user_id").alias("case_id")).agg(
        *[
            (F.round(F.sum(F.when(F.col("event_type") == t, F.round(F.col("value") * 100).cast("bigint")).otherwise(0))) / 10000).alias(t)
            for t in EVENT_COEFS
        ]
    )


USERS = "u AS (SELECT user_id AS case_id, " + ", ".join(
    f"sum(CASE WHEN event_type = '{t}' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) / 10000.0::DOUBLE AS {t}"
    for t in EVENT_COEFS
) + " FROM events GROUP BY 1)"
PHI_SQL = "phi AS (SELECT case_id, " + ", ".join(
    f"{w} * ({t} - (SELECT avg({t}) FROM u)) AS phi_{t}, {t}" for t, w in EVENT_COEFS.items()
) + " FROM u)"


@query("m07_linear_attributions", f"WITH {USERS}, {PHI_SQL} SELECT case_id, "
       + ", ".join(f"round(phi_{t} + {NUDGE}, 5) AS phi_{t}" for t in EVENT_COEFS) + " FROM phi")
def m07(spark, sf):
    phi = at.linear_attributions(user_features(spark, sf), EVENT_COEFS)
    return phi.select("case_id", *[F.round(F.col(f"phi_{t}") + NUDGE, 5).alias(f"phi_{t}") for t in EVENT_COEFS])


LONG = " UNION ALL ".join(
    f"SELECT case_id, '{t}' AS pred, {t} AS x, phi_{t} AS phi FROM phi" for t in EVENT_COEFS
)


@query("m08_explain_case", f"""WITH {USERS}, {PHI_SQL}, long AS ({LONG}) SELECT pred, round(x, 4) AS val, round(phi + {NUDGE}, 5) AS phi FROM long
  WHERE case_id = (SELECT min(user_id) FROM events)""")
def m08(spark, sf):
    users = user_features(spark, sf)
    phi = at.linear_attributions(users, EVENT_COEFS).join(users, "case_id")
    long = phi.select("case_id", F.inline(F.array(*[
        F.struct(F.lit(t).alias("pred"), F.round(t, 4).alias("val"), F.col(f"phi_{t}").alias("phi")) for t in EVENT_COEFS
    ])))
    first = table(spark, sf, "events").agg(F.min("user_id")).first()[0]
    return at.explain_case(long, first).withColumn("phi", F.round(F.col("phi") + NUDGE, 5))


@query("a18_attribution_summary", f"""WITH {USERS}, {PHI_SQL}, long AS ({LONG})
  SELECT pred AS feature, round(avg(abs(phi)) + {NUDGE}, 5) AS mean_abs_phi, round(corr(x, phi), 5) AS direction FROM long GROUP BY 1""")
def a18(spark, sf):
    users = user_features(spark, sf)
    phi = at.linear_attributions(users, EVENT_COEFS).join(users, "case_id")
    long = phi.select(F.inline(F.array(*[
        F.struct(F.lit(t).alias("feature"), F.col(t).alias("x"), F.col(f"phi_{t}").alias("phi")) for t in EVENT_COEFS
    ])))
    summary = at.attribution_summary(long)
    return summary.select("feature", F.round(F.col("mean_abs_phi") + NUDGE, 5).alias("mean_abs_phi"), F.round("direction", 5).alias("direction"))


@query("m01_split_sizes", """SELECT o_orderstatus AS status, count(*) AS cases, CAST(floor(count(*) * 0.8 + 0.5) AS BIGINT) AS train
  FROM orders GROUP BY 1""")
def m01(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("status"))
    split = md.stratified_split(orders, "status", 0.8, seed=1)
    return split.groupBy("status").agg(F.count(F.lit(1)).alias("cases"), F.count_if("is_train").alias("train"))


def encoded(spark, sf):
    """Orders with one-hot attributes and a 0/1 label that follows the data."""
    cases = orders_cases(spark, sf)
    flags = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(
        F.avg("l_discount").alias("discount"), F.sum("l_quantity").alias("quantity")
    )
    df = cases.df.join(flags, "case_id", "left").fillna(0.0, ["discount", "quantity"])
    # The order status is noise; whether an order is large follows its lines and region.
    large = (F.col("quantity") > 110) | ((F.col("region") == "ASIA") & (F.col("quantity") > 60))
    df = df.withColumn("label", large.cast("int")).drop("is_pos")
    hot = one_hot(df, ["priority", "price_q", "segment", "region"], drop_first=True)
    names = {c: c.replace(" ", "_").replace("-", "_") for c in hot.columns}
    hot = hot.withColumnsRenamed(names)
    return hot, [c for c in hot.columns if c not in ("case_id", "label")]


def split_cases(spark, sf):
    """The encoded orders, written once for all that is fitted to and asked of them, and split."""
    df, features = encoded(spark, sf)
    return md.stratified_split(materialize(df), "label", 0.8, seed=1), features


def fit(split, features, kind, **params):
    train = split.where("is_train").drop("is_train")
    return md.fit_model(train, features, kind, **params), split, features


def split_fit(spark, sf, kind, **params):
    return fit(*split_cases(spark, sf), kind, **params)


def quality(model, split, features):
    scored = md.predict(model, split.where(~F.col("is_train")).drop("is_train"), features)
    flags = scored.select((F.col("pred") == 1).alias("pred"), (F.col("label") == 1).alias("is_pos"))
    return ev.evaluate(flags)


@query("m02_boosted_trees")
def m02(spark, sf):
    """Held-out quality of boosted trees."""
    return quality(*split_fit(spark, sf, "gbt", maxIter=5, maxDepth=3))


@query("m03_forest_and_logistic")
def m03(spark, sf):
    """Held-out quality of a random forest and of a logistic regression."""
    split, features = split_cases(spark, sf)
    forest = quality(*fit(split, features, "rf", numTrees=10, maxDepth=4)).withColumn("model", F.lit("rf"))
    logistic = quality(*fit(split, features, "lr", maxIter=20)).withColumn("model", F.lit("lr"))
    return forest.unionByName(logistic)


@query("m04_grid_search")
def m04(spark, sf):
    """Cross-validated accuracy per parameter setting."""
    df, features = encoded(spark, sf)
    _, table_ = md.grid_search(df, features, "lr", {"regParam": [0.0, 0.1], "elasticNetParam": [0.0, 1.0]}, folds=5)
    return table_


@query("m05_predictions")
def m05(spark, sf):
    """Class and probability for every order."""
    model, split, features = split_fit(spark, sf, "lr", maxIter=20)
    return md.predict(model, split.drop("is_train"), features).select("case_id", "pred", "prob")


@query("m06_tree_attributions")
def m06(spark, sf):
    """Shapley values of boosted trees for every order, training orders as background."""
    model, split, features = split_fit(spark, sf, "gbt", maxIter=5, maxDepth=3)
    train = split.where("is_train")
    phi, _ = md.tree_attributions(model, split.drop("is_train"), features, background=train)
    return phi.select("case_id", *[f"phi_{f}" for f in features])


@query("m06_tree_attribution_summary")
def m06b(spark, sf):
    """Mean effect per feature of a random forest, absent features by training cover."""
    model, split, features = split_fit(spark, sf, "rf", numTrees=10, maxDepth=4)
    phi, _ = md.tree_attributions(model, split.drop("is_train"), features)
    long = phi.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x"), F.col(f"phi_{f}").alias("phi"))
        for f in features
    ])))
    return at.attribution_summary(long)


@query("m06_attributions_add_up", "SELECT count(*) AS cases, count(*) AS additive FROM orders")
def m06c(spark, sf):
    """Base value plus attributions equal the model's margin, for every order."""
    from pyspark.ml.functions import vector_to_array

    model, split, features = split_fit(spark, sf, "gbt", maxIter=5, maxDepth=3)
    phi, base = md.tree_attributions(model, split.drop("is_train"), features)
    margins = model.transform(md.assemble(phi, features)).select(
        vector_to_array("rawPrediction")[1].alias("margin"), *[f"phi_{f}" for f in features]
    )
    # The raw prediction of boosted trees holds the negated and the plain margin.
    total = sum((F.col(f"phi_{f}") for f in features), F.lit(base))
    return margins.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(F.abs(total - F.col("margin")) < 1e-6).alias("additive"),
    )


# Two leaves over twelve numbers of a line: feature, lower bound (excluded), upper bound, cover.
LINE_FEATURES = {
    "quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax",
    "line": "l_linenumber", "part": "l_partkey % 11", "supplier": "l_suppkey % 7", "ord": "l_orderkey % 13",
    "month": "month(l_shipdate)", "day": "day(l_shipdate)", "year": "year(l_shipdate)", "cents": "l_partkey % 5",
}
DEEP_LEAVES = {
    2.5: (
        ("quantity", 5, 40, 0.7), ("price", 9000, 1e9, 0.83), ("discount", 0.015, 1, 0.77), ("tax", -1, 0.065, 0.81),
        ("line", 1.5, 9, 0.72), ("part", -1, 8.5, 0.79), ("supplier", 0.5, 9, 0.86), ("ord", 1.5, 20, 0.84),
        ("month", 1.5, 11.5, 0.82), ("day", 3.5, 99, 0.9), ("year", 1992.5, 2999, 0.85), ("cents", 0.5, 9, 0.8),
    ),
    -1.25: (("quantity", 25, 99, 0.5), ("month", 0, 6.5, 0.49), ("cents", -1, 2.5, 0.61)),
}


def deep_leaves_sql():
    """Every coalition of a leaf: its size and the covers of who is absent; the row plays it as far as it passes."""
    parts = []
    for n, (value, tests) in enumerate(DEEP_LEAVES.items()):
        m = len(tests)
        passed = " + ".join(f"(CASE WHEN {f} > {lo} AND {f} <= {hi} THEN {1 << j} ELSE 0 END)" for j, (f, lo, hi, _) in enumerate(tests))
        absent = " * ".join(f"(CASE WHEN (s >> {j}) & 1 = 1 THEN 1 ELSE {c} END)::DOUBLE" for j, (*_, c) in enumerate(tests))
        phis = ", ".join(
            f"sum(reach * CASE WHEN (s >> {j}) & 1 = 1 THEN factorial(greatest(bits - 1, 0)) * factorial({m} - bits) "
            f"ELSE -factorial(bits) * factorial(greatest({m} - bits - 1, 0)) END::DOUBLE / factorial({m})::DOUBLE) AS {tests[j][0]}"
            for j in range(m)
        )
        parts.append(
            f"p{n} AS (SELECT *, {passed} AS own{n} FROM {'x' if n == 0 else f'p{n - 1}'}), "
            f"s{n} AS (SELECT s, bit_count(s) AS bits, {value} * {absent} AS reach FROM range({1 << m}) t(s)), "
            f"v{n} AS (SELECT own{n}, {phis} FROM (SELECT DISTINCT own{n} FROM p{n}) JOIN s{n} ON (s & own{n}) = s GROUP BY own{n})"
        )
    last = len(DEEP_LEAVES) - 1
    columns = []
    for f in LINE_FEATURES:
        terms = [f"v{n}.{f}" for n, tests in enumerate(DEEP_LEAVES.values()) if f in {t[0] for t in tests}]
        columns.append(f"CAST(round(1e9 * ({' + '.join(terms)})) AS BIGINT) AS phi_{f}")
    joins = " ".join(f"JOIN v{n} ON v{n}.own{n} = p{last}.own{n}" for n in range(last + 1))
    numbers = ", ".join(f"CAST({e} AS DOUBLE) AS {f}" for f, e in LINE_FEATURES.items())
    return (
        f"WITH x AS (SELECT l_orderkey, l_linenumber, {numbers} FROM lineitem), {', '.join(parts)} "
        f"SELECT l_orderkey, l_linenumber, {', '.join(columns)} FROM p{last} {joins}"
    )


@query("m06_deep_leaves", deep_leaves_sql())
def m06d(spark, sf):
    """Shapley values, in billionths, of two leaves, one testing twelve features, for every line."""
    names = list(LINE_FEATURES)
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", *[F.expr(e).cast("double").alias(f) for f, e in LINE_FEATURES.items()]
    )
    leaves = []
    for value, tests in DEEP_LEAVES.items():
        tests = sorted(tests, key=lambda t: names.index(t[0]))
        leaves.append(md.Leaf(value, tuple(names.index(t[0]) for t in tests), *(tuple(map(float, c)) for c in list(zip(*tests))[1:])))
    phi, _ = md.tree_attributions(None, lines, names, leaves=leaves)
    return phi.select(
        "l_orderkey", "l_linenumber", *[F.round(F.col(f"phi_{f}") * 1e9).cast("bigint").alias(f"phi_{f}") for f in names]
    )
