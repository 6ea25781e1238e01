"""Splits, classifiers and Shapley attributions of tree ensembles."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..rules import any_of
from ..session import materialize

#: Rows of a boundary bucket that one task may order.
BOUNDARY_ROWS = 1_000_000
#: Background patterns that travel to the tasks at once; more are taken in several passes.
BACKGROUND_PATTERNS = 100_000
#: Numbers of one array while a task compares patterns of rows with patterns of a background.
PATTERN_CELLS = 1_000_000


# ---------------------------------------------------------------- splitting


def stratified_split(
    df: DataFrame, label: str, fraction: float = 0.8, seed: int = 1, id_col: str = "case_id"
) -> DataFrame:
    """Add ``is_train``: exactly round(fraction x size) cases of every class.

    Cases are ordered by a seeded hash of their id. Counts per hash range find where the
    cut of each class falls; only the cases of that range are ordered. The result is a
    plain comparison per row, the same on every run and for every partitioning.
    """
    key = F.xxhash64(F.col(id_col), F.lit(seed))
    hashed = materialize(
        df.select(F.col(label).alias("cls"), F.col(id_col).alias("id"), key.alias("h"))
    )
    sizes = {r["cls"]: r["n"] for r in hashed.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = {cls: math.floor(n * fraction + 0.5) for cls, n in sizes.items()}
    cuts = _cuts(hashed, {c: need for c, need in wanted.items() if 0 < need < sizes[c]})
    flag: Column = F.lit(False)
    for cls, need in wanted.items():
        in_class = F.col(label).eqNullSafe(F.lit(cls))
        if need == sizes[cls]:
            flag = flag | in_class
        elif cls in cuts:
            last_h, last_id = cuts[cls]
            same_hash = (key == F.lit(last_h)) & (F.col(id_col) <= F.lit(last_id))
            flag = flag | (in_class & ((key < F.lit(last_h)) | same_hash))
    return df.withColumn("is_train", flag)


def _cuts(hashed: DataFrame, need: dict) -> dict:
    """Per class the ``need``-th (h, id) in order, by narrowing hash ranges.

    Every step counts at most 4096 ranges per class, for all classes together.
    """
    if not need:
        return {}
    need = dict(need)
    part = hashed.where(any_of([F.col("cls").eqNullSafe(F.lit(c)) for c in need]))
    for shift in (52, 40, 28, 16):
        bucket = F.shiftright("h", shift)
        counts: dict[object, list[tuple[int, int]]] = {}
        for row in part.groupBy("cls", bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect():
            counts.setdefault(row["cls"], []).append((row["b"], row["n"]))
        held = {}
        for cls, ranges in counts.items():
            for b, n in sorted(ranges):
                if need[cls] <= n:
                    held[cls] = (b, n)
                    break
                need[cls] -= n
        part = part.where(
            any_of([F.col("cls").eqNullSafe(F.lit(c)) & (bucket == b) for c, (b, _) in held.items()])
        )
        if all(n <= BOUNDARY_ROWS for _, n in held.values()):
            break
    nth = F.row_number().over(W.partitionBy("cls").orderBy("h", "id"))
    wanted = any_of([F.col("cls").eqNullSafe(F.lit(c)) & (F.col("nth") == n) for c, n in need.items()])
    return {r["cls"]: (r["h"], r["id"]) for r in part.withColumn("nth", nth).where(wanted).collect()}


# ---------------------------------------------------------------- models


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out).transform(df)


def estimator(kind: str, label: str = "label", seed: int = 1, **params):
    """``gbt`` boosted trees, ``rf`` random forest, ``lr`` logistic regression."""
    common = {"labelCol": label, "featuresCol": "features"}
    if kind == "gbt":
        return GBTClassifier(seed=seed, **common, **params)
    if kind == "rf":
        return RandomForestClassifier(seed=seed, **common, **params)
    if kind == "lr":
        return LogisticRegression(**common, **params)
    raise ValueError(f"unknown model kind {kind!r}")


def fit_model(
    df: DataFrame, features: Sequence[str], kind: str = "gbt", label: str = "label", **params
) -> Model:
    """Fit on rows with numeric feature columns and a 0/1 label."""
    return estimator(kind, label, **params).fit(assemble(df, features))


def grid_search(
    df: DataFrame,
    features: Sequence[str],
    kind: str,
    grid: Mapping[str, Sequence],
    label: str = "label",
    folds: int = 5,
    parallelism: int = 4,
    seed: int = 1,
) -> tuple[Model, DataFrame]:
    """Cross-validated search by accuracy: the best model and (params, accuracy).

    Label and features are written once: folds are drawn from that table, so they are the same
    rows whenever they are read, and every step of every model runs over its few partitions.
    """
    est = estimator(kind, label, seed=seed) if kind != "lr" else estimator(kind, label)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(est.getParam(name), list(values))
    maps = builder.build()
    cv = CrossValidator(
        estimator=est,
        estimatorParamMaps=maps,
        evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy"),
        numFolds=folds,
        parallelism=parallelism,
        seed=seed,
    )
    fitted = cv.fit(assemble(materialize(df.select(label, *features)), features))
    rows = [
        (", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda e: e[0].name)), float(a))
        for m, a in zip(maps, fitted.avgMetrics)
    ]
    return fitted.bestModel, df.sparkSession.createDataFrame(rows, "params string, accuracy double")


def predict(model: Model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add ``pred`` (class) and ``prob`` (probability of class 1)."""
    out = model.transform(assemble(df, features))
    return out.select(
        *df.columns,
        F.col("prediction").cast("int").alias("pred"),
        vector_to_array("probability")[1].alias("prob"),
    )


# ---------------------------------------------------------------- tree attributions


@dataclass(frozen=True)
class Leaf:
    """A leaf with value and the tests on the way to it, merged per feature.

    A row passes feature j when low[j] < x <= high[j]; ``cover[j]`` is the share of
    training rows that pass the tests on j along the path.
    """

    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    cover: tuple[float, ...]


def model_leaves(model: Model) -> list[Leaf]:
    """The leaves of a tree ensemble, with tree weights multiplied in.

    Boosted trees: the sum over leaves is the raw margin. Forests: it is the probability
    of class 1. The number of leaves is a property of the model, not of the data.
    """
    trees = model.trees
    forest = type(model).__name__.startswith("RandomForest")
    weights = [1.0 / len(trees)] * len(trees) if forest else list(model.treeWeights)
    leaves: list[Leaf] = []
    for tree, weight in zip(trees, weights):
        _walk(tree._call_java("rootNode"), weight, {}, leaves)
    return leaves


def _rows_of(node) -> float:
    return float(node.impurityStats().count())


def _walk(node, weight: float, path: dict[int, tuple[float, float, float]], out: list[Leaf]) -> None:
    if node.getClass().getSimpleName() == "LeafNode":
        stats = node.impurityStats()
        if "Variance" in stats.getClass().getSimpleName():
            value = node.prediction()
        else:
            counts = list(stats.stats())
            value = counts[1] / sum(counts) if sum(counts) else 0.0
        feats = tuple(sorted(path))
        out.append(
            Leaf(
                weight * float(value),
                feats,
                tuple(path[f][0] for f in feats),
                tuple(path[f][1] for f in feats),
                tuple(path[f][2] for f in feats),
            )
        )
        return
    split, total = node.split(), _rows_of(node)
    feature, threshold = split.featureIndex(), float(split.threshold())
    low, high, cover = path.get(feature, (-math.inf, math.inf, 1.0))
    for child, bounds in (
        (node.leftChild(), (low, min(high, threshold))),
        (node.rightChild(), (max(low, threshold), high)),
    ):
        share = _rows_of(child) / total if total else 0.0
        _walk(child, weight, {**path, feature: (*bounds, cover * share)}, out)


def _shapley_kernel() -> Callable:
    """Function for the tasks: Shapley values of one leaf of value 1.

    It takes ``own`` (patterns x features, 1 where the row passes), and the reference as
    weighted ``covers`` (each the chances with which absent features pass: shares of the
    training rows, or the zeros and ones of a background row). With product games the sum
    over coalitions is the integral over t in [0, 1] of the product of own t + cover (1 - t)
    over the other features. That is a polynomial below degree m, which Gauss-Legendre
    quadrature with m / 2 nodes integrates exactly: time grows with m squared, not 2^m.
    """
    cells = PATTERN_CELLS

    def shapley(own: np.ndarray, weights: np.ndarray, covers: np.ndarray) -> np.ndarray:
        m = own.shape[1]
        nodes, shares = np.polynomial.legendre.leggauss((m + 1) // 2)
        out = np.zeros(own.shape)
        step = max(1, cells // own.size)
        for at in range(0, len(weights), step):
            absent, weight = covers[None, at : at + step], weights[at : at + step]
            present = own[:, None]
            mean = np.zeros((len(own), len(weight), m))
            for t, share in zip((nodes + 1) / 2, shares / 2):
                factors = present * t + absent * (1 - t)
                before, after = np.ones_like(factors), np.ones_like(factors)
                before[..., 1:] = np.cumprod(factors[..., :-1], axis=2)
                after[..., :-1] = np.cumprod(factors[..., :0:-1], axis=2)[..., ::-1]
                mean += share * before * after
            out += np.einsum("orm,r->om", (present - absent) * mean, weight)
        return out

    return shapley


def _pattern_counter() -> Callable:
    """Function for the tasks: pattern number of each row of a matrix for one leaf.

    It is made here, not looked up by name, so workers need no copy of this package.
    """

    def patterns(leaf: tuple, x: np.ndarray) -> np.ndarray:
        own = np.zeros(len(x), dtype=np.int64)
        for j, (f, low, high) in enumerate(zip(*leaf)):
            own |= ((x[:, f] > low) & (x[:, f] <= high)).astype(np.int64) << j
        return own

    return patterns


def _tests(leaves: Sequence[Leaf]) -> list[tuple]:
    """What the tasks need of each leaf: features and bounds."""
    return [(leaf.features, leaf.low, leaf.high) for leaf in leaves]


def background_patterns(leaves: Sequence[Leaf], background: DataFrame, features: Sequence[str]) -> DataFrame:
    """Background rows per leaf and pattern of passed features: ``leaf``, ``pattern``, ``cnt``.

    All background rows are used: each task counts its own rows and sends at most one
    number per leaf and pattern.
    """
    tests = _tests(leaves)
    names = list(features)
    patterns = _pattern_counter()

    def count(batches: Iterator) -> Iterator:
        totals: dict[tuple[int, int], int] = {}
        for batch in batches:
            x = batch[names].to_numpy(dtype="float64")
            for i, leaf in enumerate(tests):
                values, counts = np.unique(patterns(leaf, x), return_counts=True)
                for v, c in zip(values, counts):
                    totals[i, int(v)] = totals.get((i, int(v)), 0) + int(c)
        rows = [(i, v, c) for (i, v), c in totals.items()]
        yield pd.DataFrame(rows, columns=["leaf", "pattern", "cnt"])

    return (
        background.select(*[F.col(f).cast("double").alias(f) for f in names])
        .mapInPandas(count, "leaf int, pattern bigint, cnt bigint")
        .groupBy("leaf", "pattern")
        .agg(F.sum("cnt").alias("cnt"))
    )


Reference = dict[int, tuple[np.ndarray, np.ndarray]]


def _background_references(counted: DataFrame, leaves: Sequence[Leaf], rows: int) -> Iterator[Reference]:
    """Weights and passes per leaf, at most about ``BACKGROUND_PATTERNS`` patterns at a time."""
    parts = -(-counted.count() // BACKGROUND_PATTERNS)
    part = F.pmod(F.xxhash64("leaf", "pattern"), F.lit(max(parts, 1)))
    for i in range(parts):
        found: dict[int, list[tuple[int, int]]] = {}
        for r in counted.where(part == i).collect():
            found.setdefault(r["leaf"], []).append((r["pattern"], r["cnt"]))
        yield {
            leaf: (
                np.array([cnt for _, cnt in met]) / rows,
                np.array([p for p, _ in met])[:, None] >> np.arange(len(leaves[leaf].features)) & 1,
            )
            for leaf, met in found.items()
        }


def tree_attributions(
    model: Model | None,
    df: DataFrame,
    features: Sequence[str],
    background: DataFrame | None = None,
    leaves: Sequence[Leaf] | None = None,
) -> tuple[DataFrame, float]:
    """Add ``phi_<feature>`` columns: Shapley values of the model output per row.

    Without ``background`` absent features follow the training covers of the trees; with
    it they take the values of the background rows, all of them. Returns the frame and
    the base value: base + sum of phi = model output. Only the model and tables derived
    from it travel to the tasks; rows are independent.

    Values add up over background patterns, so a background with more of them than
    ``BACKGROUND_PATTERNS`` is taken in several passes over the rows, each with a part of
    the patterns. A missing value passes no test; an empty background gives zeros.
    """
    leaf_list = list(model_leaves(model) if leaves is None else leaves)
    references: Iterator[Reference]
    if background is None:
        base = sum(leaf.value * math.prod(leaf.cover) for leaf in leaf_list)
        references = iter([{i: (np.ones(1), np.array([leaf.cover])) for i, leaf in enumerate(leaf_list)}])
    else:
        counted = materialize(background_patterns(leaf_list, background, features))
        rows = counted.where(F.col("leaf") == 0).agg(F.sum("cnt")).first()[0] or 0
        full = [(i, (1 << len(leaf.features)) - 1) for i, leaf in enumerate(leaf_list)]
        reached = counted.join(
            df.sparkSession.createDataFrame(full, "leaf int, pattern bigint"), ["leaf", "pattern"], "left_semi"
        )
        base = sum(leaf_list[r["leaf"]].value * r["cnt"] / rows for r in reached.collect())
        references = _background_references(counted, leaf_list, rows)
    out, added = df.withColumn("phi__", F.array_repeat(F.lit(0.0), len(features))), 0
    for reference in references:
        if added:
            out = materialize(out)
        phi = _attributed(out, features, leaf_list, reference)
        out, added = out.withColumn("phi__", F.zip_with("phi__", phi, lambda a, b: a + b)), added + 1
    phi_cols = [F.col("phi__")[i].alias(f"phi_{f}") for i, f in enumerate(features)]
    return out.select(*df.columns, *phi_cols), base


def _attributed(df: DataFrame, features: Sequence[str], leaves: Sequence[Leaf], reference: Reference) -> Column:
    """Shapley values of each row against one reference, an array in order of features."""
    games = [
        (test, leaf.value, *reference[i])
        for i, (test, leaf) in enumerate(zip(_tests(leaves), leaves))
        if leaf.features and i in reference
    ]
    shared = df.sparkSession.sparkContext.broadcast(games)
    width = len(features)
    patterns, shapley = _pattern_counter(), _shapley_kernel()

    @F.pandas_udf("array<double>")
    def attribute(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype="float64") for c in columns])
        out = np.zeros((len(x), width))
        for test, value, weights, covers in shared.value:
            met, at = np.unique(patterns(test, x), return_inverse=True)
            own = (met[:, None] >> np.arange(len(test[0])) & 1).astype(np.float64)
            out[:, test[0]] += value * shapley(own, weights, covers)[at]
        return pd.Series(list(out))

    return attribute(*[F.col(f).cast("double") for f in features])


def model_output(leaves: Sequence[Leaf], row: Sequence[float]) -> float:
    """The ensemble's output for one row, read off its leaves."""
    return sum(
        leaf.value
        for leaf in leaves
        if all(lo < row[f] <= hi for f, lo, hi in zip(leaf.features, leaf.low, leaf.high))
    )
