"""Quality of predictions: confusion counts, per-class reports and ROC points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ranks import running_sums


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 when there is nothing to divide by."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def metric_columns(tp: Column, tn: Column, fp: Column, fn: Column) -> list[Column]:
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        ratio(2 * precision * recall, precision + recall).alias("f1"),
    ]


def confusion_aggregates(pred: str = "pred", label: str = "is_pos") -> list[Column]:
    # A missing prediction or label does not hold.
    p, y = (F.coalesce(F.col(c), F.lit(False)) for c in (pred, label))
    return [
        F.count_if(p & y).alias("tp"),
        F.count_if(~p & ~y).alias("tn"),
        F.count_if(p & ~y).alias("fp"),
        F.count_if(~p & y).alias("fn"),
    ]


def evaluate(df: DataFrame, pred: str = "pred", label: str = "is_pos") -> DataFrame:
    """One row: tp, tn, fp, fn, accuracy, precision, recall, f1."""
    counts = df.agg(*confusion_aggregates(pred, label))
    cols = [F.col(c) for c in ("tp", "tn", "fp", "fn")]
    return counts.select(*cols, *metric_columns(*cols))


def confusion_matrix(df: DataFrame, label: str, pred: str) -> DataFrame:
    """(label, pred, cnt) for the combinations that occur."""
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("cnt")
    )


def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Per class: precision, recall, f1 and support.

    The cases are counted once per (label, prediction); classes are few after that.
    """
    matrix = confusion_matrix(df, label, pred)
    per_class = matrix.select(
        F.inline(
            F.array(
                F.struct(F.col("label").alias("cls"), F.col("cnt").alias("support"),
                         F.lit(0).cast("bigint").alias("predicted"),
                         F.when(F.col("label") == F.col("pred"), F.col("cnt"))
                         .otherwise(F.lit(0).cast("bigint")).alias("hit")),
                F.struct(F.col("pred").alias("cls"), F.lit(0).cast("bigint").alias("support"),
                         F.col("cnt").alias("predicted"), F.lit(0).cast("bigint").alias("hit")),
            )
        )
    ).groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hit")])
    precision = ratio(F.col("hit"), F.col("predicted"))
    recall = ratio(F.col("hit"), F.col("support"))
    return per_class.where("cls is not null").select(
        "cls",
        precision.alias("precision"),
        recall.alias("recall"),
        ratio(2 * precision * recall, precision + recall).alias("f1"),
        "support",
    )


def roc_points(df: DataFrame, score: str, label: str = "is_pos", digits: int | None = None) -> DataFrame:
    """(threshold, tp, fp, tpr, fpr) per distinct score, highest first.

    Cases are counted per distinct score before anything is ordered, and the running
    counts are summed in buckets of the score. ``digits`` rounds scores beforehand.
    """
    value = F.round(score, digits) if digits is not None else F.col(score)
    counts = df.where(F.col(score).isNotNull()).groupBy(value.alias("threshold")).agg(
        F.count_if(label).alias("pos"), F.count_if(~F.coalesce(F.col(label), F.lit(False))).alias("neg")
    )
    counts = materialize(counts)  # read for the totals and for the ranges
    totals = counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    cum = running_sums(counts, "threshold", ["pos", "neg"])
    n_pos, n_neg = F.lit(totals["p"] or 0), F.lit(totals["n"] or 0)
    return cum.select(
        "threshold",
        F.col("cum_pos").alias("tp"),
        F.col("cum_neg").alias("fp"),
        ratio(F.col("cum_pos"), n_pos).alias("tpr"),
        ratio(F.col("cum_neg"), n_neg).alias("fpr"),
    )


def auc(df: DataFrame, score: str, label: str = "is_pos") -> DataFrame:
    """Area under the ROC curve: (auc), ties counted half."""
    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(
        F.count_if(label).alias("pos"), F.count_if(~F.coalesce(F.col(label), F.lit(False))).alias("neg")
    )
    cum = running_sums(counts, "s", ["pos", "neg"], descending=False)
    # Positives beat all negatives below them and draw with those at the same score.
    wins = F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2)
    return cum.agg(
        ratio(F.sum(wins), F.sum("pos").cast("double") * F.sum("neg")).alias("auc")
    )
