"""Feature attributions: their tables, summaries and use as item utilities.

An attribution row says how much a literal a case has pushed the model's output:
(case_id, pred, val, phi).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import to_utility
from .ranks import numbered
from .utility import top_per_case


def linear_attributions(df: DataFrame, coefs: Mapping[str, float], id_col: str = "case_id") -> DataFrame:
    """Shapley values of a linear model: phi_j = w_j (x_j - mean_j), columns ``phi_<j>``."""
    means = df.agg(*[F.avg(c).alias(c) for c in coefs]).first()
    phis = [
        (F.lit(float(w)) * (F.col(c) - F.lit(means[c]))).alias(f"phi_{c}") for c, w in coefs.items()
    ]
    return df.select(id_col, *phis)


def melt_attributions(df: DataFrame, features: Sequence[str], id_col: str = "case_id") -> DataFrame:
    """Columns ``phi_<feature>`` to rows (case_id, pred, phi)."""
    wide = df.select(id_col, *[F.col(f"phi_{f}").alias(f) for f in features])
    return wide.unpivot([id_col], list(features), "pred", "phi")


def attributions_to_facts(phi: DataFrame, facts: DataFrame) -> DataFrame:
    """Keep the attributions of values a case actually has.

    ``phi`` is (case_id, pred, val, phi); the join runs on the full fact key, so a case
    with many facts spreads over many tasks.
    """
    return phi.join(facts.select("case_id", "pred", "val").distinct(), ["case_id", "pred", "val"])


def explain_case(attributions: DataFrame, case_id: object) -> DataFrame:
    """Attributions of one case, largest effect first: (pred, val, phi)."""
    one = attributions.where(F.col("case_id") == F.lit(case_id))
    return one.select("pred", "val", "phi").orderBy(F.desc(F.abs("phi")), "pred", "val")


def attribution_summary(df: DataFrame) -> DataFrame:
    """Per feature: mean size of the effect and its direction.

    ``df`` is (feature, x, phi); the direction is the correlation of value and effect,
    null when one of them never varies.
    """
    spread = F.nullif(F.stddev_pop("x") * F.stddev_pop("phi"), F.lit(0.0))
    return df.groupBy("feature").agg(
        F.avg(F.abs("phi")).alias("mean_abs_phi"),
        (F.covar_pop("x", "phi") / spread).alias("direction"),
    )


def signed_attribution(attributions: DataFrame, examples: DataFrame) -> DataFrame:
    """Summed attribution per literal over the given cases: (pred, val, total).

    Positive cases add, negative cases subtract.
    """
    known = attributions.join(examples.select("case_id", "is_pos"), "case_id")
    signed = F.when(F.col("is_pos"), F.col("phi")).otherwise(-F.col("phi"))
    return known.groupBy("pred", "val").agg(F.sum(signed).alias("total"))


def top_literals(totals: DataFrame, n: int = 6) -> DataFrame:
    return totals.orderBy(F.desc("total"), "pred", "val").limit(n)


def item_dictionary(literals: DataFrame) -> DataFrame:
    """Number the literals by (pred, val): (item_id, pred, val)."""
    distinct = literals.select("pred", "val").distinct()
    ordered = numbered(distinct, "pred", "val", name="item_id")
    return ordered.select(F.col("item_id").cast("int").alias("item_id"), "pred", "val")


def attributions_to_items(
    attributions: DataFrame, examples: DataFrame, top: int | None = None, truncate: bool = False
) -> DataFrame:
    """The literals that pushed each case towards its own class, with fixed-point size.

    Positive cases keep positive attributions, negative cases negative ones; of them the ``top``
    largest per case remain, or all: (case_id, is_pos, pred, val, util).
    """
    known = attributions.join(examples.select("case_id", "is_pos"), "case_id")
    towards = (F.col("is_pos") & (F.col("phi") > 0)) | (~F.col("is_pos") & (F.col("phi") < 0))
    sized = known.where(towards).select(
        "case_id", "is_pos", "pred", "val", to_utility("phi", truncate).alias("util")
    )
    return sized if top is None else top_per_case(sized, top, ties=("pred", "val"))


def attributions_to_tx(
    attributions: DataFrame,
    examples: DataFrame,
    items: DataFrame,
    top: int | None = None,
    truncate: bool = False,
) -> DataFrame:
    """Utility transactions with item ids: (tid, is_pos, item, util)."""
    kept = attributions_to_items(attributions, examples, top, truncate)
    return kept.join(items, ["pred", "val"]).select(
        F.col("case_id").alias("tid"), "is_pos", F.col("item_id").alias("item"), "util"
    )
