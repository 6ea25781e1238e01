"""Greedy learning in which attributions choose the candidate literals.

The cases carry ``phi_<attr>``: how much the attribute's value pushed the model towards
the positive class. Summed over the positives in play, the largest totals name the
literals a clause may take next; roles swap their sign inside exceptions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.attribution import top_literals
from ..operators.gain import Bias, Weighted, weigh
from ..operators.prep import CaseTable
from ..rules import Literal, Theory
from .learn import GreedySearch, LearnSettings, Side, grouped_bias
from .prune import prune

#: Attributions are summed as integers of this many parts per unit, so that totals do not
#: depend on the order of addition.
PARTS = 1_000_000


def weigh_guided(cases: CaseTable) -> Weighted:
    """Group equal cases, with attributions summed for positives and for negatives."""
    sums: list[Column] = []
    for attr in cases.attrs:
        parts = F.round(F.coalesce(F.col(f"phi_{attr}"), F.lit(0.0)) * PARTS).cast("bigint")
        sums.append(F.sum(F.when(F.col("is_pos"), parts)).alias(f"phi_p_w_{attr}"))
        sums.append(F.sum(F.when(~F.col("is_pos"), -parts)).alias(f"phi_n_w_{attr}"))
    return weigh(cases, sums)


class GuidedSearch(GreedySearch):
    def __init__(self, base: Weighted, bias: Bias, settings: LearnSettings, top: int):
        super().__init__(base, bias, settings)
        self.top = top

    def attribution_totals(self, pos: Side) -> DataFrame:
        """Signed totals per literal over the positives in play: (pred, val, total)."""
        entries = F.array(
            *[
                F.struct(
                    F.lit(a).alias("pred"),
                    F.col(a).alias("val"),
                    F.col(f"phi_{pos.weight}_{a}").alias("phi"),
                )
                for a in self.base.attrs
            ]
        )
        rows = self.df.where(pos.count > 0).select(F.inline(entries)).where("val is not null")
        return rows.groupBy("pred", "val").agg(F.sum("phi").alias("total"))

    def gains(
        self, body: list[Literal], pos: Side, neg: Side, n_pos: int, n_neg: int
    ) -> DataFrame:
        allowed = top_literals(self.attribution_totals(pos), self.top)
        every = super().gains(body, pos, neg, n_pos, n_neg)
        return every.join(F.broadcast(allowed), ["pred", "val"], "left_semi")


def learn_guided_rules(
    cases: CaseTable,
    top: int = 6,
    bias: Bias | None = None,
    settings: LearnSettings | None = None,
    post_prune: bool = True,
) -> Theory:
    """Learn rules whose literals are among the ``top`` by summed attribution."""
    settings = settings or LearnSettings(min_accuracy=0.8, stop_accuracy=0.8)
    base = weigh_guided(cases)
    search = GuidedSearch(base, bias or grouped_bias(base), settings, top)
    try:
        theory = search.run()
        return prune(search.df, theory) if post_prune else theory
    finally:
        search.close()
