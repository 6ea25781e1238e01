"""Simplify learned rules on grouped cases (columns ``p_w`` and ``n_w``)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rules import Rule, Theory, rule_condition

#: Conditions counted by one scan; longer lists are counted in several scans.
SCAN_WIDTH = 200


def coverage_of(df: DataFrame, rules: list[Rule], theory: Theory) -> list[tuple[int, int]]:
    """Weights covered by each rule, many rules per scan."""
    out: list[tuple[int, int]] = []
    for start in range(0, len(rules), SCAN_WIDTH):
        part = rules[start : start + SCAN_WIDTH]
        aggs = []
        for i, rule in enumerate(part):
            for name, weight in (("p", "p_w"), ("n", "n_w")):
                hit = rule_condition(rule, df, theory, weight)
                aggs.append(F.sum(F.when(hit, F.col(weight))).alias(f"{name}{i}"))
        row = df.agg(*aggs).first()
        out += [(int(row[f"p{i}"] or 0), int(row[f"n{i}"] or 0)) for i in range(len(part))]
    return out


def prune_literals(df: DataFrame, theory: Theory) -> Theory:
    """Per rule, take the first shorter body that covers no fewer positives and no more
    negatives. All rules and their alternatives are counted together.
    """
    variants: list[Rule] = []
    spans: list[tuple[int, int]] = []
    for rule in theory.rules:
        start = len(variants)
        variants.append(rule)
        # Listed cases are those of the whole body, so such a body stays as it is.
        lists = any(lit.pred in theory.listed_side for lit in rule.body)
        if len(rule.body) > 1 and not lists:
            variants += [rule.without(i) for i in range(len(rule.body))]
        spans.append((start, len(variants)))
    counts = coverage_of(df, variants, theory)
    kept = []
    for start, end in spans:
        p, n = counts[start]
        better = [i for i in range(start + 1, end) if counts[i][0] >= p and counts[i][1] <= n]
        kept.append(variants[better[0] if better else start])
    return replace(theory, rules=tuple(kept))


def prune_rules(df: DataFrame, theory: Theory, max_loss: float = 0.03) -> Theory:
    """Delete rules, smallest first, while the positives lost stay within ``max_loss``.

    Positives are grouped once by the set of rules that cover them; each deletion is
    then decided on these groups.
    """
    rules = list(theory.rules)
    if not rules:
        return theory
    fired = F.array_compact(
        F.array(
            *[F.when(rule_condition(r, df, theory, "p_w"), F.lit(i)) for i, r in enumerate(rules)]
        )
    )
    groups = (
        df.where("p_w > 0")
        .groupBy(fired.alias("fired"))
        .agg(F.sum("p_w").alias("p_w"))
        .where(F.size("fired") > 0)
        .persist()
    )
    try:
        own = groups.agg(
            F.sum("p_w").alias("all"),
            *[
                F.sum(F.when(F.array_contains("fired", i), F.col("p_w"))).alias(f"r{i}")
                for i in range(len(rules))
            ],
        ).first()
        original = int(own["all"] or 0)
        if original == 0:
            return theory
        order = sorted(range(len(rules)), key=lambda i: (int(own[f"r{i}"] or 0), i))
        kept = set(range(len(rules)))
        for i in order:
            trial = sorted(kept - {i})
            left = 0
            if trial:
                still = F.arrays_overlap("fired", F.array(*[F.lit(t) for t in trial]))
                left = groups.where(still).agg(F.sum("p_w")).first()[0] or 0
            if (original - left) / original <= max_loss:
                kept.discard(i)
        return replace(theory, rules=tuple(rules[i] for i in sorted(kept)))
    finally:
        groups.unpersist()


def prune(df: DataFrame, theory: Theory, max_loss: float = 0.03) -> Theory:
    """Literals first, then rules, then exceptions nothing refers to any more."""
    if not theory.rules:
        return theory.reachable()
    return prune_rules(df, prune_literals(df, theory), max_loss).reachable()
