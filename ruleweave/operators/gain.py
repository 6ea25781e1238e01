"""Counting and ranking all candidate literals in one aggregation."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clause_bits, explicit_bits, information_gain
from ..rules import Literal
from ..session import materialize
from .prep import CaseTable, domains, literal_array


@dataclass(frozen=True)
class Bias:
    """What a rule body may contain: attributes with recall, and values per attribute.

    ``values`` may leave attributes out: these allow every value seen in the data.
    ``literal_count`` is the number of different literals the language has.
    """

    recall: Mapping[str, int | None]
    literal_count: int
    values: Mapping[str, frozenset[str]] | None = None

    @property
    def literal_bits(self) -> float:
        return float(math.ceil(math.log2(self.literal_count))) if self.literal_count > 0 else 0.0

    def open_attrs(self, body: Sequence[Literal]) -> list[str]:
        """Attributes that may still be added to ``body``."""
        used: dict[str, int] = {}
        for lit in body:
            used[lit.pred] = used.get(lit.pred, 0) + 1
        return [a for a, times in self.recall.items() if times is None or used.get(a, 0) < times]


def derive_bias(cases: CaseTable, multi_recall: int | None = None) -> Bias:
    """Modes from the case table: one use per attribute; array attributes may be used as
    often as they gain, or ``multi_recall`` times."""
    recall = {a: multi_recall if cases.is_multi(a) else 1 for a in cases.attrs}
    return Bias(recall, literal_count(literals_in(cases)))


def bias_from_tables(modes: DataFrame, constants: DataFrame) -> Bias:
    """What mode declarations allow: their predicates, recalls and constants.

    A predicate whose constants are declared for its type takes only these; with a type
    without constants it takes every value of the data. The declarations are what a person
    writes, so they are read by the driver.
    """
    rows = modes.where("not is_head").collect()
    known: dict[str, set[str]] = {}
    for row in constants.distinct().collect():
        known.setdefault(row["type"], set()).add(row["val"])
    recall: dict[str, int | None] = {}
    values: dict[str, frozenset[str]] = {}
    for row in rows:
        recall[row["pred"]] = max(recall.get(row["pred"]) or 0, row["recall"])
        if row["kind"] == "const" and row["type"] in known:
            values[row["pred"]] = frozenset(known[row["type"]])
    count = language_size(modes, constants).first()["literals"] or 0
    return Bias(recall, int(count), values)


def literals_in(cases: CaseTable) -> DataFrame:
    """Distinct literals of the data: (pred, val)."""
    lits = literal_array(cases.df, cases.attrs, cases.unary)
    return cases.df.select(F.inline(lits)).distinct()


def literal_count(literals: DataFrame) -> int:
    return literals.count()


def language_size(modes: DataFrame, constants: DataFrame) -> DataFrame:
    """Number of different literals and the bits to name one: (literals, bits).

    A predicate has as many literals as the product of its constant domains.
    """
    sizes = constants.distinct().groupBy("type").agg(F.count(F.lit(1)).alias("size"))
    body = modes.where("not is_head")
    args = body.join(sizes, "type", "left").withColumn(
        "options", F.when(F.col("kind") == "const", F.coalesce("size", F.lit(0))).otherwise(1)
    )
    per_pred = args.groupBy("pred").agg(F.round(F.product("options")).cast("bigint").alias("n"))
    return per_pred.agg(F.sum("n").alias("literals")).select(
        "literals", F.ceil(F.log2("literals")).cast("double").alias("bits")
    )


@dataclass(frozen=True)
class Weighted:
    """Cases grouped by equal attribute values: attributes, ``p_w`` and ``n_w``.

    All counting works on these rows, whose number depends on the attribute domains
    rather than on the number of cases.
    """

    df: DataFrame
    attrs: tuple[str, ...]
    unary: frozenset[str]


def weigh(cases: CaseTable, sums: Sequence[Column] = ()) -> Weighted:
    """Group equal cases and write the groups to the shared folder.

    Array attributes are sorted sets, so equal sets are equal keys. The grouping
    combines map-side; a hot combination is one partial row per task.
    """
    keys = [
        F.array_sort(F.array_distinct(a)).alias(a) if cases.is_multi(a)
        else F.col(a).cast("string").alias(a)
        for a in cases.attrs
    ]
    pos = F.coalesce(F.col("is_pos"), F.lit(False)).cast("bigint")
    grouped = cases.df.groupBy(*keys).agg(
        F.sum(pos).alias("p_w"), F.sum(1 - pos).alias("n_w"), *sums
    )
    return Weighted(materialize(grouped), cases.attrs, cases.unary)


def candidate_counts(
    df: DataFrame,
    attrs: Sequence[str],
    p: Column,
    n: Column,
    unary: frozenset[str] = frozenset(),
) -> DataFrame:
    """Positives and negatives per literal in one pass: (pred, val, p_cov, n_cov).

    ``p`` and ``n`` are the weights of a row. Each task sends at most one row per
    literal to the shuffle.
    """
    lits = literal_array(df, attrs, unary)
    exploded = df.select(p.alias("p__"), n.alias("n__"), F.explode(lits).alias("lit"))
    return exploded.groupBy("lit.pred", "lit.val").agg(
        F.sum("p__").alias("p_cov"), F.sum("n__").alias("n_cov")
    )


def case_weights() -> tuple[Column, Column]:
    """Weights of an ungrouped case table: every case counts once."""
    pos = F.col("is_pos").cast("bigint")
    return pos, 1 - pos


def facts_candidate_counts(active: DataFrame, facts: DataFrame) -> DataFrame:
    """Candidate counts from long facts; repeated facts of a case count once."""
    once = facts.select("case_id", "pred", "val").distinct()
    joined = once.join(active.select("case_id", "is_pos"), "case_id")
    return joined.groupBy("pred", "val").agg(
        F.count_if("is_pos").alias("p_cov"), F.count_if(~F.col("is_pos")).alias("n_cov")
    )


def with_gain(counts: DataFrame, p_parent: int | Column, n_parent: int | Column) -> DataFrame:
    """Add the information gain of each candidate over its parent clause."""
    parent_p = F.lit(p_parent) if isinstance(p_parent, int) else p_parent
    parent_n = F.lit(n_parent) if isinstance(n_parent, int) else n_parent
    gain = information_gain(F.col("p_cov"), F.col("n_cov"), parent_p, parent_n)
    return counts.withColumn("gain", gain)


def with_negated(counts: DataFrame, p_parent: int, n_parent: int) -> DataFrame:
    """Candidates and their negations: what does not hold is the clause's rest.

    The counts of ``not l`` are the clause's totals less those of ``l``, so negation needs
    no scan of its own; cases without a value count for it.
    """
    plain = counts.withColumn("negated", F.lit(False))
    rest = counts.withColumns({
        "p_cov": F.lit(p_parent) - F.col("p_cov"), "n_cov": F.lit(n_parent) - F.col("n_cov"), "negated": F.lit(True),
    })
    return plain.unionByName(rest)


def rank_literals(gains: DataFrame) -> DataFrame:
    """Candidates that gain anything, best first; ties go to plain literals, then by
    attribute and value."""
    plain_first = ["negated"] if "negated" in gains.columns else []
    return gains.where("gain > 0").orderBy(
        F.desc("gain"), *plain_first, F.asc("pred"), F.asc_nulls_first("val")
    )


def argmax_literal(gains: DataFrame) -> DataFrame:
    """The best candidate; needs no sort of all candidates."""
    return rank_literals(gains).limit(1)


def bias_filter(counts: DataFrame, bias: Bias) -> DataFrame:
    """Keep candidates whose value the bias allows for its attribute."""
    if not bias.values:
        return counts
    allowed = counts.sparkSession.createDataFrame(
        [(p, v) for p, vs in bias.values.items() for v in sorted(vs)], "pred string, val string"
    )
    listed = F.col("pred").isin(list(bias.values))
    return counts.where(~listed).unionByName(
        counts.where(listed).join(F.broadcast(allowed), ["pred", "val"], "left_semi")
        .select(*counts.columns)
    )


def mdl_accept(total: int, covered: int, literal_bits: float, body_size: int) -> bool:
    """A clause pays when it is shorter than listing the positives it covers."""
    return explicit_bits(total, covered) >= clause_bits(literal_bits, body_size)


def literal_grid(modes: DataFrame, constants: DataFrame, variables: DataFrame) -> DataFrame:
    """All literals the modes allow: (pred, args).

    Arguments are filled left to right by equi joins on their type, with constants for
    ``const`` places and with known variables or a new one (``_``) for ``var`` places.
    Everything here is bounded by the declared modes and constants.
    """
    body = modes.where("not is_head")
    options = (
        constants.select(F.lit("const").alias("kind"), "type", F.col("val").alias("option"))
        .unionByName(
            variables.select(F.lit("var").alias("kind"), "type", F.col("name").alias("option"))
        )
        .unionByName(
            body.where("kind = 'var'").select("kind", "type", F.lit("_").alias("option"))
        )
        .distinct()
    )
    arity = body.agg(F.max("arg_no").alias("last")).first()["last"]
    grid = None
    for arg_no in range(0, (arity or 0) + 1):
        place = body.where(F.col("arg_no") == arg_no).join(options, ["kind", "type"])
        filled = place.select("pred", "option")
        if grid is None:
            grid = filled.select("pred", F.array("option").alias("args"))
            continue
        grid = grid.join(filled, "pred", "left").select(
            "pred",
            F.when(F.col("option").isNull(), F.col("args"))
            .otherwise(F.concat("args", F.array("option")))
            .alias("args"),
        )
    return grid


def connected(grid: DataFrame, rule_vars: Sequence[str]) -> DataFrame:
    """Candidates that share a variable with the clause."""
    known = F.array(*[F.lit(v) for v in rule_vars])
    return grid.where(F.arrays_overlap("args", known))


def attribute_modes(df: DataFrame, attrs: Sequence[str], target: str = "positive") -> DataFrame:
    """Mode rows for a table: the head and (case, value) per attribute."""
    rows = [(target, 0, "var", "case", 1, True)]
    for a in attrs:
        rows += [(a, 0, "var", "case", 1, False), (a, 1, "const", f"args_{a}", 1, False)]
    return df.sparkSession.createDataFrame(
        rows, "pred string, arg_no int, kind string, type string, recall int, is_head boolean"
    )


def attribute_constants(df: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Value domains as constants: (type, val)."""
    return domains(df, attrs).select(F.concat(F.lit("args_"), "pred").alias("type"), "val")
