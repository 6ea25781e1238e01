"""From raw case tables to facts: cleaning, discretizing, encoding and melting."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import norm_value
from .ranks import exact_quantiles

QUARTILES = (0.0, 0.25, 0.5, 0.75, 1.0)


@dataclass(frozen=True)
class CaseTable:
    """One row per case: ``case_id``, ``is_pos`` and the attribute columns.

    Attributes with several values per case are array columns; ``unary`` names
    properties without a value, whose column is null when the property is absent.
    """

    df: DataFrame
    attrs: tuple[str, ...]
    unary: frozenset[str] = field(default_factory=frozenset)

    def is_multi(self, attr: str) -> bool:
        return isinstance(self.df.schema[attr].dataType, T.ArrayType)


def encode_label(df: DataFrame, col: str, classes: Sequence[str]) -> DataFrame:
    """First class name -> 0, second -> 1, anything else -> 2."""
    code = F.when(F.col(col) == classes[0], 0).when(F.col(col) == classes[1], 1).otherwise(2)
    return df.withColumn(col, code)


def encode_alphabetical(df: DataFrame, col: str) -> DataFrame:
    """Codes 0, 1, 2 ... by sorted class name."""
    from pyspark.ml.feature import StringIndexer

    indexer = StringIndexer(inputCol=col, outputCol=f"{col}__", stringOrderType="alphabetAsc")
    coded = indexer.fit(df).transform(df)
    return coded.withColumn(col, F.col(f"{col}__").cast("int")).drop(f"{col}__")


def binary_target(df: DataFrame, col: str, target: object) -> DataFrame:
    """``is_pos``: the case has the target label; a missing label is not positive."""
    return df.withColumn("is_pos", F.coalesce(F.col(col) == F.lit(target), F.lit(False)))


def drop_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def remap(df: DataFrame, mapping: Mapping[str, Mapping[str, object]]) -> DataFrame:
    """Replace values per column; values without an entry stay as they are."""
    exprs = {}
    for col, pairs in mapping.items():
        numeric = all(isinstance(v, int) for v in pairs.values())
        expr: Column | None = None
        for old, new in pairs.items():
            hit = F.col(col) == F.lit(old)
            value = F.lit(new) if numeric else F.lit(str(new))
            expr = F.when(hit, value) if expr is None else expr.when(hit, value)
        keep = F.col(col).try_cast("int") if numeric else F.col(col)
        exprs[col] = expr.otherwise(keep) if expr is not None else F.col(col)
    return df.withColumns(exprs)


def impute_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill numeric nulls and NaN with the mean of the other values."""
    means = df.agg(*[F.avg(known(c)).alias(c) for c in cols]).first()
    fills = {c: means[c] for c in cols if means[c] is not None}
    return df.withColumns({c: F.coalesce(known(c), F.lit(m)) for c, m in fills.items()})


def known(col: str) -> Column:
    """A numeric column as double; NaN is a missing value."""
    value = F.col(col).cast("double")
    return F.when(~F.isnan(value), value)


def impute_const(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.na.fill(dict(values))


def bin_code(x: Column, edges: Sequence[float]) -> Column:
    """0-based code of the right-closed bin of ``x``; the lowest edge is included."""
    inner = sorted(set(edges))
    below = [F.when(x > F.lit(float(e)), 1).otherwise(0) for e in inner[:-1]]
    count = sum(below[1:], below[0]) if below else F.lit(0)
    return F.when(x.isNotNull(), F.greatest(count - 1, F.lit(0)))


def qcut(df: DataFrame, cols: Sequence[str], q: int = 4) -> DataFrame:
    """Replace numeric columns by their exact quantile bin.

    Edges are interpolated linearly and equal edges are merged, so a column with one
    value has the single bin 0. Ties always share a bin. NaN is missing, as null is.
    """
    df = df.withColumns({c: known(c) for c in cols})
    edges = exact_quantiles(df, cols, [i / q for i in range(q + 1)])
    return df.withColumns({c: bin_code(F.col(c), edges[c]) for c in cols})


def domains(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct non-null values per attribute: (pred, val)."""
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    return texts.unpivot([], list(cols), "pred", "val").where("val is not null").distinct()


def one_hot(
    df: DataFrame, cols: Sequence[str], drop_first: bool = False, max_values: int = 10_000
) -> DataFrame:
    """One 0/1 column per attribute value, named ``attr_value``; a null row is all zero.

    The values become columns, so their number is checked before the driver sees them.
    """
    values = domains(df, cols)
    size = values.count()
    if size > max_values:
        raise ValueError(f"{size} attribute values cannot become columns (max {max_values})")
    by_attr: dict[str, list[str]] = {c: [] for c in cols}
    for row in values.collect():
        by_attr[row["pred"]].append(row["val"])
    dummies = [
        F.when(F.col(c).cast("string") == F.lit(v), 1).otherwise(0).alias(f"{c}_{v}")
        for c in cols
        for v in sorted(by_attr[c])[1 if drop_first else 0 :]
    ]
    kept = [F.col(c) for c in df.columns if c not in cols]
    return df.select(*kept, *dummies)


def redundant_binary_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The lower value of each numeric attribute that has exactly two: (pred, val).

    Its literal says no more than the absence of the higher one.
    """
    numeric = [c for c in cols if isinstance(df.schema[c].dataType, T.NumericType)]
    if not numeric:
        return df.sparkSession.createDataFrame([], "pred string, val string")
    nums = df.select(*[F.col(c).cast("double").alias(c) for c in numeric])
    texts = domains(df, numeric)
    # Two distinct values are told from their extremes: no value set is ever collected.
    ends = nums.unpivot([], numeric, "pred", "x").where("x is not null")
    stats = ends.groupBy("pred").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    inside = (
        ends.join(F.broadcast(stats), "pred")
        .groupBy("pred")
        .agg(
            F.max((F.col("x") > F.col("lo")) & (F.col("x") < F.col("hi"))).alias("more"),
            F.first("lo").alias("lo"),
            F.first("hi").alias("hi"),
        )
        .where("not more and lo < hi")
    )
    return texts.join(F.broadcast(inside), "pred").where(
        F.col("val").cast("double") == F.col("lo")
    ).select("pred", "val")


def _valued(attr: str) -> Callable[[Column], Column]:
    return lambda v: F.struct(F.lit(attr).alias("pred"), v.cast("string").alias("val"))


def literal_array(
    df: DataFrame, attrs: Sequence[str], unary: frozenset[str] = frozenset()
) -> Column:
    """All literals of a row as array<struct<pred,val>>; missing values give none."""
    pieces = []
    for attr in attrs:
        if attr in unary:
            lit = F.struct(F.lit(attr).alias("pred"), F.lit(None).cast("string").alias("val"))
            pieces.append(F.when(F.col(attr).isNotNull(), F.array(lit)))
        elif isinstance(df.schema[attr].dataType, T.ArrayType):
            pieces.append(F.transform(F.array_compact(attr), _valued(attr)))
        else:
            lit = F.struct(F.lit(attr).alias("pred"), F.col(attr).cast("string").alias("val"))
            pieces.append(F.when(F.col(attr).isNotNull(), F.array(lit)))
    return F.flatten(F.array_compact(F.array(*pieces)))


def to_facts(cases: CaseTable, drop_binary_low: bool = False) -> DataFrame:
    """Melt a case table to facts (pred, case_id, val); nulls yield no fact."""
    lits = literal_array(cases.df, cases.attrs, cases.unary)
    facts = cases.df.select("case_id", F.inline(lits)).select("pred", "case_id", "val")
    if drop_binary_low:
        plain = [a for a in cases.attrs if not cases.is_multi(a) and a not in cases.unary]
        low = redundant_binary_values(cases.df, plain)
        # At most one row per attribute.
        facts = facts.join(F.broadcast(low), ["pred", "val"], "left_anti")
    return facts.select("pred", "case_id", "val")


def from_facts(
    facts: DataFrame,
    examples: DataFrame,
    single: Sequence[str] = (),
    multi: Sequence[str] = (),
    unary: Sequence[str] = (),
) -> CaseTable:
    """Facts (pred, case_id, val) back to one row per example; examples without facts stay.

    Facts are made distinct before they are gathered, so the values of one case are at
    most the domain of its attribute.
    """
    wanted = facts.where(F.col("pred").isin([*single, *multi, *unary])).distinct()

    def value_of(p: str) -> Column:
        return F.when(F.col("pred") == p, F.coalesce("val", F.lit("true")))

    wide = wanted.groupBy("case_id").agg(
        *[F.min(value_of(p)).alias(p) for p in (*single, *unary)],
        *[F.array_sort(F.collect_set(value_of(p))).alias(p) for p in multi],
    )
    df = examples.select("case_id", "is_pos").join(wide, "case_id", "left")
    return CaseTable(df, (*single, *multi, *unary), frozenset(unary))


def normalized(facts: DataFrame) -> DataFrame:
    """Facts with their values in export spelling."""
    return facts.withColumn("val", norm_value("val"))
