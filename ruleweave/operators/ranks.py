"""Order statistics and running sums that never sort a whole column in one task.

Both work on counts per distinct value, so repeated values cost nothing, and spread the
values over ranges with Spark's range partitioning. The ranges only steer how work is
divided; results are exact wherever they begin and end.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

#: Up to this many distinct values the built-in exact percentile holds them in memory.
SMALL_DISTINCT = 200_000


def in_ranges(df: DataFrame, *order: str, parts: int | None = None) -> DataFrame:
    """Add ``range__``: a number that rises with the order columns, one per partition.

    The table is written out, so later steps see the same ranges.
    """
    spread = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    return materialize(spread.withColumn("range__", F.spark_partition_id()))


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Counts per distinct non-null value: (col, x, cnt)."""
    as_double = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    long = as_double.unpivot([], list(cols), "col", "x").where("x is not null")
    return long.groupBy("col", "x").agg(F.count(F.lit(1)).alias("cnt"))


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], small: int = SMALL_DISTINCT
) -> dict[str, list[float]]:
    """Exact quantiles with linear interpolation, per column.

    Columns with few distinct values use ``percentile``, whose buffer is bounded by
    that number. The others go through value counts: bucket totals locate the buckets
    that hold the wanted ranks, and only those buckets are ranked.
    """
    sizes = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).first()
    few = [c for c in cols if sizes[c] <= small]
    many = [c for c in cols if sizes[c] > small]
    result: dict[str, list[float]] = {}
    if few:
        array = F.array(*[F.lit(float(p)) for p in probs])
        row = df.agg(*[F.percentile(F.col(c).cast("double"), array).alias(c) for c in few]).first()
        result.update({c: list(row[c]) if row[c] else [] for c in few})
    if many:
        result.update(_quantiles_by_rank(df, many, probs))
    return result


def _quantiles_by_rank(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], parts: int | None = None
) -> dict[str, list[float]]:
    """Totals per range tell which ranges hold the wanted ranks; only those are ranked."""
    spark = df.sparkSession
    counts = in_ranges(value_counts(df, cols), "col", "x", parts=parts)
    totals: dict[str, list[tuple[int, int]]] = {}
    for row in counts.groupBy("col", "range__").agg(F.sum("cnt").alias("cnt")).collect():
        totals.setdefault(row["col"], []).append((row["range__"], row["cnt"]))

    wanted: dict[str, list[tuple[float, int, int]]] = {}
    starts: dict[tuple[str, int], int] = {}
    for col, per_range in totals.items():
        total = sum(cnt for _, cnt in per_range)
        positions = [p * (total - 1) for p in probs]
        wanted[col] = [(pos, math.floor(pos), math.ceil(pos)) for pos in positions]
        ranks = {r for _, low, high in wanted[col] for r in (low, high)}
        start = 0
        for number, cnt in sorted(per_range):
            if any(start <= r < start + cnt for r in ranks):
                starts[col, number] = start
            start += cnt

    # A few ranges and ranks per column, whatever the number of cases.
    first = spark.createDataFrame(
        [(c, n, s) for (c, n), s in sorted(starts.items())],
        "col string, range__ int, first_rank bigint",
    )
    targets = spark.createDataFrame(
        sorted({(c, r) for c, ws in wanted.items() for _, lo, hi in ws for r in (lo, hi)}),
        "col string, target bigint",
    )
    so_far = W.partitionBy("col", "range__").orderBy("x").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = counts.join(F.broadcast(first), ["col", "range__"]).select(
        "col", "x", "cnt", (F.col("first_rank") + F.sum("cnt").over(so_far)).alias("upto")
    )
    hits = ranked.join(F.broadcast(targets), "col").where(
        (F.col("target") < F.col("upto")) & (F.col("target") >= F.col("upto") - F.col("cnt"))
    )
    at = {(r["col"], r["target"]): r["x"] for r in hits.select("col", "target", "x").collect()}
    return {
        col: [
            at[col, lo] if lo == hi or at[col, lo] == at[col, hi]
            else (hi - pos) * at[col, lo] + (pos - lo) * at[col, hi]
            for pos, lo, hi in ws
        ]
        for col, ws in wanted.items()
    }


def running_sums(
    df: DataFrame,
    order: str,
    values: Sequence[str],
    descending: bool = True,
    parts: int | None = None,
) -> DataFrame:
    """Add ``cum_<value>`` columns: sums over all rows up to and including each row.

    ``df`` holds one row per distinct ``order`` value. Rows are summed inside ranges of
    the order column; what the ranges before add up to is joined in.
    """
    ranged = in_ranges(df, order, parts=parts)
    direction = F.desc if descending else F.asc
    totals = ranged.groupBy("range__").agg(*[F.sum(v).alias(f"{v}__") for v in values])
    before = W.orderBy(direction("range__")).rowsBetween(W.unboundedPreceding, -1)
    # One row per range: as many as there are partitions.
    starts = totals.select(
        "range__",
        *[F.coalesce(F.sum(f"{v}__").over(before), F.lit(0)).alias(f"{v}_start__") for v in values],
    )
    inside = (
        W.partitionBy("range__")
        .orderBy(direction(order))
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    joined = ranged.join(F.broadcast(starts), "range__")
    return joined.select(
        *df.columns,
        *[(F.sum(v).over(inside) + F.col(f"{v}_start__")).alias(f"cum_{v}") for v in values],
    )


def numbered(df: DataFrame, *order: str, name: str = "nth", parts: int | None = None) -> DataFrame:
    """Number the rows 0, 1, 2 ... in the given order, nulls first.

    Rows are numbered inside ranges of the order; each range starts after those before it.
    """
    ranged = in_ranges(df, *order, parts=parts)
    sizes = ranged.groupBy("range__").agg(F.count(F.lit(1)).alias("size__"))
    before = W.orderBy("range__").rowsBetween(W.unboundedPreceding, -1)
    # One row per range: as many as there are partitions.
    starts = sizes.select("range__", F.coalesce(F.sum("size__").over(before), F.lit(0)).alias("start__"))
    inside = F.row_number().over(W.partitionBy("range__").orderBy(*order))
    joined = ranged.join(F.broadcast(starts), "range__")
    return joined.select(*df.columns, (F.col("start__") + inside - 1).alias(name))
