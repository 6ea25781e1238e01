"""Connected components of a table of links, in Spark jobs only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, materialize

#: Rows per file of the tables written between rounds.
PER_FILE = 500_000


def if_small(df: DataFrame, rows: int) -> DataFrame:
    """A hint to broadcast ``df`` if its counted rows are few; else Spark decides."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the smallest node it is joined to.

    A label falls to the smallest one among its neighbours' and to the label of its label,
    so the number of rounds follows the logarithm of the longest path. Each round is one
    aggregation with map-side combining and writes one small table; a node with very many
    links costs one partial row per task. Null nodes are ignored.
    """
    kept = links.select("a", "b").where("a is not null and b is not null and a <> b")
    both = materialize(kept.unionByName(kept.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    size = both.count()
    files = size // PER_FILE + 1
    first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
    labels = materialize(first.select("node", F.least("node", "near").alias("label")).coalesce(files))
    if not size:
        return labels
    nodes = labels.count()
    while True:
        known = if_small(labels.select(F.col("node").alias("b"), "label"), nodes)
        near = both.join(known, "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        own = if_small(labels.select("node", "label"), nodes)
        above = if_small(labels.select(F.col("node").alias("label"), F.col("label").alias("above")), nodes)
        lower = near.join(own, "node").join(above, "label").select(
            "node", F.least("label", "near", "above").alias("label"), F.col("label").alias("was")
        )
        labels = materialize(lower.coalesce(files))
        if labels.where("label <> was").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
