"""Top-k and threshold mining of high-utility itemsets.

Input is the long transaction table ``tx(tid, item, util)``. Mining works on one row per
transaction that carries its items in (TWU, item) order. A prefix is extended inside
its own row by the items that follow it, so growing itemsets needs no join on the
transaction; only counted totals per itemset are shuffled, and those are combined
map-side. Transactions with equal items are added up first.

Level by level, the k-th best utility found so far is the threshold. A prefix survives
when its utility plus everything that may follow it reaches the threshold, and an item
stays among the followers of a prefix when the transactions holding both can reach it.
Both bounds are never below the utility of any itemset they stand for, so nothing is
lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, materialize

#: Longest transaction whose equal copies are added up position by position.
MERGE_WIDTH = 100
#: Tails are filtered by the followers of their prefix up to this many followers.
FOLLOWERS = 200
#: Up to this many candidate itemsets of a level are decided on the driver.
FEW_CANDIDATES = 5000


# ---------------------------------------------------------------- building blocks


def merged_items(tx: DataFrame) -> DataFrame:
    """One row per (tid, item): repeated items of a transaction are added up."""
    return tx.groupBy("tid", "item").agg(F.sum("util").alias("util"))


def transaction_utility(tx: DataFrame) -> DataFrame:
    """(tid, total)."""
    return tx.groupBy("tid").agg(F.sum("util").alias("total"))


def twu(tx: DataFrame) -> DataFrame:
    """(item, twu): summed totals of the transactions that hold the item."""
    items = tx.select("tid", "item").distinct()
    totals = transaction_utility(tx)
    return items.join(totals, "tid").groupBy("item").agg(F.sum("total").alias("twu"))


def with_twu(tx: DataFrame) -> DataFrame:
    """Merged transactions with the TWU of each item."""
    merged = merged_items(tx)
    totals = transaction_utility(merged)
    weights = merged.join(totals, "tid").groupBy("item").agg(F.sum("total").alias("twu"))
    return merged.join(weights, "item")


def remaining_utility(tx: DataFrame, order: Sequence[str] = ("twu", "item")) -> DataFrame:
    """Add ``rutil``: utility of the later items of the same transaction.

    Sums run from the last item backwards, which is linear in the transaction length.
    """
    later = (
        W.partitionBy("tid")
        .orderBy(*[F.desc(c) for c in order])
        .rowsBetween(W.unboundedPreceding, -1)
    )
    return tx.withColumn("rutil", F.coalesce(F.sum("util").over(later), F.lit(0).cast("bigint")))


def utility_lists(tx: DataFrame) -> DataFrame:
    """Utility lists of single items: (item, tid, iutil, rutil)."""
    ordered = remaining_utility(with_twu(tx))
    return ordered.select("item", "tid", F.col("util").alias("iutil"), "rutil")


def itemset_utilities(lists: DataFrame, key: str = "itemset") -> DataFrame:
    """Totals per itemset: its utility and the most that may follow: (util, rutil)."""
    return lists.groupBy(key).agg(F.sum("iutil").alias("util"), F.sum("rutil").alias("rutil"))


def extend_lists(px: DataFrame, py: DataFrame, prefix: DataFrame | None = None) -> DataFrame:
    """Utility lists of joined itemsets.

    ``px`` and ``py`` hold (itemset, tid, iutil, rutil) with a common prefix, ``px``
    earlier in the item order. Utilities add up, minus the prefix counted twice.
    """
    x = px.select("tid", F.col("itemset").alias("x"), F.col("iutil").alias("ix"))
    y = py.select("tid", F.col("itemset").alias("y"), F.col("iutil").alias("iy"), "rutil")
    same = ["tid"]
    if prefix is None:
        joined = x.join(y, same).withColumn("ip", F.lit(0))
    else:
        p = prefix.select("tid", F.col("iutil").alias("ip"))
        joined = x.join(y, same).join(p, same)
    return joined.select(
        F.concat("x", F.slice("y", -1, 1)).alias("itemset"),
        "tid",
        (F.col("ix") + F.col("iy") - F.col("ip")).alias("iutil"),
        "rutil",
    )


def single_lists(tx: DataFrame) -> DataFrame:
    """Utility lists of single items, ready for ``extend_all_lists``.

    Beside (itemset, tid, iutil, rutil) a row has ``last``, the place of its last item in the
    item order, and ``before``, the utility of the items ahead of it.
    """
    return remaining_utility(with_twu(tx)).select(
        F.array("item").alias("itemset"),
        "tid",
        F.col("util").alias("iutil"),
        "rutil",
        F.struct("twu", "item").alias("last"),
        F.lit(0).cast("bigint").alias("before"),
    )


def extend_all_lists(lists: DataFrame, min_util: int) -> DataFrame:
    """Utility lists of all itemsets that are one item longer, of every prefix at once.

    Lists of itemsets that share all but their last item meet per transaction. An itemset
    whose utility and remaining utility together stay below ``min_util`` is not extended:
    nothing that begins with it can reach the threshold. That is decided on totals per
    itemset, before any lists meet. Equal rows of a transaction are to be merged beforehand
    (``single_lists`` does); null transactions or items meet nothing.
    """
    hopeful = itemset_utilities(lists).where(F.col("util") + F.col("rutil") >= min_util).select("itemset")
    prefix = F.slice("itemset", 1, F.size("itemset") - 1).alias("prefix")
    x = lists.join(hopeful, "itemset", "left_semi").select(
        "tid", prefix, F.col("itemset").alias("x"), F.col("iutil").alias("ix"), F.col("last").alias("x_last"), "before"
    )
    y = lists.select("tid", prefix, F.col("iutil").alias("iy"), "rutil", "last")
    return x.join(y, ["tid", "prefix"]).where(F.col("x_last") < F.col("last")).select(
        F.concat("x", F.array("last.item")).alias("itemset"),
        "tid",
        (F.col("ix") + F.col("iy") - F.col("before")).alias("iutil"),
        "rutil",
        "last",
        F.col("ix").alias("before"),
    )


def top_k(df: DataFrame, k: int, by: str = "util", ties: Sequence[str] = ()) -> DataFrame:
    """The k largest rows; equal ones in the order of ``ties``."""
    return df.orderBy(F.desc(by), *[F.asc(t) for t in ties]).limit(k)


def top_per_case(df: DataFrame, n: int, key: str = "case_id", by: str = "util",
                 ties: Sequence[str] = ("item",)) -> DataFrame:
    """The n largest rows of each case; Spark keeps at most n per task before it shuffles."""
    order = W.partitionBy(key).orderBy(F.desc(by), *[F.asc(t) for t in ties])
    ranked = df.withColumn("rank__", F.row_number().over(order))
    return ranked.where(F.col("rank__") <= n).drop("rank__")


# ---------------------------------------------------------------- mining


def _kth(df: DataFrame, k: int) -> list[int]:
    """The k largest utilities; k numbers at most reach the driver."""
    top = df.select("util").orderBy(F.desc("util")).limit(k).collect()
    return [r["util"] for r in top]


def transaction_rows(tx: DataFrame, min_util: int = 1, k: int | None = None, items_once: bool = False) -> DataFrame:
    """One row per transaction: ``tail`` = array<struct<item,util,after>> in item order.

    ``after`` is the utility of the later items. Items are merged before they are
    gathered, so a row holds at most the dictionary; items whose transactions cannot
    reach the threshold (the k-th best single item) are left out beforehand. ``items_once``
    tells that they are merged already, which spares a task a second table of its items.
    """
    total = F.sum("util").over(W.partitionBy("tid"))
    merged = tx.select("tid", "item", "util") if items_once else merged_items(tx)
    base = materialize(merged.withColumn("total", total))
    promising = materialize(
        base.groupBy("item").agg(F.sum("util").alias("util"), F.sum("total").alias("twu"))
    )
    size = promising.count()
    if k is not None and size > FOLLOWERS:
        best = _kth(promising, k)
        min_util = max(min_util, best[-1]) if len(best) == k else min_util
    promising = promising.where(F.col("twu") >= min_util).select("item", "twu")
    if size <= BROADCAST_ROWS:
        promising = F.broadcast(promising)
    ordered = remaining_utility(base.join(promising, "item"))
    element = F.struct("twu", "item", "util", F.col("rutil").alias("after"))
    gathered = ordered.groupBy("tid").agg(F.sort_array(F.collect_list(element)).alias("tail"))
    slim = F.transform("tail", lambda e: e.dropFields("twu"))
    return materialize(gathered.select(slim.alias("tail")))


def with_after(items: Column) -> Column:
    """array<struct<item,util>> with the utility of the later elements added to each.

    For rows with one item per attribute; long transactions get it from a window.
    """
    suffix = F.aggregate(
        F.reverse(items),
        F.array(F.lit(0).cast("bigint")),
        lambda acc, e: F.concat(acc, F.array(F.element_at(acc, -1) + e["util"])),
    )
    return F.transform(
        items,
        lambda e, i: e.withField("after", F.get(suffix, F.size(items) - i - 1)),
    )


def merge_equal(rows: DataFrame) -> DataFrame:
    """Add up transactions with the same items when that shrinks the table.

    Utility and remaining utility are sums over transactions, so equal item lists can
    be one row. Whether it pays is measured first.
    """
    keys = F.transform("tail", lambda e: e["item"])
    stats = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(F.size("tail")).alias("width"),
        F.approx_count_distinct(F.xxhash64(keys)).alias("kinds"),
    ).first()
    width = stats["width"]
    if not stats["rows"] or width > MERGE_WIDTH or stats["kinds"] * 2 > stats["rows"]:
        return rows
    at = [F.get(F.col("tail"), F.lit(i)) for i in range(width)]
    merged = rows.groupBy(keys.alias("keys")).agg(
        *[F.sum(at[i]["util"]).alias(f"u{i}") for i in range(width)],
        *[F.sum(at[i]["after"]).alias(f"a{i}") for i in range(width)],
    )
    utils = F.array(*[F.col(f"u{i}") for i in range(width)])
    afters = F.array(*[F.col(f"a{i}") for i in range(width)])
    tail = F.transform(
        "keys",
        lambda e, i: F.struct(
            e.alias("item"), F.get(utils, i).alias("util"), F.get(afters, i).alias("after")
        ),
    )
    return materialize(merged.select(tail.alias("tail")))


def _extension_stats(level: DataFrame) -> DataFrame:
    """Totals of every one-item extension found in the rows of a level.

    ``util`` is the exact utility, ``bound`` adds what may follow the new item and
    ``reach`` adds everything that may follow the old prefix.
    """
    rest = F.aggregate("tail", F.lit(0).cast("bigint"), lambda acc, e: acc + e["util"])
    steps = level.select("prefix", "iutil", rest.alias("rest"), F.inline("tail"))
    util = F.col("iutil") + F.col("util")
    return steps.groupBy("prefix", "item").agg(
        F.sum(util).alias("util"),
        F.sum(util + F.col("after")).alias("bound"),
        F.sum(F.col("iutil") + F.col("rest")).alias("reach"),
    )


def _survivors(stats: DataFrame, threshold: int) -> tuple[DataFrame, int]:
    """Extensions to grow, (prefix, item, allowed), and their number.

    An extension survives while what may follow can reach the threshold. ``allowed`` are
    the items that reach the threshold together with the prefix; null allows all.
    """
    alive = F.least("bound", "reach") >= threshold
    grown = stats.where(alive).select("prefix", "item")
    followers = stats.where(F.col("reach") >= threshold).groupBy("prefix").agg(
        F.count(F.lit(1)).alias("size"), F.collect_set("item").alias("allowed")
    )  # at most the dictionary per prefix
    few = F.when(F.col("size") <= FOLLOWERS, F.col("allowed"))
    return grown.join(followers, "prefix").select("prefix", "item", few.alias("allowed")), grown.count()


def _local_survivors(rows: list, threshold: int) -> list[tuple]:
    """``_survivors`` for a list of extensions."""
    followers: dict[tuple, list] = {}
    for r in rows:
        if r["reach"] >= threshold:
            followers.setdefault(tuple(r["prefix"]), []).append(r["item"])
    out = []
    for r in rows:
        if min(r["bound"], r["reach"]) >= threshold:
            allowed = followers[tuple(r["prefix"])]
            out.append((r["prefix"], r["item"], allowed if len(allowed) <= FOLLOWERS else None))
    return out


def _next_level(level: DataFrame, grown: DataFrame) -> DataFrame:
    """Rows of the next level: each surviving extension with the tail behind it."""
    steps = level.select("prefix", "iutil", "tail", F.posexplode("tail").alias("pos", "e")).where(
        F.col("pos") + 1 < F.size("tail")
    )
    steps = steps.withColumn("item", F.col("e.item")).join(grown, ["prefix", "item"])
    behind = F.slice("tail", F.col("pos") + 2, F.size("tail"))
    kept = F.when(F.col("allowed").isNull(), behind).otherwise(
        F.filter(behind, lambda e: F.array_contains("allowed", e["item"]))
    )
    return steps.select(
        F.concat("prefix", F.array("item")).alias("prefix"),
        (F.col("iutil") + F.col("e.util")).alias("iutil"),
        kept.alias("tail"),
    ).where(F.size("tail") > 0)


def mine(
    rows: DataFrame,
    k: int | None,
    min_util: int = 1,
    max_len: int | None = None,
    min_len: int = 1,
    with_ties: bool = False,
    merged: bool = False,
) -> DataFrame:
    """Level-wise mining over ``rows(tail)``; see the module text.

    Returns (itemset, util) with sorted items. With ``k`` the threshold starts at
    ``min_util`` and rises; without it, it stays. ``merged`` tells that equal
    transactions have been added up already.

    The candidates of a level are decided on the driver while they are few, and by Spark
    when there are more than ``FEW_CANDIDATES``.
    """
    spark = rows.sparkSession
    item_type = rows.schema["tail"].dataType.elementType["item"].dataType.simpleString()
    schema = f"itemset array<{item_type}>, util bigint"
    grown_schema = f"prefix array<{item_type}>, item {item_type}, allowed array<{item_type}>"
    level: DataFrame | None = (rows if merged else merge_equal(rows)).select(
        F.array().cast(f"array<{item_type}>").alias("prefix"),
        F.lit(0).cast("bigint").alias("iutil"),
        "tail",
    )
    threshold, length = min_util, 1
    best: list[tuple] = []  # at most k rows (itemset, util)
    found: list[DataFrame] = []
    itemset = F.array_sort(F.concat("prefix", F.array("item"))).alias("itemset")
    while level is not None:
        stats = _extension_stats(level).persist()
        few = stats.limit(FEW_CANDIDATES + 1).collect()
        local = few if len(few) <= FEW_CANDIDATES else None
        if length >= min_len:
            hits = stats.where(F.col("util") >= threshold).select(itemset, "util")
            if k is not None:
                if local is None:
                    top = [(r["itemset"], r["util"]) for r in _best(hits, k)]
                else:
                    top = [
                        (sorted([*r["prefix"], r["item"]]), r["util"])
                        for r in local
                        if r["util"] >= threshold
                    ]
                best = sorted([*best, *top], key=_preference)[:k]
                threshold = max(threshold, best[-1][1]) if len(best) == k else threshold
            if k is None or with_ties:
                found.append(materialize(hits.where(F.col("util") >= threshold)))
        length += 1
        grown, count = None, 0
        if max_len is None or length <= max_len:
            if local is None:
                grown, count = _survivors(stats, threshold)
            else:
                survivors = _local_survivors(local, threshold)
                count = len(survivors)
                grown = spark.createDataFrame(survivors, grown_schema) if survivors else None
        if grown is not None and count:
            side = F.broadcast(grown) if count <= BROADCAST_ROWS else grown
            level = materialize(_next_level(level, side))
        else:
            level = None
        stats.unpersist()
    if k is not None and not with_ties:
        return spark.createDataFrame(best, schema)
    everything = spark.createDataFrame([], schema)
    for hits in found:
        everything = everything.unionByName(hits)
    return everything.where(F.col("util") >= threshold)


def _preference(row: tuple) -> tuple:
    return (-row[1], len(row[0]), row[0])


def _best(hits: DataFrame, k: int) -> list:
    return hits.orderBy(F.desc("util"), F.size("itemset"), F.col("itemset")).limit(k).collect()


def utility_itemsets(tx: DataFrame, min_util: int, max_len: int | None = None) -> DataFrame:
    """All itemsets whose utility is at least ``min_util``: (itemset, util)."""
    return mine(transaction_rows(tx, min_util), k=None, min_util=min_util, max_len=max_len)


def mining_rows(tx: DataFrame, k: int) -> DataFrame:
    """Rows for several minings of at most ``k`` itemsets each: prepared and written once."""
    return merge_equal(transaction_rows(tx, k=k))


def top_k_utility_itemsets(
    tx: DataFrame,
    k: int,
    max_len: int | None = None,
    min_len: int = 1,
    with_ties: bool = False,
    rows: DataFrame | None = None,
    items_once: bool = False,
) -> DataFrame:
    """The k itemsets of highest utility: (itemset, util).

    Ties are ordered by length, then by the sorted items; ``with_ties`` keeps all
    itemsets that equal the k-th. ``rows`` are those of ``mining_rows`` for ``tx`` and as
    large a k at least, where several minings share them; with a ``min_len`` they are not used.
    ``items_once`` as for ``transaction_rows``.
    """
    if rows is not None and min_len == 1:
        return mine(rows, k, max_len=max_len, min_len=min_len, with_ties=with_ties, merged=True)
    rows = transaction_rows(tx, k=k if min_len == 1 else None, items_once=items_once)
    return mine(rows, k, max_len=max_len, min_len=min_len, with_ties=with_ties)


def next_itemset(tx: DataFrame, used: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """The best itemset that is not among ``used``(itemset): one row (itemset, util).

    With u used itemsets the answer is among the best u + 1; ``rows`` as for
    ``top_k_utility_itemsets``.
    """
    taken = used.select(F.array_sort("itemset").alias("itemset")).distinct()
    best = top_k_utility_itemsets(tx, taken.count() + 1, rows=rows)
    rest = best.join(taken, "itemset", "left_anti")
    return rest.orderBy(F.desc("util"), F.size("itemset"), F.col("itemset")).limit(1)
