"""Itemset mining against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from ruleweave.operators import utility as ut


def random_tx(seed: int, items: int = 6, n: int = 14, ids=range(100)):
    r = random.Random(seed)
    return [
        (t, ids[i], r.choice([0, 1, 2, 5, 9, 20]))
        for t in range(n)
        for i in r.sample(range(items), r.randint(1, items))
    ]


def brute(rows):
    by_tid = {}
    for t, i, u in rows:
        by_tid.setdefault(t, {}).setdefault(i, 0)
        by_tid[t][i] += u
    items = sorted({i for _, i, _ in rows})
    out = {}
    for size in range(1, len(items) + 1):
        for combo in itertools.combinations(items, size):
            held = [b for b in by_tid.values() if all(i in b for i in combo)]
            if held:
                out[combo] = sum(sum(b[i] for i in combo) for b in held)
    return out


def ranked(truth, min_len=1):
    keep = [(c, u) for c, u in truth.items() if len(c) >= min_len and u > 0]
    return sorted(keep, key=lambda e: (-e[1], len(e[0]), e[0]))


def as_list(df):
    rows = [(tuple(r["itemset"]), r["util"]) for r in df.collect()]
    return sorted(rows, key=lambda e: (-e[1], len(e[0]), e[0]))


def frame(spark, rows):
    return spark.createDataFrame(rows, "tid int, item int, util bigint")


@pytest.mark.parametrize("seed, k, min_len, few", [(1, 1, 1, 5000), (2, 5, 1, 0), (3, 12, 2, 9)])
def test_top_k_equals_brute_force(spark, monkeypatch, seed, k, min_len, few):
    monkeypatch.setattr(ut, "FEW_CANDIDATES", few)
    rows = random_tx(seed)
    got = as_list(ut.top_k_utility_itemsets(frame(spark, rows), k, min_len=min_len))
    assert got == ranked(brute(rows), min_len)[:k]


@pytest.mark.parametrize("seed", [4, 5])
def test_threshold_equals_brute_force(spark, seed, monkeypatch):
    rows = random_tx(seed) + random_tx(seed)  # repeated items in a transaction add up
    truth = ranked(brute(rows))
    threshold = truth[len(truth) // 2][1]
    # No follower filter: the other way through the mining must give the same.
    if seed == 5:
        monkeypatch.setattr(ut, "FOLLOWERS", 0)
        monkeypatch.setattr(ut, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(ut, "FEW_CANDIDATES", 0)
    got = as_list(ut.utility_itemsets(frame(spark, rows), threshold))
    assert got == [e for e in truth if e[1] >= threshold]


def test_ties_beyond_k_are_kept_on_request(spark):
    rows = [(0, 1, 5), (1, 2, 5), (2, 3, 5), (3, 4, 9)]
    df = frame(spark, rows)
    assert as_list(ut.top_k_utility_itemsets(df, 2)) == [((4,), 9), ((1,), 5)]
    assert len(as_list(ut.top_k_utility_itemsets(df, 2, with_ties=True))) == 4


def test_max_len_and_partitioning(spark):
    rows = random_tx(7)
    df = frame(spark, rows)
    expected = [e for e in ranked(brute(rows)) if len(e[0]) <= 2][:6]
    assert as_list(ut.top_k_utility_itemsets(df.repartition(1), 6, max_len=2)) == expected
    assert as_list(ut.top_k_utility_itemsets(df.repartition(7), 6, max_len=2)) == expected


def test_hot_item_and_hot_transaction(spark):
    hot = [(t, 0, 1) for t in range(400)] + [(0, i, 2) for i in range(12) for _ in range(30)]
    got = as_list(ut.top_k_utility_itemsets(frame(spark, hot), 3))
    assert got == ranked(brute(hot))[:3]


def test_equal_transactions_are_merged_without_loss(spark):
    rows = [(t, i, t % 5 + i) for t in range(60) for i in range(3 if t % 2 else 4)]
    tails = ut.transaction_rows(frame(spark, rows))
    merged = ut.merge_equal(tails)
    assert tails.count() == 60 and merged.count() == 2
    assert as_list(ut.top_k_utility_itemsets(frame(spark, rows), 20)) == ranked(brute(rows))[:20]


def test_utility_lists_and_their_extension(spark):
    rows = [(1, 1, 5), (1, 2, 3), (1, 3, 1), (2, 2, 4), (2, 3, 6)]
    lists = {(r["item"], r["tid"]): (r["iutil"], r["rutil"]) for r in ut.utility_lists(frame(spark, rows)).collect()}
    # TWU: item 1 -> 9, items 2 and 3 -> 19: order 1, 2, 3
    assert lists == {(1, 1): (5, 4), (2, 1): (3, 1), (3, 1): (1, 0), (2, 2): (4, 6), (3, 2): (6, 0)}
    base = ut.utility_lists(frame(spark, rows)).withColumn("itemset", F.array("item"))
    one, two, three = (base.where(f"item = {i}") for i in (1, 2, 3))
    twelve, thirteen = ut.extend_lists(one, two), ut.extend_lists(one, three)
    full = ut.extend_lists(twelve, thirteen, prefix=one).first()
    assert full["itemset"] == [1, 2, 3] and full["iutil"] == 9 and full["rutil"] == 0


@pytest.mark.parametrize("least", [0, 60])
def test_lists_of_every_prefix(spark, least):
    """All longer itemsets are met; only what cannot reach the threshold may be missing."""
    rows = random_tx(12) + [(1, None, 4), (None, 3, 4), (None, 4, 4)] + random_tx(13)[:9]
    truth = brute([r for r in rows if None not in r])
    lists, size = ut.single_lists(frame(spark, rows)), 1
    while size < 5:
        lists, size = ut.extend_all_lists(lists, least), size + 1
        totals = ut.itemset_utilities(lists).collect()
        got = {tuple(sorted(r["itemset"])): r["util"] for r in totals}
        assert len(got) == len(totals) and set(got.items()) <= set(truth.items())
        assert {c for c, u in truth.items() if len(c) == size and (u >= least or not least)} <= set(got)
    assert ut.extend_all_lists(lists.limit(0), least).count() == 0


def test_next_itemset_skips_used(spark):
    rows = random_tx(9)
    truth = ranked(brute(rows))
    used = spark.createDataFrame([(list(truth[0][0]),), (list(reversed(truth[1][0])),)], "itemset array<int>")
    got = as_list(ut.next_itemset(frame(spark, rows), used))
    assert got == [truth[2]]


def test_no_transactions(spark):
    assert as_list(ut.top_k_utility_itemsets(frame(spark, []), 3)) == []


def test_minings_share_their_rows(spark, monkeypatch):
    rows = random_tx(5)
    tx = spark.createDataFrame(rows, "tid int, item int, util bigint")
    want = ranked(brute(rows))
    shared = ut.mining_rows(tx, 4)
    monkeypatch.setattr(ut, "transaction_rows", None)  # prepared once, not by each mining
    best = ut.top_k_utility_itemsets(tx, 4, rows=shared).collect()
    assert sorted((-r.util, len(r.itemset), tuple(r.itemset)) for r in best) == [(-u, len(c), c) for c, u in want[:4]]
    used = spark.createDataFrame([(list(want[i][0]),) for i in (0, 1, 3)], "itemset array<int>")
    found = ut.next_itemset(tx, used, shared).collect()
    assert [(tuple(r.itemset), r.util) for r in found] == [want[2]]


def test_merged_items_are_not_merged_again(spark, monkeypatch):
    """One table of items per task: what is merged already goes on as it is."""
    rows = random_tx(5, items=5, n=12)
    once = ut.merged_items(spark.createDataFrame(rows, "tid long, item long, util long"))
    want = {(tuple(r["itemset"]), r["util"]) for r in ut.top_k_utility_itemsets(once, 9, with_ties=True).collect()}
    monkeypatch.setattr(ut, "merged_items", lambda tx: pytest.fail("merged again"))
    got = ut.top_k_utility_itemsets(once, 9, with_ties=True, items_once=True)
    assert {(tuple(r["itemset"]), r["util"]) for r in got.collect()} == want
