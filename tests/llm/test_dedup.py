"""Exact and near duplicates against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ruleweave.llm import components, exact_dedup, near_dedup

ROWS = [
    (1, "a b c"), (2, "abc"), (3, "ab  c"), (4, None), (5, ""), (6, " \t"), (None, "abc"), (7, "x" * 700),
    (8, "x" * 700 + " "), (9, "q"), (9, "q"), (9, "r"), (10, "r"), (11, "abd"), (12, "abcd"),
] + [(100 + i, f"w{i % 7}") for i in range(40)]


def table(spark, rows):
    clash = {"size": F.lit(1), "label": F.lit("x"), "row_hash": F.lit(0), "n_chars": F.lit(None)}
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumns(clash).repartition(4)


def exact_brute(rows):
    groups = defaultdict(set)
    for i, t in rows:
        groups["".join(c for c in (t or "") if c not in exact_dedup.BLANKS)].add((i, t or ""))
    out = set()
    for texts in groups.values():
        keep = min(texts, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))
        out |= {(i, keep[0], len(texts), (i, t) == keep) for i, t in texts}
    return out


@pytest.mark.parametrize(
    "settings",
    [{}, {"piece": 3}, {"piece": 5, "moduli": (3, 2), "bases": (2, 1)}],  # the last one makes fingerprints collide
)
def test_exact_groups(spark, settings):
    found = exact_dedup.exact_groups(table(spark, ROWS), **settings).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in found} == exact_brute(ROWS)
    assert len(found) == len(set((i, t or "") for i, t in ROWS))


def test_fingerprints_compose():
    text = bytes(range(256)) * 9
    for base, modulus in zip(exact_dedup.BASES, exact_dedup.MODULI, strict=True):
        whole, _ = exact_dedup.piece_hash(text, base, modulus)
        left, _ = exact_dedup.piece_hash(text[:700], base, modulus)
        right, shift = exact_dedup.piece_hash(text[700:], base, modulus)
        assert (left * shift + right) % modulus == whole


def test_kept_documents(spark):
    kept = exact_dedup.kept_documents(table(spark, ROWS))
    assert set(kept.columns) == {"doc_id", "text", "size", "label", "row_hash", "n_chars"}
    assert kept.count() == sum(r[3] for r in exact_brute(ROWS))
    assert exact_dedup.kept_documents(table(spark, ROWS).limit(0)).count() == 0


def shingles(text, k):
    words = (text or "").encode().lower().split()
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def near_brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    above = {i: i for i, _ in sets if i is not None}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and i <= j:
                if i == j or (a and b and 100 * len(a & b) >= percent * len(a | b)):
                    low, high = sorted((top(i), top(j)))
                    above[high] = low
    return sorted(
        ((i, len(s), None if i is None else top(i), i is None or top(i) == i) for i, s in sets), key=str
    )


def near_rows():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [[rnd.choice(words) for _ in range(60)] for _ in range(10)]
    rows = []
    for i in range(160):
        text = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 5)):
            text[rnd.randrange(60)] = rnd.choice(words)
        rows.append((i * 3 + 1, " ".join(text)))
    rows += [
        (5000, None), (5001, ""), (5002, "  "), (5003, "Hello"), (5004, "hello "), (None, "hello"),
        (1, rows[77][1]), (7, "unique words here only once"), (7, "unique words here only once"),
    ]
    return rows + [(6000 + i, " ".join(base[0])) for i in range(20)]


@pytest.mark.parametrize("pairs_per_text", [8, 0])  # the second tests heads to the end
def test_near_components(spark, pairs_per_text):
    rows = near_rows()
    found = near_dedup.near_components(table(spark, rows), words=4, pairs_per_text=pairs_per_text)
    got = found.select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == near_brute(rows, 4, 80)


def test_near_components_of_far_copies(spark, monkeypatch):
    """Copies of one text that are mostly too far from each other are not tested in pairs."""
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(300)}" for _ in range(150)]
    rows = []
    for i in range(240):
        text = base[: rnd.choice((150, 150, 150, 120))]
        for _ in range(rnd.choice((3, 6, 7, 8, 9))):
            text[rnd.randrange(len(text))] = f"x{rnd.randrange(10**9)}"
        rows.append((i, " ".join(text)))
    tested, confirmed = [], near_dedup._confirmed
    monkeypatch.setattr(
        near_dedup, "_confirmed", lambda pairs, *a: (tested.append(pairs.distinct().count()), confirmed(pairs, *a))[1]
    )
    found = near_dedup.near_components(table(spark, rows), words=4, pairs_per_text=1)
    got = found.select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == near_brute(rows, 4, 80)
    assert sum(tested) < 20 * len(rows)


def test_near_duplicates_of_nothing(spark):
    empty = table(spark, [(1, "a")]).limit(0)
    assert near_dedup.near_components(empty).count() == 0
    blank = table(spark, [(1, None), (2, ""), (None, None)])
    assert near_dedup.first_of_each(blank).count() == 3


def test_sketches_estimate():
    import numpy as np

    rnd = np.random.default_rng(0)
    k, bits = near_dedup.BANDS * near_dedup.ROWS, 64 * near_dedup.SKETCH_WORDS
    allowed = near_dedup.flips_allowed(k, bits, 0.8)
    for similarity, passes in ((0.8, True), (0.95, True), (0.3, False)):
        n = 300
        shared = int(2 * n * similarity / (1 + similarity)) + 1
        pool = rnd.integers(0, 1 << 62, 2 * n - shared, dtype=np.uint64)
        a, b = (near_dedup.samples(x, k, 1) for x in (pool[:n], pool[n - shared :]))
        differ = near_dedup.odd_sketch(a, near_dedup.SKETCH_WORDS) ^ near_dedup.odd_sketch(b, near_dedup.SKETCH_WORDS)
        assert (sum(int(x).bit_count() for x in differ.view(np.uint64)) <= allowed) == passes


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 20)] + [(40, 41), (41, 42), (7, 7), (None, 3), (50, 30)]
    found = components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    want = {i: 1 for i in range(1, 21)} | {40: 40, 41: 40, 42: 40, 30: 30, 50: 30}
    assert {r.node: r.label for r in found} == want
