"""Conversation trie, suffix removal and Merkle manifest against brute force in Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ruleweave.llm import conversation_trie, merkle_manifest, suffix_dedup

TURNS = "conv_id bigint, turn bigint, role string, text string"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- conversation trie -------------------------------------------------------------------


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own[conv].append((turn is not None, turn or 0, key, role, text))
    own = {c: [(role, text) for *_, role, text in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute_trie(rows):
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for path, cs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in cs if len(convs[c]) == len(path))
        parent = members[path[:-1]][0] if path else None
        out.append((cs[0], len(path), parent, len(cs), len(children), len(leaves), saved, sha(ends)))
    return sorted(out, key=str)


def trie(spark, rows, width):
    numbered = conversation_trie.numbered_turns(spark.createDataFrame(rows, TURNS))
    conv = F.col("conv")
    turns, convs = conversation_trie.rebuilt_turns(
        numbered, donor=conv - conv % 5, given=F.crc32(conv.cast("string")) % 9, most=8
    )
    return sorted(map(tuple, conversation_trie.prefix_trie(turns, convs, width).collect()), key=str)


@pytest.mark.parametrize("width", [1, 3, 8])
def test_trie_equals_brute_force(spark, width):
    rng = random.Random(width)
    rows = []
    for c in [*range(24), 5000, 9999]:
        for t in range(rng.choice([1, 2, 5, 11])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "", None])))
    rows += [(3, None, "user", "first"), (3, 0, "user", "tie"), (3, 0, "user", "tie"), (None, 0, "user", "no id")]
    assert trie(spark, rows, width) == brute_trie(rows)


def test_trie_of_nothing_and_of_hidden_turns(spark):
    assert trie(spark, [], 8) == []
    # Without donors, conversations that lose their only turn are members of the root alone.
    rows = [(c, 0, "user", "x") for c in range(5, 40) if c % 5]
    got = trie(spark, rows, 8)
    assert got == brute_trie(rows) and len(got) == 2


def test_before_in_key_over_ranges(spark):
    rows = [(k, o, k + o) for k in range(3) for o in range(200 if k == 1 else 2)]
    got = conversation_trie.before_in_key(spark.createDataFrame(rows, "k bigint, o bigint, v bigint"), "k", "o", ["v"])
    for r in got.collect():
        assert r["before_v"] == sum(v for k, o, v in rows if k == r["k"] and o < r["o"])


# --- suffix removal ----------------------------------------------------------------------


def brute_repeats(texts, size):
    places = defaultdict(list)
    for i, t in enumerate(texts):
        for a in range(len(t) - size + 1):
            places[t[a : a + size]].append((i, a))
    covered = [np.zeros(len(t), bool) for t in texts]
    for ps in places.values():
        if len(ps) > 1:
            for i, a in ps:
                covered[i][a : a + size] = True
    out = []
    for t, c in zip(texts, covered, strict=True):
        spans = int((np.diff(np.r_[0, c.astype(int)]) == 1).sum())
        out.append((len(t), int(c.sum()), spans, bytes(b for b, gone in zip(t, c, strict=True) if not gone)))
    return out


def passages(rng, n):
    shared = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([20, 45, 90]))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts.append(rng.choice(shared) if rng.random() < 0.6 else "".join(rng.choice("xyz ") for _ in range(30)))
        texts.append("".join(parts))
    return texts


def removed(spark, texts, ids=None, **settings):
    rows = list(zip(ids or range(len(texts)), texts, strict=True))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns(
        {"id": F.lit("clash"), "spans": F.lit(0), "row_hash": F.lit(1)}
    )
    return [tuple(r) for r in suffix_dedup.without_repeats(docs, **settings).collect()]


@pytest.mark.parametrize("limit", [2, 2048])
def test_repeats_equal_brute_force(spark, limit):
    rng = random.Random(limit)
    texts = [*passages(rng, 40), "", "ab" * 100, "a" * 130, "é" * 60]
    got = sorted(removed(spark, texts, min_bytes=24, gram=6, limit=limit))
    want = brute_repeats([t.encode() for t in texts], 24)
    assert [(n, r, s, bytes(k)) for _, n, r, s, k in got] == want


def test_repeats_of_odd_rows(spark):
    assert removed(spark, []) == []
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh") for _ in range(60))
    got = removed(spark, [text, text, None, text, ""], ids=[1, 1, None, None, 2], min_bytes=24, gram=6)
    by_id = sorted((str(i), n, r, s, bytes(k)) for i, n, r, s, k in got)
    assert by_id == [("1", 60, 60, 1, b"")] * 2 + [("2", 0, 0, 0, b""), ("None", 0, 0, 0, b""), ("None", 60, 60, 1, b"")]
    assert removed(spark, [text], min_bytes=24, gram=6)[0][2] == 0
    with pytest.raises(ValueError):
        removed(spark, [text], min_bytes=4, gram=6)


def test_repeats_in_long_texts(spark):
    rng = np.random.default_rng(3)
    long = bytes(rng.integers(97, 123, 3_000_000, dtype=np.uint8)).decode()
    other = long[1_000_000:1_000_450] + "-" + long[500_000 : 500_399] + "+" + long[262_000:262_400]
    got = {r[0]: r for r in removed(spark, [long, other])}
    assert got[0][1:4] == (3_000_000, 850, 2)
    assert got[1][1:4] == (len(other), 850, 2)


def test_transform_on_random_groups():
    rng = random.Random(1)
    for _ in range(150):
        size = rng.choice([1, 2, 3, 5, 8, 12])
        base = [bytes(rng.choice(b"ab") for _ in range(40)) for _ in range(2)]
        texts, left, groups = [], [], []
        for _ in range(rng.randint(1, 12)):
            line = bytearray(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                line[rng.randrange(40)] = rng.choice(b"abc")
            a = rng.randint(0, 20)
            texts.append(bytes(line[a : rng.randint(a, 40)]))
            left.append(20 - a)
            groups.append(rng.randint(0, 1))
        seen = defaultdict(set)
        for i, t in enumerate(texts):
            for a in range(len(t) - size + 1):
                seen[groups[i], left[i] - a, t[a : a + size]].add((i, a))
        want = set().union(*[v for v in seen.values() if len(v) > 1])
        got = {
            (int(s), w)
            for s, first, last in zip(*suffix_dedup.repeated_windows(texts, np.array(groups), np.array(left), size), strict=True)
            for w in range(first, last + 1)
        }
        assert got == want


# --- Merkle manifest ---------------------------------------------------------------------


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    return sha("".join(map(value, (doc_id, source, lang, n_chars, text))))


def tree(hashes, arity):
    """Root, and per leaf the (left, right) texts of its siblings up to it."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for i, node in enumerate(at):
            run = node - node % arity
            paths[i].append(("".join(hashes[run:node]), "".join(hashes[node + 1 : run + arity])))
        hashes = [sha("".join(hashes[i : i + arity])) for i in range(0, len(hashes), arity)]
        at = [node // arity for node in at]
    return hashes[0], paths


def brute_manifest(rows, arity):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops, inner = [], {}
    for g in order:
        ranked = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        top, paths = tree([leaf(r) for r in ranked], arity)
        tops.append(top)
        inner[g] = [(r, top, p) for r, p in zip(ranked, paths, strict=True)]
    root, upper = tree(tops, arity)
    return sorted(
        (str(r[0]), leaf(r), sub, root, p + up) for g, up in zip(order, upper, strict=True) for r, sub, p in inner[g]
    )


@pytest.mark.parametrize("arity", [2, 3, 8])
def test_manifest_equals_brute_force(spark, arity):
    rng = random.Random(arity)
    rows = [
        (i, rng.choice(["x", "É", "", None]), rng.choice(["en", "en", "en", "de", None, ""]), rng.choice(["s", None]), i)
        for i in range(75)
    ]
    rows += [(None, None, None, None, None), (3, "x", "en", "s", 3), (3, "x", "en", "s", 3), (80, "alone", "zz", "s", 5)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"tree": F.lit(1), "index": F.lit("clash"), "hash": F.lit(0)})
    made = merkle_manifest.manifest(docs, arity=arity)
    got = sorted(
        (str(r["doc_id"]), r["leaf"].hex(), r["subroot"].hex(), r["root"].hex(), [(a.hex(), b.hex()) for a, b in r["path"]])
        for r in made.collect()
    )
    assert got == brute_manifest(rows, arity)
    for r in made.select("root", merkle_manifest.fold(F.col("leaf"), F.col("path")).alias("again")).collect():
        assert r["root"] == r["again"]


def test_manifest_tells_changed_rows(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(["Big", "small", None, "", "ÄB"])]
    made = merkle_manifest.manifest(
        spark.createDataFrame(rows, DOCS), tampered={"text": merkle_manifest.lower_ascii(F.col("text"))}
    )
    folded = merkle_manifest.fold(F.col("other_leaf"), F.col("path"))
    held = {r["doc_id"]: r["held"] for r in made.select("doc_id", (folded == F.col("root")).alias("held")).collect()}
    assert held == {0: False, 1: True, 2: True, 3: True, 4: False}


def test_manifest_of_one_and_none(spark):
    assert merkle_manifest.manifest(spark.createDataFrame([], DOCS)).collect() == []
    (row,) = merkle_manifest.manifest(spark.createDataFrame([(1, "t" * 2_000_000, None, None, None)], DOCS)).collect()
    assert row["leaf"] == row["subroot"] == row["root"] and row["path"] == []
