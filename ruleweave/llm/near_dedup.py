"""Near duplicates: banded MinHash, odd sketches to screen pairs, full sets to confirm.

A text's set holds 64-bit hashes of its distinct word shingles. MinHash takes one sample
per hash function; the odd sketch folds the samples into a bitmap in which each one flips a
bit. Samples two texts share cancel out in the XOR of their bitmaps, so its population count
tells how many they do not share, precisely for high similarities.

Texts that agree in a whole band of samples are candidates. A bucket of a band is never
expanded into all its pairs: each round (the first one over a few bands only) names one
member of every bucket as its head, screens and confirms the others against the heads, joins what is linked into
components, and goes on only with buckets whose members still belong to different
components. Heads are taken out once all others have met them. When a round joins little,
the pairs of different components that are left in the buckets are tested if they are few;
else those are tested that the counts of rare shingles do not rule out (``split_pairs``).
Pairs inside a component are never tested again. Texts with equal sets take part once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..session import materialize
from .components import components, if_small
from .memories import claim

#: Bands and samples per band. A pair at similarity 0.8 shares no band with probability
#: (1 - 0.8^7)^64 = 2.9e-7; links along other members of its component remain besides.
BANDS, ROWS = 64, 7
#: Bands of the first round, which joins most of each large group.
FIRST_BANDS = 6
#: 64-bit words of an odd sketch.
SKETCH_WORDS = 16
#: The screen passes a pair unless its estimate is this many deviations below the least
#: similarity that counts.
DEVIATIONS = 6.0
#: Texts per file of the tables written between rounds.
PER_FILE = 8_000
#: All remaining pairs are tested at once when they are at most this many per text.
PAIRS_PER_TEXT = 4
#: Rounds of heads go on while they give a link for every so many texts.
TEXTS_PER_LINK = 100
#: Shingles in at most this many sets of mixed buckets are rare.
RARE = 40
#: Ratio of the sizes that one size class spans.
CLASS = 1.05

_WORDS: dict[bytes, int] = {}
_REMEMBERED = 250_000
#: Longer words are hashed each time they come.
_LONG = 100
_MASK = (1 << 64) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly; the finishing steps of a common 64-bit mixer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text; empty without words.

    Words are runs of characters other than ASCII white space, A-Z lower-cased. A text of
    fewer words than a shingle has all of them as its only shingle.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    if len(_WORDS) > _REMEMBERED:
        _WORDS.clear()
    get, hashed = _WORDS.get, []
    for word in found:
        h = get(word)
        if h is None:
            h = xxhash.xxh3_64_intdigest(word)
            if len(word) <= _LONG:
                _WORDS[word] = h
        hashed.append(h)
    h = np.array(hashed, dtype=np.uint64)
    span = min(words, len(h))
    last = len(h) - span + 1
    mix = np.full(last, span, dtype=np.uint64)
    for i in range(span):
        mix = _mixed(mix * np.uint64(0x9E3779B97F4A7C15) + h[i : i + last])
    return np.unique(mix)


def samples(hashes: np.ndarray, k: int, seed: int) -> np.ndarray:
    """MinHash samples: the least value of each of ``k`` random functions of 32 bits."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, k, dtype=np.uint32)
    least = np.full(k, np.uint32(0xFFFFFFFF), dtype=np.uint32)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    step = max(1, (1 << 17) // k)
    for start in range(0, len(low), step):
        values = low[start : start + step, None] * a
        values += b
        np.minimum(least, values.min(axis=0), out=least)
    return least.astype(np.uint64)


def odd_sketch(least: np.ndarray, words: int) -> np.ndarray:
    """Each sample flips one bit of the bitmap, chosen by the sample and its number."""
    bits = _mixed(least ^ _mixed(np.arange(len(least), dtype=np.uint64) + np.uint64(1)))
    at = (bits % np.uint64(64 * words)).astype(np.int64)
    flips = np.bincount(at, minlength=64 * words) & 1
    return np.packbits(flips.astype(np.uint8)).view(">u8").astype(np.int64)


def flips_allowed(k: int, bits: int, similarity: float, deviations: float = DEVIATIONS) -> int:
    """Largest population count of an XOR that passes the screen at this similarity.

    The samples that differ follow a binomial law; each puts two flips into the XOR.
    """
    differ = k * (1 - similarity) + deviations * (k * similarity * (1 - similarity)) ** 0.5
    flips = 2 * min(differ, k)
    expected = bits / 2 * (1 - (1 - 2 / bits) ** flips)
    spread = (bits / 4 * (1 - (1 - 4 / bits) ** flips)) ** 0.5
    return int(expected + deviations / 2 * spread) + 1


def signatures(
    docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int, seed: int
) -> DataFrame:
    """(id, row_hash, n_shingles, digest, bands, sketch), a row per document."""
    schema = (
        "id__ {0}, row_hash bigint, n_shingles bigint, digest binary, bands array<bigint>, "
        "sketch array<bigint>"
    )
    chosen = docs.select(
        F.col(id_col).alias("id__"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("row_hash"),
        F.col(text_col).alias("text__"),
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near_dedup", _WORDS.clear)
        for batch in batches:
            size, digest, keys, sketch = [], [], [], []
            for text in batch.column(2).to_pylist():
                hashes = shingle_set(text, words)
                size.append(len(hashes))
                digest.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                if not len(hashes):
                    keys.append([])
                    sketch.append([])
                    continue
                least = samples(hashes, bands * rows, seed)
                band = np.arange(bands, dtype=np.uint64)
                for i in range(rows):
                    band = _mixed(band * np.uint64(0x9E3779B97F4A7C15) + least[i::rows])
                keys.append(band.view(np.int64))
                sketch.append(odd_sketch(least, SKETCH_WORDS))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(size, pa.int64()),
                    pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                    pa.array(sketch, pa.list_(pa.int64())),
                ],
                names=["id__", "row_hash", "n_shingles", "digest", "bands", "sketch"],
            )

    kind = chosen.schema["id__"].dataType.simpleString()
    return chosen.mapInArrow(sign, schema.format(kind))


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(node, members): full shingle sets of the documents named in ``wanted``."""
    rows = docs.select(
        F.col(id_col).alias("node"),
        F.col(text_col).alias("text__"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("row_hash"),
    )
    chosen = rows.join(wanted, ["node", "row_hash"], "left_semi").select("node", "text__")
    kind = StructType([chosen.schema["node"], StructField("members", ArrayType(LongType()))])

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near_dedup", _WORDS.clear)
        for batch in batches:
            sets = [shingle_set(t, words).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "members"]
            )

    return chosen.mapInArrow(full, kind)


def _xor_count(a: str, b: str) -> Column:
    """Population count of the XOR of two sketches."""
    counts = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH_WORDS)]
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    return total


def _confirmed(
    pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str,
    words: int, percent: int, allowed: int, files: int,
) -> DataFrame:
    """Links among candidate pairs (a, b): screened by sketches, confirmed on full sets."""
    facts = nodes.select("node", "n_shingles", "sketch")
    left = facts.select(*[F.col(c).alias(f"{c}_a") for c in facts.columns])
    right = facts.select(*[F.col(c).alias(f"{c}_b") for c in facts.columns])
    screened = materialize(
        pairs.distinct()
        .join(left, F.col("a") == F.col("node_a"))
        .join(right, F.col("b") == F.col("node_b"))
        .where(
            (100 * F.least("n_shingles_a", "n_shingles_b") >= percent * F.greatest("n_shingles_a", "n_shingles_b"))
            & (_xor_count("sketch_a", "sketch_b") <= allowed)
        )
        .select("a", "b")
        .coalesce(files)
    )
    named = screened.select(F.col("a").alias("node")).unionByName(screened.select(F.col("b").alias("node"))).distinct()
    wanted = materialize(
        nodes.join(named, "node", "left_semi").select("node", "row_hash").distinct().coalesce(files)
    )
    # With few texts wanted, the others need not move.
    sets = materialize(_sets(docs, if_small(wanted, wanted.count()), id_col, text_col, words))
    both = (
        screened.join(sets.select(F.col("node").alias("a"), F.col("members").alias("set_a")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("members").alias("set_b")), "b")
        .withColumn("shared", F.size(F.array_intersect("set_a", "set_b")).cast("bigint"))
    )
    union = F.size("set_a") + F.size("set_b") - F.col("shared")
    linked = both.where(100 * F.col("shared") >= percent * union).select("a", "b")
    return materialize(linked.distinct().coalesce(files))


def split_pairs(met: DataFrame, sets: DataFrame, percent: int, rare: int = RARE) -> DataFrame:
    """Pairs (a, b) of different labels in ``met``(bucket, node, label) that can be linked.

    ``sets``(node, members) holds the full sets. Every pair of a bucket that is linked is
    among the result, with repetition. Rare shingles stand in at most ``rare`` of the sets.

    Order shingles from rare to frequent. The first one that two linked sets share is among
    the first ``n - least overlap + 1`` of either. If it is rare, it leads to the pair, unless
    too few shingles come after it in either set. If it is frequent, the sets share no rare one: of n and m shingles, r and s of them rare, they
    share min(n - r, m - s) at most and have max(n + s, m + r) or more in all. Texts that
    differ from a common one in places of their own are apart by these numbers alone, so a
    bucket's sets meet by size classes, the smaller one in its class, the larger one in those
    it can reach, and only where labels differ.
    """
    ratio = percent / 100
    listed = materialize(
        sets.dropDuplicates(["node", "members"]).select("node", F.xxhash64("members").alias("set"), "members")
    )
    shingles = listed.select("node", "set", F.size("members").alias("n"), F.explode("members").alias("shingle"))
    counted = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("met"))
    frequent = materialize(counted.where(F.col("met") > rare).select("shingle"))
    few = shingles.join(if_small(frequent, frequent.count()), "shingle", "left_anti")
    # Lists of at most ``rare`` entries.
    holders = few.groupBy("shingle").agg(F.collect_list(F.struct("node", "set", "n")).alias("held"))
    spread = holders.select("shingle", F.size("held").alias("met"), F.inline("held"))
    order = Window.partitionBy("node", "set").orderBy("met", "shingle")
    placed = materialize(spread.withColumn("nth", F.row_number().over(order)))

    labels = met.select("node", "label").distinct()
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    shown = placed.where((F.col("met") > 1) & (F.col("nth") <= prefix)).join(labels, "node")
    after = (F.col("n") - F.col("nth")).alias("after")
    lists = shown.groupBy("shingle").agg(F.collect_list(F.struct("node", "label", "n", after)).alias("held"))
    both = lists.where(F.size("held") > 1).select(
        F.explode(
            F.flatten(
                F.transform(
                    "held",
                    lambda x: F.transform(
                        F.filter(
                            "held",
                            lambda y: (x["node"] < y["node"]) & (x["label"] != y["label"])
                            & ((100 + percent) * (1 + F.least(x["after"], y["after"])) >= percent * (x["n"] + y["n"])),
                        ),
                        lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")),
                    ),
                )
            )
        ).alias("pair")
    )
    by_rare = both.select("pair.a", "pair.b")

    numbers = placed.groupBy("node", "set").agg(F.count(F.lit(1)).alias("rare"))
    facts = listed.select("node", "set", F.size("members").alias("n")).join(numbers, ["node", "set"], "left")
    facts = facts.select("node", "n", F.coalesce("rare", F.lit(0)).alias("rare")).distinct()

    def size_class(n: Column) -> Column:
        return F.floor(F.log(n) / F.log(F.lit(CLASS))).cast("int")

    reach = F.least(F.col("n").cast("double"), (F.col("n") - F.col("rare")) / ratio - F.col("rare"))
    rows = materialize(
        met.select("bucket", "node", "label").join(facts, "node")
        .withColumn("reach", reach).where(F.col("reach") >= 0.999 * ratio * F.col("n"))
    )
    large = rows.withColumn(
        "class",
        F.explode(F.sequence(size_class(0.999 * ratio * F.col("n")), size_class(1.001 * F.col("reach")))),
    ).drop("reach")
    small = rows.where(100 * (F.col("n") - F.col("rare")) >= percent * (F.col("n") + F.col("rare"))).withColumn(
        "class", size_class(F.col("n").cast("double"))
    ).drop("reach")
    place = ["bucket", "class"]
    sides = large.select(*place, "label", F.lit(0).alias("smaller")).unionByName(
        small.select(*place, "label", F.lit(1).alias("smaller"))
    )
    mixed = materialize(
        sides.groupBy(*place).agg(
            F.min("label").alias("low"), F.max("label").alias("high"), F.max("smaller").alias("smaller")
        ).where("low <> high and smaller = 1").select(*place)
    )
    left = large.join(mixed, place).select(*place, *[F.col(c).alias(f"{c}_a") for c in ("node", "label", "n", "rare")])
    right = small.join(mixed, place).select(*place, *[F.col(c).alias(f"{c}_b") for c in ("node", "label", "n", "rare")])
    by_size = left.join(right, place).where(
        (F.col("label_a") != F.col("label_b"))
        & (F.col("n_a") >= F.col("n_b"))
        & (
            100 * F.least(F.col("n_a") - F.col("rare_a"), F.col("n_b") - F.col("rare_b"))
            >= percent * F.greatest(F.col("n_a") + F.col("rare_b"), F.col("n_b") + F.col("rare_a"))
        )
    ).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    return by_rare.unionByName(by_size)


def near_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
    seed: int = 11,
    pairs_per_text: int = PAIRS_PER_TEXT,
) -> DataFrame:
    """Components of texts whose shingle sets have a similarity of ``percent`` or more.

    Gives (id, row_hash, n_shingles, component_id, kept), one row per row of ``docs``.
    ``component_id`` is the smallest id that can be reached by links, ``kept`` tells whether
    it is the row's own. Texts without words (null and empty ones too) are linked with
    nothing. Rows that repeat an id are one document: its links are those of all its rows,
    and each row is returned with the size of its own set. A row without an id cannot be
    named: it takes no part, has a null component and is kept. An empty table gives no rows.
    """
    signed = materialize(signatures(docs, id_col, text_col, words, bands, rows, seed))
    real = signed.where("id__ is not null and n_shingles > 0")
    # Equal sets take part once, under the smallest id.
    groups = materialize(real.groupBy("digest").agg(F.min("id__").alias("rep")))
    kind = signed.schema["id__"].dataType
    nodes = materialize(
        real.join(groups.withColumnRenamed("rep", "id__"), ["digest", "id__"], "left_semi")
        .withColumnRenamed("id__", "node")
        .dropDuplicates(["node", "digest"])
        .select("node", "row_hash", "n_shingles", "sketch", "bands")
    )
    members = real.select("id__", "digest").join(groups, "digest").select("id__", "rep")
    # Different sets under one id belong together.
    ids = members.groupBy("id__").agg(F.min("rep").alias("a"), F.max("rep").alias("high"))
    split = ids.where("a <> high").select("id__", "a")
    same_id = members.join(split, "id__").select("a", F.col("rep").alias("b")).where("a <> b")

    n_nodes = nodes.count()
    files = n_nodes // PER_FILE + 1  # of the tables between rounds, which follow the texts
    allowed = flips_allowed(bands * rows, 64 * SKETCH_WORDS, percent / 100)
    keyed = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    several = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("met")).where("met > 1")
    met_often = materialize(keyed.join(several, "bucket"))
    # A text that meets many others makes the best head: copies of one text link to it,
    # though they may not to each other.
    crowd = met_often.groupBy("node").agg((-F.sum("met")).alias("rank"))
    shared = materialize(met_often.drop("met").distinct().join(crowd, "node"))
    links = materialize(same_id.distinct().coalesce(files))
    labels = components(links)
    open_rows = shared.where(F.col("band") < FIRST_BANDS)
    whole = False  # whether all bands are in play
    joined = n_nodes  # links that the last round found
    last = False
    while not last:
        labelled = open_rows.join(if_small(labels, labels.count()), "node", "left").select(
            "bucket", "rank", "node", F.coalesce("label", "node").alias("label")
        )
        mixed = labelled.groupBy("bucket").agg(
            F.min(F.struct("rank", "node", "label")).alias("head"), F.min("label").alias("low"), F.max("label").alias("high"),
        )
        mixed = materialize(mixed.where("low <> high").select("bucket", "head").coalesce(files))
        if mixed.isEmpty() and whole:
            break
        # Members of different components than a head of their bucket.
        met = materialize(
            labelled.join(mixed, "bucket")
            .withColumn("is_head", F.col("head.node") == F.col("node"))
        )
        few = False
        if whole and pairs_per_text:
            per_label = met.groupBy("bucket", "label").agg(F.count(F.lit(1)).cast("double").alias("n"))
            total = (
                per_label.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"))
                .agg(F.coalesce(F.sum(F.col("n") * F.col("n") - F.col("nn")) / 2, F.lit(0.0))).first()[0]
            )
            few = total <= pairs_per_text * n_nodes
        last = whole and (few or joined * TEXTS_PER_LINK < n_nodes)
        if last and few:
            one = met.select("bucket", F.col("node").alias("a"), F.col("label").alias("label_a"))
            others = met.select("bucket", F.col("node").alias("b"), F.col("label").alias("label_b"))
            pairs = one.join(others, "bucket").where("label_a <> label_b and a < b").select("a", "b")
        elif last:
            wanted = nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", "row_hash").distinct()
            wanted = materialize(wanted.coalesce(files))
            sets = _sets(docs, if_small(wanted, wanted.count()), id_col, text_col, words)
            pairs = split_pairs(met, materialize(sets), percent)
        else:
            headed = met.where("label <> head.label")
            pairs = headed.select(
                F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b")
            )
        found = _confirmed(pairs, nodes, docs, id_col, text_col, words, percent, allowed, files)
        joined = found.count()
        links = materialize(links.unionByName(found).coalesce(files))
        labels = components(links)
        if whole:  # heads have met all the others of their buckets
            open_rows = met.where("not is_head").select("bucket", "rank", "node")
        else:
            open_rows, whole = shared, True

    named = materialize(
        groups.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
            "digest", F.coalesce("label", "rep").cast(kind).alias("label")
        )
    )
    out = signed.join(named, "digest", "left")
    component = F.when(F.col("id__").isNull(), F.lit(None)).otherwise(
        F.when(F.col("n_shingles") == 0, F.col("id__")).otherwise(F.col("label"))
    )
    return out.select(
        F.col("id__").alias(id_col),
        "row_hash",
        "n_shingles",
        component.alias("component_id"),
        F.col("id__").eqNullSafe(component).alias("kept"),
    )


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One document of each component, with all its columns; rows without an id stay."""
    stay = near_components(docs, id_col, text_col, **settings).where("kept").select(
        F.col(id_col).alias("id__")
    ).where("id__ is not null")
    named = docs.join(stay, F.col(id_col) == F.col("id__"), "left_semi")
    return named.unionByName(docs.where(F.col(id_col).isNull()))
