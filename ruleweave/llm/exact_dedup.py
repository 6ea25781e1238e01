"""Exact duplicates by composable polynomial fingerprints, confirmed piece by piece.

A text is cut into pieces. Each piece, without its white space, gets a polynomial hash
``sum(byte * base^(bytes after it))`` under two prime moduli and the factor
``base^(its bytes)`` by which whatever stands before it is shifted. Fingerprints of texts
follow from those of their pieces by ``left * shift(right) + right``, so a huge text is
hashed piece by piece and put together from three numbers each. Texts with equal
fingerprints are then compared piece by piece with one text of their group; what differs
forms a group of its own and is compared again, until nothing differs.

Large groups are split: members are dealt out by salt, and the one text they are compared
with is repeated once per salt, so no task holds a whole group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Deleted before texts are compared.
BLANKS = " \t\n\x0b\x0c\r"
#: Code points per piece; bounds the memory of a comparison.
PIECE = 1 << 18
#: Primes and bases of the two hashes.
MODULI = (2_147_483_647, 2_147_483_629)
BASES = (1_000_003, 998_244_353)
#: Members compared with one copy of their group's text.
PER_SALT = 256

_POWERS: dict[tuple[int, int], np.ndarray] = {}


def squeezed(text: Column) -> Column:
    """The text without the characters that do not count."""
    return F.translate(text, BLANKS, "")


def powers(base: int, modulus: int, size: int) -> np.ndarray:
    """base^0, base^1, ... under the modulus, at least ``size`` of them."""
    held = _POWERS.get((base, modulus))
    if held is None or len(held) < size:
        held = np.ones(1, dtype=np.uint64)
        while len(held) < size:  # twice as many by one multiplication
            shift = np.uint64(pow(base, len(held), modulus))
            held = np.concatenate([held, held * shift % np.uint64(modulus)])
        _POWERS[base, modulus] = held
    return held


def piece_hash(raw: bytes, base: int, modulus: int) -> tuple[int, int]:
    """Hash of some bytes, and the factor that shifts what stands before them.

    A product is below 2^39, so 2^24 of them are summed before the remainder is taken.
    """
    table = powers(base, modulus, len(raw) + 1)
    total, step = 0, 1 << 24
    data = np.frombuffer(raw, dtype=np.uint8)
    weights = table[: len(raw)][::-1]
    for start in range(0, len(raw), step):
        part = data[start : start + step].astype(np.uint64)
        total += int(np.dot(part, weights[start : start + step]))
    return total % modulus, int(table[len(raw)]) % modulus


def _hash_udf(moduli: Sequence[int], bases: Sequence[int]):
    blanks = BLANKS.encode()
    kind = pa.struct([("size", pa.int64())] + [(f"{n}{i}", pa.int64()) for i in (0, 1) for n in "hs"])

    @F.arrow_udf("struct<size:bigint,h0:bigint,s0:bigint,h1:bigint,s1:bigint>")
    def hashed(pieces: pa.Array) -> pa.Array:
        out = []
        for text in pieces.to_pylist():
            raw = text.encode().translate(None, blanks)
            row = {"size": len(raw)}
            for i, (base, modulus) in enumerate(zip(bases, moduli, strict=True)):
                row[f"h{i}"], row[f"s{i}"] = piece_hash(raw, base, modulus)
            out.append(row)
        return pa.array(out, type=kind)

    return hashed


def pieces_of(text: str, n_chars: str, size: int) -> Column:
    """A text cut into pieces of ``size`` code points; an empty text is one empty piece."""
    last = F.greatest(F.floor((F.col(n_chars) - 1) / size), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(F.col(text), i * size + 1, F.lit(size)))


def combined(pieces: Column, i: int, modulus: int) -> Column:
    """Fingerprint of a text from those of its pieces, in their order."""
    return F.aggregate(
        pieces,
        F.lit(0).cast("bigint"),
        lambda left, right: (left * right["hash"][f"s{i}"] + right["hash"][f"h{i}"]) % F.lit(modulus),
    )


def fingerprints(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Mapping[str, Column] | None = None,
    piece: int = PIECE,
    moduli: Sequence[int] = MODULI,
    bases: Sequence[int] = BASES,
) -> DataFrame:
    """(id, row_hash, n_chars, size, f0, f1, carried columns), a row per distinct (id, text).

    ``carry`` names columns computed from the row of a document and kept beside it.
    """
    carry = dict(carry or {})
    rows = docs.select(
        F.col(id_col).alias("id__"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text__"),
        *[c.alias(f"carry_{n}") for n, c in carry.items()],
    ).withColumns({"row_hash": F.xxhash64("text__"), "n_chars": F.length("text__").cast("bigint")})
    keys = ["id__", "row_hash", "n_chars", *[f"carry_{n}" for n in carry]]
    cut = rows.select(*keys, F.posexplode(pieces_of("text__", "n_chars", piece)).alias("no", "piece"))
    hashed = cut.select(*keys, "no", _hash_udf(moduli, bases)("piece").alias("hash"))
    # A few numbers per piece; equal rows of one document fall together here.
    whole = hashed.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.struct("no", "hash"))).alias("pieces")
    )
    return whole.select(
        F.col("id__").alias(id_col),
        "row_hash",
        "n_chars",
        F.aggregate("pieces", F.lit(0).cast("bigint"), lambda n, p: n + p["hash"]["size"]).alias("size"),
        *[combined(F.col("pieces"), i, m).alias(f"f{i}") for i, m in enumerate(moduli)],
        *[F.col(f"carry_{n}").alias(n) for n in carry],
    )


def _same_as_leader(
    docs: DataFrame, members: DataFrame, id_col: str, text_col: str, piece: int
) -> DataFrame:
    """Members of groups (with ``leader``, ``copies``) and whether each equals its leader."""
    print_cols = ["size", "f0", "f1"]
    texts = docs.select(
        F.col(id_col).alias("id__"), F.coalesce(F.col(text_col), F.lit("")).alias("text__")
    ).withColumn("row_hash__", F.xxhash64("text__"))
    held = members.join(
        texts,
        members[id_col].eqNullSafe(texts["id__"]) & (members["row_hash"] == texts["row_hash__"]),
    ).select(
        *print_cols,
        F.col("id__"),
        "row_hash",
        "leads",
        F.ceil(F.col("copies") / PER_SALT).cast("int").alias("salts"),
        squeezed(F.col("text__")).alias("bare"),
    )
    held = held.withColumn("bare_chars", F.length("bare").cast("bigint"))
    salted = held.withColumn(
        "salt",
        F.explode(
            F.when(F.col("leads"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(
                F.array(F.pmod(F.xxhash64("id__", "row_hash"), F.col("salts")).cast("int"))
            )
        ),
    )
    cut = salted.select(
        *print_cols, "salt", "id__", "row_hash", "leads", "bare_chars",
        F.posexplode(pieces_of("bare", "bare_chars", piece)).alias("no", "piece"),
    )
    on = [*print_cols, "salt", "no"]
    leaders = cut.where("leads").select(*on, F.col("piece").alias("wanted"), F.col("bare_chars").alias("long"))
    others = cut.where("not leads")
    compared = others.join(leaders, on, "left").select(
        "id__",
        "row_hash",
        *print_cols,
        (F.col("piece").eqNullSafe(F.col("wanted")) & F.col("bare_chars").eqNullSafe(F.col("long"))).alias("same"),
    )
    return compared.groupBy("id__", "row_hash", *print_cols).agg(F.min("same").alias("same"))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Mapping[str, Column] | None = None,
    piece: int = PIECE,
    moduli: Sequence[int] = MODULI,
    bases: Sequence[int] = BASES,
) -> DataFrame:
    """Groups of texts that are equal without white space, and which document stays.

    Gives (id, row_hash, keep_id, group_size, kept, n_chars, carried columns), one row per
    distinct pair of id and text: a row that repeats both is the same document. Null text
    counts as empty, so null, empty and blank texts are one group. The text with most code
    points stays, then the smallest id; a null id comes after all others. Different texts
    under one id are documents of their own; one of them is kept per group. An empty table
    gives no rows. ``row_hash`` (xxhash64 of the text) tells texts of one id apart.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, carry, piece, moduli, bases))
    key = ["size", "f0", "f1"]
    me = [id_col, "row_hash"]
    order = F.struct(
        F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("row_hash").alias("row")
    )
    # Groups of fingerprints, then of texts: class 0 equals the group's first text, class 1
    # the first of those that differ, and so on.
    rest, classes, nth = prints.select(*me, *key), [], 0
    while True:
        several = materialize(
            rest.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), F.min(order).alias("leader"))
            .where("copies > 1" if nth == 0 else "copies > 0")
        )
        members = rest.join(several, key).withColumn(
            "leads",
            F.col(id_col).eqNullSafe(F.col("leader.id")) & (F.col("row_hash") == F.col("leader.row")),
        )
        seen = _same_as_leader(docs, members, id_col, text_col, piece)
        checked = materialize(seen.withColumnRenamed("id__", id_col))
        leaders = several.select(
            F.col("leader.id").alias(id_col), F.col("leader.row").alias("row_hash"), *key
        )
        alike = leaders.unionByName(checked.where("same").select(*me, *key))
        classes.append(alike.withColumn("class", F.lit(nth)))
        rest, nth = checked.where("not same").select(*me, *key), nth + 1
        if rest.isEmpty():
            break
    grouped = classes[0]
    for more in classes[1:]:
        grouped = grouped.unionByName(more)

    # Documents with no equal fingerprint are groups of one and take no part in the join.
    best = F.struct((-F.col("n_chars")).alias("chars"), *[
        c.alias(n) for n, c in (("no_id", F.col(id_col).isNull()), ("id", F.col(id_col)), ("row", F.col("row_hash")))
    ])
    sized = grouped.join(
        prints.select(F.col(id_col).alias("id__"), F.col("row_hash").alias("row__"), "n_chars"),
        F.col(id_col).eqNullSafe(F.col("id__")) & (F.col("row_hash") == F.col("row__")),
    ).select(*me, *key, "class", "n_chars")
    stays = materialize(
        sized.groupBy(*key, "class").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("group_size"))
    )
    decided = sized.drop("n_chars").join(stays, [*key, "class"]).select(
        F.col(id_col).alias("id__"), F.col("row_hash").alias("row__"), "best", "group_size"
    )
    out = prints.join(
        decided,
        prints[id_col].eqNullSafe(F.col("id__")) & (prints["row_hash"] == F.col("row__")),
        "left",
    )
    alone = F.col("group_size").isNull()
    return out.select(
        F.col(id_col),
        "row_hash",
        F.when(alone, F.col(id_col)).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (
            alone | (F.col(id_col).eqNullSafe(F.col("best.id")) & (F.col("row_hash") == F.col("best.row")))
        ).alias("kept"),
        "n_chars",
        *list(carry or {}),
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, each once, with all their columns.

    Rows that repeat id and text are one document; the first found of them stays.
    """
    stay = exact_groups(docs, id_col, text_col).where("kept").select(
        F.col(id_col).alias("id__"), F.col("row_hash").alias("row__")
    )
    rows = docs.withColumn("row_hash__", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    chosen = rows.join(
        stay, F.col(id_col).eqNullSafe(F.col("id__")) & (F.col("row_hash__") == F.col("row__")), "left_semi"
    )
    total, distinct = (
        rows.groupBy(id_col, "row_hash__").count()
        .agg(F.sum("count"), F.count(F.lit(1))).first()
    )
    if (total or 0) > distinct:  # equal rows are there; else nothing needs to move for them
        chosen = chosen.dropDuplicates([id_col, "row_hash__"])
    return chosen.drop("row_hash__")
