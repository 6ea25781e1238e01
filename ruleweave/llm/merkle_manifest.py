"""Merkle manifest of a table: leaves, one tree per group, one tree over the groups, proofs.

A tree is built level by level. At every level the nodes are equijoined with the nodes whose
indices are their siblings': ``index XOR 1`` in a binary tree, the other slots of the run
otherwise. Slot-zero rows then emit the parents, one per run. What a level finds (each
node's siblings left and right of it) is kept, so that proofs are put together from the
root down: a node's path is its own siblings followed by its parent's path, a join in which
a parent meets at most ``arity`` children, however large its group is.

Everything is DataFrame functions. A level is written and read again; no group is gathered
anywhere, rows hold at most the ``arity - 1`` siblings of one node per level of the tree.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import numbered
from ..session import BROADCAST_ROWS, materialize

#: Nodes that share a parent.
ARITY = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    """SHA-256 of a text, as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def hexed(digests: Column) -> Column:
    """Lowercase hex text of one digest or of several in a row; what is hashed, and shown."""
    return F.lower(F.hex(digests))


def field(value: Column) -> Column:
    """A value with its length: ``-`` if null, else its UTF-8 bytes' count, ``:``, itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    """Digest of a row's fields in the given order."""
    return digest(F.concat(*[field(v) for v in values]))


def sibling_indices(index: Column, arity: int) -> Column:
    """Indices of the other slots of a node's run; some of them may not exist."""
    if arity == 2:
        return F.array(index.bitwiseXOR(F.lit(1)))
    slot = index % arity
    return F.array(*[index - slot + (slot + shift) % arity for shift in range(1, arity)])


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes (tree, index, size, hash) with the digests of their siblings left and right."""
    wanted = nodes.select("tree", "index", F.explode(sibling_indices(F.col("index"), arity)).alias("wanted"))
    others = nodes.select("tree", F.col("index").alias("wanted"), F.col("hash").alias("other"))
    found = (
        wanted.join(others, ["tree", "wanted"])
        .groupBy("tree", "index")
        .agg(F.array_sort(F.collect_list(F.struct("wanted", "other"))).alias("others"))
    )

    def side(keep: Callable[[Column], Column]) -> Column:
        kept = F.filter("others", lambda o: keep(o["wanted"]))
        return F.coalesce(F.aggregate(kept, F.lit(b""), lambda sofar, o: F.concat(sofar, o["other"])), F.lit(b""))

    return nodes.join(found, ["tree", "index"], "left").select(
        "tree",
        "index",
        "size",
        "hash",
        side(lambda i: i < F.col("index")).alias("left"),
        side(lambda i: i > F.col("index")).alias("right"),
    )


def build_trees(nodes: DataFrame, arity: int = ARITY) -> tuple[list[DataFrame], DataFrame]:
    """Levels of the trees over ``nodes`` (tree, index, size, hash), and the trees' roots.

    ``size`` is the number of nodes of the tree at that level, ``index`` runs from 0. A level
    holds the nodes of trees that have several nodes there, with ``left`` and ``right``, the
    digests of their siblings in a row. Digests are bytes; their hex text is what is hashed. A tree of one node has that node as its root. No nodes give no
    levels and no roots.
    """
    levels: list[DataFrame] = []
    roots = nodes.where("size = 1").select("tree", "hash")
    rest = nodes.where("size > 1")
    while not rest.isEmpty():
        level = materialize(_with_siblings(rest, arity))
        levels.append(level)
        parents = level.where(F.col("index") % arity == 0).select(
            "tree",
            F.floor(F.col("index") / arity).alias("index"),
            F.ceil(F.col("size") / arity).alias("size"),
            digest(hexed(F.concat("left", "hash", "right"))).alias("hash"),
        )
        roots = roots.unionByName(parents.where("size = 1").select("tree", "hash"))
        rest = parents.where("size > 1")
    return levels, roots


def node_paths(levels: Sequence[DataFrame], arity: int = ARITY) -> DataFrame | None:
    """(tree, index, path) of the nodes of the lowest level; None if there are no levels.

    ``path`` is an array of (left, right), from the node's own siblings up to its tree's root.
    """
    paths: DataFrame | None = None
    for level in reversed(levels):
        own = F.array(F.struct("left", "right"))
        if paths is None:
            paths = level.select("tree", "index", own.alias("path"))
            continue
        above = paths.select("tree", F.col("index").alias("up"), F.col("path").alias("rest"))
        below = level.select("tree", "index", F.floor(F.col("index") / arity).alias("up"), own.alias("own"))
        # The parent may be the root of its tree: then no level above holds it.
        paths = below.join(above, ["tree", "up"], "left").select(
            "tree",
            "index",
            F.when(F.col("rest").isNull(), F.col("own")).otherwise(F.concat("own", "rest")).alias("path"),
        )
    return paths


def fold(leaf: Column, path: Column) -> Column:
    """Root recomputed from a leaf and the siblings on its path."""
    return F.aggregate(
        path, leaf, lambda node, step: digest(hexed(F.concat(step["left"], node, step["right"])))
    )


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return digest(hexed(F.aggregate(
        path, F.lit(b""), lambda sofar, step: F.concat(sofar, step["left"], step["right"])
    )))


def _small(df: DataFrame) -> DataFrame:
    """The table, broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def manifest(
    rows: DataFrame,
    id_col: str = "doc_id",
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    group_col: str = "lang",
    tampered: dict[str, Column] | None = None,
    tampered_where: Column | None = None,
    arity: int = ARITY,
) -> DataFrame:
    """(id, leaf, subroot, root, path, other_leaf), one row per row of ``rows``.

    All digests are bytes (``hexed`` gives their text). A leaf is the digest of a row's ``fields``. Leaves of a group (a value of ``group_col``;
    null is a group of its own) ascend by id, null ids first, rows of one id by leaf; they
    give the group's subroot. Subroots ascend by group, null first, bytewise; they give the
    root. ``path`` holds a leaf's siblings up to the root, as (left, right) per level.
    ``other_leaf`` is the digest with the fields in ``tampered`` replaced in the rows of
    ``tampered_where``, elsewhere the leaf itself. Equal rows are leaves of their own with
    equal digests. Empty texts are values of length 0, unlike nulls. Texts are hashed whole
    in their row. One row alone is leaf, subroot and root, with an empty path. An empty
    table gives no rows. Columns that are not named are ignored; the names used here are
    made after the fields are read, so that they cannot clash.
    """
    leaf = leaf_digest([F.col(c) for c in fields])
    other = leaf
    if tampered:
        changed = leaf_digest([tampered.get(c, F.col(c)) for c in fields])
        where = F.lit(True) if tampered_where is None else tampered_where
        other = F.when(where, changed).otherwise(leaf)
    leaves = materialize(
        rows.select(
            F.col(id_col).alias("id"), F.col(group_col).alias("grp"), leaf.alias("leaf"), other.alias("other_leaf")
        )
    )
    ordered = materialize(numbered(leaves, "grp", "id", "leaf", "other_leaf", name="nth"))
    groups = ordered.groupBy("grp").agg(
        F.min("nth").alias("first"), F.count(F.lit(1)).alias("size")
    )
    groups = materialize(numbered(groups, "grp", name="tree"))
    n_groups = groups.count()
    placed = ordered.join(_small(groups), ordered["grp"].eqNullSafe(groups["grp"])).select(
        "id", "leaf", "other_leaf", "tree", (F.col("nth") - F.col("first")).alias("index"), "size"
    )
    placed = materialize(placed)

    levels, subroots = build_trees(placed.select("tree", "index", "size", F.col("leaf").alias("hash")), arity)
    subroots = materialize(subroots)
    tops = subroots.select(
        F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("index"), F.lit(n_groups).alias("size"), "hash"
    )
    top_levels, root = build_trees(tops, arity)

    nothing = F.array().cast("array<struct<left:binary,right:binary>>")
    upper = node_paths(top_levels, arity)
    ends = subroots.withColumnRenamed("hash", "subroot")
    if upper is None:
        ends = ends.withColumn("upper", nothing)
    else:
        ends = ends.join(upper.select(F.col("index").alias("tree"), F.col("path").alias("upper")), "tree")
    top = root.first()  # one row, none for an empty table
    ends = _small(materialize(ends.withColumn("root", F.lit(bytes(top["hash"]) if top else None).cast("binary"))))

    lower = node_paths(levels, arity)
    if lower is None:
        pathed = placed.withColumn("lower", nothing)
    else:
        pathed = placed.join(lower.withColumnRenamed("path", "lower"), ["tree", "index"], "left")
    return pathed.join(ends, "tree").select(
        F.col("id").alias(id_col),
        "leaf",
        "subroot",
        "root",
        F.concat(F.coalesce("lower", nothing), F.col("upper")).alias("path"),
        "other_leaf",
    )


def lower_ascii(text: Column) -> Column:
    """A-Z become a-z, nothing else changes."""
    return F.translate(text, UPPER, LOWER)
