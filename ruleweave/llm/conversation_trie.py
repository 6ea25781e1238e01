"""Prefix trie of conversations by ROLLUP over positional columns of turn ids.

Turns are numbered inside their conversations and replaced by ids of their content. A
conversation is cut into blocks of ``width`` positions; a block is one row with a column
per position and the id of the node that the turns before the block lead to. ``GROUP BY
node before, ROLLUP(t0, t1, ...)`` with ``grouping_id`` then aggregates every prefix of
every block in one job, however long the conversations are: a long conversation goes on in
further rows that are keyed by the prior block's node.

The id of a node is the sum of the digests of (position, turn id) of its path, in parts that
do not overflow. Sums of a path follow from those of its blocks by running totals over
ranges of (conversation, block), so that even one conversation that holds a third of all
turns is spread over tasks. Subtree totals are a second ROLLUP over the same columns: a node
adds to its prefixes in its own block, and what a conversation's smallest-member nodes add
in later blocks is carried to the conversation's earlier blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import in_ranges
from ..session import materialize

#: Positions of a block, that is columns of the ROLLUP.
WIDTH = 8
#: 32-bit parts of a node's id; sums of 2^31 of them fit into a bigint.
PARTS = [f"n{i}" for i in range(6)]
#: Ids whose decimal texts are joined in one row before they are hashed in order.
IDS_PER_ROW = 4096


def turn_id(role: Column, text: Column) -> Column:
    """128 bits of the SHA-256 of a turn; the role's length tells where the text begins."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substr(F.sha2(whole, 256), F.lit(1), F.lit(32)))


def step_parts(position: Column, turn: Column) -> Column:
    """What a turn at a position adds to the id of a path, as an array of parts."""
    hexed = F.sha2(F.concat(F.hex(turn), F.lit("@"), position.cast("string")), 256)
    return F.array(*[
        F.conv(F.substr(hexed, F.lit(1 + 8 * i), F.lit(8)), 16, 10).cast("bigint") for i in range(len(PARTS))
    ])


def before_in_key(df: DataFrame, key: str, order: str, values: Sequence[str], descending: bool = False) -> DataFrame:
    """Add ``before_<value>``: the sum over the rows of the same key that come earlier.

    Rows are summed inside ranges of (key, order); a key that goes over several ranges is
    carried on by the totals of its ranges, one row each.
    """
    ranged = in_ranges(df, key, order)
    turn = F.desc if descending else F.asc
    totals = ranged.groupBy(key, "range__").agg(*[F.sum(v).alias(f"{v}__") for v in values])
    earlier = Window.partitionBy(key).orderBy(turn("range__")).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        key, "range__", *[F.coalesce(F.sum(f"{v}__").over(earlier), F.lit(0)).alias(f"{v}__") for v in values]
    )
    carried = starts.where(" or ".join(f"{v}__ <> 0" for v in values))
    inside = Window.partitionBy("range__", key).orderBy(turn(order)).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumns({f"{v}_in": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}).join(
        carried, [key, "range__"], "left"
    ).select(
        *df.columns,
        *[(F.col(f"{v}_in") + F.coalesce(f"{v}__", F.lit(0))).alias(f"before_{v}") for v in values],
    )


def numbered_turns(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv, nth, turn_id, n_bytes): turns numbered from 0 inside their conversation.

    Null turns come first; equal turn numbers are ordered by the turn's id. Null role or text
    counts as empty. Rows without a conversation's id belong to none and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    small = materialize(
        turns.where(F.col(conv_col).isNotNull()).select(
            F.col(conv_col).cast("bigint").alias("conv"),
            F.col(turn_col).alias("turn"),
            turn_id(role, text).alias("turn_id"),
            F.octet_length(text).cast("bigint").alias("n_bytes"),
        )
    )
    order = ["turn", "turn_id"]
    ranged = in_ranges(small, "conv", *order)
    sizes = ranged.groupBy("conv", "range__").agg(F.count(F.lit(1)).alias("size"))
    earlier = Window.partitionBy("conv").orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv", "range__", F.sum("size").over(earlier).alias("start")).where("start is not null")
    inside = F.row_number().over(Window.partitionBy("range__", "conv").orderBy(*order)).cast("bigint")
    return ranged.withColumn("inside", inside).join(starts, ["conv", "range__"], "left").select(
        "conv", (F.col("inside") - 1 + F.coalesce("start", F.lit(0))).alias("nth"), "turn_id", "n_bytes"
    )


def rebuilt_turns(numbered: DataFrame, donor: Column, given: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are replaced by another's.

    ``donor`` and ``given`` are functions of ``conv``: the conversation that gives its first
    turns, and how many (``most`` at most). Gives turns (conv, pos, turn_id, n_bytes) and all
    conversations (conv, length), those without turns too. A donor that is absent gives none.
    """
    sizes = materialize(numbered.groupBy("conv").agg((F.max("nth") + 1).alias("size")))
    plan = sizes.select("conv", "size", donor.alias("donor"), given.cast("bigint").alias("given")).join(
        sizes.select(F.col("conv").alias("donor"), F.col("size").alias("donor_size")), "donor", "left"
    ).withColumn("base", F.least("given", F.coalesce("donor_size", F.lit(0))))
    plan = materialize(plan.select("conv", "size", "donor", "given", "base"))
    own = numbered.join(plan.select("conv", "given", "base"), "conv").where("nth >= given").select(
        "conv", (F.col("base") + F.col("nth") - F.col("given")).alias("pos"), "turn_id", "n_bytes"
    )
    first = numbered.where(F.col("nth") < most).withColumnRenamed("conv", "donor")
    taken = first.join(plan.select("donor", "conv", "given"), "donor").where("nth < given").select(
        "conv", F.col("nth").alias("pos"), "turn_id", "n_bytes"
    )
    length = F.col("base") + F.greatest(F.col("size") - F.col("given"), F.lit(0))
    return own.unionByName(taken), plan.select("conv", length.alias("length"))


def blocks(turns: DataFrame, convs: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row per conversation and block: (conv, block, length, t0.., before_n0.., n0..).

    ``t<i>`` is a struct of a turn's id and its text's bytes, null past the conversation's
    end. ``before_*`` is the id of the node before the block, ``n*`` what the block adds to
    it. Conversations without turns have a first block without turns.
    """
    parts = step_parts(F.col("pos"), F.col("turn_id"))
    placed = turns.select("conv", "pos", F.struct("turn_id", "n_bytes").alias("turn"), parts.alias("parts"))
    slots = [F.max(F.when(F.col("pos") % width == i, F.col("turn"))).alias(f"t{i}") for i in range(width)]
    sums = [F.sum(F.col("parts")[i]).alias(p) for i, p in enumerate(PARTS)]
    filled = placed.groupBy("conv", F.floor(F.col("pos") / width).alias("block")).agg(*slots, *sums)
    empty = convs.where("length = 0").select(
        "conv",
        F.lit(0).cast("bigint").alias("block"),
        *[F.lit(None).cast("struct<turn_id:binary,n_bytes:bigint>").alias(f"t{i}") for i in range(width)],
        *[F.lit(0).cast("bigint").alias(p) for p in PARTS],
    )
    chained = before_in_key(filled.unionByName(empty), "conv", "block", PARTS)
    return chained.join(convs, "conv")


def _rollup(rows: DataFrame, measures: str, width: int) -> DataFrame:
    """All prefixes of all blocks, with their depth, node id and parent's id."""
    spark, cols = rows.sparkSession, [f"t{i}" for i in range(width)]
    key = ", ".join(["block", *[f"before_{p}" for p in PARTS]])
    grouped = spark.sql(
        f"SELECT {key}, {', '.join(cols)}, {width} - bit_count(grouping_id()) AS inside, {measures} "
        f"FROM {{rows}} GROUP BY {key}, ROLLUP({', '.join(cols)})",
        rows=rows,
    )
    path = F.array(*[F.col(c) for c in cols])
    # Past a conversation's end columns are null: the prefix ends before them. The prefix of
    # no turns is a node in the first block only; elsewhere the prior block has it.
    last = F.when(F.col("inside") > 0, F.element_at(path, F.greatest(F.col("inside"), F.lit(1)).cast("int")))
    is_node = ((F.col("inside") == 0) & (F.col("block") == 0)) | last.isNotNull()
    nodes = grouped.withColumn("last", last).where(is_node)
    steps = F.transform(
        F.filter(path, lambda t: t.isNotNull()),
        lambda t, i: step_parts(F.col("block") * width + i, t["turn_id"]),
    )
    nodes = nodes.withColumns({"steps": steps, "depth": F.col("block") * width + F.col("inside")})

    def with_steps(taken: Column, part: int) -> Column:
        return F.aggregate(taken, F.col(f"before_{PARTS[part]}"), lambda total, step: total + step[part])

    def node_id(drop: int) -> Column:
        taken = F.slice("steps", 1, F.greatest(F.size("steps") - drop, F.lit(0)))
        sums = [with_steps(taken, i).alias(p) for i, p in enumerate(PARTS)]
        return F.struct((F.col("depth") - drop).alias("depth"), *sums)

    return nodes.withColumns({
        "node": node_id(0),
        "parent": F.when(F.col("depth") > 0, node_id(1)),
    }).drop("steps", "inside")


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's id texts, which come in order; state is one running digest."""
    node, running, node_type = None, None, None

    def rows(nodes: list, digests: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"node": pa.array(nodes, node_type), "ends_sha256": digests})

    for batch in batches:
        node_type = batch.schema.field("node").type
        done_nodes, done = [], []
        for now, text in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if now != node:
                if running is not None:
                    done_nodes.append(node)
                    done.append(running.hexdigest())
                node, running = now, hashlib.sha256(text.encode())
            else:
                running.update(b"," + text.encode())
        if done:
            yield rows(done_nodes, done)
    if running is not None:
        yield rows([node], [running.hexdigest()])


def ends_digests(members: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv): digest of the ascending ids, comma-joined.

    Ids of one span of ``IDS_PER_ROW`` are joined in parallel first. A digest over all of a
    node's ids is sequential by its nature: their texts pass one task, one row at a time.
    """
    spans = members.groupBy("node", F.floor(F.col("conv") / IDS_PER_ROW).alias("span")).agg(
        F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids")
    )
    ordered = spans.repartition("node").sortWithinPartitions("node", "span").select("node", "ids")
    node_type = ordered.schema["node"].dataType.simpleString()
    return ordered.mapInArrow(_hash_ids, f"node {node_type}, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row per distinct prefix of the conversations.

    ``turns`` is (conv, pos, turn_id, n_bytes), ``convs`` (conv, length) with every
    conversation. Gives (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256): the smallest conversation with the prefix, its number of
    turns, the parent's smallest conversation (null for the root), conversations with the
    prefix, child nodes, childless nodes of the subtree, the subtree's sum of (n_convs - 1)
    times the bytes of the last text, and the digest of the conversations that end there.
    Conversations without turns are members of the root alone. Equal conversations share all
    nodes. No conversations give no nodes, not even a root.
    """
    rows = materialize(blocks(turns, convs, width))
    nodes = materialize(_rollup(rows, "count(1) AS n_convs, min(conv) AS conv_id", width))
    children = materialize(
        nodes.where("parent is not null").groupBy(F.col("parent").alias("node"))
        .agg(F.count(F.lit(1)).alias("n_children"))
    )
    own = materialize(
        nodes.join(children, "node", "left").withColumns({
            "n_children": F.coalesce("n_children", F.lit(0).cast("bigint")),
            "leaf": F.col("n_children").isNull().cast("bigint"),
            "saved": (F.col("n_convs") - 1) * F.coalesce("last.n_bytes", F.lit(0)),
        })
    )
    # What nodes add to the prefixes in their own block, and, carried by their smallest
    # conversation, to those in its earlier blocks.
    keys = ["block", *[f"before_{p}" for p in PARTS], *[f"t{i}" for i in range(width)]]
    added = own.where("block > 0").groupBy(F.col("conv_id").alias("conv"), "block").agg(
        F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf")
    )
    heads = added.select("conv").distinct()
    line = rows.join(heads, "conv", "left_semi").join(added, ["conv", "block"], "left").select(
        "conv", *keys, *[F.coalesce(v, F.lit(0).cast("bigint")).alias(v) for v in ("saved", "leaf")]
    )
    later = before_in_key(line, "conv", "block", ["saved", "leaf"], descending=True).select(
        *keys, F.col("before_saved").alias("saved"), F.col("before_leaf").alias("leaf")
    ).where("saved <> 0 or leaf <> 0")
    both = own.select(*keys, "saved", "leaf").unionByName(later)
    totals = _rollup(both, "sum(saved) AS saved_tokens, sum(leaf) AS n_leaves", width).select(
        "node", "saved_tokens", "n_leaves"
    )

    final = F.col("block") == F.greatest(F.floor((F.col("length") - 1) / width), F.lit(0))
    ended = rows.where(final).select(
        F.struct(F.col("length").alias("depth"), *[(F.col(f"before_{p}") + F.col(p)).alias(p) for p in PARTS]).alias("node"),
        "conv",
    )
    parents = own.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (
        own.join(parents, "parent", "left")
        .join(totals, "node")
        .join(ends_digests(ended), "node", "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )
