"""Exact top-k inner products through a pivot-distance index.

Vectors become integers, and one more coordinate makes all of them equally long, so that the
largest inner product is the smallest distance. Every vector is keyed by its nearest pivot
and its distance to it; the table, sorted by that key, is cut into blocks, each an annulus
around a pivot. A block is no nearer to a query than the difference between the query's
distance to the pivot and the annulus, by the triangle inequality.

A query is first scored inside its own block, which bounds its k-th best score; then in the
few annuli nearest to it, which tightens the bound; then in every annulus that the bound
does not exclude. What is skipped cannot hold a better vector, so the result is exact.

Pivots are a bounded sample; every vector is indexed. Blocks and batches of queries have a
bounded size, and each meeting of the two is one row for a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

#: Vectors sampled as pivots, vectors per block, queries per batch, and annuli searched
#: before the bound is used against all of them.
PIVOTS, BLOCK, BATCH, NEAREST = 48, 1024, 256, 4
#: Products and their sums stay exact in double precision below this.
EXACT = float(1 << 53)


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null unless all components are finite."""
    whole = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(
        whole,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(2.0**40)),
    )
    return F.when(
        vector.isNotNull() & (F.size(vector) > 0) & fine,
        F.transform(whole, lambda x: F.floor(x * scale).cast("bigint")),
    )


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices, exactly."""
    top = (float(np.abs(a).max(initial=0)) + 1) * (float(np.abs(b).max(initial=0)) + 1) * a.shape[1]
    if top < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


def distances(x: np.ndarray, lift: np.ndarray, pivots: np.ndarray, pivot_lift: np.ndarray) -> np.ndarray:
    """Distances of lifted vectors to lifted pivots; ``lift`` is the added coordinate."""
    square = (
        (x.astype(np.float64) ** 2).sum(1)[:, None] + (pivots.astype(np.float64) ** 2).sum(1)[None, :]
        - 2.0 * (x.astype(np.float64) @ pivots.astype(np.float64).T)
        + (lift[:, None] - pivot_lift[None, :]) ** 2
    )
    return np.sqrt(np.maximum(square, 0.0))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, least: np.ndarray):
    """(query, id, score) of each query's k best in a block, without itself.

    ``ids`` ascend, so that a stable sort leaves ties with the smaller id first. Scores
    below ``least`` are left out.
    """
    out = []
    for i in range(len(scores)):
        row = scores[i]
        keep = np.flatnonzero((row >= least[i]) & (ids != own[i]))
        if len(keep) > k:
            floor = np.partition(row[keep], len(keep) - k)[len(keep) - k]
            keep = keep[row[keep] >= floor]
        keep = keep[np.argsort(-row[keep], kind="stable")][:k]
        out.append((keep, row[keep]))
    return out


def top_inner_products(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    pivots: int = PIVOTS,
    block: int = BLOCK,
    batch: int = BATCH,
    nearest: int = NEAREST,
) -> DataFrame:
    """(query_id, rank, id, score): the k best partners of every query row.

    ``is_query`` tells which rows are queries; candidates are all rows but those with the
    query's own id. Vectors that are null, empty, or hold null or non-finite components (or
    ones beyond 2^40) take no part, nor do rows without an id; vectors of another length
    than the most frequent (of equally frequent ones, the largest) have no score with the
    rest and take no part. Of rows that repeat an id, the one with the smallest vector counts,
    and it is a query if one of them is. Ties go to the smaller id. With fewer than
    k candidates all are returned; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("id"),
        integers(F.col(vector_col), scale).alias("vec"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).where("id is not null and vec is not null")
    shape = (
        rows.groupBy(F.size("vec").alias("dim"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("long"),
        )
        .orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    )
    out_schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not shape:
        return spark.createDataFrame([], out_schema)
    dim, longest = shape[0]["dim"], shape[0]["long"]
    rows = rows.where(F.size("vec") == dim)
    repeated = rows.groupBy("id").count().where("count > 1")
    if not repeated.isEmpty():
        rows = rows.groupBy("id").agg(F.min("vec").alias("vec"), F.max("asks").alias("asks"))
    sample = rows.select("id", "vec").orderBy(F.xxhash64("id", "vec"), "id").limit(pivots).collect()
    centres = np.array([r["vec"] for r in sample], dtype=np.int64)
    centre_lift = np.sqrt(np.maximum(longest - (centres.astype(np.float64) ** 2).sum(1), 0.0))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if not part.num_rows:
                continue
            x = _matrix(part.column(1), dim)
            lift = np.sqrt(np.maximum(longest - (x.astype(np.float64) ** 2).sum(1), 0.0))
            far = distances(x, lift, centres, centre_lift)
            cell = far.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [
                    *[part.column(i) for i in range(3)], pa.array(cell.astype(np.int32)),
                    pa.array(far[np.arange(len(x)), cell]),
                ],
                names=["id", "vec", "asks", "cell", "far"],
            )

    keyed = rows.mapInArrow(key, "id bigint, vec array<bigint>, asks boolean, cell int, far double")
    # One sort by the key; equal vectors lie in as many blocks as they need.
    ordered = materialize(keyed).repartitionByRange("cell", "far", "id").sortWithinPartitions("cell", "far", "id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of one cell, with the queries inside them scored against their block."""
        held: dict[str, list[np.ndarray]] = {}

        def closed() -> pa.RecordBatch:
            ids = np.concatenate(held["id"])
            at = np.argsort(ids, kind="stable")
            ids = ids[at]
            x = np.concatenate(held["vec"])[at]
            far, asks = np.concatenate(held["far"])[at], np.concatenate(held["asks"])[at]
            who = np.flatnonzero(asks)
            q = x[who]
            none = np.full(len(who), np.iinfo(np.int64).min)
            best = _best(products(q, x), ids, ids[who], k, none) if len(who) else []
            first = [
                {
                    "id": int(ids[w]), "vec": q[i].tolist(),
                    "least": int(s[-1]) if len(s) == k else None,
                }
                for i, (w, (_, s)) in enumerate(zip(who, best, strict=True))
            ]
            kind = pa.list_(pa.struct([("id", pa.int64()), ("vec", pa.list_(pa.int64())), ("least", pa.int64())]))
            columns = [
                pa.array([held["cell"][0]], pa.int32()), pa.array([far.min()]), pa.array([far.max()]),
                pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([x.astype("<i8").tobytes()], pa.binary()),
                pa.array([first], kind),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["cell", "low", "high", "ids", "matrix", "queries"])

        size = 0
        for part in batches:
            ids, asks = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            cells, far = (part.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            x = _matrix(part.column(1), dim)
            at = 0
            while at < len(ids):
                if size and (cells[at] != held["cell"][0] or size == block):
                    yield closed()
                    size = 0
                if not size:
                    held = {"id": [], "vec": [], "far": [], "asks": [], "cell": [cells[at]]}
                end = at + min(block - size, int(np.searchsorted(cells[at:], cells[at], side="right")))
                for name, values in (("id", ids), ("vec", x), ("far", far), ("asks", asks)):
                    held[name].append(values[at:end])
                size, at = size + end - at, end
        if size:
            yield closed()

    blocks = materialize(
        ordered.mapInArrow(
            cut,
            "cell int, low double, high double, ids array<bigint>, matrix binary, "
            "queries array<struct<id:bigint,vec:array<bigint>,least:bigint>>",
        ).withColumn("block", F.expr("uuid()"))
    )
    asked = blocks.select("block", F.explode("queries").alias("q")).select(F.col("block").alias("home"), "q.*")
    queries = materialize(asked.withColumn("batch", F.monotonically_increasing_id()))
    # Batches of bounded size: numbers of one task that follow each other.
    queries = queries.withColumn("batch", F.floor(F.col("batch") / batch))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's distance to every pivot."""
        for part in batches:
            if not part.num_rows:
                continue
            x = _matrix(part.column(1), dim)
            far = distances(x, np.zeros(len(x)), centres, centre_lift)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array(far.tolist(), pa.list_(pa.float64())),
                    pa.array((x.astype(np.float64) ** 2).sum(1)),
                ],
                names=["id", "far", "square"],
            )

    reaches = materialize(queries.select("id", "vec").mapInArrow(reach, "id bigint, far array<double>, square double"))
    rings = blocks.select("block", "cell", "low", "high")

    def pairs(known: DataFrame) -> DataFrame:
        """(query, block, gap) for blocks a query's bound ``least`` does not exclude."""
        wide = known.join(reaches, "id").select(
            "id", "home", "batch", "least", "square", F.posexplode("far").alias("cell", "to")
        )
        gap = F.greatest(F.col("to") - F.col("high"), F.col("low") - F.col("to"), F.lit(0.0))
        most = (F.col("square") + F.lit(longest) - F.pow(gap, 2)) / 2
        slack = 1.0 + 1e-9 * (F.abs(F.col("square")) + F.lit(longest))
        return (
            wide.join(rings, "cell").withColumn("gap", gap)
            .where(F.col("least").isNull() | (most + slack >= F.col("least")))
            .select("id", "home", "batch", "block", "gap")
        )

    def score(chosen: DataFrame, known: DataFrame) -> DataFrame:
        """The k best of each query in each of its blocks, at or above its bound."""
        asks = chosen.select("id", "block").join(known.select("id", "vec", "least", "batch"), "id")
        packed = asks.groupBy("block", "batch").agg(F.collect_list(F.struct("id", "vec", "least")).alias("asked"))
        meet = packed.join(blocks.select("block", "ids", "matrix"), "block").select("asked", "ids", "matrix")

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                for i in range(part.num_rows):
                    asked = part.column(0)[i].as_py()
                    ids = np.array(part.column(1)[i].as_py(), dtype=np.int64)
                    x = np.frombuffer(part.column(2)[i].as_py(), dtype="<i8").reshape(-1, dim)
                    q = np.array([a["vec"] for a in asked], dtype=np.int64)
                    own = np.array([a["id"] for a in asked], dtype=np.int64)
                    low = np.iinfo(np.int64).min
                    least = np.array([low if a["least"] is None else a["least"] for a in asked], dtype=np.int64)
                    found = _best(products(q, x), ids, own, k, least)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(own, [len(at) for at, _ in found])),
                            pa.array(np.concatenate([ids[at] for at, _ in found])),
                            pa.array(np.concatenate([s for _, s in found])),
                        ],
                        names=["id", "partner", "score"],
                    )

        return meet.mapInArrow(best, "id bigint, partner bigint, score bigint")

    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "partner"))
    near = F.row_number().over(W.partitionBy("id").orderBy("gap", "block"))
    # A query's own block and the annuli nearest to it.
    every = pairs(queries)
    close = every.withColumn("nth", near).where((F.col("nth") <= nearest) | (F.col("block") == F.col("home")))
    first = materialize(score(close, queries))
    best_first = materialize(first.withColumn("rank", place).where(F.col("rank") <= k))
    bound = best_first.where(F.col("rank") == k).select("id", F.col("score").alias("bound"))
    tighter = materialize(
        queries.join(bound, "id", "left").withColumn("least", F.greatest("least", "bound")).drop("bound")
    )
    # All annuli that are not excluded now, without those already searched.
    done = close.select("id", "block")
    rest = pairs(tighter).join(done, ["id", "block"], "left_anti")
    more = score(rest, tighter)
    total = best_first.select("id", "partner", "score").unionByName(more)
    return (
        total.withColumn("rank", place).where(F.col("rank") <= k)
        .select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("partner").alias("vec_id"), "score")
    )
