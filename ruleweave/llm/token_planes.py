"""Token ids in a block-transposed, compressed table format.

Format. A corpus is a folder of Parquet files; a row is a chunk: some whole documents of one
range of ids, in ascending order. The ids of a chunk are cut into blocks of ``BLOCK`` ids.
Each block of unsigned 32-bit numbers is transposed, so that equal bytes (or bits) of all
its numbers stand together; the j-th planes of a chunk's blocks, one after another, are
plane j, and every plane is compressed with zstandard. High planes are nearly empty, low
ones hold the entropy.

Chunk index. Beside its planes a row holds ``part`` and ``chunk`` (its place), ``offset``
(ids before it in its part), ``n_ids``, ``doc_ids`` and ``lengths`` (its documents) and
``plane`` (``byte`` or ``bit``). Index columns are read without touching the planes; what
stands before a part is the sum over the parts before it.

Files are written and committed by Spark, to any file system it knows; a lost executor
costs the writing of its unfinished parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .tokens import encoder

#: Ids per transposed block, and ids after which a chunk is closed (a longer document makes
#: a longer chunk: its ids take no more memory than its text, which is one value anyway).
BLOCK = 8192
CHUNK = 1 << 18
LEVEL = 3


def to_planes(ids: np.ndarray, plane: str, block: int = BLOCK) -> list[bytes]:
    """Planes of some uint32 ids: 4 of bytes or 32 of bits, uncompressed."""
    parts = [ids[i : i + block].astype("<u4") for i in range(0, len(ids), block)]
    if plane == "byte":
        return [b"".join(p.view(np.uint8)[j::4].tobytes() for p in parts) for j in range(4)]
    if plane == "bit":
        bits = [np.unpackbits(p.view(np.uint8), bitorder="little").reshape(-1, 32) for p in parts]
        return [b"".join(np.packbits(b[:, j], bitorder="little").tobytes() for b in bits) for j in range(32)]
    raise ValueError(f"plane is byte or bit, not {plane}")


def from_planes(planes: list[bytes], n_ids: int, plane: str, block: int = BLOCK) -> np.ndarray:
    """The ids again."""
    out = np.zeros(n_ids, dtype="<u4")
    if plane == "byte":
        seen = out.view(np.uint8)
        for j, raw in enumerate(planes):
            seen[j::4] = np.frombuffer(raw, dtype=np.uint8)
        return out
    at = 0
    for i in range(0, n_ids, block):
        size = min(block, n_ids - i)
        width = (size + 7) // 8
        bits = np.stack([
            np.unpackbits(np.frombuffer(raw, np.uint8, width, at), bitorder="little")[:size] for raw in planes
        ], axis=1)
        out[i : i + size] = np.packbits(bits, axis=1, bitorder="little").view("<u4")[:, 0]
        at += width
    return out


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    plane: str = "byte",
    block: int = BLOCK,
    chunk_ids: int = CHUNK,
) -> None:
    """Encode every text, append ``end_id`` and write the ids in ascending order of the ids.

    Null text counts as empty and gives the end id alone. Rows without an id come first;
    rows that repeat an id follow each other, in the order of their texts' hashes. An empty
    table gives an empty corpus. Only the two columns are read.
    """
    rows = docs.select(F.col(id_col).alias("id__"), F.coalesce(F.col(text_col), F.lit("")).alias("text__"))
    keys = ["id__", F.xxhash64("text__")]
    # Ids and a hash: many rows under one id still spread over the ranges.
    spread = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    id_kind = spread.schema["id__"].dataType
    schema = (
        f"part int, chunk int, offset bigint, n_ids bigint, doc_ids {ArrayType(id_kind).simpleString()}, "
        "lengths array<bigint>, plane string, block int, planes array<binary>"
    )
    end = np.array([end_id], dtype="<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        part, enc, squeeze = TaskContext.get().partitionId(), encoder(tokenizer), zstandard.ZstdCompressor(LEVEL)
        held, lengths, names, size, chunk, offset, kind = [], [], [], 0, 0, 0, None

        def closed() -> pa.RecordBatch:
            raw = b"".join(held)
            planes = to_planes(np.frombuffer(raw, dtype="<u4"), plane, block)
            row = [
                pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([offset], pa.int64()),
                pa.array([len(raw) // 4], pa.int64()), pa.array([names], pa.list_(kind)),
                pa.array([lengths], pa.list_(pa.int64())), pa.array([plane]), pa.array([block], pa.int32()),
                pa.array([[squeeze.compress(p) for p in planes]], pa.list_(pa.binary())),
            ]
            columns = ["part", "chunk", "offset", "n_ids", "doc_ids", "lengths", "plane", "block", "planes"]
            return pa.RecordBatch.from_arrays(row, names=columns)

        for batch in batches:
            kind = batch.column(0).type
            for name, text_ids in zip(batch.column(0).to_pylist(), enc.encode_column(batch.column(1)), strict=True):
                ids = text_ids + end
                held.append(ids)
                lengths.append(len(ids) // 4)
                names.append(name)
                size += lengths[-1]
                if size >= chunk_ids:
                    yield closed()
                    chunk, offset, size = chunk + 1, offset + size, 0
                    held, lengths, names = [], [], []
        if names:
            yield closed()

    spread.mapInArrow(write, schema).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of a corpus, from its files alone.

    ``start`` counts the ids of all documents before it, ``ids`` holds its ids as
    little-endian unsigned 32-bit numbers.
    """
    chunks = spark.read.parquet(path)
    totals = chunks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # One row per part: as many as there were partitions.
    starts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = chunks.join(F.broadcast(starts), "part").select(
        (F.col("before") + F.col("offset")).alias("start"), "n_ids", "doc_ids", "lengths", "plane", "block", "planes"
    )
    id_kind = chunks.schema["doc_ids"].dataType.elementType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                start, n_ids = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                doc_ids = batch.column(2)[i].values
                lengths = np.array(batch.column(3)[i].as_py(), dtype=np.int64)
                plane, block = batch.column(4)[i].as_py(), batch.column(5)[i].as_py()
                planes = [expand.decompress(p) for p in batch.column(6)[i].as_py()]
                raw = from_planes(planes, n_ids, plane, block).tobytes()
                ends = np.cumsum(lengths)
                ids = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, pa.array(start + ends - lengths), pa.array(lengths), pa.array(ids, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return placed.mapInArrow(read, f"doc_id {id_kind}, start bigint, n_tokens bigint, ids binary")


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """Place, size and documents of every chunk, without its planes."""
    return spark.read.parquet(path).select(
        "part", "chunk", "offset", "n_ids", F.size("doc_ids").alias("n_docs"),
        F.element_at("doc_ids", 1).alias("first_id"), F.element_at("doc_ids", -1).alias("last_id"),
    )
