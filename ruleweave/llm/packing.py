"""Packing documents into sequences of bounded length: fix what dominates, best-fit the rest.

Only lengths matter for packing, and there are at most as many different lengths as a
sequence has places. So the plan is made on the histogram of lengths, whose size is bounded
however many documents there are: placements say which ranks of a length go to which run of
sequences at which place. Documents then get their rank among those of their length from a
range-partitioned numbering, and with it their sequence.

The reduction follows Martello and Toth: for the largest length left, a small set of
lengths that dominates every other set it could share a sequence with (each of those can be
exchanged against it without needing more sequences) is fixed for good. What no rule fixes
is packed by best fit in decreasing order, many equal documents at a time.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import numbered
from ..session import BROADCAST_ROWS, materialize
from .tokens import encoder

#: (length, first rank, number of documents, first sequence, offset): ranks and sequences
#: count up together.
Placement = tuple[int, int, int, int, int]


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, piece, start, length, ids): every document's ids with ``end_id``, cut if too long.

    Only documents longer than ``capacity`` are cut, into full pieces and a rest. ``ids``
    holds little-endian unsigned 32-bit numbers. Null text counts as empty: the end id alone.
    """
    rows = docs.select(F.col(id_col).alias("id__"), F.coalesce(F.col(text_col), F.lit("")).alias("text__"))
    kind = rows.schema["id__"].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            row, piece, start, length, ids = [], [], [], [], []
            for i, text_ids in enumerate(enc.encode_column(batch.column(1))):
                raw = text_ids + end
                for nth, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(nth)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    ids.append(part)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()),
                ],
                names=["id__", "piece", "start", "length", "ids"],
            )

    schema = f"id__ {kind}, piece int, start bigint, length bigint, ids binary"
    return rows.mapInArrow(cut, schema).withColumnRenamed("id__", id_col)


class _Stock:
    """How many documents of each length are left."""

    def __init__(self, histogram: dict[int, int]):
        self.count = {s: n for s, n in histogram.items() if n > 0}
        self.sizes = sorted(self.count)

    def take(self, chosen: Counter, times: int) -> None:
        for size, n in chosen.items():
            self.count[size] -= n * times
            if not self.count[size]:
                del self.count[size]
                self.sizes.pop(bisect_left(self.sizes, size))

    def smallest(self, n: int, used: Counter, above: int = 0) -> list[int]:
        """The n smallest lengths above a bound, with repetition, without those used."""
        found: list[int] = []
        for size in self.sizes[bisect_right(self.sizes, above) :]:
            found += [size] * min(n - len(found), self.count[size] - used[size])
            if len(found) == n:
                break
        return found

    def largest(self, limit: int, used: Counter) -> int:
        """The largest length of at most ``limit`` that is left; 0 if there is none."""
        at = bisect_right(self.sizes, limit)
        while at:
            at -= 1
            if self.count[self.sizes[at]] > used[self.sizes[at]]:
                return self.sizes[at]
        return 0

    def best_pair(self, limit: int, used: Counter) -> int:
        """The largest sum of two lengths that is at most ``limit``; 0 if there is none."""
        sizes = np.array([s for s in self.sizes if s < limit and self.count[s] > used[s]])
        if not len(sizes):
            return 0
        partner = np.searchsorted(sizes, limit - sizes, side="right") - 1
        single = np.array([self.count[s] - used[s] < 2 for s in sizes])
        partner = np.where(single & (partner == np.arange(len(sizes))), partner - 1, partner)
        return int(np.where(partner >= 0, sizes + sizes[partner], 0).max())


def dominating(stock: _Stock, size: int, capacity: int) -> Counter | None:
    """A set with ``size`` that dominates all sets with it, if one of the rules shows one."""
    mine, room = Counter([size]), capacity - size
    low = stock.smallest(3, mine)
    if not low or low[0] > room:  # nothing fits beside it
        return mine
    first = stock.largest(room, mine)
    if first == room or len(low) < 2 or low[0] + low[1] > room:  # a perfect fit, or one fits at most
        return mine + Counter([first])
    if len(low) == 3 and sum(low) <= room:  # three may fit: no rule
        return None
    pair = mine + Counter([first])
    if stock.best_pair(room, mine) <= first:  # no two fill more than the one
        return pair
    second = stock.largest(room - first, pair)
    if second:
        rivals = stock.smallest(2, mine, above=second)
        if len(rivals) < 2 or sum(rivals) > room:  # no pair has both larger than the second
            return pair + Counter([second])
    return None


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Placement], int]:
    """Placements for all documents of a histogram of lengths, and the number of sequences."""
    if any(not 0 < size <= capacity for size in histogram):
        raise ValueError(f"lengths must be between 1 and {capacity}")
    stock, placed, sequences = _Stock(histogram), [], 0
    ranks: Counter = Counter()

    def put(size: int, n: int, sequence: int, offset: int) -> None:
        placed.append((size, ranks[size], n, sequence, offset))
        ranks[size] += n

    # Reduction, from the largest length down.
    for size in sorted(histogram, reverse=True):
        while size in stock.count:
            chosen = dominating(stock, size, capacity)
            if chosen is None:
                break
            times = min(stock.count[s] // n for s, n in chosen.items())
            offset = 0
            for s in sorted(chosen.elements(), reverse=True):
                put(s, times, sequences, offset)
                offset += s
            stock.take(chosen, times)
            sequences += times

    # Best fit, decreasing: runs of sequences with equal room, by room.
    runs: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []

    def keep(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            runs[room].append((first, n))

    for size in reversed(list(stock.sizes)):
        left = stock.count[size]
        while left:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    rooms.pop(at)
            else:
                room, first, n = capacity, sequences, -(-left // (capacity // size))
                sequences += n
            each = room // size  # a sequence is filled up before the next is begun
            full = min(n, left // each)
            for i in range(each if full else 0):
                put(size, full, first, capacity - room + i * size)
            left -= full * each
            keep(room - each * size, first, full)
            if full < n and left:  # the last one takes what remains
                for i in range(left):
                    put(size, 1, first + full, capacity - room + i * size)
                keep(room - left * size, first + full, 1)
                full, left = full + 1, 0
            keep(room, first + full, n - full)
    return placed, sequences


def pack(pieces: DataFrame, capacity: int, order: list[str], length_col: str = "length") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to every row of ``pieces``.

    ``order`` names columns that, after the length, number the rows; equal rows may be
    exchanged. Lengths run from 1 to ``capacity``; other lengths, null among them, are an
    error. An empty table gives no rows.
    """
    # Range partitioning reads its input twice; the written pieces are not encoded again.
    pieces = materialize(pieces)
    ranked = numbered(pieces, length_col, *order, name="nth__")
    # At most one row per length.
    counts = {r[length_col]: r["count"] for r in ranked.groupBy(length_col).count().collect()}
    if None in counts:
        raise ValueError("a piece has no length")
    placed, _ = plan(counts, capacity)
    before, firsts = 0, {}
    for size in sorted(counts):
        firsts[size], before = before, before + counts[size]
    spark = pieces.sparkSession
    table = spark.createDataFrame(
        [(s, firsts[s] + r, firsts[s] + r + n, q, o) for s, r, n, q, o in placed],
        "size__ bigint, from__ bigint, to__ bigint, sequence__ bigint, offset bigint",
    )
    if len(placed) <= BROADCAST_ROWS:
        table = F.broadcast(table)
    joined = ranked.join(
        table,
        (F.col(length_col) == F.col("size__")) & (F.col("nth__") >= F.col("from__")) & (F.col("nth__") < F.col("to__")),
    )
    return joined.select(
        *pieces.columns, (F.col("sequence__") + F.col("nth__") - F.col("from__")).alias("sequence_id"), "offset"
    )
