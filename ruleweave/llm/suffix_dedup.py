"""Removal of repeated passages by interval expansion on a Burrows-Wheeler transform.

Every byte string of ``min_bytes`` that starts at two places or more is found, and the bytes
it covers go. No suffix array of the whole corpus is built; the corpus is cut so that equal
strings meet:

1. A window's anchor is its leftmost gram with the least hash. Equal windows have equal
   anchors at equal distances. Consecutive windows with one anchor are a segment, the text
   that they cover. Segments are told apart by a digest; equal ones are counted where they
   are found, so that copies are one row however many there are.
2. Segments whose anchor occurs more than once are grouped by anchor. A group with more
   than ``LIMIT`` different segments is split by halves of the distance to the anchor, each
   half grouped by the text that all its windows share, until groups are small: at the last
   step a group is one text.
3. In a task, the segments of some groups are one text with a character's distance to the
   anchor as part of the character. Its suffixes are sorted column by column from the right,
   which gives the last-to-first mapping of the transform. From the intervals of suffixes
   that share nothing, breadth-first backward extension finds the boundaries between
   suffixes that share 1, 2, 3 ... characters, each once. It stops at ``min_bytes``: suffixes
   with no boundary between them share at least that much.
4. What is repeated goes back to all places of a segment, and from there to the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Bytes of a repeated passage.
MIN_BYTES = 400
#: Bytes of the grams that anchors are chosen from.
GRAM = 32
#: Different segments of one anchor that are sorted together.
LIMIT = 2048
#: Bytes of segments that are sorted at once; a group is never cut.
BLOCK = 3 << 20
#: Bytes that are hashed at once; longer texts are read in overlapping slices.
SLICE = 1 << 18

_ODD, _MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every ``gram`` consecutive bytes, by doubling."""
    size, part, taken = 1, data.astype(np.uint64) + np.uint64(1), 0
    whole, rest = None, gram
    while True:
        if rest & 1:
            if whole is None:
                whole, taken = part, size
            else:
                n = len(data) - taken - size + 1
                whole = whole[:n] * np.uint64(pow(_ODD, size, 1 << 64)) + part[taken : taken + n]
                taken += size
        rest >>= 1
        if not rest:
            break
        n = len(data) - 2 * size + 1
        part = part[:n] * np.uint64(pow(_ODD, size, 1 << 64)) + part[size : size + n]
        size *= 2
    mixed = whole ^ (whole >> np.uint64(29))
    mixed *= np.uint64(_MIX)
    return mixed ^ (mixed >> np.uint64(32))


def anchors(data: np.ndarray, min_bytes: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams, and for every window the place of its anchor."""
    hashes = gram_hashes(data, gram)
    bits = np.uint64((1 << 22) - 1)
    # The least value has the least hash; places in the low bits make it the leftmost.
    least = (hashes & ~bits) | np.arange(len(hashes), dtype=np.uint64)
    window, reach = min_bytes - gram + 1, 1
    while reach * 2 <= window:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    if reach < window:
        shift = window - reach
        least = np.minimum(least[: len(least) - shift], least[shift:])
    return hashes, (least & bits).astype(np.int64)


def _slices(texts: list[bytes], min_bytes: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts that have a window, several short ones or a slice of a long one at a time."""
    group, size = [], 0
    for nth, text in enumerate(texts):
        if len(text) < min_bytes:
            continue
        for start in range(0, len(text) - min_bytes + 1, SLICE):
            part = text[start : start + SLICE + min_bytes - 1]
            if size and size + len(part) > SLICE + min_bytes:
                yield group
                group, size = [], 0
            group.append((nth, start, part))
            size += len(part)
    if group:
        yield group


def segments_of(texts: list[bytes], min_bytes: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (text, anchor hash, first window, windows, distance to the anchor, digest)."""
    for group in _slices(texts, min_bytes):
        raw = b"".join(part for _, _, part in group)
        sizes = np.array([len(part) for _, _, part in group])
        begins = np.cumsum(sizes) - sizes
        hashes, place = anchors(np.frombuffer(raw, np.uint8), min_bytes, gram)
        of = np.repeat(np.arange(len(group)), sizes)[: len(place)]
        inside = np.arange(len(place)) + min_bytes <= (begins + sizes)[of]
        place = np.where(inside, place, -1)
        first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (of[1:] != of[:-1])])
        windows = np.diff(np.r_[first, len(place)])
        real = place[first] >= 0
        first, windows = first[real], windows[real]
        text_no, start = (np.array([g[i] for g in group]) for i in (0, 1))
        digests = [
            hashlib.blake2b(raw[a : a + n + min_bytes - 1], digest_size=16).digest()
            for a, n in zip(first.tolist(), windows.tolist(), strict=True)
        ]
        yield (
            text_no[of[first]],
            hashes[place[first]].view(np.int64),
            first - begins[of[first]] + start[of[first]],
            windows,
            place[first] - first,
            np.array(digests, dtype=object),
        )


class Transform:
    """Burrows-Wheeler transform of segments whose characters carry their column.

    A column is a distance to the anchor of the segment's group. ``forward[row]`` is the row
    of the suffix that is one character longer (-1 at a segment's begin), ``back`` its
    inverse (-1 at the end mark). ``shared[row]`` is what a row shares with the row before it
    where that is known, else -1; to begin with, 0 where their first characters differ.
    """

    def __init__(self, texts: list[bytes], groups: np.ndarray, left: np.ndarray):
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        self.begin, end = -left.astype(np.int64), sizes - left
        shift = np.cumsum(sizes) - sizes - self.begin  # place of column 0 in the data
        n = int(sizes.sum()) + len(texts)
        self.forward, self.back = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        self.shared = np.full(n, -1, np.int16)
        self.segment, self.column = np.empty(n, np.int32), np.empty(n, np.int32)
        self.walls = np.zeros(n, bool)  # where a group or column begins
        dense = np.unique(groups, return_inverse=True)[1].astype(np.uint32)
        by_end = np.argsort(end, kind="stable")
        ends_sorted, row_of = end[by_end], np.zeros(len(texts), np.int64)
        order, base, upto = np.empty(0, np.int64), 0, len(texts)
        for column in range(int(end.max()), int(self.begin.min()) - 1, -1):
            since = np.searchsorted(ends_sorted, column)
            new, upto = by_end[since:upto], since
            order = order[self.begin[order] <= column]
            rows_before = row_of[order]
            key = np.zeros(len(new) + len(order), np.uint16)
            key[len(new) :] = data[shift[order] + column].astype(np.uint16) + 1
            together = np.concatenate([new, order])
            was = np.concatenate([np.full(len(new), -1, np.int64), rows_before])
            # Stable: what follows, already sorted, decides between equal characters.
            by = np.argsort(key, kind="stable")
            by = by[_stable(dense[together[by]])]
            order, key, was = together[by], key[by], was[by]
            rows = np.arange(base, base + len(order))
            self.back[rows] = was
            self.forward[was[was >= 0]] = rows[was >= 0]
            group = dense[order]
            wall = np.r_[True, group[1:] != group[:-1]]
            self.walls[rows] = wall
            self.shared[rows[wall | (key == 0) | np.r_[True, (key[1:] != key[:-1]) | (key[:-1] == 0)]]] = 0
            self.segment[rows], self.column[rows] = order, column
            row_of[order] = rows
            base += len(order)


def _stable(values: np.ndarray) -> np.ndarray:
    """Stable order of numbers below 2^32; small ones are sorted by counting."""
    if len(values) == 0 or values.max() < 1 << 16:
        return np.argsort(values.astype(np.uint16), kind="stable")
    low = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    return low[np.argsort((values[low] >> 16).astype(np.uint16), kind="stable")]


def _spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start, the numbers start .. start + count - 1, and whose they are."""
    owner = np.repeat(np.arange(len(starts)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return starts[owner] + offset, owner


def expand_intervals(bwt: Transform, min_bytes: int) -> np.ndarray:
    """Rows that share at least ``min_bytes`` characters with the row before them.

    A boundary found at some length parts an interval. The longer suffixes on both sides of
    it, the first and last of each preceding character, are parted at one character more,
    unless they were before. The side with fewer runs of preceding characters is read, up
    to the next boundary of an earlier length; such boundaries are looked up as they were at
    the last refresh, so that an interval may be too wide, never too narrow.
    """
    forward, back, shared = bwt.forward, bwt.back, bwt.shared
    n = len(shared)
    if n == 0:
        return np.zeros(0, bool)
    run = np.ones(n, bool)
    run[1:] = (forward[1:] < 0) | (forward[:-1] < 0) | (forward[1:] != forward[:-1] + 1)
    run[1:] |= shared[forward[1:]] == 0
    run_rows, runs_upto = np.flatnonzero(run), np.cumsum(run, dtype=np.int32)
    front = np.flatnonzero((shared == 0) & ~bwt.walls)
    known, since = np.flatnonzero(bwt.walls), len(front)
    for length in range(1, min_bytes):
        if len(front) == 0:
            break
        if length > 1 and since > n // 16:
            known, since = np.flatnonzero((shared >= 0) & (shared < length - 1)), len(front)
        low = known[np.searchsorted(known, front, "left") - 1]
        at = np.searchsorted(known, front, "right")
        high = np.where(at < len(known), known[np.minimum(at, len(known) - 1)], n)
        n_right = runs_upto[high - 1] - runs_upto[front]
        n_left = runs_upto[front - 1] - runs_upto[low]
        to_right = n_right <= n_left
        # Right: the first row of each preceding character at or after the boundary.
        edge = front[to_right]
        more, owner = _spread(runs_upto[edge], n_right[to_right])
        rows = np.concatenate([edge, run_rows[more]])
        edges = np.concatenate([edge, edge[owner]])
        longer = forward[rows]
        ok = longer > 0
        longer, edges = longer[ok], edges[ok]
        ok = shared[longer] < 0
        longer, edges = longer[ok], edges[ok]
        found = [longer[back[longer - 1] < edges]]
        # Left: the last row of each preceding character before the boundary.
        edge = front[~to_right]
        more, owner = _spread(runs_upto[low[~to_right]], n_left[~to_right])
        rows = np.concatenate([edge - 1, run_rows[more] - 1])
        edges = np.concatenate([edge, edge[owner]])
        longer = forward[rows] + 1
        ok = (longer > 0) & (longer < n)
        longer, edges = longer[ok], edges[ok]
        ok = shared[longer] < 0
        longer, edges = longer[ok], edges[ok]
        found.append(longer[back[longer] >= edges])
        front = np.unique(np.concatenate(found))
        shared[front] = length
        since += len(front)
    return shared < 0


def repeated_windows(
    texts: list[bytes], groups: np.ndarray, left: np.ndarray, min_bytes: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (segment, first, last) of windows that another segment of their group holds too."""
    bwt = Transform(texts, groups, left)
    joined = expand_intervals(bwt, min_bytes)
    rows = np.flatnonzero(joined | np.r_[joined[1:], False])
    segment = bwt.segment[rows].astype(np.int64)
    window = bwt.column[rows] - bwt.begin[segment]
    by = np.lexsort([window, segment])
    segment, window = segment[by], window[by]
    starts = np.ones(len(by), bool)
    starts[1:] = (segment[1:] != segment[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(starts)
    last = np.r_[first[1:], len(by)] - 1 if len(by) else first
    return segment[first], window[first], window[last]


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
SPANS = "array<struct<first:bigint,last:bigint>>"


def _judge(min_bytes: int):
    """Task function: (grp, digest, copies, left, windows, text) in order of grp -> spans."""

    def flush(group: list[dict]) -> pa.RecordBatch:
        spans: list[list[dict]] = [[] for _ in group]
        found = repeated_windows(
            [g["text"] for g in group],
            np.array([g["grp"] for g in group]),
            np.array([g["left"] for g in group]),
            min_bytes,
        )
        for segment, first, last in zip(*(a.tolist() for a in found), strict=True):
            spans[segment].append({"first": first, "last": last})
        for i, g in enumerate(group):
            if g["copies"] > 1:
                spans[i] = [{"first": 0, "last": g["windows"] - 1}]
        some = [i for i, s in enumerate(spans) if s]
        return pa.RecordBatch.from_pydict({
            "grp": pa.array([group[i]["grp"] for i in some], pa.int64()),
            "digest": pa.array([group[i]["digest"] for i in some], pa.binary()),
            "spans": pa.array([spans[i] for i in some], _SPANS),
        })

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        size, seen = 0, set()
        for batch in batches:
            for row in batch.to_pylist():
                if group and row["grp"] != group[-1]["grp"]:
                    seen = set()
                    if size >= BLOCK:
                        yield flush(group)
                        group, size = [], 0
                if row["digest"] not in seen:  # a document's row may be there twice
                    seen.add(row["digest"])
                    group.append(row)
                    size += len(row["text"])
        if group:
            yield flush(group)

    return judge


def _split(min_bytes: int, width: int):
    """Task function: a segment's windows by distance to the anchor, ``width`` each."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("grp", "digest", "part", "core", "skip", "left", "windows", "copies", "text")}
            for row in batch.to_pylist():
                left, text = row["left"], row["text"]
                least = left - row["windows"] + 1
                for part in range(least // width, left // width + 1):
                    far, near = min(left, (part + 1) * width - 1), max(least, part * width)
                    begin = left - far
                    # All windows of the part hold this, so equal windows have it in common.
                    core = text[left - part * width : left - (part + 1) * width + 1 + min_bytes]
                    piece = text[begin : left - near + min_bytes]
                    for name, value in zip(out, (
                        row["grp"], row["digest"], part, hashlib.blake2b(core, digest_size=16).digest(),
                        begin, far, far - near + 1, row["copies"], piece,
                    ), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out)

    return split


def judge_segments(segments: DataFrame, min_bytes: int, limit: int = LIMIT, width: int = 0) -> DataFrame:
    """(grp, digest, spans) of segments (grp, digest, copies, left, windows, text).

    ``spans`` are runs of windows that start at another place too. Segments of a group that
    nothing repeats are missing. Groups of more than ``limit`` segments are split.
    """
    sizes = segments.groupBy("grp").agg(F.count(F.lit(1)).alias("segs"), F.sum("copies").alias("total"))
    sized = segments.join(sizes.where("total > 1"), "grp")
    columns = ["grp", "digest", "copies", "left", "windows", "text"]
    few = sized.where(F.col("segs") <= limit).select(columns)
    judged = few.repartition("grp").sortWithinPartitions("grp").mapInArrow(
        _judge(min_bytes), f"grp bigint, digest binary, spans {SPANS}"
    )
    width = width or 1 << (min_bytes - 1).bit_length()
    many = sizes.where(F.col("segs") > limit).select("grp")
    if width == 1 or many.isEmpty():
        return judged
    parts = materialize(
        segments.join(many, "grp", "left_semi").select(columns).mapInArrow(
            _split(min_bytes, width // 2),
            "grp bigint, digest binary, part bigint, core binary, skip bigint, left bigint, windows bigint,"
            " copies bigint, text binary",
        ).withColumns({"sub": F.xxhash64("grp", "part", "core"), "sub_digest": F.sha2("text", 256)})
    )
    below = parts.groupBy(F.col("sub").alias("grp"), F.unhex("sub_digest").alias("digest")).agg(
        F.sum("copies").alias("copies"), F.min("left").alias("left"), F.min("windows").alias("windows"),
        F.min("text").alias("text"),
    )
    found = judge_segments(materialize(below), min_bytes, limit, width // 2).select(
        F.col("grp").alias("sub"), F.hex("digest").alias("found"), F.col("spans").alias("inner")
    )
    back = parts.select("grp", "digest", "skip", "sub", F.upper("sub_digest").alias("found")).join(
        found, ["sub", "found"]
    ).select(
        "grp", "digest",
        F.explode(F.transform("inner", lambda s: F.struct(
            (s["first"] + F.col("skip")).alias("first"), (s["last"] + F.col("skip")).alias("last")
        ))).alias("span"),
    ).groupBy("grp", "digest").agg(F.collect_list("span").alias("spans"))
    return judged.unionByName(back)


def _find(min_bytes: int, gram: int):
    """Task function: (id, row_hash, text) -> rows of segments."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids, rows = batch.column("id"), batch.column("row_hash")
            for text_no, anchor, first, windows, left, digest in segments_of(texts, min_bytes, gram):
                take = pa.array(text_no)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), rows.take(take), pa.array(anchor), pa.array(digest, pa.binary()),
                     pa.array(first), pa.array(windows), pa.array(left)],
                    ["id", "row_hash", "grp", "digest", "first", "windows", "left"],
                )

    return find


def _cut_segments(min_bytes: int):
    """Task function: texts with their chosen segments -> segments with their text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pydict({
                    "grp": pa.array([w["grp"] for w in wanted], pa.int64()),
                    "digest": [w["digest"] for w in wanted],
                    "copies": pa.array([w["copies"] for w in wanted], pa.int64()),
                    "left": pa.array([w["left"] for w in wanted], pa.int64()),
                    "windows": pa.array([w["windows"] for w in wanted], pa.int64()),
                    "text": [text[w["first"] : w["first"] + w["windows"] + min_bytes - 1] for w in wanted],
                })

    return cut


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row_hash"), text.cast("binary").alias("text"))


def _of_document(left: DataFrame, right: DataFrame) -> Column:
    return left["id"].eqNullSafe(right["id__"]) & (left["row_hash"] == right["row__"])


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    min_bytes: int = MIN_BYTES, gram: int = GRAM, limit: int = LIMIT,
) -> DataFrame:
    """(id, row_hash, spans): runs of window starts that are repeated, per document with any.

    Spans may touch and come in no order; equal rows are one row here. See
    ``without_repeats`` for the cases.
    """
    if not 1 <= gram <= min_bytes:
        raise ValueError("a gram must fit into a passage")
    texts = _texts(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    found = materialize(
        texts.where(F.length("text") >= min_bytes).mapInArrow(
            _find(min_bytes, gram),
            f"id {kind}, row_hash bigint, grp bigint, digest binary, first bigint, windows bigint, left bigint",
        )
    )
    place = F.struct("id", "row_hash", "first")
    distinct = materialize(
        found.groupBy("grp", "digest").agg(
            F.count(F.lit(1)).alias("copies"), F.min(place).alias("place"),
            F.min("windows").alias("windows"), F.min("left").alias("left"),
        )
    )
    several = distinct.groupBy("grp").agg(F.sum("copies").alias("total")).where("total > 1").select("grp")
    wanted = distinct.join(several, "grp").groupBy(
        F.col("place.id").alias("id__"), F.col("place.row_hash").alias("row__")
    ).agg(F.collect_list(F.struct("grp", "digest", "copies", "left", "windows", "place.first")).alias("wanted"))
    segments = materialize(
        texts.join(wanted, _of_document(texts, wanted)).select("text", "wanted").mapInArrow(
            _cut_segments(min_bytes),
            "grp bigint, digest binary, copies bigint, left bigint, windows bigint, text binary",
        )
    )
    judged = judge_segments(segments, min_bytes, limit)
    return found.join(judged, ["grp", "digest"]).groupBy("id", "row_hash").agg(
        F.flatten(F.collect_list(F.transform("spans", lambda s: F.struct(
            (s["first"] + F.col("first")).alias("first"), (s["last"] + F.col("first")).alias("last")
        )))).alias("spans")
    )


def _remove(min_bytes: int):
    """Task function: texts with spans -> what is left of them."""

    def kept(text: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
        runs: list[list[int]] = []
        for first, last in sorted((s["first"], s["last"] + min_bytes) for s in spans or []):
            if runs and first <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], last)
            else:
                runs.append([first, last])
        begins, ends = [0, *[r[1] for r in runs]], [*[r[0] for r in runs], len(text)]
        return b"".join(text[a:b] for a, b in zip(begins, ends, strict=True)), len(runs)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            left = list(map(kept, texts, batch.column("spans").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([len(t) - len(k) for t, (k, _) in zip(texts, left, strict=True)], pa.int64()),
                    pa.array([n for _, n in left], pa.int64()),
                    pa.array([k for k, _ in left], pa.binary()),
                ],
                ["id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return remove


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    min_bytes: int = MIN_BYTES, gram: int = GRAM, limit: int = LIMIT,
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept), one row per row of ``docs``.

    A text is its UTF-8 bytes, null counts as empty. Every byte goes that is covered by a
    string of ``min_bytes`` bytes which starts at another place too, in any document, in the
    input; passages may overlap. ``n_spans`` counts maximal removed runs, ``kept`` are the
    bytes left, in which a cut may fall inside a character. Texts below ``min_bytes`` are
    kept. Rows that repeat an id and text are copies of each other; rows of one id with
    different texts are documents of their own. A null id is an id like any other. An empty
    table gives no rows. Other columns are ignored. Texts of any length are read in slices,
    but a text and its spans must fit into a task.
    """
    spans = repeated_spans(docs, id_col, text_col, min_bytes, gram, limit).withColumnsRenamed(
        {"id": "id__", "row_hash": "row__"}
    )
    texts = _texts(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    return texts.join(spans, _of_document(texts, spans), "left").select("id", "text", "spans").mapInArrow(
        _remove(min_bytes), f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    ).withColumnRenamed("id", id_col)
