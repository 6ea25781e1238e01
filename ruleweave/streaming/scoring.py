"""Scoring of case streams with a learned theory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.coverage import score
from ..operators.evaluate import confusion_aggregates, metric_columns
from ..rules import Theory


def score_stream(cases: DataFrame, theory: Theory) -> DataFrame:
    """``score`` on a stream: a projection without state.

    Exceptions that are lists of case ids would need a join and are refused.
    """
    if theory.listed:
        raise ValueError("listed exceptions cannot be scored on a stream")
    return score(cases, theory)


def windowed_quality(
    scored: DataFrame, ts: str = "ts", window: str = "1 hour", watermark: str = "10 minutes"
) -> DataFrame:
    """Confusion counts and metrics per tumbling window, for streams and batches.

    The state holds four counters per open window.
    """
    source = scored.withWatermark(ts, watermark) if scored.isStreaming else scored
    counts = source.groupBy(F.window(ts, window).alias("w")).agg(*confusion_aggregates())
    cols = [F.col(c) for c in ("tp", "tn", "fp", "fn")]
    return counts.select(F.col("w.start").alias("start"), *cols, *metric_columns(*cols))


def append_quality(
    cases: DataFrame, theory: Theory, path: str, checkpoint: str,
    ts: str = "ts", window: str = "1 hour", watermark: str = "10 minutes",
) -> None:
    """Score what has arrived in the stream ``cases`` and append the windows that are over.

    Everything that is there by now is read, then the stream stops; the next call with the
    same ``checkpoint`` (a shared folder) goes on after it, with the state of windows that
    are still open. A window is over once the watermark has passed its end: it is written
    once, and rows that arrive for it later are dropped. ``path`` is a folder of Parquet.
    """
    live = windowed_quality(score_stream(cases, theory), ts, window, watermark)
    query = (
        live.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
