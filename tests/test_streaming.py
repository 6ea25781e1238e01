"""The same scoring on a stream as on a batch."""

import pytest
from pyspark.sql import functions as F

from ruleweave.operators.coverage import add_enumerated_exceptions, score
from ruleweave.rules import Literal, Rule, Theory
from ruleweave.streaming.scoring import score_stream, windowed_quality

from .fixtures import cars

THEORY = Theory(
    "positive",
    (Rule("positive", (Literal("safety", "high"), Literal("ab0", None, True))),),
    (Rule("ab0", (Literal("seats", "2"),)),),
)


def test_stream_equals_batch(spark, tmp_path):
    c = cars(spark)
    timed = c.df.withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("case_id") * 600))
    timed.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(timed.schema).parquet(str(tmp_path / "in"))

    query = score_stream(stream, THEORY).writeStream.format("memory").queryName("scored").start()
    query.processAllAvailable()
    query.stop()
    batch = score(timed, THEORY)
    assert spark.table("scored").exceptAll(batch).count() == 0
    assert spark.table("scored").count() == batch.count()

    live = windowed_quality(score_stream(stream, THEORY))
    query = live.writeStream.format("memory").outputMode("complete").queryName("quality").start()
    query.processAllAvailable()
    query.stop()
    expected = windowed_quality(batch)
    assert spark.table("quality").exceptAll(expected).count() == 0
    assert spark.table("quality").count() == expected.count() > 1


def test_listed_exceptions_are_refused(spark):
    c = cars(spark)
    theory = add_enumerated_exceptions(c, Rule("positive", (Literal("safety", "high"),)))
    with pytest.raises(ValueError):
        score_stream(c.df, theory)
