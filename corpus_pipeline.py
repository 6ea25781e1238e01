"""A training corpus from raw documents: toxic texts and copies go, the rest is packed.

Each stage takes what the stage before it kept and returns documents with their columns; the
last returns the pieces of the packed sequences. The model of the first stage is learned
from the labelled rows of ``documents`` that are not held out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.llm import exact_dedup, near_dedup, packing, toxicity
from ruleweave.llm.queries import WORD_BPE, public_tokenizer
from ruleweave.llm.ship import ship
from ruleweave.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Documents with this toxicity score or more go; at most so many tokens in a sequence.
TOXIC, CAPACITY, END_ID = 0.7, 4096, 1


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC`` stay, with all their columns."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(toxicity.training_rows(docs, labels))
    scored = toxicity.score_documents(docs, model, name="toxicity__")
    return scored.where(F.col("toxicity__") < TOXIC).drop("toxicity__")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, with all its columns."""
    ship(spark)
    return exact_dedup.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words, similarity 0.8."""
    ship(spark)
    return near_dedup.first_of_each(docs, words=5, percent=80)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, sequence_id, offset): every document's place."""
    ship(spark)
    pieces = packing.token_pieces(docs, public_tokenizer(WORD_BPE), END_ID, CAPACITY).drop("ids")
    return packing.pack(pieces, CAPACITY, ["doc_id", "piece", "start"])


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack_documents),
]

#: No stage but the second can be expressed in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what each keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
