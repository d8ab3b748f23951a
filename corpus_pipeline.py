"""From documents to packed training sequences, stage by stage.

Stage functions take ``(spark, docs, sf_dir)``; all but the last return the columns of documents.

Defined cases: null and empty texts and texts of any length go through the stages, empty ones have no share of the mix
and so don't reach the packing; rows that repeat are near copies of each other, one stays; null ids are ids like
others; without labels nothing is toxic; empty tables give an empty table; other columns are dropped at the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitloom.llm import common, jaccard, mixing, packing, pii, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Train on the labelled documents at hand; those that the model takes for toxic go."""
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, list(COLUMNS)).filter(F.col("score") < 0.5).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity 0.8: one document of each group of near copies stays."""
    return jaccard.deduplicate(docs).select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts becomes the name of its kind."""
    return pii.redact(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to their target weights; copies and cuts are rows."""
    return mixing.mixed(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("pii", redact),
    ("mixing", mix),
    ("packing", pack),
]

#: Training, tokenizing and the packing plan are not SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    df = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        df = common.materialize(stage(spark, df, sf_dir), name)
    return STAGES[-1][1](spark, df, sf_dir)
