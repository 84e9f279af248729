"""The study's inputs as views of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicvote.functions.labels import recode_topic
from topicvote.operators.features import (
    Vocabulary,
    count_vectors,
    fit_vocabulary,
    with_arrays,
    with_plain,
)
from topicvote.operators.rounds import start_state
from topicvote.session import materialise
from topicvote.sources.tables import read_table, spread

FOLD = 3


def raw_topic():
    """Two source groups have a topic of their own; the language decides for the others."""
    source = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    return (
        F.when(source % 7 == 0, 20)
        .when(source == 13, 16)
        .when(F.col("lang") == "en", 1)
        .when(F.col("lang") == "de", 4)
        .when(F.col("lang") == "es", 12)
        .otherwise(103)
    )


def raw_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, majortopic (not recoded), text, sim"""
    docs = read_table(spark, folder, "documents")
    return docs.select(
        "doc_id",
        raw_topic().alias("majortopic"),
        "text",
        (F.col("doc_id") % 3 + 1).cast("int").alias("sim"),
    )


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, label, text, sim"""
    return raw_corpus(spark, folder).select(
        "doc_id", recode_topic("majortopic").alias("label"), "text", "sim"
    )


def tokenised(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, label, sim and words, lower-cased text that the counting steps split."""
    return with_plain(spread(corpus(spark, folder)))


def counted(spark: SparkSession, folder: str) -> tuple[DataFrame, Vocabulary]:
    """The feature table, written once: doc_id, label, sim, raw_features."""
    docs = tokenised(spark, folder)
    vocabulary = fit_vocabulary(docs)
    return materialise(count_vectors(docs, vocabulary), "counts"), vocabulary


def training_rows(spark: SparkSession, folder: str, fold: int = FOLD) -> tuple[DataFrame, Vocabulary]:
    """Counts together with the state before round 1."""
    rows, vocabulary = counted(spark, folder)
    return start_state(with_arrays(rows), fold), vocabulary
