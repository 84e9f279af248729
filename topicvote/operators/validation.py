"""Simulated validation: check a sample of each topic's verdicts and route the rest by it.

``classified`` has one row per document with a verdict: doc_id, label, verdict, draw (the random
order of the check) and the columns of the state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicvote.constants import TOPICS
from topicvote.functions.hashing import DEFAULT_SEED, draw
from topicvote.functions.literals import constant_table
from topicvote.operators.sampling import required_sample_size, sample_per_group

STATE_COLUMNS = ["doc_id", "sim", "row_hash", "label", "original_label", "in_train", "neg_topics"]


def check_order(round_number: int, seed: int | str = DEFAULT_SEED, hashed: str = "row_hash") -> Column:
    return draw(hashed, seed, "validate", round_number)


def sample_sizes(classified: DataFrame) -> DataFrame:
    """(verdict, num_classified, sample_size)"""
    sizes = classified.groupBy("verdict").agg(F.count("*").alias("num_classified"))
    return sizes.withColumn("sample_size", required_sample_size("num_classified"))


def validation_sample(classified: DataFrame) -> DataFrame:
    """The checked documents of every topic, with ``correct``."""
    sample = sample_per_group(classified, "verdict", "draw")
    return sample.withColumn("correct", (F.col("label") == F.col("verdict")).cast("int"))


def validation_numbers(
    classified: DataFrame, gate: float | None, topics: Sequence[int] = TOPICS
) -> DataFrame:
    """One row per topic: the counters of the check, whether the topic passes the gate, and the
    last sampled row (``cut``), by which sampled rows are told from others without a join."""
    sizes = classified.groupBy("verdict").agg(F.count("*").alias("num_classified"))
    checked = validation_sample(classified).groupBy("verdict").agg(
        F.count("*").alias("num_sample"),
        F.sum("correct").alias("num_correct"),
        F.max(F.struct("draw", "doc_id")).alias("cut"),
    )
    all_topics = constant_table(classified, ["topic"], [(t,) for t in topics])
    joined = (
        all_topics.join(F.broadcast(sizes), F.col("topic") == sizes["verdict"], "left")
        .drop("verdict")
        .join(F.broadcast(checked), F.col("topic") == checked["verdict"], "left")
        .drop("verdict")
        .na.fill(0, ["num_classified", "num_sample", "num_correct"])
    )
    precision = F.col("num_correct") / F.nullif("num_sample", F.lit(0))
    wrong = F.col("num_sample") - F.col("num_correct")
    passes = F.coalesce(precision >= F.lit(gate), F.lit(False)) if gate is not None else F.lit(False)
    return joined.select(
        "topic",
        "num_classified",
        "num_sample",
        (F.col("num_classified") - F.col("num_sample")).alias("num_non_sample"),
        "num_correct",
        wrong.alias("num_incorrect"),
        precision.alias("precision_in_sample"),
        F.when(passes, F.col("num_classified") - wrong)
        .otherwise(F.col("num_correct"))
        .alias("num_added_to_training"),
        passes.alias("passes"),
        "cut",
    )


def route(classified: DataFrame, numbers: DataFrame, keep_negatives: bool) -> DataFrame:
    """Next state of the classified documents.

    A checked document enters the training set if its verdict was right and returns otherwise,
    then remembering the rejected topic if ``keep_negatives``. An unchecked one enters with its
    verdict as the label if its topic passed the gate.
    """
    gates = numbers.select(F.col("topic").alias("verdict"), "passes", "cut")
    rows = classified.join(F.broadcast(gates), "verdict")
    checked = F.struct("draw", "doc_id") <= F.col("cut")
    right = F.col("label") == F.col("verdict")
    accepted = F.when(checked, right).otherwise(F.col("passes"))
    negatives = F.col("neg_topics")
    if keep_negatives:
        rejected = checked & ~right
        negatives = F.when(
            rejected, F.array_union("neg_topics", F.array("verdict"))
        ).otherwise(F.col("neg_topics"))
    return rows.select(
        "doc_id",
        "sim",
        "row_hash",
        F.when(accepted, F.col("verdict")).otherwise(F.col("label")).alias("label"),
        "original_label",
        accepted.cast("int").alias("in_train"),
        negatives.alias("neg_topics"),
    )


def learn_tied(tied: DataFrame) -> DataFrame:
    """Next state of documents with every vote on several topics: they are coded by hand, which
    the true label stands for, and enter the training set."""
    return tied.select(
        "doc_id",
        "sim",
        "row_hash",
        "label",
        "original_label",
        F.lit(1).alias("in_train"),
        "neg_topics",
    )
