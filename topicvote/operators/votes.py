"""From votes to verdicts, on the long vote table (doc_id, topic, i, j, vote)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicvote.constants import TOPICS


def vote_tally(votes: DataFrame) -> DataFrame:
    """(doc_id, topic, tally): replicates that vote for the topic."""
    return votes.groupBy("doc_id", "topic").agg(F.sum("vote").alias("tally"))


def full_votes(tally: DataFrame, n_votes: int) -> DataFrame:
    """(doc_id, max_tally, n_full, verdict): the verdict is the only topic with every vote."""
    full = F.col("tally") == n_votes
    n_full = F.count_if(full)
    return tally.groupBy("doc_id").agg(
        F.max("tally").alias("max_tally"),
        n_full.alias("n_full"),
        F.when(n_full == 1, F.max(F.when(full, F.col("topic")))).alias("verdict"),
    )


def unanimous_verdicts(tally: DataFrame, n_votes: int) -> DataFrame:
    return full_votes(tally, n_votes).where(F.col("n_full") == 1).select("doc_id", "verdict")


def tied_documents(tally: DataFrame, n_votes: int) -> DataFrame:
    """Documents with every vote on more than one topic: candidates for active learning."""
    return full_votes(tally, n_votes).where(F.col("n_full") > 1).select("doc_id", "n_full")


def encoded_votes(votes: DataFrame) -> DataFrame:
    """Votes as topic codes: the code where the classifier said yes, else 0."""
    return votes.withColumn("vote", F.when(F.col("vote") == 1, F.col("topic")).otherwise(0))


def wide_votes(votes: DataFrame, topics: Sequence[int] = TOPICS) -> DataFrame:
    """One row per document and replicate with a ``prediction_<topic>`` column per topic."""
    coded = encoded_votes(votes).withColumn("name", F.concat(F.lit("prediction_"), F.col("topic")))
    names = [f"prediction_{t}" for t in topics]
    return coded.groupBy("doc_id", "i", "j").pivot("name", names).agg(F.max("vote"))


def strictness_tallies(votes: DataFrame, grid: int) -> DataFrame:
    """(doc_id, topic, tally_1..tally_grid): tallies over the first g x g replicates, all from
    one aggregation."""
    return votes.groupBy("doc_id", "topic").agg(
        *[
            F.sum(F.when((F.col("i") <= g) & (F.col("j") <= g), F.col("vote")).otherwise(0)).alias(
                f"tally_{g}"
            )
            for g in range(1, grid + 1)
        ]
    )


def strictness_verdicts(votes: DataFrame, grid: int) -> DataFrame:
    """(doc_id, g, verdict) for every strictness g x g that leaves a single topic."""
    per_doc = strictness_tallies(votes, grid).groupBy("doc_id")
    aggs = []
    for g in range(1, grid + 1):
        full = F.col(f"tally_{g}") == g * g
        aggs.append(
            F.when(F.count_if(full) == 1, F.max(F.when(full, F.col("topic")))).alias(f"verdict_{g}")
        )
    wide = per_doc.agg(*aggs)
    rows = F.array(
        *[
            F.struct(F.lit(g).alias("g"), F.col(f"verdict_{g}").alias("verdict"))
            for g in range(1, grid + 1)
        ]
    )
    return (
        wide.select("doc_id", F.explode(rows).alias("v"))
        .select("doc_id", "v.g", "v.verdict")
        .where(F.col("verdict").isNotNull())
    )
