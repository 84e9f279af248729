"""The start corpus: joined sources, filters, text, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicvote.constants import TOPICS
from topicvote.functions.hashing import DEFAULT_SEED, split_number
from topicvote.functions.text import assemble_text


def build_corpus(articles: DataFrame, text_types: DataFrame, topics: DataFrame) -> DataFrame:
    """Articles with a text type, a title, a URL and a topic: doc_id, majortopic, date, text.

    Missing strings become empty before the filters. ``articles``: id, date, title, url_api,
    lead_paragraph, headline_print; ``text_types``: id, text_type; ``topics``: id, majortopic.
    """
    kept = text_types.where(F.col("text_type") == "article").select("id")
    rows = articles.join(kept, "id").join(topics.select("id", "majortopic"), "id").na.fill("")
    return rows.where((F.col("title") != "") & (F.col("url_api") != "")).select(
        F.col("id").alias("doc_id"),
        "majortopic",
        "date",
        assemble_text("title", "lead_paragraph", "headline_print").alias("text"),
    )


def with_folds(corpus: DataFrame, folds: int = 3, seed: int | str = DEFAULT_SEED) -> DataFrame:
    """Adds ``sim``, a reproducible random fold 1..folds."""
    return corpus.withColumn("sim", split_number("doc_id", folds, seed))


def holdout(corpus: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) of one fold"""
    return corpus.where(F.col("sim") != fold), corpus.where(F.col("sim") == fold)


def topic_counts(corpus: DataFrame, label: str = "label") -> DataFrame:
    return corpus.groupBy(label).agg(F.count("*").alias("n"))


def fold_topic_counts(corpus: DataFrame, folds: int = 3, label: str = "label") -> DataFrame:
    """One row per topic, a column ``sim_<fold>`` per fold."""
    wide = corpus.groupBy(label).pivot("sim", list(range(1, folds + 1))).count().na.fill(0)
    return wide.select(label, *[F.col(str(f)).alias(f"sim_{f}") for f in range(1, folds + 1)])


def fold_sizes(corpus: DataFrame, folds: int = 3, label: str = "label") -> DataFrame:
    """(fold, label, n_train, n_test) for all folds from one count of (sim, label)."""
    cells = corpus.groupBy("sim", label).agg(F.count("*").alias("n"))
    every = F.array(*[F.lit(f) for f in range(1, folds + 1)])
    held = F.col("sim") == F.col("fold")
    return (
        cells.withColumn("fold", F.explode(every))
        .groupBy("fold", label)
        .agg(
            F.sum(F.when(held, 0).otherwise(F.col("n"))).alias("n_train"),
            F.sum(F.when(held, F.col("n")).otherwise(0)).alias("n_test"),
        )
    )


def coded_topics(corpus: DataFrame, label: str = "label") -> DataFrame:
    """Rows whose topic has a classifier."""
    return corpus.where(F.col(label).isin(*TOPICS))
