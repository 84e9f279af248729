"""Topic codes, names and class names as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicvote.constants import OTHER_TOPIC, TOPIC_NAMES
from topicvote.functions.literals import constant_array, constant_table


def recode_topic(topic: str | Column, above: int = 23) -> Column:
    """Codes above the threshold become 'other'."""
    column = F.col(topic) if isinstance(topic, str) else topic
    return F.when(column > above, OTHER_TOPIC).otherwise(column).cast("int")


def binary_label(label: str | Column, topic: int | Column) -> Column:
    """One-vs-rest label as a double; a missing label counts as 'rest'."""
    column = F.col(label) if isinstance(label, str) else label
    return F.coalesce((column == topic).cast("double"), F.lit(0.0))


def topic_table(df: DataFrame) -> DataFrame:
    """The 22 topic codes with name and category, as a table."""
    rows = [(code, name, f"{code}. {name}") for code, name in TOPIC_NAMES.items()]
    return constant_table(df, ["topic", "name", "category"], rows)


def with_category(df: DataFrame, topic: str = "topic") -> DataFrame:
    """Adds ``category`` ('12. Law and Crime'); null for codes without a name."""
    names = topic_table(df).select(F.col("topic").alias(topic), "category")
    return df.join(F.broadcast(names), topic, "left")


def label_index(labels: DataFrame, label: str) -> DataFrame:
    """Position of each label among the sorted distinct labels, the number by which a fitted
    model calls it. One row per class, so the window is over a handful of rows."""
    distinct = labels.select(label).where(F.col(label).isNotNull()).distinct()
    position = F.row_number().over(W.orderBy(label)) - 1
    return distinct.select(position.cast("int").alias("index"), label)


def index_to_label(index: str | Column, labels: Sequence[int]) -> Column:
    """Maps a predicted class number back to its code, given the sorted codes."""
    column = F.col(index) if isinstance(index, str) else index
    return F.element_at(constant_array([int(x) for x in labels]), column.cast("int") + 1)


def class_name_to_code(name: str | Column) -> Column:
    """'Class: 12' -> 12."""
    column = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(column, "Class: ", "").cast("int")
