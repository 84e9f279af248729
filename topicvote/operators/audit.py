"""Checks and repairs of fetched metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicvote.session import materialise


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n_null) from one pass."""
    names = list(columns or df.columns)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return counts.unpivot([], names, "column", "n_null")


# Texts that mark the kinds of error in the logs.
ERROR_MARKS = {
    "overrun": "ERROR : subscript out of bounds",
    "error": "ERROR :",
    "http_error": "ERROR : HTTP error",
    "length_zero": "length zero",
    "undefined_columns": "undefined columns",
}


def error_flags(logs: DataFrame, column: str = "api_logs") -> DataFrame:
    """0/1 flags for the kinds of error."""
    return logs.withColumns(
        {name: F.col(column).contains(mark).cast("int") for name, mark in ERROR_MARKS.items()}
    )


def error_lines(logs: DataFrame, column: str = "api_logs") -> DataFrame:
    """Lines that report an error, runs past the end of the list aside."""
    flagged = error_flags(logs, column)
    return flagged.where((F.col("overrun") == 0) & (F.col("error") == 1)).drop("overrun")


def error_counts(logs: DataFrame, column: str = "api_logs") -> DataFrame:
    return logs.groupBy(column).agg(F.count("*").alias("n_errortype"))


def repair(rows: DataFrame, fixes: DataFrame, key: str, missing: str) -> DataFrame:
    """Replaces the rows whose ``missing`` column is null by their second attempt, if there is
    one. Complete rows pass by the join. A column only one side has is null for the other."""
    broken = rows.where(F.col(missing).isNull())
    complete = rows.where(F.col(missing).isNotNull())
    retried = fixes.join(broken.select(key), key, "left_semi")
    still = broken.join(fixes.select(key), key, "left_anti")
    return complete.unionByName(still).unionByName(retried, allowMissingColumns=True)


def numbered_rows(df: DataFrame, order: str, name: str = "row_nr") -> DataFrame:
    """Adds consecutive numbers 1, 2, ... in the order of a unique column.

    The rows are range-partitioned by the column and written with their partition's number; each
    partition then counts on from the sizes of those before it. No task sees more than its range.
    """
    ranged = df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id())
    ranged = materialise(ranged, "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    position = F.row_number().over(W.partitionBy("_part").orderBy(order))
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(name, position + F.col("_offset"))
        .drop("_part", "_offset")
    )


def row_range(df: DataFrame, order: str, first: int, last: int) -> DataFrame:
    """Rows ``first`` to ``last`` (1-based, both included) in the order of a unique column."""
    rows = numbered_rows(df, order)
    return rows.where(F.col("row_nr").between(first, last))
