"""Helpers that several of these operators use."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicvote.session import materialise

HOT_SHARE = 1000
BROADCAST_BYTES = 32 << 20
GROUP_ROWS = 1 << 15


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def column(df: DataFrame, name: str):
    """A column of ``df`` by its exact name, dots included."""
    return df[f"`{name}`"]


def join_groups(members: DataFrame, groups: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Joins ``members`` (written before, any number of rows a key) with ``groups`` (one row a
    key, key never null). A key that holds at least 1/1000 of the members is hot. There cannot be
    more than 1000 of them, so their rows are broadcast whatever the input's size, and members
    with a hot key stay where they are. All others meet in an ordinary join."""
    counts = members.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = members.count()
    hot = materialise(
        counts.filter(F.col("_n") * HOT_SHARE >= F.lit(total)).select(key), "hot"
    )
    hot_groups = materialise(groups.join(F.broadcast(hot), key, "left_semi"), "hot_groups")
    warm = members.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(hot_groups), key, how)
    cold = members.join(F.broadcast(hot), key, "left_anti").join(groups, key, how)
    return warm.unionByName(cold)


def bounded_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame | None:
    """``df`` (written before) with a broadcast hint if its counted rows fit, else None."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else None


def map_rows(
    df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """Arrow batches of ``df`` through ``function``, which yields any number of batches for each."""

    def run(batches):
        for batch in batches:
            yield from function(batch)

    return df.mapInArrow(run, schema)


def text_slices(batch: pa.RecordBatch, name: str = "text", characters: int = 1 << 20):
    """The texts of a batch, null as empty, in slices (first row, texts) of about so many
    characters, so that working memory follows the slice and not the batch."""
    first, texts, size = 0, [], 0
    for at, text in enumerate(batch.column(name)):
        value = text.as_py() or ""
        texts.append(value)
        size += len(value)
        if size >= characters:
            yield first, texts
            first, texts, size = at + 1, [], 0
    if texts:
        yield first, texts


def sorted_groups(
    batches: Iterator[pa.RecordBatch], key: str, most: int | None = None, rows: int = GROUP_ROWS
) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Whole groups of rows sorted by ``key``, about ``rows`` rows at a time: a table, a number for the
    group of each row, and of the part of its group. With ``most`` a group is cut into parts of so
    many rows, and whole parts are given out, so that no group is held as a whole."""
    held, given = None, 0

    def cut(table: pa.Table, last: bool):
        nonlocal held, given
        codes = table.column(key).chunk(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
        heads = np.flatnonzero(np.diff(codes, prepend=-1))
        inside = np.arange(len(codes)) - np.repeat(heads, np.diff(heads, append=len(codes)))
        part = inside // most if most else np.zeros(len(codes), np.int64)
        part[: heads[1] if len(heads) > 1 else len(codes)] += given
        done = len(codes)
        if not last:
            others = np.flatnonzero((codes != codes[-1]) | (part != part[-1]))
            done = int(others[-1]) + 1 if len(others) else 0
        held, given = table.slice(done), int(part[-1]) if most and not last else 0
        return table.slice(0, done), codes[:done], part[:done]

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows >= rows:
            found = cut(held.combine_chunks(), False)
            if found[0].num_rows:
                yield found
    if held is not None and held.num_rows:
        yield cut(held.combine_chunks(), True)
