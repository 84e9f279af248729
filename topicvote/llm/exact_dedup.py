"""Exact deduplication by two passes over a Bloom filter, in DataFrame operations only.

Pass 1 marks two bits of one 64-bit filter word for every text and counts the marks. A bit
marked at least twice stays set: a text can have a copy only if both of its bits are set. Pass 2
looks every row up in that filter; only rows that may be repeated are shuffled and compared by
their SHA-256, and all others pass straight through. The filter has 16 bits for every row. It is
broadcast if its counted words fit ``BROADCAST_BYTES``; a larger one is joined by word.

Two texts are equal if they are identical without the characters ``[\\x20\\x09-\\x0D]``; null is
empty. Of equal texts the one with the most code points stays, then the smallest id (null last).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicvote.llm.common import bounded_broadcast, column, join_groups
from topicvote.session import materialise

BITS_PER_ROW = 16
FILTER_ROW_BYTES = 48


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def _filter_columns(rows: int) -> tuple[Column, Column, Column]:
    """Filter word and two bit numbers of a digest."""
    words = max(1, -(-rows * BITS_PER_ROW // 64))
    word = F.pmod(F.xxhash64("digest"), F.lit(words))
    other = F.xxhash64("digest", F.lit(1))
    return word, F.pmod(other, F.lit(64)).cast("int"), F.pmod(F.shiftright(other, 8), F.lit(64)).cast("int")


def repeated_filter(digests: DataFrame, rows: int) -> DataFrame:
    """word, bits: the bits that at least two of ``rows`` digests mark."""
    word, one, two = _filter_columns(rows)
    marks = digests.select(word.alias("word"), F.explode(F.array_distinct(F.array(one, two))).alias("bit"))
    return (
        marks.groupBy("word", "bit")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n >= 2")
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    )


def flag_repeated(digests: DataFrame, marked: DataFrame, rows: int) -> DataFrame:
    """``digests`` with ``repeated``: false only if no other row has the same digest."""
    word, one, two = _filter_columns(rows)
    keyed = digests.withColumn("word", word)
    mask = F.expr("shiftleft(1L, _one)").bitwiseOR(F.expr("shiftleft(1L, _two)"))
    small = bounded_broadcast(marked, FILTER_ROW_BYTES)
    if small is not None:
        looked_up = keyed.join(small, "word", "left")
    else:
        looked_up = join_groups(materialise(keyed, "keyed"), marked, "word", "left")
    return (
        looked_up.withColumns({"_one": one, "_two": two})
        .withColumn("repeated", F.coalesce(F.col("bits").bitwiseAND(mask) == mask, F.lit(False)))
        .drop("word", "bits", "_one", "_two")
    )


def mark_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for every row of ``docs``.

    Rows that repeat both id and text share one answer, as nothing tells them apart; an empty
    table gives an empty result. Other columns of ``docs`` are not read."""
    text = column(docs, text_column)
    digests = materialise(
        docs.select(
            column(docs, id_column).alias("doc_id"),
            F.length(F.coalesce(text, F.lit(""))).alias("size"),
            digest(text).alias("digest"),
        ),
        "digests",
    )
    rows = digests.count()
    marked = materialise(repeated_filter(digests, rows), "filter")
    flagged = flag_repeated(digests, marked, rows)
    unique = flagged.filter(~F.col("repeated")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest"
    )
    candidates = materialise(flagged.filter("repeated").drop("repeated"), "candidates")
    groups = candidates.groupBy("digest").agg(
        F.min(F.struct(-F.col("size"), F.col("doc_id").isNull(), F.col("doc_id"))).getField("doc_id").alias("keep_id"),
        F.count(F.lit(1)).alias("group_size"),
    )
    members = join_groups(candidates, groups, "digest").select("doc_id", "keep_id", "group_size", "digest")
    return unique.unionByName(members).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; exactly one row of each group,
    also where whole rows are repeated."""
    text = column(docs, text_column)
    keyed = docs.select(
        F.struct(*[column(docs, c).alias(c) for c in docs.columns]).alias("row"), digest(text).alias("digest")
    )
    digests = materialise(docs.select(digest(text).alias("digest")), "digests")
    rows = digests.count()
    marked = materialise(repeated_filter(digests, rows), "filter")
    flagged = flag_repeated(keyed, marked, rows)
    row = F.col("row")
    order = F.struct(
        -F.length(F.coalesce(row.getField(text_column), F.lit(""))),
        row.getField(id_column).isNull(),
        row.getField(id_column),
    )
    best = flagged.filter("repeated").groupBy("digest").agg(F.min_by("row", order).alias("row")).select("row")
    kept = flagged.filter(~F.col("repeated")).select("row").unionByName(best)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
