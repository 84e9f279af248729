"""Best-fit packing of documents into sequences, planned on the driver over counts of lengths.

Documents become token ids and an end token; longer ones than a sequence are cut, and the first
piece takes what is left over, so that all others fill a sequence each. Pieces are range-sorted by
length; a piece's rank among its length is its place in that order.

The plan is a sequential loop on the driver; no round runs on Spark. A round takes all pieces of one
length, longest first, together. Its successor is the smallest gap
that holds the length. Ranks resolve conflicts: the gaps of that size take as many pieces each as
fit, in the order of ranks, and what remains sweeps on to the next larger gap. Only when no gap is
left, new sequences are opened. Then the gaps are updated and the next round begins. As one length
at a time is placed, the result is that of sequential best-fit decreasing.

Sequences with the same gap are one run (gap, first sequence, number). Lengths are at most
``capacity``, so there are at most 1024 rounds and their plan is a table of runs whose size depends
on the lengths that occur and not on the number of pieces; it is broadcast, and each piece finds
its sequence by its rank.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from topicvote.llm.bpe import TOKENIZER, vocabulary
from topicvote.llm.common import column, map_rows
from topicvote.session import materialise, ship_package

CAPACITY = 1024
END_ID = 2


@cache
def tokenizer(path: str) -> tiktoken.Encoding:
    """A worker's encoder of the vocabulary in a file; its special token counts in texts, too."""
    vocab = vocabulary(path)
    special = {vocab.bytes[i].decode(): i for i in vocab.special}
    ranks = {b: i for i, b in enumerate(vocab.bytes) if b and i not in vocab.special}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def pieces(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    name: str = TOKENIZER,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    keep_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the ids themselves if ``keep_ids``. Null and
    empty texts have the end token only."""
    ship_package(docs.sparkSession)
    schema = "piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids

    def run(batch):
        encoder = tokenizer(public_tokenizers.path(name))
        special = tuple(encoder.special_tokens_set)

        def encode(text):
            if any(s in text for s in special):
                return encoder.encode(text, allowed_special="all")
            return encoder.encode_ordinary(text)

        owners, number, starts, lengths, sums, kept = [], [], [], [], [], []
        for at, text in enumerate(batch.column("text")):
            ids = encode(text.as_py() or "")
            ids.append(end_id)
            ids = np.array(ids, "<u4")
            parts = -(-len(ids) // capacity)
            head = len(ids) - (parts - 1) * capacity
            for k in range(parts):
                a = head + (k - 1) * capacity if k else 0
                part = ids[a : head + k * capacity]
                owners.append(at)
                number.append(k)
                starts.append(a)
                lengths.append(len(part))
                sums.append(zlib.crc32(part))
                if keep_ids:
                    kept.append(part.astype(np.int32))
        columns = [
            batch.column("doc_id").take(pa.array(owners, pa.int64())),
            pa.array(number, pa.int32()),
            *(pa.array(x, pa.int64()) for x in (starts, lengths, sums)),
        ]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if keep_ids:
            columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
        yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(column(docs, id_column).alias("doc_id"), column(docs, text_column).alias("text"))
    return map_rows(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {schema}")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from_rank, to_rank, first_sequence, each, at): the pieces of that length with
    ranks in [from_rank, to_rank) go to sequences from ``first_sequence`` on, ``each`` pieces to a
    sequence, the first of them at offset ``at``."""
    gaps: dict[int, deque[tuple[int, int]]] = defaultdict(deque)
    rows, opened = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            gap = next((g for g in range(length, capacity + 1) if gaps.get(g)), None)
            if gap is None:
                gap, each = capacity, capacity // length
                run = (opened, -(-left // each))
                opened += run[1]
            else:
                run, each = gaps[gap].popleft(), gap // length
            first, number = run
            full, over = divmod(min(left, number * each), each)
            placed = full * each + over
            rows.append((length, rank, rank + placed, first, each, capacity - gap))
            rank, left = rank + placed, left - placed
            for start, size, used in ((first, full, each), (first + full, int(over > 0), over)):
                if size and gap - used * length:
                    gaps[gap - used * length].append((start, size))
            untouched = number - full - (over > 0)
            if untouched:
                gaps[gap].appendleft((first + number - untouched, untouched))
    return rows


PLAN = "length bigint, from_rank bigint, to_rank bigint, first_sequence bigint, each bigint, at bigint"


def ranked(cut: DataFrame) -> DataFrame:
    """``cut`` (written before) with ``rank``, from 0 among the pieces of a length. Each range
    partition numbers its own rows; one row for each partition and length carries the numbers on."""
    order = ["length", *[c for c in ("doc_id", "piece", "ids_crc32") if c in cut.columns]]
    at = F.monotonically_increasing_id()
    ordered = materialise(
        cut.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at).withColumn(
            "part", F.shiftright("at", 33)
        ),
        "ordered",
    )
    heads = ordered.groupBy("part", "length").agg(F.min("at").alias("least"), F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = heads.select(
        "part", "length", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least")).alias("shift")
    )
    return ordered.join(offsets, ["part", "length"]).withColumn("rank", F.col("at") + F.col("shift")).drop(
        "part", "at", "shift"
    )


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (any columns, with length 1 to ``capacity``) with sequence_id and offset. Pieces of
    a sequence follow each other without a gap from offset 0."""
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = F.broadcast(spark.createDataFrame(plan(counts, capacity), PLAN))
    rows = ranked(cut)
    found = rows.join(table, "length").filter("rank >= from_rank AND rank < to_rank")
    nth = F.col("rank") - F.col("from_rank")
    return found.select(
        *cut.columns,
        (F.col("first_sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("each")) * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (ids), sequence_id, offset of every piece. The ids stay
    out of the sort and are joined with the places at the end."""
    capacity = options.get("capacity", CAPACITY)
    cut = pieces(docs, id_column, text_column, **options)
    if not options.get("keep_ids"):
        return pack(materialise(cut, "pieces"), capacity)
    cut = materialise(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    placed = pack(cut.drop("ids"), capacity)
    return placed.join(cut.select("row", "ids"), "row").drop("row")
