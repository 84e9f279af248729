"""Sums over the training rows of many models, in one pass.

A model's rows are told by a flag: the training rows of a topic, or the other ones, maybe only
those with a small draw. The flags of a row follow from its state by arithmetic, so a task makes
them for blocks of models while it has the row's term counts at hand, adds them to its sums and gives
these out once at its end, by chunks of terms and blocks, which are added up in a second stage. The input
is read in one job, however many models and folds there are.

Where the sums of the round before are known, only what has changed is added to them: rows that
got another label or now train, and rows whose draw lies between the old and the new end of a
flag's interval. The sums are integers, so they equal those of a full pass.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicvote.functions.hashing import P, draw_coefficients
from topicvote.session import materialise, ship_package

BLOCK = 32
BUFFERED_ENTRIES = 1 << 20
CHUNK_ENTRIES = 1 << 16
N_TERMS = 1 << 18
SUM_BYTES = 128 * 1024 * 1024
READ_BYTES = 64 * 1024 * 1024
CHUNK_TERMS = 1024
PRODUCTS = 1 << 17
SHORT = 16
SINGLE = 1 << 24
PART_BYTES = 32 * 1024 * 1024
ROWS_TERM = -1
TOUCHED_TERM = -2
BEFORE = "before_"
NO_LABEL = -(2**31)


@dataclass(frozen=True)
class Flag:
    """The training rows of ``topic``, or if ``negative`` all others and the known negatives of the
    topic; of these the ones whose draw for ``key`` is below ``threshold``, if one is set. Rows of
    the ``fold`` do not train, if one is set."""

    topic: int
    negative: bool = False
    key: tuple | None = None
    threshold: int | None = None
    fold: int | None = None

    @property
    def identity(self) -> Flag:
        """What stays the same from round to round."""
        return replace(self, threshold=None)


@dataclass(frozen=True)
class FlagSums:
    """The written sums of flags; a place that is no longer used is None. ``touched`` is how many
    (row, flag) pairs were summed for them in the last pass."""

    flags: tuple[Flag | None, ...]
    table: DataFrame
    touched: int


def entry_arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term numbers and counts of all rows, and where each row begins (one more at the end)."""
    ids, tfs = batch.column("term_ids"), batch.column("tfs")
    starts = np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy())])
    return ids.flatten().to_numpy(), tfs.flatten().to_numpy(), starts.astype(np.int64)


def weighted_sums(ids: np.ndarray, tfs: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted sums of the entries ``ids`` and ``tfs`` of every row; ``starts`` has one more element than there
    are rows. ``PRODUCTS`` weights are gathered at a time, which stay in the processor's cache; rows of up to
    ``SHORT`` entries are summed together with those of their length."""
    width, kind = weights.shape[1], weights.dtype
    out, tfs, sizes = np.zeros((len(starts) - 1, width), kind), tfs.astype(kind), np.diff(starts)
    weights = np.ascontiguousarray(weights)  # else every gathering copies all of them
    block = max(SHORT, PRODUCTS // max(1, width))
    room = np.empty((block, width), kind)
    for size in range(1, SHORT + 1):
        rows = np.flatnonzero(sizes == size)
        for at in range(0, len(rows), block // size):
            here = rows[at : at + block // size]
            entries = (starts[here][:, None] + np.arange(size)).ravel()
            parts = np.take(weights, ids[entries], axis=0, out=room[: len(entries)], mode="clip")
            parts *= tfs[entries, None]
            out[here] = parts if size == 1 else parts.reshape(len(here), size, width).sum(axis=1)
    for row in np.flatnonzero(sizes > SHORT):
        for at in range(starts[row], starts[row + 1], block):
            end = min(at + block, starts[row + 1])
            out[row] += tfs[at:end] @ np.take(weights, ids[at:end], axis=0, out=room[: end - at], mode="clip")
    return out


def term_sums(
    ids: np.ndarray, tfs: np.ndarray, owner: np.ndarray, shares: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(terms, sums): the entries of every term, each times the shares of the row ``owner``, added, about
    ``CHUNK_ENTRIES`` entries at a time; every term comes once. Where counts and shares (-1, 0, 1) are whole numbers
    and no sum can pass 2**24, single precision is exact too."""
    kind = np.float32 if shares.dtype.kind != "f" and tfs.sum(dtype=float) < SINGLE else np.float64
    order = np.argsort(ids, kind="stable")
    ids, tfs, owner = ids[order], tfs[order], owner[order]
    heads = np.flatnonzero(np.diff(ids, prepend=-1))
    starts = np.append(heads, len(ids))
    shares = np.ascontiguousarray(shares, kind)
    at = 0
    while at < len(heads):
        end = max(int(np.searchsorted(starts, starts[at] + CHUNK_ENTRIES, side="right")) - 1, at + 1)
        own = starts[at : end + 1]
        part = slice(own[0], own[-1])
        yield ids[heads[at:end]], weighted_sums(owner[part], tfs[part], own - own[0], shares)
        at = end


class TrainingRows:
    """State columns of buffered rows, and the flags that follow from them; with ``prefix`` the state
    of the round before."""

    def __init__(self, batches: Sequence[pa.RecordBatch], prefix: str = ""):
        table = pa.Table.from_batches(batches)
        self.label = table.column(prefix + "label").fill_null(NO_LABEL).to_numpy()
        self.train = table.column(prefix + "in_train").fill_null(0).to_numpy() == 1
        self.hash = table.column("row_hash").fill_null(0).to_numpy()
        self.sim = table.column("sim").fill_null(NO_LABEL).to_numpy() if "sim" in table.column_names else None
        known = table.column(prefix + "neg_topics").combine_chunks()
        sizes = known.value_lengths().fill_null(0).to_numpy()
        self.known_row = np.repeat(np.arange(len(sizes)), sizes)
        self.known_topic = known.flatten().to_numpy()

    def flags(self, wanted: Sequence[Flag | None]) -> np.ndarray:
        out = np.zeros((len(self.label), len(wanted)), bool)
        for k, flag in enumerate(wanted):
            if flag is None:
                continue
            is_topic = self.label == flag.topic
            trains = self.train if flag.fold is None else self.train & (self.sim != flag.fold)
            if not flag.negative:
                out[:, k] = trains & is_topic
                continue
            chosen = trains.copy()
            chosen[self.known_row[self.known_topic == flag.topic]] = True
            chosen &= ~is_topic
            if flag.threshold is not None:
                a, b = draw_coefficients(*flag.key)
                chosen &= (self.hash * a + b) % P < flag.threshold
            out[:, k] = chosen
        return out


def packed(sums: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold all of them."""
    largest = np.abs(sums).max(initial=0)
    kind = next((k for k in (np.int16, np.int32) if largest <= np.iinfo(k).max), float)
    return sums.astype(kind).tobytes()


def unpacked(data: pa.Scalar, size: int) -> np.ndarray:
    kind = {2: np.int16, 4: np.int32, 8: float}[len(data.as_buffer()) // size]
    return np.frombuffer(data.as_buffer(), kind).astype(float)


def _block_rows(block: int, terms: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    used = sums.any(axis=1)
    terms, sums = terms[used], sums[used]
    columns = [pa.array(terms.astype(np.int32)), pa.array(np.full(len(terms), block, np.int32))]
    columns += [pa.array(np.ascontiguousarray(sums[:, k])) for k in range(BLOCK)]
    names = ["term_id", "block", *[f"s{k}" for k in range(BLOCK)]]
    return pa.RecordBatch.from_arrays(columns, names)


PARTS = "chunk int, block int, data binary"
HEADS = -1


def _partial_sums(
    flags: Sequence[Flag | None], before: Sequence[Flag | None] | None, with_terms: bool, first: int, n_terms: int
):
    """(chunk, block, data): sums of a task's rows for the flags of some blocks, the ``first`` one and those after
    it, by ``CHUNK_TERMS`` terms; under ``HEADS`` the number of rows and how many of them changed."""
    n_blocks, chunk_terms = -(-len(flags) // BLOCK), CHUNK_TERMS
    width = n_blocks * BLOCK

    def held_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        """Small batches are summed together."""
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if with_terms:
                size += len(batch.column("term_ids").flatten())
            if size >= BUFFERED_ENTRIES:
                yield held
                held, size = [], 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, heads, bound = np.zeros((0, width), np.int32), np.zeros((2, width), np.int64), 0
        for held in held_batches(batches):
            here = np.zeros((sum(b.num_rows for b in held), width), np.int8)
            here[:, : len(flags)] = TrainingRows(held).flags(flags)
            if before is not None:
                here[:, : len(flags)] -= TrainingRows(held, BEFORE).flags(before)
            heads += np.stack([here.sum(axis=0, dtype=np.int64), np.abs(here).sum(axis=0, dtype=np.int64)])
            if not with_terms:
                continue
            parts = [entry_arrays(b) for b in held]
            owner = np.repeat(np.arange(len(here)), np.concatenate([np.diff(p[2]) for p in parts]))
            used = here.any(axis=1)[owner]
            ids, tfs, owner = np.concatenate([p[0] for p in parts])[used], np.concatenate([p[1] for p in parts])[used], owner[used]
            bound += int(tfs.sum(dtype=np.int64))
            if bound > np.iinfo(sums.dtype).max:
                sums = sums.astype(np.int64)
            if len(ids) and ids.max() >= len(sums):
                more = max(ids.max() + 1, min(2 * len(sums), n_terms)) - len(sums)
                sums = np.concatenate([sums, np.zeros((more, width), sums.dtype)])
            for terms, added in term_sums(ids, tfs, owner, here):
                sums[terms] += added.astype(sums.dtype)
        for k in range(n_blocks):
            own = slice(k * BLOCK, (k + 1) * BLOCK)
            yield _part(HEADS, first + k, heads[:, own])
            for at in range(0, len(sums), chunk_terms):
                part = sums[at : at + chunk_terms, own]
                if part.any():
                    part = np.pad(part, ((0, chunk_terms - len(part)), (0, 0)))
                    yield _part(at // chunk_terms, first + k, part)

    return run


def _part(chunk: int, block: int, sums: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([chunk], pa.int32()), pa.array([block], pa.int32()), pa.array([packed(sums)], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["chunk", "block", "data"])


def _added_parts(chunk_terms: int):
    """Rows (term_id, block, s0..) of the sums of sorted parts."""

    def rows(chunk: int, block: int, sums: np.ndarray) -> pa.RecordBatch:
        heads = np.array([ROWS_TERM, TOUCHED_TERM])
        terms = heads if chunk == HEADS else np.arange(chunk * chunk_terms, (chunk + 1) * chunk_terms)
        return _block_rows(block, terms, sums.astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, total = None, None
        for batch in batches:
            places = zip(batch.column("chunk").to_pylist(), batch.column("block").to_pylist(), strict=True)
            for place, data in zip(places, batch.column("data"), strict=True):
                if place != here:
                    if here is not None:
                        yield rows(*here, total)
                    here, total = place, np.zeros((2 if place[0] == HEADS else chunk_terms, BLOCK))
                total += unpacked(data, total.size).reshape(total.shape)
        if here is not None:
            yield rows(*here, total)

    return run


def flagged_sums(
    rows: DataFrame,
    flags: Sequence[Flag],
    with_terms: bool = True,
    before: FlagSums | None = None,
    n_terms: int = N_TERMS,
) -> FlagSums:
    """A table (term_id, block, s0..): for flag ``block * BLOCK + k`` the counts of the term summed over
    its rows as ``s<k>``, and under the term ``ROWS_TERM`` their number. Written, in one job: a task sums all
    its rows for as many flags as take ``SUM_BYTES`` with ``n_terms`` terms, and gives its sums out once; rows
    are read again for the flags after these.

    ``rows`` has label, in_train, row_hash and maybe neg_topics and sim, and term_ids and tfs if
    ``with_terms``. With ``before``, the sums of the round before, it also has label, in_train and
    neg_topics of that round under names with ``BEFORE``, and only rows whose flags have changed are
    summed: flags keep their places, new ones come behind them.
    """
    ship_package(rows.sparkSession)
    if before is not None:
        old = {f.identity: k for k, f in enumerate(before.flags) if f is not None}
        placed: list[Flag | None] = [None] * len(before.flags)
        for flag in flags:
            if flag.identity in old:
                placed[old[flag.identity]] = flag
            else:
                placed.append(flag)
        former = [*before.flags, *[None] * (len(placed) - len(before.flags))]
        former = [f if placed[k] is not None else None for k, f in enumerate(former)]
        flags = placed
    else:
        former = None

    def state(prefix: str) -> list[Column]:
        known = F.col(f"{prefix}neg_topics") if f"{prefix}neg_topics" in rows.columns else F.array()
        return [
            F.col(f"{prefix}label").cast("int").alias(f"{prefix}label"),
            F.col(f"{prefix}in_train").cast("int").alias(f"{prefix}in_train"),
            known.cast("array<int>").alias(f"{prefix}neg_topics"),
        ]

    def used(prefix: str) -> Column:
        trains = F.coalesce(F.col(f"{prefix}in_train") == 1, F.lit(False))
        return trains | (F.size(f"{prefix}neg_topics") > 0) if f"{prefix}neg_topics" in rows.columns else trains

    columns = [*state(""), F.col("row_hash").cast("bigint").alias("row_hash")]
    wanted = used("")
    if former is not None:
        columns += state(BEFORE)
        wanted = wanted | used(BEFORE)
    if any(f is not None and f.fold is not None for f in flags):
        columns.append(F.col("sim").cast("int").alias("sim"))
    columns += ["term_ids", "tfs"] if with_terms else []
    names = [f"s{k}" for k in range(BLOCK)]
    schema = ", ".join(["term_id int", "block int", *[f"{n} bigint" for n in names]])
    used_rows = rows.where(wanted).select(*columns)
    used_rows = used_rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    n_terms = max(1, n_terms) if with_terms else 0
    step = BLOCK * max(1, SUM_BYTES // (4 * BLOCK * max(1, n_terms)))
    tiles = []
    for at in range(0, len(flags), step):
        own, old_flags = list(flags[at : at + step]), None if former is None else former[at : at + step]
        tiles.append(used_rows.mapInArrow(_partial_sums(own, old_flags, with_terms, at // BLOCK, n_terms), PARTS))
    parts = reduce(DataFrame.unionByName, tiles)
    added = parts.repartition("chunk", "block").sortWithinPartitions("chunk", "block").mapInArrow(_added_parts(CHUNK_TERMS), schema)
    if before is not None:
        added = added.unionByName(before.table.where(F.col("term_id") != TOUCHED_TERM))
        added = added.groupBy("term_id", "block").agg(*[F.sum(n).alias(n) for n in names])
    sums = materialise(added, "sums")
    pairs = sums.where(F.col("term_id") == TOUCHED_TERM).agg(F.sum(sum(map(F.col, names[1:]), F.col(names[0])))).first()[0]
    return FlagSums(tuple(flags), sums, pairs or 0)


def flag_vectors(
    sums: FlagSums, n_terms: int, read_bytes: int = READ_BYTES, wanted: Collection[Flag] | None = None
) -> Iterator[tuple[Flag, np.ndarray, int]]:
    """(flag, sums of all terms, number of rows) of every flag (or those ``wanted``), in order. As
    many blocks are read at a time as take ``read_bytes`` at most, one at least."""
    n_flags = len(sums.flags)
    n_blocks = -(-n_flags // BLOCK)
    step = max(1, read_bytes // (8 * (BLOCK + 1) * (n_terms + 1)))
    for first in range(0, n_blocks, step):
        here = sums.flags[first * BLOCK : (first + step) * BLOCK]
        if not any(f is not None and (wanted is None or f in wanted) for f in here):
            continue
        chosen = F.col("block").between(first, first + step - 1) & (F.col("term_id") != TOUCHED_TERM)
        table = sums.table.where(chosen).toArrow()
        blocks, terms = table.column("block").to_numpy(), table.column("term_id").to_numpy()
        columns = [table.column(f"s{k}").to_numpy() for k in range(BLOCK)]
        for block in range(first, min(first + step, n_blocks)):
            at = np.flatnonzero(blocks == block)
            for k in range(min(BLOCK, n_flags - block * BLOCK)):
                flag = sums.flags[block * BLOCK + k]
                if flag is None or (wanted is not None and flag not in wanted):
                    continue
                vector = np.zeros(n_terms + 1)
                vector[terms[at]] = columns[k][at]  # ROWS_TERM is the last place
                yield flag, vector[:-1], int(vector[-1])


def flag_rows(sums: FlagSums) -> list[int]:
    """The number of rows of every flag, in order; 0 at a place that is no longer used."""
    counts = {r["block"]: r for r in sums.table.where(F.col("term_id") == ROWS_TERM).collect()}
    out = []
    for k, flag in enumerate(sums.flags):
        row = counts.get(k // BLOCK)
        out.append(0 if flag is None or row is None else row[f"s{k % BLOCK}"])
    return out


def chunked_sums(sums: FlagSums, n_terms: int, chunk_terms: int) -> DataFrame:
    """(chunk, data): the sums of ``chunk_terms`` terms after each other as a matrix (term, flag) of
    doubles, zeros too. Written, about ``PART_BYTES`` to a file; nothing of it comes to the driver."""
    width = BLOCK * -(-len(sums.flags) // BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, None
        for batch in batches:
            chunks, terms, blocks = (batch.column(n).to_numpy() for n in ("chunk", "term_id", "block"))
            values = np.stack([batch.column(f"s{k}").to_numpy() for k in range(BLOCK)], axis=1)
            for chunk in np.unique(chunks):
                if chunk != here:
                    if here is not None:
                        yield chunk_batch(here, held)
                    here, held = chunk, np.zeros((min(chunk_terms, n_terms - chunk * chunk_terms), width))
                at = np.flatnonzero((chunks == chunk) & (terms >= 0))
                places = held.reshape(len(held), -1, BLOCK)
                places[terms[at] - chunk * chunk_terms, blocks[at]] = values[at]
        if here is not None:
            yield chunk_batch(here, held)

    rows = sums.table.where(F.col("term_id") >= 0)
    rows = rows.withColumn("chunk", F.floor(F.col("term_id") / chunk_terms).cast("int"))
    spark, n_chunks = rows.sparkSession, -(-n_terms // chunk_terms)
    every = spark.range(n_chunks).select(
        F.lit(ROWS_TERM).alias("term_id"),
        F.lit(0).alias("block"),
        *[F.lit(0).cast("bigint").alias(f"s{k}") for k in range(BLOCK)],
        F.col("id").cast("int").alias("chunk"),
    )
    parts = max(spark.sparkContext.defaultParallelism, -(-8 * width * n_terms // PART_BYTES))
    rows = rows.unionByName(every).repartition(parts, "chunk").sortWithinPartitions("chunk")
    return materialise(rows.mapInArrow(run, CHUNKS), "chunks")


CHUNKS = "chunk int, data binary"


def chunk_batch(chunk: int, matrix: np.ndarray) -> pa.RecordBatch:
    data = pa.array([matrix.tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([int(chunk)], pa.int32()), data], ["chunk", "data"])
