"""Rows of term counts in blocks, written to the shared folder once and read by every pass of a fit.

A block has about ``BLOCK_ENTRIES`` entries of at most ``BLOCK_ROWS`` rows, in two files. ``rows`` has the rows as they
came, for sums along a row. ``terms`` has the entries by term, for sums along a term: cut into pieces of at most
``PIECE`` entries, those of one size after each other, ``PIECES`` at a time, all their first entries, then all their
second ones and so on. So a pass sorts nothing, and adds whole arrays.

A row keeps its block and its place in it, whichever task reads the block, so that a fit may keep numbers of the rows
in files beside it (``write`` and ``read``).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from topicvote.operators.flags import NO_LABEL, SINGLE, entry_arrays
from topicvote.session import new_path

BLOCK_ENTRIES = 1 << 21
BLOCK_ROWS = 1 << 16
PIECE = 32
PIECES = 2048
HELD = 4


@dataclass(frozen=True)
class Terms:
    """The entries of a block by term: ``counts`` pieces of each of the ``sizes``, and their ``terms``; ``bounds`` are
    the sums of the entries' counts and of their squares."""

    sizes: Sequence[int]
    counts: Sequence[int]
    bounds: Sequence[float]
    terms: np.ndarray
    owner: np.ndarray
    tfs: np.ndarray

    def add(self, shares: np.ndarray, out: np.ndarray, power: int = 1, columns: np.ndarray | None = None) -> None:
        """Adds the entries' counts to a ``power``, times the shares of their rows, to their terms' rows of ``out`` (to
        its ``columns``). Where shares (-1, 0, 1) are whole numbers and no sum can pass 2**24, single precision is exact too."""
        if not shares.shape[1]:
            return
        if columns is not None and len(columns) == out.shape[1]:
            columns = None
        single = shares.dtype.kind != "f" and self.bounds[power - 1] < SINGLE
        kind = np.float32 if single else np.float64
        shares = np.ascontiguousarray(shares, kind)
        room = np.empty((PIECES, shares.shape[1]), kind)
        piece = entry = 0
        for size, count in zip(self.sizes, self.counts, strict=True):
            for first in range(0, count, PIECES):
                n = min(PIECES, count - first)
                total, part = np.zeros((n, shares.shape[1]), kind), room[:n]
                for _ in range(size):
                    here = slice(entry, entry + n)
                    np.take(shares, self.owner[here], axis=0, out=part, mode="clip")
                    tfs = self.tfs[here]
                    if tfs.max() > 1:
                        part *= tfs.astype(kind)[:, None] ** power
                    total += part
                    entry += n
                terms = self.terms[piece : piece + n]
                if size == PIECE:  # a term may have many
                    heads = np.flatnonzero(np.diff(terms, prepend=-1))
                    terms, total = terms[heads], np.add.reduceat(total, heads, axis=0)
                if columns is None:
                    out[terms] += total
                else:
                    out[terms[:, None], columns] += total
                piece += n

    def dump(self) -> bytes:
        head = {"sizes": self.sizes, "counts": self.counts, "bounds": self.bounds, "tfs": self.tfs.dtype.str}
        head = json.dumps(head).encode()
        return b"".join([len(head).to_bytes(8, "little"), head, *(a.tobytes() for a in (self.terms, self.owner, self.tfs))])

    @classmethod
    def load(cls, data: bytes) -> Terms:
        at = 8 + int.from_bytes(data[:8], "little")
        head = json.loads(data[8:at])
        n, entries = sum(head["counts"]), sum(s * c for s, c in zip(head["sizes"], head["counts"], strict=True))
        terms = np.frombuffer(data, np.int32, n, at)
        owner = np.frombuffer(data, np.uint16, entries, at + 4 * n)
        tfs = np.frombuffer(data, np.dtype(head["tfs"]), entries, at + 4 * n + 2 * entries)
        return cls(head["sizes"], head["counts"], head["bounds"], terms, owner, tfs)


def by_term(ids: np.ndarray, tfs: np.ndarray, starts: np.ndarray) -> Terms:
    owner = np.repeat(np.arange(len(starts) - 1, dtype=np.uint16), np.diff(starts))
    # large counts first: behind them most steps have counts of 1 only
    order = np.argsort(ids.astype(np.int64) << 8 | 255 - np.minimum(tfs, 255), kind="stable")
    ids, owner = ids[order], owner[order]
    tfs = tfs[order].astype(np.min_scalar_type(int(tfs.max(initial=0))))
    heads = np.flatnonzero(np.diff(ids, prepend=-1))
    runs = np.diff(heads, append=len(ids))
    whole, rest = runs // PIECE, runs % PIECE
    of = np.concatenate([np.repeat(np.arange(len(runs)), whole), np.flatnonzero(rest)])
    within = np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole)
    begins = heads[of] + PIECE * np.concatenate([within, whole[rest > 0]])
    lengths = np.concatenate([np.full(len(within), PIECE), rest[rest > 0]])
    by_size = np.argsort(lengths, kind="stable")
    of, begins, lengths = of[by_size], begins[by_size], lengths[by_size]
    sizes, counts = np.unique(lengths, return_counts=True)
    places, at = [], 0
    for size, count in zip(sizes.tolist(), counts.tolist(), strict=True):
        for first in range(at, at + count, PIECES):
            own = begins[first : min(first + PIECES, at + count)]
            places.append((own[None, :] + np.arange(size)[:, None]).ravel())
        at += count
    places = np.concatenate([np.zeros(0, np.int64), *places])
    bounds = [float(tfs.sum(dtype=float)), float((tfs.astype(float) ** 2).sum())]
    return Terms(sizes.tolist(), counts.tolist(), bounds, ids[heads[of]].astype(np.int32), owner[places], tfs[places])


@dataclass(frozen=True)
class Blocks:
    """``entries`` has the number of entries of every block by its name, blocks of like rows after each other."""

    folder: str
    entries: dict[str, int]

    def spread(self, parts: int) -> list[list[str]]:
        """The blocks in at most ``parts`` groups of about as many entries, each in the order of the blocks."""
        groups: list[list[str]] = [[] for _ in range(max(1, min(parts, len(self.entries))))]
        filled = [0] * len(groups)
        for name in sorted(self.entries, key=self.entries.get, reverse=True):
            at = filled.index(min(filled))
            groups[at].append(name)
            filled[at] += self.entries[name] + 1
        place = {name: k for k, name in enumerate(self.entries)}
        return [sorted(group, key=place.get) for group in groups]

    def over(self, spark: SparkSession, work: Callable[[int, list[str]], Iterator[pa.RecordBatch]], kind: str) -> DataFrame:
        """What ``work`` gives for the number and the blocks of every group, a task each."""
        groups = self.spread(spark.sparkContext.defaultParallelism)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number in batch.column("id").to_pylist():
                    yield from work(number, groups[number])

        return spark.range(0, len(groups), 1, len(groups)).mapInArrow(run, kind)

    def rows(self, name: str) -> pa.RecordBatch:
        return pa.ipc.open_stream(_read(f"{self.folder}/rows/{name}")).read_next_batch()

    def terms(self, name: str) -> Terms:
        return Terms.load(_read(f"{self.folder}/terms/{name}"))

    def write(self, kind: str, name: str, matrix: np.ndarray) -> None:
        """Numbers of the rows of a block."""
        _write(f"{self.folder}/{kind}/{name}", np.ascontiguousarray(matrix).tobytes())

    def read(self, kind: str, name: str, dtype: type, width: int) -> np.ndarray:
        return np.frombuffer(_read(f"{self.folder}/{kind}/{name}"), dtype).reshape(-1, width)

    def drop(self, *kinds: str) -> None:
        for kind in kinds:
            system, path = fs.FileSystem.from_uri(f"{self.folder}/{kind}")
            if system.get_file_info(path).type == fs.FileType.Directory:
                system.delete_dir(path)


def _write(uri: str, data: bytes) -> None:
    folder, _, name = uri.rpartition("/")
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    made = f"{path}/{uuid.uuid4().hex}.part"
    with system.open_output_stream(made) as out:
        out.write(data)
    system.move(made, f"{path}/{name}")


def _read(uri: str) -> bytes:
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(path) as data:
        return data.read()


def _cut(batch: pa.RecordBatch, entries: int, rows: int) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Slices of a batch that have so many entries and rows at most (a row of more is alone), and their entries."""
    starts, first = entry_arrays(batch)[2], 0
    while first < batch.num_rows:
        end = int(np.searchsorted(starts, starts[first] + entries, side="right")) - 1
        end = max(first + 1, min(end, first + rows, batch.num_rows))
        yield batch.slice(first, end - first), int(starts[end] - starts[first])
        first = end


def _alike(batch: pa.RecordBatch, by: Sequence[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The rows of a batch by the values of the columns ``by``."""
    if not by:
        yield (), batch
        return
    values = np.stack([batch.column(c).fill_null(NO_LABEL).to_numpy(zero_copy_only=False) for c in by], axis=1)
    found, which = np.unique(values, axis=0, return_inverse=True)
    for k, key in enumerate(found.tolist()):
        yield tuple(key), batch.take(pa.array(np.flatnonzero(which.ravel() == k)))


def write_blocks(rows: DataFrame, by: Sequence[str] = ()) -> Blocks:
    """Writes ``rows``, which have term_ids, tfs and other columns, in one job. Rows of a block are alike in the columns
    ``by`` (whole numbers); a task holds ``HELD`` blocks' entries at most for that."""
    spark = rows.sparkSession
    folder, most_entries, most_rows, most_held = new_path(spark, "blocks"), BLOCK_ENTRIES, BLOCK_ROWS, HELD * BLOCK_ENTRIES

    def write(key: tuple, held: list[pa.RecordBatch], entries: int, place: int) -> pa.RecordBatch:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        name, out = uuid.uuid4().hex, pa.BufferOutputStream()
        with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as stream:
            stream.write_batch(batch)
        _write(f"{folder}/rows/{name}", out.getvalue())
        _write(f"{folder}/terms/{name}", by_term(*entry_arrays(batch)).dump())
        part = TaskContext.get().partitionId()
        found = {"kind": [json.dumps(key)], "part": [part], "place": [place], "name": [name], "entries": [entries]}
        return pa.RecordBatch.from_pydict(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[pa.RecordBatch]] = {}
        size: dict[tuple, int] = {}
        entries: dict[tuple, int] = {}
        place = 0
        for batch in batches:
            for key, alike in _alike(batch, by):
                for part, more in _cut(alike, most_entries, most_rows):
                    if key in held and (entries[key] + more > most_entries or size[key] + part.num_rows > most_rows):
                        yield write(key, held.pop(key), entries.pop(key), place)
                        place += 1
                        del size[key]
                    held.setdefault(key, []).append(part)
                    size[key], entries[key] = size.get(key, 0) + part.num_rows, entries.get(key, 0) + more
                while sum(entries.values()) > most_held:
                    largest = max(entries, key=entries.get)
                    yield write(largest, held.pop(largest), entries.pop(largest), place)
                    place += 1
                    del size[largest]
        for key in held:
            yield write(key, held[key], entries[key], place)
            place += 1

    found = sorted(rows.mapInArrow(run, "kind string, part bigint, place bigint, name string, entries bigint").collect())
    return Blocks(folder, {r["name"]: r["entries"] for r in found})
