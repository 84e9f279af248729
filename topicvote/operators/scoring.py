"""Scoring of many linear classifiers in one pass over the documents.

Every classifier of an ensemble (naive Bayes or linear SVM, one per topic and replicate) is a
weight vector over the vocabulary and an intercept. The vectors form one matrix, which tasks write to
the shared folder in chunks of terms (``StoredWeights``); the driver never has it. An executor makes one
file of it, of which a task maps a group of models at a time, whatever the number of models and folds. A document meets all
classifiers inside its own row, so no vote is ever shuffled to find a verdict.
"""

from __future__ import annotations

import fcntl
import os
import tempfile
import uuid
from collections.abc import Callable, Collection, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicvote.functions.literals import constant_array, constant_rows
from topicvote.operators.flags import FlagSums, entry_arrays, weighted_sums
from topicvote.operators.sampling import EnsembleSpec
from topicvote.session import new_path, ship_package

TILE_BYTES = 64 * 1024 * 1024
TILE_MODELS = 128
BITS = 62
# Sent files must outlive the jobs: an executor that joins late fetches them from the driver.
_sent: list[tempfile.TemporaryDirectory] = []


@dataclass(frozen=True)
class StoredWeights:
    """Weights (term, model) in the shared folder: rows (chunk, data) of ``chunk_terms`` terms and ``width``
    models each, which are added; terms without a row have none. These are the models from ``first`` to ``last``."""

    path: str
    n_terms: int
    width: int
    chunk_terms: int
    first: int
    last: int

    @property
    def shape(self) -> tuple[int, int]:
        return self.n_terms, self.last - self.first

    def __len__(self) -> int:
        return self.n_terms

    @property
    def name(self) -> str:
        return "weights-" + Path(self.path).parent.name

    def models(self, first: int, last: int) -> StoredWeights:
        return replace(self, first=first, last=last)

    def fill(self, out: np.ndarray) -> None:
        """Writes all models to ``out``, chunk by chunk."""
        system, path = fs.FileSystem.from_uri(self.path)
        table = ds.dataset(path, format="parquet", filesystem=system)
        for batch in table.to_batches(batch_size=1, batch_readahead=1, fragment_readahead=1, use_threads=False):
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
                part = np.frombuffer(data.as_buffer()).reshape(-1, self.width)
                out[chunk * self.chunk_terms : chunk * self.chunk_terms + len(part)] += part

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        out = np.zeros((self.n_terms, self.width))
        self.fill(out)
        return out[:, self.first : self.last].astype(dtype or float)

    def __getitem__(self, at) -> np.ndarray:
        return np.asarray(self)[at]

    def opened(self) -> np.ndarray:
        """In a task: the weights, mapped from a file that the first task of an executor makes."""
        if not self.n_terms:
            return np.zeros(self.shape)
        root, name = Path(SparkFiles.getRootDirectory()), self.name
        target = root / f"{name}.npy"
        if not target.exists():
            with open(root / f"{name}.lock", "w") as lock:
                fcntl.flock(lock, fcntl.LOCK_EX)
                if not target.exists():
                    made = root / f"{name}.part"
                    out = np.lib.format.open_memmap(made, "w+", float, (self.n_terms, self.width))
                    self.fill(out)
                    out.flush()
                    os.replace(made, target)
        return np.load(target, mmap_mode="r")[:, self.first : self.last]

    def grouped(self, group: int) -> GroupedWeights:
        """In a task: the weights in a file of groups of ``group`` models, which the first task of an executor makes
        chunk by chunk. A task maps a group at a time."""
        root, name = Path(SparkFiles.getRootDirectory()), f"{self.name}-{group}"
        target = root / f"{name}.groups"
        if not target.exists():
            with open(root / f"{name}.lock", "w") as lock:
                fcntl.flock(lock, fcntl.LOCK_EX)
                if not target.exists():
                    made = root / f"{name}.part"
                    with open(made, "w+b") as out:
                        out.truncate(8 * self.n_terms * self.width)
                        self._fill_groups(out.fileno(), group)
                    os.replace(made, target)
        return GroupedWeights(str(target), self.n_terms, self.width, group, self.first, self.last)

    def _fill_groups(self, file: int, group: int) -> None:
        system, path = fs.FileSystem.from_uri(self.path)
        table = ds.dataset(path, format="parquet", filesystem=system)
        for batch in table.to_batches(batch_size=1, batch_readahead=1, fragment_readahead=1, use_threads=False):
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
                part = np.frombuffer(data.as_buffer()).reshape(-1, self.width)
                for first in range(0, self.width, group):
                    own = np.ascontiguousarray(part[:, first : first + group])
                    at = 8 * (first * self.n_terms + chunk * self.chunk_terms * own.shape[1])
                    held = np.frombuffer(os.pread(file, own.nbytes, at)).reshape(own.shape)
                    os.pwrite(file, (held + own).tobytes(), at)


@dataclass(frozen=True)
class GroupedWeights:
    """Weights in a file: a matrix (term, model) for each ``group`` models; these are the models from ``first`` to
    ``last``."""

    path: str
    n_terms: int
    width: int
    group: int
    first: int
    last: int

    def tiles(self, tile: int) -> Iterator[tuple[slice, np.ndarray]]:
        """The places of up to ``tile`` models, and their weights; only one group is mapped at a time."""
        for start in range(self.first - self.first % self.group, self.last, self.group):
            wide = min(self.group, self.width - start)
            shape = (self.n_terms, wide)
            data = np.memmap(self.path, float, "r", 8 * start * self.n_terms, shape) if self.n_terms else np.zeros(shape)
            end = min(self.last, start + wide)
            for at in range(max(self.first, start), end, tile):
                last = min(at + tile, end)
                part = data if last - at == wide else np.ascontiguousarray(data[:, at - start : last - start])
                yield slice(at - self.first, last - self.first), part
            del data, part


def _tiles(weights: np.ndarray | GroupedWeights, tile: int) -> Iterator[tuple[slice, np.ndarray]]:
    if isinstance(weights, GroupedWeights):
        yield from weights.tiles(tile)
        return
    for first in range(0, weights.shape[1], tile):
        here = slice(first, first + tile)
        yield here, np.ascontiguousarray(weights[:, here])


def store_weights(chunks: DataFrame, n_terms: int, width: int, chunk_terms: int) -> StoredWeights:
    """Writes the rows (chunk, data) of a weight matrix."""
    path = new_path(chunks.sparkSession, "weights")
    chunks.write.parquet(path)
    return StoredWeights(path, n_terms, width, chunk_terms, 0, width)


@dataclass
class LinearEnsemble:
    """``weights`` is (vocabulary, models), in the shared folder or in memory; ``model_of`` maps (topic,
    replicate), topic-major, to a model. Replicates of a topic that keeps all its negatives share one
    model. ``sums`` are those the models were made of, if they were made of any."""

    spec: EnsembleSpec
    weights: StoredWeights | np.ndarray
    intercepts: np.ndarray
    model_of: np.ndarray
    sums: FlagSums | None = None


def weights_file(n_terms: int, models: int) -> np.ndarray:
    """Zeros (term, model), mapped from a new file in which a model's weights lie together: they are
    written model by model, and the driver does not hold more than it writes."""
    if not n_terms * models:
        return np.zeros((n_terms, models))
    path = Path(_folder()) / f"weights-{uuid.uuid4().hex}.npy"
    return np.lib.format.open_memmap(path, "w+", float, (n_terms, models), fortran_order=True)


def _folder() -> str:
    folder = tempfile.TemporaryDirectory(prefix="topicvote-")
    _sent.append(folder)
    return folder.name


def _send(spark: SparkSession, weights: StoredWeights | np.ndarray) -> StoredWeights | str:
    """Gives every executor weights that are in memory as a file, model by model; returns the file's name."""
    if isinstance(weights, StoredWeights):
        return weights
    if isinstance(weights, np.memmap):
        weights.flush()
        path = Path(weights.filename)
    else:
        path = Path(_folder()) / f"weights-{uuid.uuid4().hex}.npy"
        np.save(path, np.asfortranarray(weights))
    spark.sparkContext.addFile(str(path))
    return path.name


def tile_models(n_terms: int, tile_bytes: int = TILE_BYTES) -> int:
    """Models that a task holds the weights of at a time."""
    return max(1, min(TILE_MODELS, tile_bytes // (8 * max(1, n_terms))))


def _voted(
    batch: pa.RecordBatch, at: np.ndarray | None, weights: np.ndarray | GroupedWeights, intercepts: np.ndarray, tile: int
) -> np.ndarray:
    """Votes (row, model) of the rows ``at`` of a batch (all if None), a tile of models at a time."""
    ids, tfs, starts = entry_arrays(batch if at is None else batch.take(pa.array(at)))
    votes = np.empty((len(starts) - 1, len(intercepts)), np.int8)
    for here, part in _tiles(weights, tile):
        votes[:, here] = weighted_sums(ids, tfs, starts, part) + intercepts[here] > 0
    return votes


def _scored(
    counted: DataFrame,
    ensembles: Mapping[int | None, LinearEnsemble],
    keep: Collection[str],
    column: str,
    kind: str,
    finish: Callable[[np.ndarray, LinearEnsemble], np.ndarray],
    tile_bytes: int = TILE_BYTES,
) -> DataFrame:
    """The kept columns and an array of what ``finish`` makes of the models' votes (0/1, a row per
    document). A row is scored by the ensemble of its fold (``sim``), or by the only one under None.

    A task holds ``tile_bytes`` of weights, ``PRODUCTS`` products, and a
    byte for each model and row of a batch, whatever the vocabulary and the number of models."""
    spark = counted.sparkSession
    ship_package(spark)
    kept = [f for f in counted.schema.fields if f.name in keep]
    by_fold = None not in ensembles
    rows = counted.select(*[f.name for f in kept], "term_ids", "tfs", *([F.col("sim").alias("_fold")] if by_fold else []))
    sent = {}
    for fold, ensemble in ensembles.items():
        slots = LinearEnsemble(ensemble.spec, np.empty((0, 0)), ensemble.intercepts, ensemble.model_of)
        sent[fold] = _send(spark, ensemble.weights), slots, tile_models(len(ensemble.weights), tile_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = {
            fold: np.load(SparkFiles.get(at), mmap_mode="r") if isinstance(at, str) else at.grouped(tile)
            for fold, (at, _, tile) in sent.items()
        }
        for batch in batches:
            values = None
            for fold, (_, slots, tile) in sent.items():
                at = np.flatnonzero(batch.column("_fold").to_numpy(zero_copy_only=False) == fold) if by_fold else None
                part = finish(_voted(batch, at, opened[fold], slots.intercepts, tile), slots)
                if at is None:
                    values = part
                    continue
                if values is None:
                    values = np.zeros((batch.num_rows, part.shape[1]), part.dtype)
                values[at] = part
            sizes = np.arange(batch.num_rows + 1, dtype=np.int32) * values.shape[1]
            lists = pa.ListArray.from_arrays(sizes, pa.array(values.ravel()))
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, lists], [*[f.name for f in kept], column])

    schema = rows.select(*[f.name for f in kept], F.array().cast(f"array<{kind}>").alias(column)).schema
    return rows.mapInArrow(run, schema)


def score_votes(
    counted: DataFrame,
    ensemble: LinearEnsemble | Mapping[int | None, LinearEnsemble],
    keep: Collection[str] = ("doc_id",),
) -> DataFrame:
    """The kept columns and ``model_votes``, one 0/1 per distinct model; ``ensemble`` may be one for each
    fold (``sim``)."""
    ensembles = ensemble if isinstance(ensemble, Mapping) else {None: ensemble}
    return _scored(counted, ensembles, keep, "model_votes", "tinyint", lambda votes, _: votes)


def score_tallies(
    counted: DataFrame,
    ensemble: LinearEnsemble | Mapping[int, LinearEnsemble],
    keep: Collection[str] = ("doc_id",),
    grids: Sequence[int] | None = None,
    tile_bytes: int = TILE_BYTES,
) -> DataFrame:
    """The kept columns and ``tallies``: how many replicates vote for each topic, in the order of
    the ensemble's topics. With ``grids`` one such run for every g in it, over the replicates with
    i, j <= g. ``ensemble`` may be one for each fold (``sim``), of the same spec."""
    ensembles = ensemble if isinstance(ensemble, Mapping) else {None: ensemble}
    spec = next(iter(ensembles.values())).spec
    every = max(spec.outer, spec.inner)
    used = np.array(
        [[i <= g and j <= g for i, j in spec.replicates] for g in grids or [every]], np.int16
    )

    def finish(votes: np.ndarray, ensemble: LinearEnsemble) -> np.ndarray:
        by_topic = votes[:, ensemble.model_of].reshape(len(votes), len(spec.topics), spec.votes)
        tallies = np.einsum("dtr,gr->dgt", by_topic, used)
        return tallies.reshape(len(votes), used.shape[0] * len(spec.topics))

    return _scored(counted, ensembles, keep, "tallies", "smallint", finish, tile_bytes)


def tally_rows(topics: Sequence[int], tallies: str = "tallies") -> Column:
    """``tallies`` as an array of (topic, tally)."""
    return F.transform(
        F.arrays_zip(constant_array(topics).alias("topic"), F.col(tallies).alias("tally")),
        lambda z: F.struct(z["topic"].alias("topic"), z["tally"].cast("bigint").alias("tally")),
    )


def full_topics(topics: Sequence[int], n_votes: int, tallies: Column) -> Column:
    """The topics that have every vote."""
    zipped = F.arrays_zip(constant_array(topics).alias("topic"), tallies.alias("tally"))
    return F.transform(F.filter(zipped, lambda z: z["tally"] == n_votes), lambda z: z["topic"])


def only_topic(full: str) -> Column:
    """The verdict: the only topic with every vote, or null."""
    return F.when(F.size(full) == 1, F.get(full, F.lit(0)))


def strictness_verdicts(
    counted: DataFrame, ensemble: LinearEnsemble, keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """The kept columns, g and verdict for every strictness g x g that leaves a single topic."""
    spec = ensemble.spec
    grids, width = list(range(1, spec.outer + 1)), len(spec.topics)
    parts = [
        F.struct(
            F.lit(g).alias("g"),
            full_topics(spec.topics, g * g, F.slice("tallies", k * width + 1, width)).alias("full"),
        )
        for k, g in enumerate(grids)
    ]
    scored = score_tallies(counted, ensemble, keep, grids)
    return (
        scored.select(*keep, F.explode(F.array(*parts)).alias("p"))
        .where(F.size("p.full") == 1)
        .select(*keep, "p.g", F.get("p.full", F.lit(0)).alias("verdict"))
    )


def vote_table(counted: DataFrame, ensemble: LinearEnsemble) -> DataFrame:
    """The long vote table (doc_id, topic, i, j, vote)."""
    spec = ensemble.spec
    slots = constant_rows(
        [
            {"topic": t, "i": i, "j": j, "model": int(ensemble.model_of[n * spec.votes + r])}
            for n, t in enumerate(spec.topics)
            for r, (i, j) in enumerate(spec.replicates)
        ]
    )
    return (
        score_votes(counted, ensemble)
        .select("doc_id", "model_votes", F.explode(slots).alias("s"))
        .select("doc_id", "s.topic", "s.i", "s.j", F.get("model_votes", "s.model").cast("int").alias("vote"))
    )


def wide_vote_table(counted: DataFrame, ensemble: LinearEnsemble) -> DataFrame:
    """What ``votes.wide_votes`` makes of the vote table: (doc_id, i, j) with a ``prediction_<topic>`` column per
    topic. A document's votes for a topic are packed in words of ``BITS`` bits inside its row; rows of the same
    ``doc_id`` are joined by these words, and only then there is a row for each replicate."""
    spec = ensemble.spec
    width, words = len(spec.topics), -(-spec.votes // BITS)
    values = 1 << (np.arange(spec.votes, dtype=np.int64) % BITS)

    def finish(votes: np.ndarray, ensemble: LinearEnsemble) -> np.ndarray:
        out = np.empty((len(votes), words, width), np.int64)
        places = ensemble.model_of.reshape(width, spec.votes)
        for k in range(words):
            own = slice(k * BITS, (k + 1) * BITS)
            for t in range(width):
                out[:, k, t] = votes[:, places[t, own]] @ values[own]
        return out.reshape(len(votes), words * width)

    scored = _scored(counted, {None: ensemble}, ["doc_id"], "bits", "bigint", finish)
    either = [F.bit_or(F.get("bits", F.lit(k))).alias(f"word_{k}") for k in range(words * width)]
    slots = constant_rows(
        [{"i": i, "j": j, "word": r // BITS, "bit": r % BITS} for r, (i, j) in enumerate(spec.replicates)]
    )
    rows = scored.groupBy("doc_id").agg(*either).select("*", F.explode(slots).alias("s"))

    def vote(place: int, topic: int) -> Column:
        own = F.array(*[F.col(f"word_{k * width + place}") for k in range(words)])
        return F.when(F.getbit(F.get(own, F.col("s.word")), F.col("s.bit")) == 1, topic).otherwise(0)

    predictions = [vote(n, t).alias(f"prediction_{t}") for n, t in enumerate(spec.topics)]
    return rows.select("doc_id", "s.i", "s.j", *predictions)


def ensemble_verdicts(
    counted: DataFrame,
    ensemble: LinearEnsemble | Mapping[int, LinearEnsemble],
    missing_vote: str = "exclude",
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """The kept columns, ``full_topics`` and ``verdict``, without a long vote table.

    A document that was rejected for a topic has no vote there. ``'exclude'`` gives it no verdict
    at all, as an inner join of the topics' votes does; ``'abstain'`` lets the other topics decide.
    """
    if missing_vote not in ("exclude", "abstain"):
        raise ValueError("missing_vote is 'exclude' or 'abstain'")
    has_negatives = "neg_topics" in counted.columns
    scored = score_tallies(counted, ensemble, {*keep, "neg_topics"})
    spec = (next(iter(ensemble.values())) if isinstance(ensemble, Mapping) else ensemble).spec
    full = full_topics(spec.topics, spec.votes, F.col("tallies"))
    if has_negatives:
        if missing_vote == "exclude":
            empty = F.array().cast("array<int>")
            full = F.when(F.size("neg_topics") > 0, empty).otherwise(full)
        else:
            full = F.array_except(full, "neg_topics")
    return scored.select(*keep, full.alias("full_topics")).withColumn(
        "verdict", only_topic("full_topics")
    )
