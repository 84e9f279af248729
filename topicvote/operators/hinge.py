"""Many linear support vector machines fitted together, three Spark jobs for a step of all of them.

A model is told by two flags (``flags.py``): the rows it shall say yes to and those it shall say no
to. Each model takes its own quasi-Newton steps (limited memory BFGS with a backtracking line search)
towards the minimum of what the library's own learner minimises for one model in many jobs: the mean
hinge loss of standardised features with a quadratic penalty.

The rows are read in blocks (``blocks.py``). Margins grow linearly along a direction, so one pass over the rows
gives what the directions add to the margins, and from these numbers of a row and model all losses and slopes that a
line search may ask for. A second pass gives the gradients where the searches ended: a task sums those of its rows in one
matrix and gives it out in chunks of terms, which are added chunk by chunk in a second stage.

Points, gradients, directions and the last ``MEMORY`` steps stay in the shared folder, in files of a chunk
of terms each, and margins in files of a block of rows each; tasks read and write them. The driver gets the inner
products that a step needs, a few numbers for each chunk and model, and decides by them. A task's matrix of sums has a
number for each term and model of a tile; models are fitted in tiles that keep it below ``STATE_BYTES``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass, field
from math import sqrt
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicvote.operators.blocks import Blocks, write_blocks
from topicvote.operators.flags import Flag, TrainingRows, chunk_batch, entry_arrays, packed, unpacked, weighted_sums
from topicvote.operators.scoring import StoredWeights, store_weights
from topicvote.session import new_path, ship_package

MEMORY = 10
STATE_BYTES = 128 * 1024 * 1024
CHUNK_TERMS = 4096
DIRECT_BYTES = 64 * 1024 * 1024
TOTALS = -1
ARMIJO, WOLFE, GROW = 1e-4, 0.9, 2.1
LINE_STEPS = 8
LINE_CELLS = 1 << 15
VALUES = 20


@dataclass(frozen=True)
class Machine:
    """Learns to tell the rows of ``yes`` from those of ``no``."""

    yes: Flag
    no: Flag


class _LineSearchFailed(Exception):
    pass


@dataclass
class _Products:
    """Inner products of a model's gradient and its steps and changes of the gradient, by their numbers."""

    gradient: float
    steps: dict[int, float] = field(default_factory=dict)
    changes: dict[int, float] = field(default_factory=dict)
    step_change: dict[tuple[int, int], float] = field(default_factory=dict)
    change_change: dict[tuple[int, int], float] = field(default_factory=dict)


def _direction(known: _Products, history: Sequence[int]) -> tuple[float, dict[int, float], dict[int, float]]:
    """Shares of the gradient, of the steps and of the changes in the direction (uphill), by a two-loop recursion
    over ``history``, the newest first."""
    of_gradient, of_step, of_change = 1.0, dict.fromkeys(history, 0.0), dict.fromkeys(history, 0.0)
    shares = {}
    for i in history:
        along = of_gradient * known.steps[i] + sum(of_change[j] * known.step_change[i, j] for j in history)
        shares[i] = along / known.step_change[i, i]
        of_change[i] -= shares[i]
    if history:
        newest = history[0]
        scale = known.step_change[newest, newest] / known.change_change[newest, newest]
        of_gradient *= scale
        of_change = {i: scale * v for i, v in of_change.items()}
    for i in reversed(history):
        along = of_gradient * known.changes[i]
        along += sum(of_change[j] * known.change_change[i, j] + of_step[j] * known.step_change[j, i] for j in history)
        of_step[i] += shares[i] - along / known.step_change[i, i]
    return of_gradient, of_step, of_change


def descend(max_iter: int, tolerance: float) -> Generator[tuple, object, None]:
    """Steps of a model. It asks ``("evaluate", alpha, _)`` for (value, slope) at its point and so much of its
    direction, ``("commit", history, _)`` to go there, for the products of the new gradient, step and change with
    those of ``history``, and ``("direct", shares, (alpha, shrink))`` for a new direction's slope at its point: alpha is
    the first part of it that will be asked for, later ones are shrunk or grown."""
    value, _ = yield "evaluate", 0.0, None
    number, known = yield "commit", [], None
    first, values, history, failed = value, [value], [], False
    iteration = 0
    while iteration < max_iter:
        try:
            length = sqrt(known.gradient)
            if not length:
                raise _LineSearchFailed
            alpha, shrink = (0.5 / length, 0.1) if iteration == 0 else (1.0, 0.5)
            slope = yield "direct", _direction(known, history), (alpha, shrink)
            if not slope < 0:
                raise _LineSearchFailed
            for _ in range(LINE_STEPS):
                new_value, new_slope = yield "evaluate", alpha, None
                if new_value > value + alpha * slope * ARMIJO:
                    alpha *= shrink
                elif new_slope < WOLFE * slope:
                    alpha *= GROW
                elif new_slope > -WOLFE * slope:
                    alpha *= shrink
                else:
                    break
            else:
                raise _LineSearchFailed
        except _LineSearchFailed:
            if failed:
                break
            failed, history = True, []
            continue
        number, new = yield "commit", history, None
        new.step_change = {**known.step_change, **new.step_change}
        new.change_change = {**known.change_change, **new.change_change}
        known, value = new, new_value
        if known.step_change[number, number] > 0:
            history = [number, *history][:MEMORY]
        iteration += 1
        still = abs(value - max(values)) <= tolerance * abs(first)
        flat = sqrt(known.gradient) <= max(tolerance * value, 1e-8)
        values = [*values, value][-VALUES:]
        if still or flat:
            break


@dataclass(frozen=True)
class _Files:
    """Named matrices (term, model) of doubles in the shared folder, a file for each chunk of terms."""

    folder: str
    n_terms: int
    chunk_terms: int

    @property
    def n_chunks(self) -> int:
        return -(-self.n_terms // self.chunk_terms)

    def write(self, name: str, chunk: int, matrix: np.ndarray) -> None:
        system, path = fs.FileSystem.from_uri(self.folder)
        system.create_dir(f"{path}/{name}", recursive=True)
        made = f"{path}/{name}/{uuid.uuid4().hex}.part"
        with system.open_output_stream(made) as out:
            out.write(np.ascontiguousarray(matrix, float).tobytes())
        system.move(made, f"{path}/{name}/{chunk}")

    def read(self, name: str, chunk: int) -> np.ndarray:
        system, path = fs.FileSystem.from_uri(self.folder)
        with system.open_input_stream(f"{path}/{name}/{chunk}") as data:
            values = np.frombuffer(data.read())
        return values.reshape(min(self.chunk_terms, self.n_terms - chunk * self.chunk_terms), -1)

    def drop(self, *names: str) -> None:
        system, path = fs.FileSystem.from_uri(self.folder)
        for name in names:
            if system.get_file_info(f"{path}/{name}").type == fs.FileType.Directory:
                system.delete_dir(f"{path}/{name}")


@dataclass(frozen=True)
class _TrialWeights(StoredWeights):
    """Weights of a step, or of a direction. An executor keeps only those of the last one of a fit."""

    files: _Files | None = None

    @property
    def name(self) -> str:
        return f"trial-{Path(self.files.folder).parent.name}-{self.path}"

    def fill(self, out: np.ndarray) -> None:
        for chunk in range(self.files.n_chunks):
            at = chunk * self.chunk_terms
            out[at : at + self.chunk_terms] = self.files.read(self.path, chunk)

    def opened(self) -> np.ndarray:
        out = super().opened()
        if self.n_terms:
            here = Path(out.base.filename if out.base is not None and hasattr(out.base, "filename") else out.filename)
            for old in here.parent.glob(f"trial-{Path(self.files.folder).parent.name}-*.npy"):
                if old.name != here.name:
                    old.unlink(missing_ok=True)
        return out


def _by_chunk(spark: SparkSession, files: _Files, work: Callable[[int], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Does ``work`` for every chunk in tasks, and adds what it returns in the order of the chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column("id").to_pylist():
                yield chunk_batch(chunk, work(chunk))

    if not files.n_chunks:
        return np.zeros(shape)
    parts = min(files.n_chunks, 2 * spark.sparkContext.defaultParallelism)
    return _in_order(spark.range(0, files.n_chunks, 1, parts).mapInArrow(run, "chunk int, data binary"), shape)


def _in_order(rows: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    table = rows.toArrow().sort_by("chunk")
    out = np.zeros(shape)
    for data in table.column("data"):
        out += np.frombuffer(data.as_buffer()).reshape(shape)
    return out


def _chosen(rows: TrainingRows, machines: Sequence[Machine]) -> np.ndarray:
    """1 where a model shall say yes to a row, -1 where it shall say no, else 0."""
    yes = list(dict.fromkeys(m.yes for m in machines))
    which = [yes.index(m.yes) for m in machines]
    return rows.flags(yes)[:, which].astype(np.int8) - rows.flags([m.no for m in machines])


def _chunk_sums(
    blocks: Blocks,
    n_terms: int,
    width: int,
    chunk_terms: int,
    work: Callable[[str], tuple[np.ndarray | None, np.ndarray, np.ndarray]],
    whole: bool,
    power: int,
):
    """(chunk, part, data): ``work`` gives models (all if None), the shares of a block's rows in each of them and two
    rows of totals of all models. Sums of
    counts (to a ``power``) times shares by chunk of terms, ``whole`` numbers or not; under ``TOTALS`` the totals."""

    def run(number: int, names: list[str]) -> Iterator[pa.RecordBatch]:
        sums, totals = np.zeros((n_terms, width)), np.zeros((2, width))
        for name in names:
            columns, shares, own = work(name)
            totals += own
            blocks.terms(name).add(shares, sums, power, columns)
        if totals.any():
            yield pa.RecordBatch.from_pydict({"chunk": [TOTALS], "part": [number], "data": [totals.tobytes()]}, SUMS)
        for at in range(0, n_terms, chunk_terms):
            part = sums[at : at + chunk_terms]
            if part.any():
                yield pa.RecordBatch.from_pydict({"chunk": [at // chunk_terms], "part": [number], "data": [packed(part) if whole else part.tobytes()]}, SUMS)

    return run


def _counts(machines: Sequence[Machine], power: int):
    """Counts to a power in the rows of the models, and the number of these rows."""

    def work(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        used = np.abs(_chosen(TrainingRows([batch]), machines))
        n = used.sum(axis=0, dtype=float)
        return entry_arrays(batch)[1].astype(float) ** power, used, np.stack([n, np.zeros(len(n))])

    return work


SUMS = pa.schema([("chunk", pa.int64()), ("part", pa.int64()), ("data", pa.binary())])


def _added(files: _Files, name: str | None, order: Sequence[int], finish: Callable[[int, np.ndarray], np.ndarray]):
    """Adds sorted rows (chunk, part, data) for each chunk, in the order of the parts; writes the sum (if it has a
    name) and gives out what ``finish`` makes of it. The totals are given out as they are."""

    width = len(order)

    def done(chunk: int, total: np.ndarray) -> pa.RecordBatch:
        if chunk == TOTALS:
            return chunk_batch(chunk, total)
        if name:
            files.write(name, chunk, total)
        return chunk_batch(chunk, finish(chunk, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, total = None, None
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
                if chunk != here:
                    if here is not None:
                        yield done(here, total)
                    height = 2 if chunk == TOTALS else min(files.chunk_terms, files.n_terms - chunk * files.chunk_terms)
                    here, total = chunk, np.zeros((height, width))
                if len(data.as_buffer()):
                    total += unpacked(data, total.size).reshape(total.shape)
        if here is not None:
            yield done(here, total)

    return run


def _reached(first: np.ndarray, shrink: np.ndarray) -> np.ndarray:
    """The parts of a direction (trial, model) that a line search may come to from the ``first`` ones."""
    steps = [(i, j) for i in range(LINE_STEPS) for j in range(LINE_STEPS - i)]
    return np.stack([first * shrink**i * GROW**j for i, j in steps])


def _on_line(signs: np.ndarray, margins: np.ndarray, changes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What rows (row, model) lack to a margin of 1, and what of it a whole direction makes up; 0 for rows that a
    model does not read."""
    return np.where(signs != 0, 1 - signs * margins, 0.0), signs * changes


def _line_sums(signs: np.ndarray, slack: np.ndarray, gain: np.ndarray, alphas: np.ndarray) -> np.ndarray:
    """Losses, their slopes and the rows' shares in the gradient (trial, 3, model) at parts of a direction."""
    out = np.zeros((len(alphas), 3, signs.shape[1]))
    step = max(1, LINE_CELLS // max(1, signs.shape[1]))
    for at in range(0, len(signs), step):
        here, more, sign = slack[at : at + step], gain[at : at + step], signs[at : at + step]
        for k, alpha in enumerate(alphas):
            left = here - alpha * more
            lacks = left > 0
            out[k, 0] += np.maximum(left, 0, out=left).sum(axis=0)
            out[k, 1] -= np.multiply(more, lacks, out=left).sum(axis=0)
            out[k, 2] -= np.multiply(sign, lacks, out=left).sum(axis=0)
    return out


class _Fit:
    """A tile of models. Files by chunk of terms: ``dev`` and ``mean`` (deviations, 0 where a term is not used, and
    standardised means), ``p``, ``g`` and ``d`` with a number (points, gradients, directions), ``s`` and ``y`` (steps,
    changes of the gradient) and ``w`` (directions for plain counts). By block of rows: ``sign``, ``m`` with a number
    (margins at the points) and ``v`` (what a direction adds to them), these two of the models only that read a row of the
    block."""

    def __init__(self, spark: SparkSession, blocks: Blocks, machines: Sequence[Machine], n_terms: int, usable: np.ndarray, penalty: float):
        self.spark, self.blocks, self.machines, self.penalty = spark, blocks, machines, penalty
        self.files = _Files(new_path(spark, "fit"), n_terms, CHUNK_TERMS)
        self.own = uuid.uuid4().hex  # of the tile's files by block
        k = len(machines)
        self.alpha, self.slope, self.share = np.zeros(k), np.zeros(k), np.zeros(k)
        # the intercepts' parts of the vectors
        self.point, self.gradient, self.direction = np.zeros(k), np.zeros(k), np.zeros(k)
        self.steps: dict[int, np.ndarray] = {}
        self.changes: dict[int, np.ndarray] = {}
        self.mean_point, self.mean_direction = np.zeros(k), np.zeros(k)
        # squares of points and directions, and their products
        self.square, self.long, self.both = np.zeros(k), np.zeros(k), np.zeros(k)
        self.shrink = np.zeros(k)
        self.at, self.to = 0, 0
        self.traced: list[int] = []
        self.line: np.ndarray | None = None
        self.sums: np.ndarray | None = None
        self._scale(usable)
        files, zero = self.files, ("p0", "g0")

        def start(chunk: int) -> np.ndarray:
            shape = files.read("dev", chunk).shape
            for name in zero:
                files.write(name, chunk, np.zeros(shape))
            return np.zeros((0, 0))

        _by_chunk(self.spark, files, start, (0, 0))

    def _scale(self, usable: np.ndarray) -> None:
        """From the sums of counts and of their squares: two passes for all models of the tile."""
        files, blocks, machines, own = self.files, self.blocks, self.machines, self.own
        every, k = range(len(machines)), len(machines)

        def counts(power: int):
            count = _counts(machines, power)

            def work(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                _, used, totals = count(blocks.rows(name))
                columns = np.flatnonzero(used.any(axis=0))
                return columns, used[:, columns], totals

            return work

        def mark(number: int, names: list[str]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k)
            for name in names:
                signs = _chosen(TrainingRows([blocks.rows(name)]), machines)
                total += signs.sum(axis=0)
                blocks.write(f"sign{own}", name, signs)
            yield chunk_batch(number, total)

        signs = _in_order(blocks.over(self.spark, mark, "chunk int, data binary"), (k,))
        zeros = np.zeros((3, k))
        (n, _), _ = _tile_sums(self.spark, blocks, files, every, counts(1), "total", lambda chunk, sums: zeros)
        self.n = np.maximum(n, 1)
        self.loss, self.share = n.copy(), -signs  # where all weights are 0

        def finish(chunk: int, square: np.ndarray) -> np.ndarray:
            used = usable[chunk * files.chunk_terms : (chunk + 1) * files.chunk_terms]
            total = files.read("total", chunk)
            variance = np.maximum(square - total * total / np.maximum(n, 1), 0) / np.maximum(n - 1, 1)
            deviation = np.sqrt(np.where(used[:, None], variance, 0))
            mean = np.divide(total / np.maximum(n, 1), deviation, out=np.zeros_like(total), where=deviation > 0)
            files.write("dev", chunk, deviation)
            files.write("mean", chunk, mean)
            return zeros

        _tile_sums(self.spark, blocks, files, every, counts(2), None, finish, power=2)
        files.drop("total")

    def direct(self, asked: dict[int, tuple]) -> None:
        """New directions of the models asked for, those of the others are 0."""
        files, k, to = self.files, len(self.machines), self.to + 1
        order = sorted(asked)
        numbers = sorted({i for (_, steps, _), _ in asked.values() for i in steps})
        shares = np.zeros((1 + 2 * len(numbers), k))
        for model, ((gradient, steps, changes), (alpha, shrink)) in asked.items():
            shares[0, model], self.alpha[model], self.shrink[model] = gradient, alpha, shrink
            for at, i in enumerate(numbers):
                shares[1 + 2 * at : 3 + 2 * at, model] = steps.get(i, 0), changes.get(i, 0)
        point = self.at

        def work(chunk: int) -> np.ndarray:
            gradient = files.read(f"g{point}", chunk)
            out = shares[0] * gradient
            for at, i in enumerate(numbers):
                out += shares[1 + 2 * at] * files.read(f"s{i}", chunk) + shares[2 + 2 * at] * files.read(f"y{i}", chunk)
            out = np.where(-out * gradient < 0, -out, 0.0)
            files.write(f"d{to}", chunk, out)
            files.write(f"w{to}", chunk, _plain(files, chunk, out)[:, order])
            pairs = [(out, gradient), (out, files.read("mean", chunk)), (out, out), (out, files.read(f"p{point}", chunk))]
            return np.stack([(a * b).sum(axis=0) for a, b in pairs])

        slope, self.mean_direction, self.long, self.both = _by_chunk(self.spark, files, work, (4, k))
        out = shares[0] * self.gradient
        for at, i in enumerate(numbers):
            out += shares[1 + 2 * at] * self.steps[i] + shares[2 + 2 * at] * self.changes[i]
        self.direction = np.where(-out * self.gradient < 0, -out, 0.0)
        self.slope = slope + self.direction * self.gradient
        files.drop(f"d{self.to}", f"w{self.to}")
        self.to, self.line = to, None

    def _trace(self, order: Sequence[int]) -> None:
        """What the directions add to the margins of the rows, and the losses, slopes and shares at every part of
        them that a line search may ask for: one pass over the rows."""
        blocks, own, files, k, at, to = self.blocks, self.own, self.files, len(self.machines), self.at, self.to
        weights = _TrialWeights(f"w{to}", files.n_terms, len(order), files.chunk_terms, 0, len(order), files)
        intercepts = (self.direction - self.mean_direction)[order]
        alphas = _reached(self.alpha[order], self.shrink[order])

        def run(number: int, names: list[str]) -> Iterator[pa.RecordBatch]:
            opened, chosen, used = weights.opened(), None, None
            out = np.zeros((len(alphas), 3, len(order)))
            for name in names:
                signs = blocks.read(f"sign{own}", name, np.int8, k)
                reading = np.flatnonzero(signs.any(axis=0))
                here = np.isin(reading, order)
                models = reading[here]
                if not len(models):
                    continue
                places = np.searchsorted(order, models)
                if chosen is None or not np.array_equal(places, chosen):
                    chosen, used = places, opened if len(places) == len(order) else np.ascontiguousarray(opened[:, places])
                changes = weighted_sums(*entry_arrays(blocks.rows(name)), used) + intercepts[places]
                blocks.write(f"v{own}-{to}", name, changes)
                signs = signs[:, models]
                margins = blocks.read(f"m{own}-{at}", name, float, len(reading))[:, here]
                out[:, :, places] += _line_sums(signs, *_on_line(signs, margins, changes), alphas[:, places])
            yield chunk_batch(number, out)

        self.sums = _in_order(blocks.over(self.spark, run, "chunk int, data binary"), (len(alphas), 3, len(order)))
        blocks.drop(f"v{own}-{to - 1}")
        self.traced, self.line = list(order), alphas

    def evaluate(self, asked: dict[int, float]) -> dict[int, tuple[float, float]]:
        """(value, slope along the direction) of the models asked for, so much of their direction away."""
        out = {}
        if not self.at:  # all weights are 0
            return {m: (float(self.loss[m] / self.n[m]), 0.0) for m in asked}
        if self.line is None:
            self._trace(sorted(asked))
        for m, alpha in asked.items():
            model = self.traced.index(m)
            trial = int(np.abs(np.log(self.line[:, model] / alpha)).argmin())
            alpha = self.alpha[m] = self.line[trial, model]
            loss, slope, self.share[m] = self.sums[trial, :, model]
            square = self.square[m] + 2 * alpha * self.both[m] + alpha * alpha * self.long[m]
            value = loss / self.n[m] + 0.5 * self.penalty * square
            out[m] = float(value), float(slope / self.n[m] + self.penalty * (self.both[m] + alpha * self.long[m]))
        return out

    def commit(self, asked: dict[int, Sequence[int]]) -> dict[int, tuple[int, _Products]]:
        """Moves the models asked for to the points they were last evaluated at: one pass over the rows gives their
        gradients there."""
        files, blocks, own, k, penalty, n = self.files, self.blocks, self.own, len(self.machines), self.penalty, self.n
        order = sorted(asked)
        numbers = sorted({i for history in asked.values() for i in history})
        moved = np.zeros(k, bool)
        moved[order] = True
        alpha, share, old, to, number = self.alpha.copy(), self.share.copy(), self.at, self.to, self.at + 1
        traced = self.traced

        def work(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            signs = blocks.read(f"sign{own}", name, np.int8, k)
            reading = np.flatnonzero(signs.any(axis=0))
            here = np.isin(reading, order)
            models = reading[here]
            signs = signs[:, models]
            if not len(reading):
                return models, signs, np.zeros((2, len(order)))
            if old and not len(models):
                margins, shares = blocks.read(f"m{own}-{old}", name, float, len(reading)), signs
            elif old:
                known = reading[np.isin(reading, traced)]
                margins = blocks.read(f"m{own}-{old}", name, float, len(reading)).copy()
                changes = blocks.read(f"v{own}-{to}", name, float, len(known))[:, np.isin(known, order)]
                slack, gain = _on_line(signs, margins[:, here], changes)
                shares = np.where(slack - alpha[models] * gain > 0, -signs, 0)
                margins[:, here] += alpha[models] * changes
            else:
                margins, shares = np.zeros((len(signs), len(reading))), -signs
            blocks.write(f"m{own}-{number}", name, margins)
            return np.searchsorted(order, models), shares, np.zeros((2, len(order)))

        def finish(chunk: int, raw: np.ndarray) -> np.ndarray:
            deviation, mean = files.read("dev", chunk), files.read("mean", chunk)
            sums = np.zeros(deviation.shape)
            sums[:, order] = raw
            scaled = np.divide(sums, deviation, out=np.zeros_like(sums), where=deviation > 0)
            point, before = files.read(f"p{old}", chunk), files.read(f"g{old}", chunk)
            step = np.where(moved, alpha * files.read(f"d{to}", chunk), 0.0) if old else np.zeros(point.shape)
            point = point + step
            gradient = np.where(moved, (scaled - share * mean) / n + penalty * point, before)
            change = gradient - before
            for name, matrix in (("p", point), ("g", gradient), ("s", step), ("y", change)):
                files.write(f"{name}{number}", chunk, matrix)
            pairs = [(gradient, gradient), (gradient, step), (gradient, change), (step, change), (change, change), (mean, point), (point, point)]
            out = [(a * b).sum(axis=0) for a, b in pairs]
            for i in numbers:
                s, y = files.read(f"s{i}", chunk), files.read(f"y{i}", chunk)
                pairs = [(gradient, s), (gradient, y), (step, y), (s, change), (y, change)]
                out += [(a * b).sum(axis=0) for a, b in pairs]
            return np.stack(out)

        found = _tile_sums(self.spark, blocks, files, order, work, None, finish, (7 + 5 * len(numbers), k))[1]
        step = np.where(moved, alpha * self.direction, 0.0)
        gradient = np.where(moved, share / n, self.gradient)
        change = gradient - self.gradient
        self.point, self.gradient = self.point + step, gradient
        self.steps[number], self.changes[number] = step, change
        self.mean_point, self.square = found[5], found[6]
        own_parts = [gradient * gradient, gradient * step, gradient * change, step * change, change * change]
        for at, part in enumerate(own_parts):
            found[at] += part
        for at, i in enumerate(numbers):
            s, y = self.steps[i], self.changes[i]
            for place, part in enumerate((gradient * s, gradient * y, step * y, s * change, y * change)):
                found[7 + 5 * at + place] += part
        files.drop(f"p{old}", f"g{old}")
        blocks.drop(f"m{own}-{old}")
        self.at, self.line = number, None
        out = {}
        for m, history in asked.items():
            products = _Products(found[0, m], {number: found[1, m]}, {number: found[2, m]})
            products.step_change[number, number] = found[3, m]
            products.change_change[number, number] = found[4, m]
            for at, i in enumerate(numbers):
                if i in history:
                    products.steps[i], products.changes[i], step_y, s_change, y_change = found[7 + 5 * at : 12 + 5 * at, m]
                    products.step_change[number, i], products.step_change[i, number] = step_y, s_change
                    products.change_change[number, i] = products.change_change[i, number] = y_change
            out[m] = number, products
        return out

    def run(self, max_iter: int, tolerance: float) -> None:
        """Models search along their directions until none asks, then move together, then turn together: a step of
        all of them is two passes over the rows, whatever the searches ask for."""
        running = {m: descend(max_iter, tolerance) for m in range(len(self.machines))}
        asked = {m: next(steps) for m, steps in running.items()}
        history: dict[int, Sequence[int]] = {}
        while asked:
            kind = next(k for k in ("evaluate", "commit", "direct") if any(a[0] == k for a in asked.values()))
            here = {m: a[1:] for m, a in asked.items() if a[0] == kind}
            if kind == "direct":
                self.direct(here)
                answers = {m: float(self.slope[m]) for m in here}
            elif kind == "commit":
                answers = self.commit({m: a[0] for m, a in here.items()})
                history |= {m: [answers[m][0], *a[0]][: MEMORY + 1] for m, a in here.items()}
            else:
                answers = self.evaluate({m: a[0] for m, a in here.items()})
            for m, answer in answers.items():
                try:
                    asked[m] = running[m].send(answer)
                except StopIteration:
                    del asked[m]
                    history.pop(m, None)
            needed = {i for numbers in history.values() for i in numbers}
            for i in [i for i in self.steps if i not in needed]:
                self.files.drop(f"s{i}", f"y{i}")
                del self.steps[i], self.changes[i]

    def weights(self) -> tuple[StoredWeights, np.ndarray]:
        """Weights of plain counts and intercepts at the points; the files of the fit are dropped."""
        files, at = self.files, self.at

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk in batch.column("id").to_pylist():
                    yield chunk_batch(chunk, _plain(files, chunk, files.read(f"p{at}", chunk)))

        parts = min(max(1, files.n_chunks), 2 * self.spark.sparkContext.defaultParallelism)
        chunks = self.spark.range(0, files.n_chunks, 1, parts).mapInArrow(run, "chunk int, data binary")
        out = store_weights(chunks, files.n_terms, len(self.machines), files.chunk_terms)
        files.drop("")
        self.blocks.drop(f"sign{self.own}", f"m{self.own}-{at}", f"v{self.own}-{self.to}")
        return out, self.point - self.mean_point


def _plain(files: _Files, chunk: int, point: np.ndarray) -> np.ndarray:
    deviation = files.read("dev", chunk)
    return np.divide(point, deviation, out=np.zeros_like(point), where=deviation > 0)


def _tile_sums(
    spark: SparkSession,
    blocks: Blocks,
    files: _Files,
    order: Sequence[int],
    work: Callable[[str], tuple[np.ndarray | None, np.ndarray, np.ndarray]],
    name: str | None,
    finish: Callable[[int, np.ndarray], np.ndarray],
    shape: tuple[int, int] | None = None,
    whole: bool = True,
    power: int = 1,
) -> tuple[np.ndarray, np.ndarray]:
    """The totals, and the sums (of this ``shape``) of what ``finish`` makes of the chunks of ``_chunk_sums``, which are
    written as ``name``, if there is one. The tasks' matrices are added on the executors, about ``DIRECT_BYTES`` in a task."""
    shape = shape or (3, len(order))
    kind = "chunk bigint, part bigint, data binary"
    partial = blocks.over(spark, _chunk_sums(blocks, files.n_terms, len(order), files.chunk_terms, work, whole, power), kind)
    size = min(len(blocks.entries), spark.sparkContext.defaultParallelism) * 8 * files.n_terms * len(order)
    parts = min(files.n_chunks + 1, size // max(1, DIRECT_BYTES) + spark.sparkContext.defaultParallelism)
    every = spark.range(files.n_chunks).select(
        F.col("id").alias("chunk"), F.lit(-1).cast("bigint").alias("part"), F.lit(b"").alias("data")
    )
    added = partial.unionByName(every).repartition(parts, "chunk").sortWithinPartitions("chunk", "part")
    table = added.mapInArrow(_added(files, name, order, finish), "chunk int, data binary").toArrow().sort_by("chunk")
    totals, found = np.zeros((2, len(order))), np.zeros(shape)
    for chunk, data in zip(table.column("chunk").to_pylist(), table.column("data"), strict=True):
        into = totals if chunk == TOTALS else found
        into += np.frombuffer(data.as_buffer()).reshape(into.shape)
    return totals, found


def fit(
    rows: DataFrame,
    machines: Sequence[Machine],
    n_terms: int,
    usable: np.ndarray | None = None,
    max_iter: int = 10,
    penalty: float = 0.1,
    tolerance: float = 1e-4,
    state_bytes: int = STATE_BYTES,
) -> Iterator[tuple[int, StoredVector, float]]:
    """(model, weights of plain counts, intercept) of every machine.

    ``rows`` has label, in_train, row_hash, neg_topics, term_ids and tfs and is read once, to write its blocks; terms
    that are not ``usable`` get no weight. Sums of gradients are whole numbers, they do not depend on the tasks."""
    spark = rows.sparkSession
    ship_package(spark)
    usable = np.ones(n_terms, bool) if usable is None else usable
    # A machine of two topics reads no others' rows: blocks of one topic and fold are not gathered for it.
    pairs = not all(m.no.negative for m in machines)
    by = [c for c in ("label", "sim") if c in rows.columns] if pairs else []
    blocks = write_blocks(rows.coalesce(spark.sparkContext.defaultParallelism), by)
    tile = max(1, state_bytes // (8 * max(1, n_terms)))
    for first in range(0, len(machines), tile):
        models = _Fit(spark, blocks, machines[first : first + tile], n_terms, usable, penalty)
        models.run(max_iter, tolerance)
        weights, intercepts = models.weights()
        for k, intercept in enumerate(intercepts):
            yield first + k, StoredVector(weights, k), float(intercept)
    blocks.drop("")


@dataclass(frozen=True)
class StoredVector:
    """Weights of a model in the shared folder."""

    table: StoredWeights
    model: int

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        return self.table[:, self.model].astype(dtype or float)


def together(spark: SparkSession, vectors: dict[int, StoredVector], n_terms: int, width: int) -> StoredWeights:
    """One table of ``width`` models of the vectors at their places, made by tasks."""
    by_table: dict[StoredWeights, list[tuple[int, int]]] = {}
    for place, vector in vectors.items():
        by_table.setdefault(vector.table, []).append((place, vector.model))
    parts = []
    for table, pairs in by_table.items():
        found = spark.read.schema("chunk int, data binary").parquet(table.path)

        def run(batches: Iterator[pa.RecordBatch], table=table, pairs=tuple(pairs)) -> Iterator[pa.RecordBatch]:
            places, models = map(list, zip(*pairs, strict=True))
            for batch in batches:
                for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
                    values = np.frombuffer(data.as_buffer()).reshape(-1, table.width)
                    out = np.zeros((len(values), width))
                    out[:, places] = values[:, models]
                    yield chunk_batch(chunk, out)

        parts.append(found.mapInArrow(run, "chunk int, data binary"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    chunk_terms = next(iter(by_table)).chunk_terms
    return store_weights(out, n_terms, width, chunk_terms)
