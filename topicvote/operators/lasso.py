"""Multinomial regressions with an L1 penalty, all penalties and folds fitted together.

A regression has a column of weights for each class. Every pass over the rows gives the losses and gradients of all
regressions that still run; points, gradients, directions and steps stay in the shared folder, in files of a chunk of terms
each (``hinge.py``), and the driver gets inner products only. The steps are those of the library's own learner (limited
memory quasi-Newton, kept to the orthant of the pseudo-gradient), of the same objective: the mean loss and the penalty
times the sum of the absolute weights of standardised counts; intercepts are free.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicvote.operators.blocks import Blocks, write_blocks
from topicvote.operators.flags import chunk_batch, entry_arrays, weighted_sums
from topicvote.operators.hinge import (
    CHUNK_TERMS,
    MEMORY,
    STATE_BYTES,
    _by_chunk,
    _Files,
    _Products,
    _tile_sums,
    _TrialWeights,
    descend,
)
from topicvote.operators.scoring import StoredWeights, store_weights
from topicvote.session import new_path, ship_package

TINY = 1e-15


@dataclass(frozen=True)
class Regression:
    """Fitted on the rows outside of ``fold`` (on all if None)."""

    penalty: float
    fold: int | None = None


@dataclass(frozen=True)
class Fitted:
    """``weights`` of plain counts (term, regression and class) and ``intercepts`` (regression, class)."""

    weights: StoredWeights
    intercepts: np.ndarray
    values: np.ndarray


def _losses(margins: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Losses (row, regression) and shares of the classes (row, regression, class)."""
    margins = margins - margins.max(axis=2, keepdims=True)
    shares = np.exp(margins)
    whole = shares.sum(axis=2, keepdims=True)
    own = margins[np.arange(len(kind)), :, kind]
    return np.log(whole[..., 0]) - own, shares / whole


def _kinds(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("index").to_numpy(), batch.column("fold").to_numpy()


def _margins(batch: pa.RecordBatch, weights: np.ndarray, used: np.ndarray, intercepts: np.ndarray) -> np.ndarray:
    """Margins (row, column). Most terms have no weight in any regression: only those ``used`` are gathered."""
    ids, tfs, starts = entry_arrays(batch)
    held = used[ids]
    starts = np.concatenate([[0], np.cumsum(held)])[starts]
    return weighted_sums(ids[held], tfs[held], starts, weights) + intercepts


def _pseudo(gradient: np.ndarray, point: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """The slope of loss and penalty; where a weight is 0 the one towards smaller values, if there is any."""
    low, high = gradient - penalty, gradient + penalty
    return np.where(point > 0, high, np.where(point < 0, low, np.where(high < 0, high, np.where(low > 0, low, 0.0))))


def _stepped(point: np.ndarray, pseudo: np.ndarray, step: np.ndarray) -> np.ndarray:
    """A step that ends where a weight would change its sign."""
    out = point + step
    side = np.where(point != 0, np.sign(point), -np.sign(pseudo))
    return np.where(np.sign(out) == side, out, 0.0)


class _Fit:
    """A tile of regressions. Files: ``dev`` and ``mean`` of each group of rows, ``p``, ``g``, ``q`` and ``d`` with a number
    (points, gradients, pseudo-gradients, directions), ``s`` and ``y`` (steps, changes of the gradient), ``w`` (weights
    of plain counts at the points asked for), ``raw`` (sums of a pass)."""

    def __init__(self, spark: SparkSession, blocks: Blocks, models: Sequence[Regression], n_terms: int, cells: np.ndarray):
        self.spark, self.blocks, self.models = spark, blocks, models
        self.classes = cells.shape[1]
        self.files = _Files(new_path(self.spark, "lasso"), n_terms, CHUNK_TERMS)
        self.width = len(models) * self.classes
        self.own = np.repeat(np.arange(len(models)), self.classes)  # the regression of a column
        folds = list(dict.fromkeys(m.fold for m in models))
        self.group = np.array([folds.index(m.fold) for m in models])[self.own]
        self.penalty = np.array([m.penalty for m in models])[self.own]
        held = np.stack([cells.sum(axis=0) - (0 if f is None else cells[f]) for f in folds])
        self.n = np.maximum(held.sum(axis=1), 1)[self.group]
        priors = np.log1p(held)
        priors -= priors.mean(axis=1, keepdims=True)
        zero = np.zeros(self.width)
        self.point, self.alpha, self.mean_at, self.size_at = priors[self.group[:: self.classes]].ravel(), zero.copy(), zero.copy(), zero.copy()
        self.gradient, self.direction, self.share = zero.copy(), zero.copy(), zero.copy()
        self.steps, self.changes = {}, {}
        self.at, self.to, self.tried, self.passes = 0, 0, 0, 0
        self.raw = self.w = None
        self.values = np.zeros(len(models))
        self._scale(folds)
        files, width = self.files, self.width

        def start(chunk: int) -> np.ndarray:
            height = len(files.read("dev", chunk))
            for name in ("p0", "g0", "q0", "d0"):
                files.write(name, chunk, np.zeros((height, width)))
            return np.zeros((0, 0))

        _by_chunk(self.spark, files, start, (0, 0))

    def _scale(self, folds: Sequence[int | None]) -> None:
        files, blocks, every = self.files, self.blocks, range(len(folds))
        n = self.n[[int(np.flatnonzero(self.group == g)[0]) for g in every]]

        def work(name: str) -> tuple[None, np.ndarray, np.ndarray]:
            fold = _kinds(blocks.rows(name))[1]
            used = np.stack([np.ones(len(fold), int) if f is None else (fold != f).astype(int) for f in folds], axis=1)
            return None, used, np.zeros((2, len(folds)))

        def finish(chunk: int, square: np.ndarray) -> np.ndarray:
            total = files.read("total", chunk)
            deviation = np.sqrt(np.maximum(square - total * total / n, 0) / np.maximum(n - 1, 1))
            files.write("dev", chunk, deviation)
            files.write("mean", chunk, np.divide(total / n, deviation, out=np.zeros_like(total), where=deviation > 0))
            return np.zeros((3, len(folds)))

        _tile_sums(self.spark, blocks, files, every, work, "total", lambda chunk, sums: np.zeros((3, len(folds))))
        _tile_sums(self.spark, blocks, files, every, work, None, finish, power=2)
        files.drop("total")

    def _try(self, direct=None) -> np.ndarray:
        """Writes the weights at the points asked for, after new directions of ``direct`` (chunk)."""
        files, group, alpha, at, to = self.files, self.group, self.alpha.copy(), self.at, self.to
        self.tried += 1
        trial = f"w{self.tried}"

        def work(chunk: int) -> np.ndarray:
            slope = np.zeros(len(group)) if direct is None else direct(chunk)
            deviation = files.read("dev", chunk)[:, group]
            point = _stepped(files.read(f"p{at}", chunk), files.read(f"q{at}", chunk), alpha * files.read(f"d{to}", chunk))
            files.write(trial, chunk, np.divide(point, deviation, out=np.zeros_like(point), where=deviation > 0))
            return np.stack([slope, (files.read("mean", chunk)[:, group] * point).sum(axis=0), np.abs(point).sum(axis=0)])

        slope, self.mean_at, self.size_at = _by_chunk(self.spark, files, work, (3, self.width))
        files.drop(f"w{self.tried - 1}")
        self.w = trial, alpha
        return slope

    def _sum(self, columns: np.ndarray) -> np.ndarray:
        """Sums of the columns of each regression."""
        return columns.reshape(*columns.shape[:-1], -1, self.classes).sum(axis=-1)

    def direct(self, asked: dict[int, tuple]) -> dict[int, float]:
        files, own, old = self.files, self.own, self.to
        numbers = sorted({i for (_, steps, _), _ in asked.values() for i in steps})
        shares = np.zeros((1 + 2 * len(numbers), len(self.models)))
        for model, ((gradient, steps, changes), (alpha, _)) in asked.items():
            shares[0, model] = gradient
            self.alpha[own == model] = alpha
            for k, i in enumerate(numbers):
                shares[1 + 2 * k : 3 + 2 * k, model] = steps.get(i, 0), changes.get(i, 0)
        shares, chosen, at = shares[:, own], np.isin(own, list(asked)), self.at
        self.to += 1
        new = f"d{self.to}"

        def work(chunk: int) -> np.ndarray:
            pseudo = files.read(f"q{at}", chunk)
            out = shares[0] * pseudo
            for k, i in enumerate(numbers):
                out += shares[1 + 2 * k] * files.read(f"s{i}", chunk) + shares[2 + 2 * k] * files.read(f"y{i}", chunk)
            out = np.where(chosen, np.where(out * pseudo > 0, -out, 0.0), files.read(f"d{old}", chunk))
            files.write(new, chunk, out)
            return (out * pseudo).sum(axis=0)

        slope = self._try(work)
        out = shares[0] * self.gradient
        for k, i in enumerate(numbers):
            out += shares[1 + 2 * k] * self.steps[i] + shares[2 + 2 * k] * self.changes[i]
        self.direction = np.where(chosen, np.where(out * self.gradient > 0, -out, 0.0), self.direction)
        files.drop(f"d{old}")
        slope = self._sum(slope + self.direction * self.gradient)
        return {m: float(slope[m]) for m in asked}

    def evaluate(self, asked: dict[int, float]) -> dict[int, tuple[float, float]]:
        """(value, slope along the direction) of the regressions asked for: one pass over the rows."""
        files, blocks, own, classes, to = self.files, self.blocks, self.own, self.classes, self.to
        for model, alpha in asked.items():
            self.alpha[own == model] = alpha
        columns = np.flatnonzero(np.isin(own, list(asked)))
        if self.w is None or not np.array_equal(self.w[1][columns], self.alpha[columns]):
            self._try()
        if self.raw:
            files.drop(self.raw[0])
        self.passes += 1
        raw = f"raw{self.passes}"
        weights = _TrialWeights(self.w[0], files.n_terms, self.width, files.chunk_terms, 0, self.width, files)
        intercepts = (self.point + self.alpha * self.direction - self.mean_at)[columns]
        folds = [self.models[m].fold for m in sorted(asked)]
        opened = []

        def work(name: str) -> tuple[None, np.ndarray, np.ndarray]:
            batch = blocks.rows(name)
            if not opened:
                whole = weights.opened()
                opened.append(whole if len(columns) == whole.shape[1] else np.ascontiguousarray(whole[:, columns]))
                opened.append(opened[0].any(axis=1))
            kind, fold = _kinds(batch)
            margins = _margins(batch, *opened, intercepts)
            losses, shares = _losses(margins.reshape(len(kind), len(folds), classes), kind)
            shares[np.arange(len(kind)), :, kind] -= 1
            used = np.stack([np.ones(len(fold), bool) if f is None else fold != f for f in folds], axis=1)
            shares = (shares * used[..., None]).reshape(len(kind), -1)
            totals = np.zeros((2, len(columns)))
            totals[0], totals[1, ::classes] = shares.sum(axis=0), np.where(used, losses, 0).sum(axis=0)
            return None, shares, totals

        zeros = np.zeros((3, len(columns)))
        found, _ = _tile_sums(self.spark, blocks, files, columns, work, raw, lambda chunk, sums: zeros, whole=False)
        self.raw = raw, columns
        self.share[columns] = found[0]
        gradient, point, penalty = self._gradient(), self._moved(), self.penalty

        def along(chunk: int) -> np.ndarray:
            here = point(chunk)
            return (_pseudo(gradient(chunk), here, penalty) * files.read(f"d{to}", chunk))[:, columns].sum(axis=0)[None]

        slopes = np.zeros(self.width)
        slopes[columns] = _by_chunk(self.spark, files, along, (1, len(columns)))[0]
        slopes = self._sum(slopes + self.share / self.n * self.direction)
        values = np.zeros(self.width)
        values[columns] = found[1]
        values = self._sum(values / self.n + self.penalty * self.size_at)
        for m in asked:
            self.values[m] = values[m]
        return {m: (float(values[m]), float(slopes[m])) for m in asked}

    def _moved(self):
        files, alpha, at, to = self.files, self.alpha.copy(), self.at, self.to
        return lambda chunk: _stepped(files.read(f"p{at}", chunk), files.read(f"q{at}", chunk), alpha * files.read(f"d{to}", chunk))

    def _gradient(self):
        """The gradient (chunk) at the points of the last pass."""
        files, group, share, n, (raw, columns) = self.files, self.group, self.share.copy(), self.n, self.raw

        def work(chunk: int) -> np.ndarray:
            deviation, mean = files.read("dev", chunk)[:, group], files.read("mean", chunk)[:, group]
            sums = np.zeros(deviation.shape)
            sums[:, columns] = files.read(raw, chunk)
            return (np.divide(sums, deviation, out=np.zeros_like(sums), where=deviation > 0) - share * mean) / n

        return work

    def commit(self, asked: dict[int, Sequence[int]]) -> dict[int, tuple[int, _Products]]:
        """Moves the regressions asked for to the points they were last evaluated at."""
        files, own, old, number, penalty = self.files, self.own, self.at, self.at + 1, self.penalty
        numbers = sorted({i for history in asked.values() for i in history})
        moved = np.isin(own, list(asked))
        point_at, gradient_at = self._moved(), self._gradient()

        def work(chunk: int) -> np.ndarray:
            start, before = files.read(f"p{old}", chunk), files.read(f"g{old}", chunk)
            point = np.where(moved, point_at(chunk), start)
            gradient = np.where(moved, gradient_at(chunk), before)
            pseudo = _pseudo(gradient, point, penalty)
            step, change = point - start, gradient - before
            for name, matrix in (("p", point), ("g", gradient), ("q", pseudo), ("s", step), ("y", change)):
                files.write(f"{name}{number}", chunk, matrix)
            pairs = [(pseudo, pseudo), (pseudo, step), (pseudo, change), (step, change), (change, change)]
            out = [(a * b).sum(axis=0) for a, b in pairs]
            for i in numbers:
                s, y = files.read(f"s{i}", chunk), files.read(f"y{i}", chunk)
                out += [(a * b).sum(axis=0) for a, b in ((pseudo, s), (pseudo, y), (step, y), (s, change), (y, change))]
            return np.stack(out)

        found = _by_chunk(self.spark, files, work, (5 + 5 * len(numbers), self.width))
        step = np.where(moved, self.alpha * self.direction, 0.0)
        gradient = np.where(moved, self.share / self.n, self.gradient)
        change = gradient - self.gradient
        self.point, self.gradient = self.point + step, gradient
        self.steps[number], self.changes[number] = step, change
        found[:5] += [gradient * gradient, gradient * step, gradient * change, step * change, change * change]
        for k, i in enumerate(numbers):
            s, y = self.steps[i], self.changes[i]
            found[5 + 5 * k : 10 + 5 * k] += [gradient * s, gradient * y, step * y, s * change, y * change]
        found = self._sum(found)
        files.drop(f"p{old}", f"g{old}", f"q{old}")
        self.at, self.w = number, None
        self.alpha[moved] = 0
        out = {}
        for m, history in asked.items():
            products = _Products(found[0, m], {number: found[1, m]}, {number: found[2, m]})
            products.step_change[number, number] = found[3, m]
            products.change_change[number, number] = found[4, m]
            for k, i in enumerate(numbers):
                if i in history:
                    products.steps[i], products.changes[i], step_y, s_change, y_change = found[5 + 5 * k : 10 + 5 * k, m]
                    products.step_change[number, i], products.step_change[i, number] = step_y, s_change
                    products.change_change[number, i] = products.change_change[i, number] = y_change
            out[m] = number, products
        return out

    def run(self, max_iter: int, tolerance: float) -> None:
        running = {m: descend(max_iter, tolerance) for m in range(len(self.models))}
        asked = {m: next(steps) for m, steps in running.items()}
        history: dict[int, Sequence[int]] = {}
        while asked:
            kind = next(k for k in ("commit", "direct", "evaluate") if any(a[0] == k for a in asked.values()))
            here = {m: a[1:] for m, a in asked.items() if a[0] == kind}
            if kind == "direct":
                answers = self.direct(here)
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

    def fitted(self) -> Fitted:
        """Weights and intercepts at the points; the files of the fit are dropped."""
        self.alpha[:] = 0
        self._try()
        files, trial = self.files, self.w[0]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk in batch.column("id").to_pylist():
                    yield chunk_batch(chunk, files.read(trial, chunk))

        parts = min(max(1, files.n_chunks), 2 * self.spark.sparkContext.defaultParallelism)
        chunks = self.spark.range(0, files.n_chunks, 1, parts).mapInArrow(run, "chunk int, data binary")
        weights = store_weights(chunks, files.n_terms, self.width, files.chunk_terms)
        files.drop("")
        return Fitted(weights, (self.point - self.mean_at).reshape(-1, self.classes), self.values.copy())


def fit(
    rows: DataFrame,
    models: Sequence[Regression],
    n_terms: int,
    classes: int,
    max_iter: int = 100,
    tolerance: float = 1e-6,
    state_bytes: int = STATE_BYTES,
) -> list[tuple[Sequence[Regression], Fitted]]:
    """Tiles of regressions. ``rows`` (written before) has index (class number), fold (from 0), term_ids and tfs."""
    ship_package(rows.sparkSession)
    rows = rows.select("index", "fold", "term_ids", "tfs")
    found = rows.groupBy("fold", "index").count().collect()
    cells = np.zeros((max((r["fold"] for r in found), default=0) + 1, classes))
    for r in found:
        cells[r["fold"], r["index"]] = r["count"]
    spark = rows.sparkSession
    blocks = write_blocks(rows.coalesce(spark.sparkContext.defaultParallelism))
    tile = max(1, state_bytes // (8 * max(1, n_terms) * classes))
    out = []
    for first in range(0, len(models), tile):
        own = models[first : first + tile]
        fitting = _Fit(spark, blocks, own, n_terms, cells)
        fitting.run(max_iter, tolerance)
        out.append((own, fitting.fitted()))
    blocks.drop("")
    return out


def _fitted_margins(batch: pa.RecordBatch, fitted: Fitted, opened: list) -> np.ndarray:
    if not opened:
        weights = fitted.weights.opened()
        opened += [weights, weights.any(axis=1)]
    return _margins(batch, *opened, fitted.intercepts.ravel()).reshape(-1, *fitted.intercepts.shape)


def held_out_losses(rows: DataFrame, models: Sequence[Regression], fitted: Fitted) -> np.ndarray:
    """The mean loss of every regression on the rows of its fold."""
    folds = np.array([-1 if m.fold is None else m.fold for m in models])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, opened = np.zeros((2, len(folds))), []
        for batch in batches:
            kind, fold = _kinds(batch)
            losses, _ = _losses(_fitted_margins(batch, fitted, opened), kind)
            held = fold[:, None] == folds
            out += [np.where(held, np.minimum(losses, -np.log(TINY)), 0).sum(axis=0), held.sum(axis=0)]
        yield pa.RecordBatch.from_pydict({"model": pa.array(range(len(folds)), pa.int32()), "loss": out[0], "n": out[1]})

    sums = rows.select("index", "fold", "term_ids", "tfs").mapInArrow(run, "model int, loss double, n double")
    found = sorted(sums.groupBy("model").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).collect())
    return np.array([r["loss"] / r["n"] if r["n"] else 0.0 for r in found])


def predict(rows: DataFrame, fitted: Fitted, model: int, *keep: str) -> DataFrame:
    """The kept columns and ``prediction``, the likeliest class by one of the regressions."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = []
        for batch in batches:
            best = _fitted_margins(batch, fitted, opened)[:, model].argmax(axis=1)
            columns = [*(batch.column(c) for c in keep), pa.array(best.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "prediction"])

    schema = rows.select(*keep, F.lit(0).alias("prediction")).schema
    return rows.select(*keep, "term_ids", "tfs").mapInArrow(run, schema)
