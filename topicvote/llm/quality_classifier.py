"""Text quality by a factorisation machine over hashed words, structure and metadata (lengths).

A document is a sparse vector: its distinct words, hashed to ``WORD_SLOTS`` places and weighted by
1 + log(count) to unit length, and standardised figures of its structure. The score is

    sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)

and the pairs are summed in linear time, as 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

The machine is fitted on at most ``SAMPLE`` labelled rows (chosen by a hash of the id, all of them
if there are fewer), one vector for an id however often it repeats, in a single task; only the machine
reaches the driver. Labels are joined by id. Two rows of
labels for an id count as 1 only if all do, null labels do not count. Without labels of both kinds
every score is 0.5, which is a pass. Ids, labels, language and source are never part of a vector.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicvote.llm.common import column, map_rows
from topicvote.session import ship_package

WORD_SLOTS = 1 << 15
FACTORS = 8
SAMPLE = 20_000
EPOCHS = 6
BATCH = 256
RATE = 0.02
DECAY = 1e-4

SIGNS = b"#*$%&|<>"
FIGURES = 14



def _share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


def structure(data: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """Figures of a text's form, each of the order of 1."""
    size, n = len(data), len(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    gone = lambda chars: size - len(data.translate(None, chars))
    letters = gone(bytes(range(65, 91)) + bytes(range(97, 123))) + gone(bytes(range(128, 256)))
    return [
        math.log1p(n) / 8,
        math.log1p(size) / 10,
        _share(size, n) / 10,
        _share(gone(SIGNS), n),
        _share(gone(b"!?"), n),
        _share(gone(b".,;:"), n),
        _share(gone(b"0123456789"), size) * 10,
        _share(gone(bytes(range(65, 91))), letters),
        _share(gone(bytes(range(128, 256))), size),
        _share(len(counts), n),
        _share(max(counts.values(), default=0), n),
        _share(sum(a == b for a, b in zip(words, words[1:], strict=False)), n),
        1 - _share(len(set(lines)), len(lines)) if lines else 0.0,
        _share(n, len(lines)) / 50,
    ]


def vector(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and values; figures of structure have the last ``FIGURES`` places."""
    data = (text or "").encode()
    words = data.split()
    counts = Counter(words)
    places = np.fromiter((zlib.crc32(w) % WORD_SLOTS for w in counts), np.int64, len(counts))
    values = 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))
    if len(values):
        values /= math.sqrt(values @ values)
    figures = np.array(structure(data, words, counts))
    return (
        np.concatenate([places, WORD_SLOTS + np.arange(FIGURES)]).astype(np.int32),
        np.concatenate([values, figures]).astype(np.float32),
    )


@dataclass
class Machine:
    """w0, w and v of the model, and the scaling of the figures."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    centre: np.ndarray
    spread: np.ndarray

    def scaled(self, values: np.ndarray) -> np.ndarray:
        out = values.astype(np.float64)
        out[-FIGURES:] = np.clip((out[-FIGURES:] - self.centre) / self.spread, -4, 4)
        return out

    def score(self, places: np.ndarray, values: np.ndarray) -> float:
        x = self.scaled(values)
        v = self.factors[places] * x[:, None]
        pairs = 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        raw = self.bias + float(self.weights[places] @ x) + pairs
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, raw))))


def untrained() -> Machine:
    size = WORD_SLOTS + FIGURES
    return Machine(0.0, np.zeros(size), np.zeros((size, FACTORS)), np.zeros(FIGURES), np.ones(FIGURES))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Machine:
    """Adam over shuffled batches of rows; the gradient of the pairs is v_if's own
    x_i (sum_j v_jf x_j - v_if x_i)."""
    machine = untrained()
    if len(set(labels.tolist())) < 2:
        return machine
    figures = np.array([v[-FIGURES:] for _, v in rows])
    machine.centre, machine.spread = figures.mean(0), np.maximum(figures.std(0), 1e-6)
    rows = [(p, machine.scaled(v).astype(np.float32)) for p, v in rows]
    draw = np.random.default_rng(seed)
    size = WORD_SLOTS + FIGURES
    theta = np.concatenate([np.zeros((size, 1)), draw.normal(0, 0.02, (size, FACTORS))], axis=1)
    first, second, bias, step = np.zeros_like(theta), np.zeros_like(theta), 0.0, 0
    share = labels.mean()
    bias = math.log(share / (1 - share))
    for _ in range(EPOCHS):
        order = draw.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            sizes = np.array([len(rows[k][0]) for k in chosen])
            places = np.concatenate([rows[k][0] for k in chosen])
            x = np.concatenate([rows[k][1] for k in chosen])
            heads = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            here = theta[places]
            vx = here[:, 1:] * x[:, None]
            sums = np.add.reduceat(vx, heads)
            raw = (
                bias
                + np.add.reduceat(here[:, 0] * x, heads)
                + 0.5 * (sums**2 - np.add.reduceat(vx**2, heads)).sum(1)
            )
            wrong = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[chosen]) / len(chosen)
            each = np.repeat(wrong, sizes)
            slope = np.column_stack([each * x, (each * x)[:, None] * (np.repeat(sums, sizes, axis=0) - vx)])
            used, where = np.unique(places, return_inverse=True)
            sorted_ = np.argsort(where, kind="stable")
            gradient = np.add.reduceat(slope[sorted_], np.searchsorted(where[sorted_], np.arange(len(used))))
            gradient += DECAY * theta[used]
            step += 1
            first[used] = 0.9 * first[used] + 0.1 * gradient
            second[used] = 0.999 * second[used] + 0.001 * gradient**2
            change = (first[used] / (1 - 0.9**step)) / (np.sqrt(second[used] / (1 - 0.999**step)) + 1e-8)
            theta[used] -= RATE * change
            bias -= RATE * float(wrong.sum())
    machine.bias, machine.weights, machine.factors = bias, theta[:, 0].copy(), theta[:, 1:].copy()
    return machine


def held_out(id_: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    sample: int = SAMPLE,
) -> Machine:
    """A machine from the rows of ``docs`` that have a label and are not held out."""
    ship_package(docs.sparkSession)
    known = (
        labels.select(column(labels, id_column).alias("doc_id"), column(labels, label_column).alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("label").cast("int").alias("label"))
    )
    number = known.count()
    space = 1 << 30
    place = F.pmod(F.xxhash64("doc_id"), F.lit(space))
    bound = space if number <= sample else math.floor(space * 0.97 * sample / number)
    chosen = known.filter(place < bound).limit(sample)

    def run(batch):
        rows = [vector(t.as_py()) for t in batch.column("text")]
        columns = [
            batch.column("doc_id"),
            batch.column("label"),
            pa.array([p.tobytes() for p, _ in rows], pa.binary()),
            pa.array([v.tobytes() for _, v in rows], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "places", "vals"])

    texts = docs.select(column(docs, id_column).alias("doc_id"), column(docs, text_column).alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc_id")
    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = map_rows(joined, run, f"doc_id {kind}, label int, places binary, vals binary")
    one = rows.groupBy("doc_id", "label").agg(F.min(F.struct("places", "vals")).alias("x"))
    chosen = one.select("doc_id", "label", "x.places", "x.vals").repartition(1)
    found = chosen.sortWithinPartitions("doc_id").mapInArrow(_trained, "machine binary").first()
    return pickle.loads(bytes(found["machine"])) if found else untrained()


def _trained(batches):
    """One row, the machine of all sorted rows (doc_id, label, places, vals): a task of at most ``SAMPLE``
    rows, whose vectors are read where the batches hold them."""
    rows, labels = [], []
    for batch in batches:
        columns = zip(batch.column("places"), batch.column("vals"), strict=True)
        rows += [(np.frombuffer(p.as_buffer(), np.int32), np.frombuffer(v.as_buffer(), np.float32)) for p, v in columns]
        labels += batch.column("label").to_pylist()
    if not rows:
        return
    machine = train(rows, np.array(labels, np.float64))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(machine)], pa.binary())], ["machine"])


def score(docs: DataFrame, machine: Machine, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, score of every row, null and empty texts included."""
    ship_package(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batch):
        scores = [model.value.score(*vector(t.as_py())) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select(column(docs, id_column).alias("doc_id"), column(docs, text_column).alias("text"))
    return map_rows(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, machine: Machine, text_column: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``least``, with all their columns."""
    ship_package(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(machine)
    place = docs.columns.index(text_column)

    def run(batch):
        texts = batch.column(place)
        yield batch.filter(pa.array([model.value.score(*vector(t.as_py())) >= least for t in texts], pa.bool_()))

    return map_rows(docs, run, docs.schema)
