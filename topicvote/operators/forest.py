"""Random forests on sparse term counts, a Spark job for a level of all trees.

A node tries a few random terms. A task finds the nodes that its rows have reached, counts the rows by (node, term,
count of the term, class), for terms that are in the row only, and gives its counts out once; the rows without a term
are the rest of their node. The counts of a node meet in a group, which finds its best split, and the driver gets a split
for each node. A row is never made dense, and nothing that is shuffled or sent grows with the number of rows.

Impurity (Gini), stopping, merging of leaves, votes and importance are those of the library's classifier. A split lies
between any two counts of a term, where the library sorts counts into at most 32 bins of a sample. A row is in the bag
of a tree as often as a Poisson draw by its hash says, whatever its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicvote.functions.hashing import DEFAULT_SEED
from topicvote.operators.flags import entry_arrays
from topicvote.session import ship_package

DEPTH = 5
ROWS = 1024
PAIRS = 1 << 20
HELD = 1 << 22
COUNT_BITS = 24
TOTAL = -1
EPSILON = 2.0**-52
POISSON = np.cumsum([exp(-1) / factorial(k) for k in range(13)])

COUNTS = "node int, slot int, tf int, class int, n bigint"
SPLITS = "node int, slot int, least int, gain double, total array<double>, left array<double>"


@dataclass
class Forest:
    """Trees in arrays (tree, node); the children of node k are 2k + 1 and 2k + 2. A row goes left if it has the term
    ``feature`` (-1 at a leaf) at most ``least`` times. ``counts`` (tree, node, class) are those of the bag."""

    feature: np.ndarray
    least: np.ndarray
    gain: np.ndarray
    counts: np.ndarray
    depth: int

    @classmethod
    def empty(cls, trees: int, depth: int, classes: int) -> Forest:
        shape = trees, 2 ** (depth + 1) - 1
        return cls(np.full(shape, -1, np.int64), np.zeros(shape, np.int64), np.zeros(shape), np.zeros((*shape, classes)), depth)

    def nodes_of(self, ids: np.ndarray, tfs: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The node (row, tree) that each row reaches."""
        rows, own = np.arange(len(starts) - 1)[:, None], np.arange(len(self.feature))
        used = np.unique(self.feature[self.feature >= 0])
        node = np.zeros((len(rows), len(own)), np.int64)
        if not len(used):
            return node
        place = np.minimum(np.searchsorted(used, ids), len(used) - 1)
        hit = used[place] == ids
        held = np.zeros((len(rows), len(used)), np.int32)
        held[np.repeat(rows[:, 0], np.diff(starts))[hit], place[hit]] = tfs[hit]
        column = np.searchsorted(used, np.maximum(self.feature, used[0]))
        for _ in range(self.depth):
            right = held[rows, column[own, node]] > self.least[own, node]
            node = np.where(self.feature[own, node] >= 0, 2 * node + 1 + right, node)
        return node

    def grow(self, tree: int, node: int, split: dict) -> None:
        self.counts[tree, node] = split["total"]
        if split["slot"] < 0:
            return
        left = np.array(split["left"])
        self.least[tree, node], self.gain[tree, node] = split["least"], split["gain"]
        self.counts[tree, 2 * node + 1], self.counts[tree, 2 * node + 2] = left, self.counts[tree, node] - left

    def merge_leaves(self) -> None:
        """Two leaves of one parent that vote alike become one leaf."""
        votes = self.counts.argmax(axis=2)
        for node in reversed(range(2**self.depth - 1)):
            children = slice(2 * node + 1, 2 * node + 3)
            alike = (self.feature[:, children] < 0).all(axis=1) & (votes[:, 2 * node + 1] == votes[:, 2 * node + 2])
            self.feature[alike, node] = -1

    def importances(self) -> dict[int, float]:
        """Shares of the terms in the decrease of impurity, of trees of equal weight."""
        out: dict[int, float] = {}
        reached = self.counts.sum(axis=2)
        for tree in range(len(self.feature)):
            found: dict[int, float] = {}
            nodes = [0]
            for node in nodes:
                term = int(self.feature[tree, node])
                if term >= 0:
                    found[term] = found.get(term, 0.0) + float(self.gain[tree, node] * reached[tree, node])
                    nodes += [2 * node + 1, 2 * node + 2]
            whole = sum(found.values())
            for term, value in found.items():
                out[term] = out.get(term, 0.0) + value / whole
        whole = sum(out.values())
        return {term: value / whole for term, value in sorted(out.items())}


def gini(counts: np.ndarray) -> np.ndarray:
    whole = np.maximum(counts.sum(axis=-1), 1)
    out = np.ones(counts.shape[:-1])
    for k in range(counts.shape[-1]):
        out -= (counts[..., k] / whole) ** 2
    return out


def drawn(hashes: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """How often (row, tree) a row is in the bag of a tree."""
    keys = np.random.default_rng(seed).integers(0, 2**63, trees, dtype=np.uint64)
    x = hashes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + keys
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x = x ^ (x >> np.uint64(31))
    return np.searchsorted(POISSON, (x >> np.uint64(11)) * 2.0**-53, side="right")


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(keys, return_inverse=True)
    return keys, np.bincount(place, n, len(keys)).astype(np.int64)


def _counted(forest: Forest, trees: np.ndarray, nodes: np.ndarray, wanted: np.ndarray, bag: int | None):
    """Rows of ``COUNTS`` of a task: ``wanted`` (node, slot) are the terms that the nodes of the trees try."""
    classes, width = forest.counts.shape[2], wanted.shape[1]
    number = np.full(forest.feature.shape, -1)
    number[trees, nodes] = np.arange(len(nodes))
    order = np.argsort(wanted, axis=None, kind="stable")
    terms, own = wanted.ravel()[order], order // max(1, width)

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(keys, numbers): node * (width + 1) + slot + 1, count and class in one key."""
        ids, tfs, starts = entry_arrays(batch)
        kind = batch.column("index").to_numpy().astype(np.int64)
        hashes = batch.column("row_hash").to_numpy()
        every = np.arange(len(forest.feature))
        n = np.ones((len(kind), len(every)), int) if bag is None else drawn(hashes, len(every), bag)
        here = number[every, forest.nodes_of(ids, tfs, starts)]
        here[n == 0] = -1
        row, tree = np.nonzero(here >= 0)
        yield ((here[row, tree] * (width + 1)) << COUNT_BITS) * classes + kind[row], n[row, tree]
        first = np.searchsorted(terms, ids, "left")
        many = np.searchsorted(terms, ids, "right") - first
        ends = np.cumsum(many)
        owner = np.repeat(np.arange(len(kind)), np.diff(starts))
        at = 0
        while at < len(ids):
            end = max(at + 1, int(np.searchsorted(ends, ends[at] - many[at] + PAIRS, "right")))
            size = many[at:end]
            entry = np.repeat(np.arange(at, end), size)
            pair = np.arange(len(entry)) + np.repeat(first[at:end] - np.cumsum(size) + size, size)
            tree = trees[own[pair]]
            met = here[owner[entry], tree] == own[pair]
            entry, pair, tree = entry[met], pair[met], tree[met]
            key = own[pair] * (width + 1) + order[pair] % width + 1
            row = owner[entry]
            yield ((key << COUNT_BITS) + tfs[entry]) * classes + kind[row], n[row, tree]
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for keys, n in parts(batch.slice(at, ROWS)):
                    held.append(_summed(keys, n))
                    size += len(held[-1][0])
                    if size > HELD:
                        held = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
                        size = len(held[0][0]) // 2
        if not held:
            return
        keys, n = _summed(*map(np.concatenate, zip(*held, strict=True)))
        for at in range(0, len(keys), PAIRS):
            key = keys[at : at + PAIRS]
            place, tf = key // classes >> COUNT_BITS, key // classes & ((1 << COUNT_BITS) - 1)
            columns = [place // (width + 1), place % (width + 1) - 1, tf, key % classes]
            arrays = [pa.array(c.astype(np.int32)) for c in columns] + [pa.array(n[at : at + PAIRS])]
            yield pa.RecordBatch.from_arrays(arrays, ["node", "slot", "tf", "class", "n"])

    return run


def _best_split(classes: int):
    """The best split of a node from its counts: the first of equal ones, by slot and then by count."""

    def find(table: pa.Table) -> pa.Table:
        slot, tf, kind, n = (table.column(c).to_numpy() for c in ("slot", "tf", "class", "n"))
        head = slot == TOTAL
        total = np.bincount(kind[head], n[head], classes)
        whole, impurity = total.sum(), gini(total)
        best, gain, least, left = TOTAL, 0.0, 0, np.zeros(classes)
        order = np.lexsort((tf, slot))
        slot, tf, kind, n = slot[order], tf[order], kind[order], n[order]
        for s in np.unique(slot[slot >= 0]):
            own = slice(*np.searchsorted(slot, [s, s + 1]))
            values, place = np.unique(tf[own], return_inverse=True)
            held = np.bincount((place + 1) * classes + kind[own], n[own], (len(values) + 1) * classes).reshape(-1, classes)
            held[0] = total - held.sum(axis=0)
            below = held.cumsum(axis=0)[:-1]
            size = below.sum(axis=1)
            gains = impurity - size / whole * gini(below) - (whole - size) / whole * gini(total - below)
            gains[(size < 1) | (whole - size < 1)] = 0
            k = int(gains.argmax())
            if gains[k] > gain:
                best, gain, least, left = int(s), float(gains[k]), int(values[k - 1]) if k else 0, below[k]
        out = {"node": [table.column("node")[0].as_py()], "slot": [best], "least": [least], "gain": [gain]}
        out |= {"total": [total.tolist()], "left": [left.tolist()]}
        kinds = [("node", pa.int32()), ("slot", pa.int32()), ("least", pa.int32()), ("gain", pa.float64())]
        lists = pa.list_(pa.float64())
        return pa.table(out, pa.schema([*kinds, ("total", lists), ("left", lists)]))

    return find


def fit(
    rows: DataFrame,
    n_terms: int,
    classes: int,
    trees: int = 100,
    features_per_split: int = 20,
    depth: int = DEPTH,
    bootstrap: bool = True,
    seed: int = DEFAULT_SEED,
) -> Forest:
    """A forest of ``rows`` (written before) with index (class number), row_hash, term_ids and tfs."""
    ship_package(rows.sparkSession)
    rows = rows.select("index", "row_hash", "term_ids", "tfs")
    rows = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    forest = Forest.empty(trees, depth, classes)
    frontier = [(t, 0) for t in range(trees)]
    width = min(features_per_split, n_terms)
    for level in range(depth):
        if not frontier:
            break
        wanted = np.array([_tried(seed, t, node, n_terms, width) for t, node in frontier]).reshape(len(frontier), width)
        own = np.array(frontier)
        counted = rows.mapInArrow(_counted(forest, own[:, 0], own[:, 1], wanted, seed if bootstrap else None), COUNTS)
        for split in counted.groupBy("node").applyInArrow(_best_split(classes), SPLITS).collect():
            tree, node = frontier[split["node"]]
            forest.grow(tree, node, split)
            if split["slot"] >= 0:
                forest.feature[tree, node] = wanted[split["node"], split["slot"]]
        children = [(t, c) for t, node in frontier if forest.feature[t, node] >= 0 for c in (2 * node + 1, 2 * node + 2)]
        frontier = [(t, c) for t, c in children if level + 1 < depth and gini(forest.counts[t, c]) >= EPSILON]
    forest.merge_leaves()
    return forest


def _tried(seed: int, tree: int, node: int, n_terms: int, width: int) -> np.ndarray:
    if width == n_terms:
        return np.arange(n_terms)
    return np.random.default_rng([seed, tree, node]).choice(n_terms, width, replace=False)


def predict(rows: DataFrame, forest: Forest, *keep: str) -> DataFrame:
    """The kept columns and ``prediction``, the class number with the largest sum of the trees' shares."""
    ship_package(rows.sparkSession)
    shares = forest.counts / np.maximum(forest.counts.sum(axis=2, keepdims=True), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.arange(len(shares))
        for batch in batches:
            found = [np.zeros(0, np.int64)]
            for at in range(0, batch.num_rows, ROWS):
                node = forest.nodes_of(*entry_arrays(batch.slice(at, ROWS)))
                found.append(shares[own, node].sum(axis=1).argmax(axis=1))
            columns = [*(batch.column(c) for c in keep), pa.array(np.concatenate(found).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "prediction"])

    schema = rows.select(*keep, F.lit(0).alias("prediction")).schema
    return rows.select(*keep, "term_ids", "tfs").mapInArrow(run, schema)
