"""Blocks of rows against brute force, and how often a fit reads them."""

import numpy as np
import pytest

from topicvote.operators import blocks, hinge
from topicvote.operators.blocks import Blocks, Terms, by_term, write_blocks
from topicvote.operators.flags import Flag, entry_arrays

SCHEMA = "label int, in_train int, row_hash long, neg_topics array<int>, term_ids array<int>, tfs array<int>"


def _rows(n, terms, seed):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        label = int(rng.integers(1, 3))
        chance = np.where(np.arange(terms) % 2 == label - 1, 0.4, 0.2)
        used = np.flatnonzero(rng.random(terms) < chance)
        out.append((label, 1, k, [], used.tolist(), rng.integers(1, 4, len(used)).tolist()))
    return out


@pytest.mark.parametrize("largest", [3, 300, 1 << 22])
def test_sums_by_term(monkeypatch, largest):
    monkeypatch.setattr(blocks, "PIECE", 4)
    monkeypatch.setattr(blocks, "PIECES", 3)
    rng = np.random.default_rng(largest)
    sizes = np.array([0, 1, 9, 30, 0, 17, 40, 2])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    ids, tfs = rng.integers(0, 12, starts[-1]).astype(np.int32), rng.integers(1, largest, starts[-1]).astype(np.int32)
    terms = Terms.load(by_term(ids, tfs, starts).dump())
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for shares in (rng.integers(-1, 2, (len(sizes), 5)).astype(np.int8), rng.normal(size=(len(sizes), 5))):
        for power in (1, 2):
            wanted, found = np.zeros((12, 5)), np.zeros((12, 5))
            np.add.at(wanted, ids, tfs[:, None].astype(float) ** power * shares[owner])
            terms.add(shares, found, power)
            assert np.allclose(found, wanted, rtol=1e-12)
            assert shares.dtype.kind == "f" or (found == wanted).all()


def test_no_entries():
    none = np.zeros(0, np.int32)
    terms = Terms.load(by_term(none, none, np.zeros(3, np.int64)).dump())
    out = np.zeros((4, 2))
    terms.add(np.ones((2, 2)), out)
    assert not out.any()


def test_blocks_have_every_row_once(spark, monkeypatch):
    rows = _rows(60, 20, 1)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for entries, size in ((40, 1 << 16), (1 << 20, 7), (1, 1 << 16)):
        monkeypatch.setattr(blocks, "BLOCK_ENTRIES", entries)
        monkeypatch.setattr(blocks, "BLOCK_ROWS", size)
        made = write_blocks(frame)
        found = []
        for name, count in made.entries.items():
            batch = made.rows(name)
            assert batch.num_rows <= size and len(entry_arrays(batch)[0]) == count
            assert batch.num_rows == 1 or count <= entries
            found += [tuple(r.values()) for r in batch.to_pylist()]
        assert sorted(found) == sorted(rows)
        groups = made.spread(4)
        assert len(groups) == 4 and sorted(sum(groups, [])) == sorted(made.entries)


def test_no_rows(spark):
    found = list(hinge.fit(spark.createDataFrame([], SCHEMA), [hinge.Machine(Flag(1), Flag(2))], 5))
    assert len(found) == 1 and not np.asarray(found[0][1]).any() and found[0][2] == 0


def test_losses_along_a_direction():
    rng = np.random.default_rng(2)
    signs, margins, changes = rng.integers(-1, 2, (50, 3)), rng.normal(size=(50, 3)), rng.normal(size=(50, 3))
    alphas = hinge._reached(np.array([1.0, 0.3, 2.0]), np.array([0.5, 0.1, 0.5]))
    assert len(alphas) == 36  # eight trials, shrunk or grown
    out = hinge._line_sums(signs, *hinge._on_line(signs, margins, changes), alphas)
    for alpha, (loss, slope, share) in zip(alphas, out, strict=True):
        left = 1 - signs * (margins + alpha * changes)
        on = (signs != 0) & (left > 0)
        assert np.allclose(loss, np.where(on, left, 0).sum(axis=0))
        assert np.allclose(slope, np.where(on, -signs * changes, 0).sum(axis=0))
        assert (share == np.where(on, -signs, 0).sum(axis=0)).all()


def test_a_step_is_two_passes_over_the_rows(spark, monkeypatch):
    """However often the line searches of the models ask for losses, and although the rows are read once."""
    asked, passes, evaluate, over = [], [], hinge._Fit.evaluate, Blocks.over
    monkeypatch.setattr(hinge._Fit, "evaluate", lambda self, models: (asked.append(self.at), evaluate(self, models))[1])
    monkeypatch.setattr(Blocks, "over", lambda *args: (passes.append(1), over(*args))[1])
    machines = [hinge.Machine(Flag(1), Flag(1, True)), hinge.Machine(Flag(2), Flag(1))]
    rows = spark.createDataFrame(_rows(40, 4, 3), SCHEMA).repartition(2)
    assert len(list(hinge.fit(rows, machines, 4, max_iter=12, tolerance=0.0))) == 2
    points = len(set(asked))
    assert len(asked) > points + 8
    assert len(passes) <= 3 + 2 * points + 2 * len(machines)  # a machine may fail to find a part twice


def test_blocks_of_like_rows(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ENTRIES", 50)
    rows = [(*r[:1], k % 2, *r[2:]) for k, r in enumerate(_rows(90, 20, 4))]
    rows[5] = (None, *rows[5][1:])
    made = write_blocks(spark.createDataFrame(rows, SCHEMA).repartition(2), ("label", "in_train"))
    found = []
    for name in made.entries:
        part = [tuple(r.values()) for r in made.rows(name).to_pylist()]
        assert len({r[:2] for r in part}) == 1
        found += part
    assert sorted(found, key=str) == sorted(rows, key=str)


def test_sums_of_some_columns():
    rng = np.random.default_rng(8)
    starts = np.arange(0, 81, 8)
    ids, tfs = rng.integers(0, 9, 80).astype(np.int32), np.ones(80, np.int32)
    shares, out, wanted = rng.integers(-1, 2, (10, 2)), np.zeros((9, 4)), np.zeros((9, 2))
    by_term(ids, tfs, starts).add(shares, out, 1, np.array([1, 3]))
    np.add.at(wanted, ids, shares[np.repeat(np.arange(10), 8)])
    assert (out[:, [1, 3]] == wanted).all() and not out[:, [0, 2]].any()


def test_machines_of_two_topics_read_their_rows_only(spark, monkeypatch):
    """Of each block only the models that read its rows are summed, and the models are those of mixed blocks."""
    rows = [(1 + k % 4, *r[1:]) for k, r in enumerate(_rows(90, 12, 5))]  # no machine reads those of 4
    frame = spark.createDataFrame(rows, SCHEMA).repartition(2)
    machines = [hinge.Machine(Flag(a), Flag(b)) for a, b in ((1, 2), (1, 3), (2, 3))]
    monkeypatch.setattr(blocks, "HELD", 1)
    apart = [(np.asarray(w), b) for _, w, b in hinge.fit(frame, machines, 12, max_iter=5)]
    write, asked = hinge.write_blocks, []
    monkeypatch.setattr(hinge, "write_blocks", lambda df, by: (asked.append(list(by)), write(df))[1])
    mixed = [(np.asarray(w), b) for _, w, b in hinge.fit(frame, machines, 12, max_iter=5)]
    assert asked == [["label"]]
    for (one, here), (two, there) in zip(apart, mixed, strict=True):
        assert np.allclose(one, two, atol=1e-9) and np.isclose(here, there, atol=1e-9) and one.any()
