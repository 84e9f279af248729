"""Sums of tasks and tiles of weights against brute force, and what a task gives out and maps."""

import numpy as np
import pyarrow as pa

from topicvote.operators import flags, hinge
from topicvote.operators.flags import Flag, packed, term_sums, unpacked, weighted_sums
from topicvote.operators.scoring import GroupedWeights, StoredWeights


def test_weighted_sums_of_short_long_and_empty_rows(monkeypatch):
    monkeypatch.setattr(flags, "PRODUCTS", 100)  # rows of more than 33 entries are cut
    rng = np.random.default_rng(3)
    sizes = np.array([0, 1, 2, 5, 16, 17, 90, 0, 300, 1])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    ids, tfs = rng.integers(0, 50, starts[-1]), rng.integers(1, 9, starts[-1])
    weights = np.concatenate([rng.normal(size=(50, 3)), [[np.inf, np.nan, -np.inf]]])  # no row has the last term
    wanted = [tfs[a:b] @ weights[ids[a:b]] for a, b in zip(starts, starts[1:])]
    for order in ("C", "F"):
        assert np.allclose(weighted_sums(ids, tfs, starts, np.asarray(weights, order=order)), wanted)


def test_term_sums_are_exact_and_come_once(monkeypatch):
    monkeypatch.setattr(flags, "CHUNK_ENTRIES", 7)
    rng = np.random.default_rng(4)
    ids, owner, shares = rng.integers(0, 40, 500), rng.integers(0, 20, 500), rng.integers(-1, 2, (20, 5))
    for largest in (9, 1 << 26):  # beyond single precision
        tfs = rng.integers(1, largest, 500)
        wanted = np.zeros((40, 5), np.int64)
        np.add.at(wanted, ids, tfs[:, None] * shares[owner])
        parts = list(term_sums(ids, tfs, owner, shares))
        terms = np.concatenate([p[0] for p in parts])
        assert len(parts) > 5 and len(set(terms.tolist())) == len(terms)
        assert (np.concatenate([p[1] for p in parts]).astype(np.int64) == wanted[terms]).all()


def test_whole_sums_are_sent_in_few_bytes():
    for largest, size in ((32767, 2), (-32768, 4), (1 << 31, 8), (-(1 << 40), 8)):
        sums = np.array([[0.0, 1.0, float(largest)]])
        data = packed(sums)
        assert len(data) == 3 * size
        assert unpacked(pa.scalar(data, pa.binary()), 3).tolist() == sums[0].tolist()


def _batch(first, terms):
    n = len(terms)
    columns = [np.ones(n, np.int32), np.ones(n, np.int32), np.arange(first, first + n)]
    names = ["label", "in_train", "row_hash", "neg_topics", "term_ids", "tfs"]
    lists = [pa.array(x, pa.list_(pa.int32())) for x in ([[]] * n, terms, [[2] * len(t) for t in terms])]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), *lists], names)


def test_a_task_gives_its_sums_out_once():
    """However many entries a task reads, each chunk of terms and block of flags comes once."""
    terms = [[k % 7, 7 + k % 3000] for k in range(3000)]
    batches = [_batch(3000 * k, terms) for k in range(400)]  # 2.4 million entries
    out = list(flags._partial_sums([Flag(1), Flag(1, True)], None, True, 0, 4096)(iter(batches)))
    places = [(b.column("chunk")[0].as_py(), b.column("block")[0].as_py()) for b in out]
    assert sorted(places) == [(-1, 0), (0, 0), (1, 0), (2, 0)]
    heads = unpacked(next(b for b in out if b.column("chunk")[0].as_py() == -1).column("data")[0], 2 * flags.BLOCK)
    assert heads[0] == 1_200_000 and heads[1] == 0
    data = unpacked(next(b for b in out if b.column("chunk")[0].as_py() == 0).column("data")[0], flags.CHUNK_TERMS * flags.BLOCK)
    sums = data.reshape(flags.CHUNK_TERMS, flags.BLOCK)
    assert sums[0, 0] == 2 * 400 * sum(k % 7 == 0 for k in range(3000)) and sums[7, 0] == 800 and not sums[:, 1].any()


def test_the_machines_counts_and_squares_are_sums_of_a_task():
    machine = hinge.Machine(Flag(1), Flag(1, True))
    tfs, used, totals = hinge._counts([machine], 2)(_batch(0, [[1, 2], [2]]))
    assert tfs.tolist() == [4, 4, 4] and used.tolist() == [[1], [1]] and totals.tolist() == [[2], [0]]


def test_one_group_of_models_is_mapped_at_a_time(spark, tmp_path):
    rng = np.random.default_rng(6)
    weights = rng.normal(size=(10, 7))
    table = pa.table({"chunk": pa.array([0, 1, 2, 0], pa.int32()), "data": [
        weights[:4].tobytes(), weights[4:8].tobytes(), weights[8:].tobytes(), np.ones((4, 7)).tobytes()]})
    spark.createDataFrame(table).write.parquet(str(tmp_path / "weights"))
    weights[:4] += 1  # rows of a chunk are added
    stored = StoredWeights(str(tmp_path / "weights"), 10, 7, 4, 2, 7)
    grouped = stored.grouped(3)
    assert isinstance(grouped, GroupedWeights)
    for tile in (3, 2):
        found = np.full((10, 5), np.nan)
        for here, part in grouped.tiles(tile):
            assert part.shape[1] <= tile
            mapped = part if isinstance(part, np.memmap) else None
            assert mapped is None or mapped.nbytes <= 8 * 10 * 3
            found[:, here] = part
        assert np.allclose(found, weights[:, 2:])
