"""NN-descent and the search on its graph against all pairs."""

import numpy as np
import pytest

from topicvote.llm import nn_descent


def nearest(rows, k):
    """{query: [(id, score)]} of rows (id, vector or None): all pairs in double precision."""
    real = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and usable(v)]
    size = max((len(v) for _, v in real), default=0)
    ids = np.array([i for i, _ in real])
    x = np.array([np.pad(v, (0, size - len(v))) for _, v in real])
    out = {}
    for at, i in enumerate(ids):
        if i % 20 == 0:
            scores = (x * x[at]).sum(axis=1)
            others = [(-scores[j], ids[j]) for j in range(len(ids)) if j != at]
            out[int(i)] = [(int(j), -s) for s, j in sorted(others)[:k]]
    return out


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def found(spark, rows, k=20, kind="float"):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], f"vec_id bigint, embedding array<{kind}>, node int, ids string")
    got = {}
    for r in nn_descent.nearest(table, table.filter("vec_id % 20 = 0"), k).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    return {q: [v[n] for n in range(1, len(v) + 1)] for q, v in got.items()}


def vectors(n, size, seed, groups=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, size))
    return (centres[rng.integers(0, groups, n)] + rng.normal(size=(n, size))).astype(np.float32)


def same(got, expected):
    assert got.keys() == expected.keys()
    for q, rows in expected.items():
        assert [i for i, _ in got[q]] == [i for i, _ in rows], q
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in rows], rel=1e-12)


def test_small_tables_are_exact(spark):
    """Equal vectors, ties, rows that take no part, vectors of different sizes and lengths."""
    x = (vectors(200, 6, 1) * np.linspace(0.2, 3, 200)[:, None]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # very many equal ones, three of them queries
    rows += [(2000, [1.0, 2.0]), (2001, []), (2020, None), (2040, [0.0] * 6), (2060, [float("nan")] * 6),
             (2080, [float("inf")] + [0.0] * 5), (2100, [None, 1.0]), (None, [1.0] * 6), (-20, [-0.0, 1.0, 0.0, 0.0, 0.0, 0.0])]
    same(found(spark, rows), nearest(rows, 20))


def test_fewer_candidates_and_empty_table(spark):
    rows = [(20 * i, [float(i + 1), 1.0]) for i in range(5)]
    same(found(spark, rows, kind="double"), nearest(rows, 20))
    assert found(spark, [(0, None), (20, [0.0])]) == {}
    assert found(spark, []) == {}


def test_repeated_ids_are_candidates_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (5, [2.0, 0.0]), (5, [2.0, 0.0]), (5, [3.0, 0.0]), (0, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = nn_descent.nearest(table, table.filter("vec_id = 0"), 4).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(
        [(1, 5, 3.0), (2, 5, 2.0), (3, 5, 2.0), (4, 0, 1.0)] * 2
    )


def test_recall_of_the_graph(spark, monkeypatch):
    """Blocks far smaller than the table: rounds and search have to find most neighbours."""
    monkeypatch.setattr(nn_descent, "BLOCK", 200)
    monkeypatch.setattr(nn_descent, "TREES", 4)
    x = vectors(3000, 16, 2)
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)]
    expected, got = nearest(rows, 20), found(spark, rows)
    assert got.keys() == expected.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert hits / (20 * len(expected)) > 0.95
    scores = {(q, i): s for q in expected for i, s in expected[q]}
    assert all(s == pytest.approx(scores[q, i], rel=1e-12) for q in got for i, s in got[q] if (q, i) in scores)


def test_rounds_improve_the_graph(spark):
    x = vectors(1500, 12, 3)
    x /= np.linalg.norm(x, axis=1)[:, None]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    distinct = nn_descent.nodes(nn_descent.valid(table, "vec_id", "embedding"), 1)
    codes, size, count = nn_descent.coded(distinct)
    at = {r["node"]: r["ids"][0] for r in distinct.collect()}
    rng = np.random.default_rng(4)
    names = np.array(sorted(at))
    rows = [(int(n), [int(m) for m in rng.choice(names[names != n], 10, replace=False)], [-1e9] * 10, [True] * 10) for n in names]
    graph = spark.createDataFrame(rows, nn_descent.GRAPH)
    scores = x @ x.T
    near = {i: set(np.argsort(-np.where(np.arange(len(x)) == i, -np.inf, scores[i]))[:10]) for i in range(len(x))}
    recalls = []
    for number in range(4):
        graph = nn_descent._take_over(graph, nn_descent.introductions(graph, codes, number, 10, 10), 10, number, 10)
        hits = sum(len({at[m] for m in r["nbrs"]} & near[at[r["node"]]]) for r in graph.collect())
        recalls.append(hits / (10 * len(x)))
    assert recalls == sorted(recalls) and recalls[0] < 0.3 < 0.5 < recalls[-1]
