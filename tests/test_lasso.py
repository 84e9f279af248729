"""The regressions against the library's, and what reaches the driver."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from topicvote.operators import hinge, lasso
from topicvote.operators.baselines import lasso_verdicts

SCHEMA = "doc_id long, index int, fold int, term_ids array<int>, tfs array<int>"


def _rows(n, terms, classes, seed):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        kind = int(rng.integers(classes))
        counts = rng.integers(1, 4, terms) * (rng.random(terms) < np.where(np.arange(terms) % 7 == kind, 0.5, 0.25))
        used = np.flatnonzero(counts)
        out.append((k, kind, k % 3, used.tolist(), counts[used].tolist()))
    return out


def _objective(data, n_terms, classes, weights, intercepts, penalty):
    x, y = np.zeros((len(data), n_terms)), np.array([r[1] for r in data])
    for at, r in enumerate(data):
        x[at, r[3]] = r[4]
    margins = x @ weights + intercepts
    loss = np.log(np.exp(margins).sum(axis=1)) - margins[np.arange(len(y)), y]
    return loss.mean() + penalty * np.abs(weights * x.std(axis=0, ddof=1)[:, None]).sum()


def test_objective_is_no_worse_than_the_librarys(spark, monkeypatch):
    monkeypatch.setattr(lasso, "CHUNK_TERMS", 7)
    terms, classes = 24, 3
    data = _rows(240, terms, classes, 2)
    rows = spark.createDataFrame(data, SCHEMA).repartition(3)
    models = [lasso.Regression(0.02), lasso.Regression(0.05, 1)]
    (own, fitted), = lasso.fit(rows, models, terms, classes, max_iter=40)
    assert list(own) == models
    weights = np.asarray(fitted.weights).reshape(terms, 2, classes)
    for k, model in enumerate(models):
        held = [r for r in data if model.fold is None or r[2] != model.fold]
        vectors = [(float(r[1]), Vectors.sparse(terms, r[3], [float(v) for v in r[4]])) for r in held]
        library = LogisticRegression(labelCol="index", family="multinomial", elasticNetParam=1.0, regParam=model.penalty, maxIter=40)
        found = library.fit(spark.createDataFrame(vectors, ["index", "features"]))
        wanted = _objective(held, terms, classes, found.coefficientMatrix.toArray().T, found.interceptVector.toArray(), model.penalty)
        got = _objective(held, terms, classes, weights[:, k], fitted.intercepts[k], model.penalty)
        assert got <= wanted + 1e-4 and got == pytest.approx(fitted.values[k], abs=1e-8)
        assert (weights[:, k] == 0).sum() > 10  # the penalty leaves terms out
    losses = lasso.held_out_losses(rows, models, fitted)
    out = [r for r in data if r[2] == 1]
    assert losses[1] == pytest.approx(_objective(out, terms, classes, weights[:, 1], fitted.intercepts[1], 0.0))


def test_the_driver_gets_no_gradients(spark, monkeypatch):
    """What it gets has the size of the regressions and chunks, whatever the number of terms."""
    got = []
    whole = hinge._in_order
    monkeypatch.setattr(lasso, "CHUNK_TERMS", 4096)
    monkeypatch.setattr(hinge, "_in_order", lambda rows, shape: (got.append(int(np.prod(shape))), whole(rows, shape))[1])
    terms = 4000
    data = [(k, i, f, [t * 400 % 4000 + t for t in ids], tfs) for k, i, f, ids, tfs in _rows(60, 10, 2, 3)]
    rows = spark.createDataFrame(data, SCHEMA)
    lasso.fit(rows, [lasso.Regression(0.05)], terms, 2, max_iter=3)
    assert got and max(got) <= (5 + 5 * hinge.MEMORY) * 2


def test_verdicts_by_the_best_penalty(spark):
    rows = spark.createDataFrame(_rows(300, 14, 3, 4), SCHEMA).select("doc_id", F.col("index").alias("label"), "term_ids", "tfs")
    coded = lasso_verdicts(rows, 14, F.col("doc_id") < 200, penalties=(10.0, 0.01), max_iter=10).collect()
    assert len(coded) == 100 and sum(r["label"] == r["verdict"] for r in coded) > 50
