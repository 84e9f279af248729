"""The forest against the library's trees, where nothing is drawn, and its bags."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from topicvote.operators import forest
from topicvote.operators.baselines import fit_forest, forest_importance, forest_verdicts
from topicvote.operators.features import trimmed_rows, trimmed_terms


def _rows(n, terms, classes, seed):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        kind = int(rng.integers(classes))
        counts = rng.integers(0, 4, terms) * (rng.random(terms) < np.where(np.arange(terms) % classes == kind, 0.6, 0.3))
        used = np.flatnonzero(counts)
        out.append((k, kind, used.tolist(), counts[used].tolist()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_one_tree_of_all_rows_and_terms_is_the_librarys(spark, monkeypatch, seed):
    monkeypatch.setattr(forest, "ROWS", 37)
    monkeypatch.setattr(forest, "PAIRS", 100)
    monkeypatch.setattr(forest, "HELD", 50)
    terms = 9
    data = _rows(400, terms, 3, seed)
    rows = spark.createDataFrame(data, "doc_id long, index int, term_ids array<int>, tfs array<int>")
    rows = rows.withColumn("row_hash", F.col("doc_id")).repartition(3)
    ours = forest.fit(rows, terms, 3, trees=1, features_per_split=terms, bootstrap=False)
    vectors = [(k, float(c), Vectors.sparse(terms, ids, [float(x) for x in tfs])) for k, c, ids, tfs in data]
    library = DecisionTreeClassifier(labelCol="index").fit(spark.createDataFrame(vectors, ["doc_id", "index", "features"]))
    wanted = library.transform(spark.createDataFrame(vectors, ["doc_id", "index", "features"]))
    got = forest.predict(rows, ours, "doc_id")
    assert {r["doc_id"]: r["prediction"] for r in got.collect()} == {r["doc_id"]: r["prediction"] for r in wanted.collect()}
    found = library.featureImportances
    assert ours.importances() == pytest.approx(dict(zip(found.indices.tolist(), found.values.tolist(), strict=True)))


def test_a_forest_does_not_depend_on_the_partitions_and_learns(spark):
    rows = spark.createDataFrame(_rows(600, 40, 3, 5), "doc_id long, label int, term_ids array<int>, tfs array<int>")
    train = F.col("doc_id") < 400
    one, codes = fit_forest(rows.repartition(1), 40, train, trees=20, features_per_split=6)
    many, _ = fit_forest(rows.repartition(4), 40, train, trees=20, features_per_split=6)
    assert codes == [0, 1, 2]
    assert (one.feature == many.feature).all() and (one.least == many.least).all() and (one.counts == many.counts).all()
    coded = forest_verdicts(rows, 40, train, trees=20, features_per_split=6).collect()
    assert len(coded) == 200 and sum(r["label"] == r["verdict"] for r in coded) > 120
    shares = forest_importance(rows, train, [f"t{k}" for k in range(40)], trees=20, features_per_split=6)
    assert shares.agg(F.sum("impurity")).first()[0] == pytest.approx(1)


def test_bags_are_poisson_draws():
    n = forest.drawn(np.arange(20000) * 7919, 5, 1)
    assert np.allclose([(n == k).mean() for k in range(4)], [np.exp(-1), np.exp(-1), np.exp(-1) / 2, np.exp(-1) / 6], atol=0.01)
    assert abs(np.corrcoef(n.T) - np.eye(5)).max() < 0.03


def test_what_a_task_gives_out_does_not_grow_with_its_rows():
    """Nor is a row made dense: there may be any number of terms."""
    def batch(n):
        lists = [pa.array(x, pa.list_(pa.int32())) for x in ([[k % 3, 10**9 + k % 2] for k in range(n)], [[1, 2]] * n)]
        heads = [pa.array([k % 2 for k in range(n)], pa.int32()), pa.array(range(n), pa.int64())]
        return pa.RecordBatch.from_arrays([*heads, *lists], ["index", "row_hash", "term_ids", "tfs"])

    grown = forest.Forest.empty(4, 5, 2)
    wanted = np.tile([0, 1, 10**9], (4, 1))
    task = forest._counted(grown, np.arange(4), np.zeros(4, int), wanted, 1)
    sizes = [sum(b.num_rows for b in task(iter([batch(n)]))) for n in (300, 6000)]
    assert sizes[0] == sizes[1] == 4 * (2 + 2 + 2 + 1)


def test_terms_of_all_blocks_are_in_the_rows(spark, monkeypatch):
    from topicvote.operators import features

    monkeypatch.setattr(features, "BLOCK_TERMS", 2)
    docs = [(k, [f"w{j}" for j in range(5) if (k >> j) & 1] * 2) for k in range(1, 32)]
    words = spark.createDataFrame(docs, "doc_id long, words array<string>")
    terms, rows = trimmed_rows(words, trimmed_terms(words, 2, 1.0))
    assert sorted(terms) == [f"w{j}" for j in range(5)] and rows.columns == ["doc_id", "term_ids", "tfs"]
    for r in rows.collect():
        assert sorted(terms[i] for i in r["term_ids"]) == sorted(set(docs[r["doc_id"] - 1][1])) and set(r["tfs"]) <= {2}
