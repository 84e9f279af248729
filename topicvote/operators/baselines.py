"""Baseline models on an 80/20 split: multinomial LASSO and random forest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicvote.functions.hashing import DEFAULT_SEED, row_hash
from topicvote.functions.labels import index_to_label
from topicvote.operators import forest, lasso
from topicvote.operators.forest import Forest, predict
from topicvote.operators.lasso import Regression


def _indexed(vectors: DataFrame, train: Column, label: str) -> tuple[DataFrame, list]:
    codes = [r[0] for r in vectors.where(train).select(label).distinct().orderBy(label).collect()]
    position = F.array_position(F.array(*[F.lit(c) for c in codes]), F.col(label)) - 1
    return vectors.where(train).withColumn("index", position.cast("double")), codes


def lasso_verdicts(
    rows: DataFrame,
    n_terms: int,
    train: Column,
    label: str = "label",
    keep: Sequence[str] = ("doc_id", "label"),
    penalties: tuple[float, ...] = (0.1, 0.01, 0.001),
    folds: int = 3,
    max_iter: int = 100,
) -> DataFrame:
    """Multinomial regression with an L1 penalty chosen by cross-validation on the deviance (``lasso.py``).
    ``verdict`` codes the rows outside ``train``. ``rows`` (written before) has doc_id, the label, term_ids and tfs,
    ``n_terms`` terms in all. The regressions of all rows are fitted along with those of the folds."""
    indexed, codes = _indexed(rows, train, label)
    fold = (row_hash("doc_id", f"fold {DEFAULT_SEED}") % folds).cast("int")
    indexed = indexed.withColumns({"index": F.col("index").cast("int"), "fold": fold})
    models = [Regression(p, f) for f in [None, *range(folds)] for p in penalties]
    deviance, places = dict.fromkeys(penalties, 0.0), {}
    for own, fitted in lasso.fit(indexed, models, n_terms, len(codes), max_iter):
        for k, (model, loss) in enumerate(zip(own, lasso.held_out_losses(indexed, own, fitted), strict=True)):
            if model.fold is None:
                places[model.penalty] = fitted, k
            else:
                deviance[model.penalty] += loss
    best = min(penalties, key=deviance.get)
    coded = lasso.predict(rows.where(~train), *places[best], *keep)
    return coded.select(*keep, index_to_label("prediction", codes).alias("verdict"))


def forest_verdicts(
    rows: DataFrame,
    n_terms: int,
    train: Column,
    label: str = "label",
    keep: Sequence[str] = ("doc_id", "label"),
    trees: int = 100,
    features_per_split: int = 20,
) -> DataFrame:
    """Random forest (``forest.py``). ``verdict`` codes the rows outside ``train``. ``rows`` (written before) has
    doc_id, the label, term_ids and tfs, ``n_terms`` terms in all."""
    fitted, codes = fit_forest(rows, n_terms, train, label, trees, features_per_split)
    coded = predict(rows.where(~train), fitted, *keep)
    return coded.select(*keep, index_to_label("prediction", codes).alias("verdict"))


def fit_forest(
    rows: DataFrame, n_terms: int, train: Column, label: str = "label", trees: int = 100, features_per_split: int = 20
) -> tuple[Forest, list]:
    """The fitted forest, and the labels of its classes."""
    indexed, codes = _indexed(rows, train, label)
    indexed = indexed.withColumns({"index": F.col("index").cast("int"), "row_hash": row_hash("doc_id")})
    return forest.fit(indexed, n_terms, len(codes), trees, features_per_split), codes


def forest_importance(
    rows: DataFrame,
    train: Column,
    names: list[str],
    label: str = "label",
    trees: int = 100,
    features_per_split: int = 20,
) -> DataFrame:
    """(feature, impurity) of every feature that a tree splits at: its share in the decrease of
    impurity. ``names`` are those of the term numbers."""
    fitted, _ = fit_forest(rows, len(names), train, label, trees, features_per_split)
    pairs = [(names[i], v) for i, v in fitted.importances().items() if v > 0]
    return rows.sparkSession.createDataFrame(pairs, "feature string, impurity double")
