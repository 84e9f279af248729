"""Linear support vector machines: the one-vs-rest ensemble, and one-vs-one for all topics.

All models of an ensemble are fitted together (``hinge.py``).
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicvote.operators.features import Vocabulary
from topicvote.operators.flags import Flag, FlagSums
from topicvote.operators.hinge import Machine, StoredVector, fit, together
from topicvote.operators.sampling import EnsembleSpec, in_train, negatives_flag, sampling_thresholds
from topicvote.operators.scoring import LinearEnsemble, StoredWeights, score_votes, weights_file


def training_vectors(rows: DataFrame) -> DataFrame:
    """What the optimiser reads of the rows that train a model."""
    known = F.col("neg_topics") if "neg_topics" in rows.columns else F.array().cast("array<int>")
    used = in_train() | (F.size(known) > 0)
    columns = [
        F.col("label").cast("int").alias("label"),
        F.col("in_train").cast("int").alias("in_train"),
        F.col("row_hash").cast("bigint").alias("row_hash"),
        known.cast("array<int>").alias("neg_topics"),
    ]
    columns += [F.col("sim").cast("int").alias("sim")] if "sim" in rows.columns else []
    return rows.where(used).select(*columns, "term_ids", "tfs")


def fit_ensemble(
    rows: DataFrame,
    vocabulary: Vocabulary,
    spec: EnsembleSpec,
    state: DataFrame | None = None,
    before: FlagSums | None = None,
    max_iter: int = 10,
    reg_param: float = 0.1,
) -> LinearEnsemble:
    """One machine per topic and replicate on the same draws as the naive Bayes ensemble.

    The features are idf-weighted counts; as they are standardised, a term's idf only matters where
    it is 0. The weights of the result apply to plain counts. Gradients depend on the weights, so nothing
    of the round ``before`` can be kept."""
    plan = sampling_thresholds(rows if state is None else state, spec)
    machines: dict[Machine, int] = {}
    model_of = []
    for t in spec.topics:
        for i, j in spec.replicates:
            if plan[t]["label"] == 0 or plan[t]["non_label_all"] == 0:
                # Without positives nothing is coded, without negatives everything is.
                model_of.append(0 if plan[t]["label"] else 1)
                continue
            machine = Machine(Flag(t), negatives_flag(plan, spec, t, i, j))
            model_of.append(machines.setdefault(machine, 2 + len(machines)))
    n_terms, intercepts = len(vocabulary), np.zeros(2 + len(machines))
    intercepts[:2] = np.inf, -np.inf
    found = {}
    if machines:
        vectors = training_vectors(rows)
        for k, weight, intercept in fit(vectors, list(machines), n_terms, vocabulary.idf > 0, max_iter, reg_param):
            found[2 + k], intercepts[2 + k] = weight, intercept
    weights = _together(rows.sparkSession, found, n_terms, len(intercepts))
    return LinearEnsemble(spec, weights, intercepts, np.array(model_of))


def _together(spark: SparkSession, found: dict, n_terms: int, width: int) -> StoredWeights | np.ndarray:
    """Weights of models at their places; vectors in memory go to a file."""
    if found and all(isinstance(weight, StoredVector) for weight in found.values()):
        return together(spark, found, n_terms, width)
    weights = weights_file(n_terms, width)
    for place, weight in found.items():
        weights[:, place] = weight
    return weights


def pairwise_verdicts(
    rows: DataFrame,
    vocabulary: Vocabulary,
    labels: Sequence[int],
    keep: Sequence[str] = ("doc_id", "label"),
    folds: Sequence[int] | None = None,
    max_iter: int = 20,
    reg_param: float = 0.1,
) -> DataFrame:
    """One-vs-one: a machine for each pair of labels, fitted on the rows with ``in_train`` 1, codes the
    others. With ``folds``, where ``in_train`` is 1 throughout, every row (``sim``) is coded by machines
    fitted on the rows outside its fold; those of all folds are fitted together. The label with most
    votes wins, of equal ones the first of ``labels``; a margin of 0 votes for the second label of a pair.

    ``rows`` has label, in_train, row_hash, term_ids and tfs; ``labels`` are those of the training rows."""
    pairs = list(combinations(range(len(labels)), 2))
    test = rows if folds else rows.where(F.col("in_train") == 0)
    if not pairs:
        verdict = F.lit(labels[0] if labels else None).cast("int")
        return test.select(*keep, verdict.alias("verdict"))
    groups = list(folds or [None])
    machines = [Machine(Flag(labels[a], fold=f), Flag(labels[b], fold=f)) for f in groups for a, b in pairs]
    intercepts = {f: np.zeros(len(pairs)) for f in groups}
    usable = vocabulary.idf > 0
    found = {f: {} for f in groups}
    for k, weight, intercept in fit(training_vectors(rows), machines, len(vocabulary), usable, max_iter, reg_param):
        group, place = groups[k // len(pairs)], k % len(pairs)
        found[group][place], intercepts[group][place] = weight, intercept
    weights = {f: _together(rows.sparkSession, found[f], len(vocabulary), len(pairs)) for f in groups}
    spec, own = EnsembleSpec(), np.arange(len(pairs))
    scored = score_votes(test, {f: LinearEnsemble(spec, weights[f], intercepts[f], own) for f in groups}, keep)
    votes = [F.get("model_votes", F.lit(k)).cast("int") for k in range(len(pairs))]
    counts = []
    for at in range(len(labels)):
        won = [v for (a, _), v in zip(pairs, votes, strict=True) if a == at]
        won += [1 - v for (_, b), v in zip(pairs, votes, strict=True) if b == at]
        counts.append(sum(won[1:], won[0]))
    ballots = F.array(*counts)
    winner = F.array_position(ballots, F.array_max(ballots)).cast("int")
    verdict = F.element_at(F.array(*[F.lit(x) for x in labels]), winner)
    return scored.select(*keep, verdict.cast("int").alias("verdict"))
