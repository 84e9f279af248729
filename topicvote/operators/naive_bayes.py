"""Naive Bayes from aggregated term counts.

Sums of term counts are integers, so a model does not depend on the order in which tasks add
them up; the inverse document frequencies are multiplied in once per term.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import NaiveBayes
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicvote.functions.labels import index_to_label
from topicvote.operators.features import Vocabulary
from topicvote.operators.flags import CHUNK_TERMS, CHUNKS, Flag, FlagSums, chunk_batch, chunked_sums, flag_rows, flagged_sums
from topicvote.operators.sampling import EnsembleSpec, fold_thresholds, negatives_flag, sampling_thresholds
from topicvote.operators.scoring import LinearEnsemble, store_weights


def multiclass_verdicts(vectors: DataFrame, fold: int, smoothing: float = 0.1) -> DataFrame:
    """Fits on the rows outside the fold and codes the fold: (doc_id, sim, label, verdict)."""
    train = vectors.where(F.col("sim") != fold)
    test = vectors.where(F.col("sim") == fold)
    codes = [r["label"] for r in train.select("label").distinct().orderBy("label").collect()]
    position = reduce(
        lambda chain, c: chain.when(F.col("label") == c[1], float(c[0])),
        enumerate(codes),
        F.when(F.lit(False), 0.0),
    )
    model = NaiveBayes(
        featuresCol="features", labelCol="index", smoothing=smoothing, modelType="multinomial"
    ).fit(train.withColumn("index", position))
    return model.transform(test).select(
        "doc_id", "sim", "label", index_to_label("prediction", codes).alias("verdict")
    )


def fit_ensemble(
    rows: DataFrame,
    vocabulary: Vocabulary,
    spec: EnsembleSpec,
    state: DataFrame | None = None,
    before: FlagSums | None = None,
) -> LinearEnsemble:
    """One binary model per topic and replicate, from one pass over ``rows``.

    ``rows`` has label, in_train, row_hash, term_ids, tfs and maybe neg_topics; ``state`` may give
    the same rows without the counts. With ``before``, the sums of the round before, only what has
    changed since is summed (``flags.py``); the result's ``sums`` serve the next round."""
    plan = sampling_thresholds(rows if state is None else state, spec)
    return _fitted(rows, vocabulary, spec, {None: plan}, before)[None]


def fit_folds(
    rows: DataFrame, vocabulary: Vocabulary, spec: EnsembleSpec, folds: Sequence[int] = (1, 2, 3)
) -> dict[int, LinearEnsemble]:
    """An ensemble for each fold, fitted on the rows outside of it: one pass over ``rows`` for all.

    ``rows`` has sim, label, in_train (1 throughout), row_hash, term_ids and tfs."""
    return _fitted(rows, vocabulary, spec, fold_thresholds(rows, spec, folds))


def _fitted(
    rows: DataFrame,
    vocabulary: Vocabulary,
    spec: EnsembleSpec,
    plans: dict[int | None, dict[int, dict]],
    before: FlagSums | None = None,
) -> dict[int | None, LinearEnsemble]:
    """An ensemble for each fold of ``plans``. Tasks make the weights, a chunk of terms at a time; a sum for
    each chunk and flag comes to the driver."""
    spark, n_terms = rows.sparkSession, len(vocabulary)
    flags: list[Flag] = []
    model_at: dict[Flag, int] = {}
    model_of: dict[int | None, list[int]] = {}
    sizes: dict[int | None, int] = {}
    for fold, plan in plans.items():
        active = [t for t in spec.topics if plan[t]["label"] > 0 and plan[t]["non_label_all"] > 0]
        flags += [Flag(t, fold=fold) for t in active]
        own: dict[Flag, int] = {}
        slots = model_of[fold] = []
        for t in spec.topics:
            for i, j in spec.replicates:
                if t not in active:
                    # Without positives nothing is coded, without negatives everything is.
                    slots.append(0 if plan[t]["label"] else 1)
                    continue
                flag = negatives_flag(plan, spec, t, i, j, fold)
                slots.append(own.setdefault(flag, 2 + len(own)))
        model_at |= own
        sizes[fold] = 2 + len(own)
    ends = np.cumsum(list(sizes.values()))
    starts = {fold: int(end - sizes[fold]) for fold, end in zip(sizes, ends, strict=True)}
    intercepts = {fold: np.zeros(n) for fold, n in sizes.items()}
    for values in intercepts.values():
        values[:2] = np.inf, -np.inf
    sums = flagged_sums(rows, [*flags, *model_at], before=before, n_terms=n_terms) if flags else None
    if sums is None:
        weights = store_weights(spark.createDataFrame([], CHUNKS), n_terms, int(ends[-1]), CHUNK_TERMS)
    else:
        place = {flag: k for k, flag in enumerate(sums.flags) if flag is not None}
        counts = flag_rows(sums)
        columns, yes, no = [], [], []
        for flag, at in model_at.items():
            n, own = counts[place[flag]], place[Flag(flag.topic, fold=flag.fold)]
            if n:
                columns.append(starts[flag.fold] + at)
                yes.append(own)
                no.append(place[flag])
                intercepts[flag.fold][at] = np.log(counts[own] + spec.smoothing) - np.log(n + spec.smoothing)
            else:
                intercepts[flag.fold][at] = np.inf
        chunks = chunked_sums(sums, n_terms, CHUNK_TERMS)
        made = chunks.mapInArrow(
            _weights(vocabulary.idf, _totals(chunks, vocabulary.idf), spec.smoothing, int(ends[-1]), columns, yes, no),
            CHUNKS,
        )
        weights = store_weights(made, n_terms, int(ends[-1]), CHUNK_TERMS)
    return {
        fold: LinearEnsemble(
            spec,
            weights.models(starts[fold], starts[fold] + sizes[fold]),
            intercepts[fold],
            np.array(model_of[fold]),
            sums,
        )
        for fold in plans
    }


def _weighted(data: pa.Scalar, chunk: int, idf: np.ndarray, chunk_terms: int) -> np.ndarray:
    here = idf[chunk * chunk_terms : (chunk + 1) * chunk_terms]
    return np.frombuffer(data.as_buffer()).reshape(len(here), -1) * here[:, None]


def _totals(chunks: DataFrame, idf: np.ndarray) -> np.ndarray:
    """Weighted counts of all terms for every flag, added in the order of the chunks."""
    chunk_terms = CHUNK_TERMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
                by_flag = np.ascontiguousarray(_weighted(data, chunk, idf, chunk_terms).T)
                yield chunk_batch(chunk, by_flag.sum(axis=1))

    table = chunks.mapInArrow(run, CHUNKS).toArrow().sort_by("chunk")
    return sum(np.frombuffer(data.as_buffer()) for data in table.column("data"))


def _weights(
    idf: np.ndarray,
    totals: np.ndarray,
    smoothing: float,
    width: int,
    columns: Sequence[int],
    yes: Sequence[int],
    no: Sequence[int],
):
    """Weights of the models at ``columns`` from the sums of the flags ``yes`` and ``no``, chunk by chunk."""
    chunk_terms = CHUNK_TERMS
    heights = np.log(totals + smoothing * len(idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
                logs = np.log(_weighted(data, chunk, idf, chunk_terms) + smoothing) - heights
                out = np.zeros((len(logs), width))
                here = idf[chunk * chunk_terms : (chunk + 1) * chunk_terms]
                out[:, columns] = here[:, None] * (logs[:, yes] - logs[:, no])
                yield chunk_batch(chunk, out)

    return run
