"""Rounds of coding: classify, check, route, and train again on the outcome.

The state (one narrow row per document) has the same schema in every round and is written after
each one, so plans do not grow. Term counts are written once, apart from the state.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicvote.constants import GATES
from topicvote.functions.hashing import DEFAULT_SEED, row_hash
from topicvote.operators import naive_bayes
from topicvote.operators.features import Vocabulary, with_arrays
from topicvote.operators.flags import BEFORE, FlagSums
from topicvote.operators.sampling import EnsembleSpec
from topicvote.operators.scoring import LinearEnsemble, ensemble_verdicts
from topicvote.operators.validation import (
    STATE_COLUMNS,
    check_order,
    learn_tied,
    route,
    validation_numbers,
)
from topicvote.session import materialise, materialise_bucketed

Learner = Callable[
    [DataFrame, Vocabulary, EnsembleSpec, DataFrame, FlagSums | None], LinearEnsemble
]

BUCKET_BYTES = 256 * 1024 * 1024
ENTRY_BYTES = 12


@dataclass
class WorkflowConfig:
    """``variant``: v0 takes every verdict; v1 checks samples; v2 also remembers rejected topics;
    v3 gates from round 1; v4 also learns from tied documents."""

    variant: str = "v1"
    fold: int = 3
    rounds: int = 5
    spec: EnsembleSpec = field(default_factory=EnsembleSpec)
    missing_vote: str = "exclude"
    learner: Learner = naive_bayes.fit_ensemble
    buckets: int | None = None

    @property
    def validated(self) -> bool:
        return self.variant != "v0"

    @property
    def keep_negatives(self) -> bool:
        return self.variant in ("v2", "v3", "v4")

    @property
    def active_learning(self) -> bool:
        return self.variant == "v4"

    def gate(self, round_number: int) -> float | None:
        schedule = GATES[self.variant]
        return schedule[min(round_number, len(schedule)) - 1]


def start_state(corpus: DataFrame, fold: int, seed: int | str = DEFAULT_SEED) -> DataFrame:
    """State before round 1: the rows outside the fold train. ``corpus`` has doc_id, sim and
    label; its other columns stay."""
    return corpus.withColumns(
        {
            "row_hash": row_hash("doc_id", seed),
            "original_label": F.col("label"),
            "in_train": (F.col("sim") != fold).cast("int"),
            "neg_topics": F.array().cast("array<int>"),
        }
    )


def classify(
    counted: DataFrame,
    state: DataFrame,
    vocabulary: Vocabulary,
    config: WorkflowConfig,
    before: tuple[DataFrame, FlagSums | None] | None = None,
) -> tuple[DataFrame, FlagSums | None]:
    """Fits the ensemble of a round and adds ``full_topics`` and ``verdict`` to the test rows. With
    the state and sums of the round ``before``, a learner that sums only sums what has changed."""
    rows = with_arrays(state.join(counted.select("doc_id", "raw_features"), "doc_id"))
    fitted, sums = rows, None
    if before is not None and before[1] is not None:
        changing = ("label", "in_train", "neg_topics")
        former = before[0].select("doc_id", *[F.col(c).alias(BEFORE + c) for c in changing])
        fitted, sums = rows.join(former, "doc_id"), before[1]
    ensemble = config.learner(fitted, vocabulary, config.spec, state, sums)
    coded = classify_with(rows.where(F.col("in_train") == 0), ensemble, config.missing_vote)
    return coded, ensemble.sums


def classify_with(test: DataFrame, ensemble: LinearEnsemble, missing_vote: str) -> DataFrame:
    return ensemble_verdicts(test, ensemble, missing_vote, keep=STATE_COLUMNS)


def self_trained(coded: DataFrame) -> DataFrame:
    """Next state of test rows when every verdict is taken: it becomes the label."""
    return coded.select(
        "doc_id",
        "sim",
        "row_hash",
        F.coalesce("verdict", "label").alias("label"),
        "original_label",
        F.col("verdict").isNotNull().cast("int").alias("in_train"),
        "neg_topics",
    )


def split_coded(coded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classified, remaining)"""
    return coded.where(F.col("verdict").isNotNull()), coded.where(F.col("verdict").isNull())


@dataclass
class RoundResult:
    """``summed``: the (document, model) pairs that were summed to fit the round."""

    round_number: int
    state: DataFrame
    coded: DataFrame
    numbers: DataFrame
    summed: int | None = None


def next_state(
    state: DataFrame, coded: DataFrame, config: WorkflowConfig, round_number: int
) -> tuple[DataFrame, DataFrame]:
    """(state after the round, its counters)"""
    trained = state.where(F.col("in_train") == 1)
    classified, remaining = split_coded(coded)
    if not config.validated:
        numbers = classified.groupBy(F.col("verdict").alias("topic")).agg(
            F.count("*").alias("num_classified")
        )
        numbers = numbers.select(
            "topic",
            "num_classified",
            F.lit(0).cast("bigint").alias("num_sample"),
            F.lit(0).cast("bigint").alias("num_non_sample"),
            F.lit(0).cast("bigint").alias("num_correct"),
            F.lit(0).cast("bigint").alias("num_incorrect"),
            F.lit(None).cast("double").alias("precision_in_sample"),
            F.col("num_classified").alias("num_added_to_training"),
        )
        return trained.unionByName(self_trained(coded)), numbers

    classified = classified.withColumn("draw", check_order(round_number, config.spec.seed))
    numbers = validation_numbers(classified, config.gate(round_number), config.spec.topics)
    # One row per topic: computed once, then a literal table.
    numbers = state.sparkSession.createDataFrame(numbers.toArrow())
    parts = [trained, route(classified, numbers, config.keep_negatives)]
    if config.active_learning:
        tied = F.size("full_topics") > 1
        parts.append(learn_tied(remaining.where(tied)))
        remaining = remaining.where(~tied)
    parts.append(remaining.select(*STATE_COLUMNS))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out, numbers.drop("passes", "cut")


def bucket_number(counted: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets of about ``bucket_bytes`` of counts, measured; one for each core at least."""
    filled = F.size(F.unwrap_udt("raw_features").getField("indices"))
    size = ENTRY_BYTES * (counted.agg(F.sum(filled)).first()[0] or 0)
    return max(counted.sparkSession.sparkContext.defaultParallelism, -(-size // bucket_bytes))


def _write(df: DataFrame, name: str, buckets: int) -> DataFrame:
    return materialise_bucketed(df, name, "doc_id", buckets)


@dataclass
class FirstRound:
    """What round 1 starts from and finds. No gate or memory of a variant has a part in it: variants share it."""

    counted: DataFrame
    buckets: int
    state: DataFrame
    coded: DataFrame
    sums: FlagSums | None


def first_round(
    counted: DataFrame, vocabulary: Vocabulary, config: WorkflowConfig, buckets: int
) -> FirstRound:
    """``counted`` is bucketed by document."""
    corpus = counted.select("doc_id", "sim", "label")
    state = start_state(corpus, config.fold, config.spec.seed).select(*STATE_COLUMNS)
    state = _write(state, "state", buckets)
    coded, sums = classify(counted, state, vocabulary, config)
    return FirstRound(counted, buckets, state, materialise(coded, "coded"), sums)


def run(
    counted: DataFrame,
    vocabulary: Vocabulary,
    config: WorkflowConfig,
    first: FirstRound | None = None,
) -> list[RoundResult]:
    """All rounds of one fold. ``counted``: doc_id, sim, label, raw_features. ``first`` is round 1, if it is known.

    The counts and the state are bucketed by document, and the join that starts every round needs
    no shuffle. There are ``config.buckets`` buckets, by default as many as ``bucket_number`` says.
    """
    if first is None:
        buckets = config.buckets or bucket_number(counted)
        first = first_round(_write(counted, "counts", buckets), vocabulary, config, buckets)
    counted, state = first.counted, first.state
    results = []
    before = None
    for number in range(1, config.rounds + 1):
        if number == 1:
            coded, sums = first.coded, first.sums
        else:
            coded, sums = classify(counted, state, vocabulary, config, before)
            coded = materialise(coded, "coded")
        after, numbers = next_state(state, coded, config, number)
        before, state = (state, sums), _write(after, "state", first.buckets)
        numbers = numbers.select(
            F.lit(config.variant).alias("variant"),
            F.lit(config.fold).alias("fold"),
            F.lit(number).alias("round"),
            *numbers.columns,
        )
        results.append(RoundResult(number, state, coded, numbers, sums and sums.touched))
    return results


def run_all(
    counted: DataFrame, vocabulary: Vocabulary, configs: Sequence[WorkflowConfig], threads: int = 4
) -> list[list[RoundResult]]:
    """Runs of several folds or variants. They read the same bucketed counts, and those that start alike share round 1;
    else they do not depend on each other and keep their tables apart, so their jobs share the cluster."""
    buckets = {c.buckets: c.buckets or bucket_number(counted) for c in configs}
    written = {n: _write(counted, "counts", n) for n in dict.fromkeys(buckets.values())}

    def start(config: WorkflowConfig) -> tuple:
        return repr(config.spec), config.fold, config.missing_vote, config.learner, buckets[config.buckets]

    starts = {start(c): c for c in configs}
    with ThreadPoolExecutor(threads) as pool:
        found = pool.map(
            lambda c: first_round(written[buckets[c.buckets]], vocabulary, c, buckets[c.buckets]), starts.values()
        )
        first = dict(zip(starts, found, strict=True))
        return list(pool.map(lambda c: run(counted, vocabulary, c, first[start(c)]), configs))


def known_negatives(state: DataFrame) -> DataFrame:
    """(doc_id, topic) pairs that a check rejected."""
    return state.select("doc_id", F.explode("neg_topics").alias("topic"))


def train_test_rows(state: DataFrame, topic: int) -> tuple[DataFrame, DataFrame]:
    """Training and test rows of one topic: a known negative of it trains and is not tested."""
    known = F.array_contains("neg_topics", F.lit(topic))
    trains = (F.col("in_train") == 1) | known
    return state.where(trains), state.where(~trains)


def label_history(results: list[RoundResult]) -> DataFrame:
    """(doc_id, round, label, original_label, in_train) after every round."""
    out = None
    for r in results:
        rows = r.state.select(
            "doc_id", F.lit(r.round_number).alias("round"), "label", "original_label", "in_train"
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def final_verdicts(state: DataFrame, fold: int) -> DataFrame:
    """(doc_id, sim, label, verdict) of the fold: the label under which a document entered the
    training set is its verdict, and ``label`` is the true one."""
    return state.where(F.col("sim") == fold).select(
        "doc_id",
        "sim",
        F.col("original_label").alias("label"),
        F.when(F.col("in_train") == 1, F.col("label")).alias("verdict"),
    )
