"""One-vs-rest class counts, down-sampling of negatives, samples of a required size."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicvote.constants import SAMPLE_DELTA, SAMPLE_MINIMUM, SAMPLE_Z, TOPICS
from topicvote.functions.hashing import DEFAULT_SEED, P, draw_coefficients
from topicvote.functions.literals import constant_array, constant_rows, constant_table
from topicvote.operators.flags import Flag, flag_vectors, flagged_sums


def in_train() -> Column:
    return F.col("in_train") == 1


@dataclass
class EnsembleSpec:
    """One classifier per topic and replicate (i, j).

    ``repeats='independent'`` draws anew for every (i, j); ``'same-sample'`` draws once per i.
    """

    topics: Sequence[int] = field(default_factory=lambda: list(TOPICS))
    outer: int = 3
    inner: int = 3
    repeats: str = "independent"
    seed: int | str = DEFAULT_SEED
    smoothing: float = 0.1

    @property
    def replicates(self) -> list[tuple[int, int]]:
        return [(i, j) for i in range(1, self.outer + 1) for j in range(1, self.inner + 1)]

    @property
    def votes(self) -> int:
        return self.outer * self.inner

    def key(self, topic: int, i: int, j: int) -> tuple:
        return (self.seed, topic, i, j if self.repeats == "independent" else 0)


def training_class_counts(state: DataFrame, topics: Sequence[int] = TOPICS) -> DataFrame:
    """(topic, label, non_label_all, train_all) of the training rows of every topic.

    A training row counts for all topics, a known negative only for the topic it was rejected
    from. The rows are first counted by label, so only those few counts meet the topic list.
    """
    all_topics = constant_array(topics)
    code = F.when(F.col("label").isin(*topics), F.col("label"))
    by_label = state.where(in_train()).groupBy(code.alias("label")).count()
    for_all = by_label.select("label", "count", F.explode(all_topics).alias("topic"))
    topics_only = constant_table(state, ["topic"], [(t,) for t in topics]).select(
        F.lit(None).cast("int").alias("label"), F.lit(0).cast("bigint").alias("count"), "topic"
    )
    rows = for_all.unionByName(topics_only)
    if "neg_topics" in state.columns:
        known = (
            state.where(~in_train())
            .select(F.explode("neg_topics").alias("topic"))
            .groupBy("topic")
            .count()
            .select(F.lit(None).cast("int").alias("label"), "count", "topic")
        )
        rows = rows.unionByName(known.where(F.col("topic").isin(*topics)))
    return (
        rows.groupBy("topic")
        .agg(
            F.coalesce(
                F.sum(F.when(F.col("label") == F.col("topic"), F.col("count"))), F.lit(0)
            ).alias("label"),
            F.sum("count").alias("train_all"),
        )
        .select(
            "topic",
            "label",
            (F.col("train_all") - F.col("label")).alias("non_label_all"),
            "train_all",
        )
    )


def with_fraction(counts: DataFrame) -> DataFrame:
    """Adds the share of negatives to draw; null keeps them all.

    Below one positive in ten negatives, ten negatives per positive are wanted, but no fewer
    than a tenth of the training rows.
    """
    tenth = F.floor(F.col("train_all") / 10)
    wanted = F.greatest(F.col("label") * 10, tenth)
    rare = (F.col("non_label_all") > 0) & (F.col("label") / F.nullif("non_label_all", F.lit(0)) < 0.1)
    return counts.withColumn("fraction", F.when(rare, wanted / F.col("non_label_all")))


def sampling_thresholds(state: DataFrame, spec: EnsembleSpec) -> dict[int, dict]:
    """Counts and draw threshold of every topic, on the driver: one row per topic."""
    rows = with_fraction(training_class_counts(state, spec.topics)).collect()
    return {
        r["topic"]: {
            "label": r["label"],
            "non_label_all": r["non_label_all"],
            "threshold": None if r["fraction"] is None else ceil(r["fraction"] * P),
        }
        for r in rows
    }


def fold_thresholds(
    rows: DataFrame, spec: EnsembleSpec, folds: Sequence[int]
) -> dict[int, dict[int, dict]]:
    """``sampling_thresholds`` of every fold, when the rows outside a fold train: from one count of
    the rows by fold and label."""
    code = F.when(F.col("label").isin(*spec.topics), F.col("label")).cast("int")
    cells = rows.groupBy("sim", code.alias("label")).count().collect()
    train = {f: sum(r["count"] for r in cells if r["sim"] is not None and r["sim"] != f) for f in folds}
    own = {
        (f, t): sum(r["count"] for r in cells if r["sim"] is not None and r["sim"] != f and r["label"] == t)
        for f in folds for t in spec.topics
    }
    counts = constant_table(
        rows,
        ["fold", "topic", "label", "non_label_all", "train_all"],
        [(f, t, n, train[f] - n, train[f]) for (f, t), n in own.items()],
    )
    plans: dict[int, dict[int, dict]] = {f: {} for f in folds}
    for r in with_fraction(counts).collect():
        plans[r["fold"]][r["topic"]] = {
            "label": r["label"],
            "non_label_all": r["non_label_all"],
            "threshold": None if r["fraction"] is None else ceil(r["fraction"] * P),
        }
    return plans


def negatives_flag(
    plan: dict[int, dict], spec: EnsembleSpec, topic: int, i: int, j: int, fold: int | None = None
) -> Flag:
    """The negatives of a model. Replicates of a topic that keeps them all have the same."""
    threshold = plan[topic]["threshold"]
    key = None if threshold is None else spec.key(topic, i, j)
    return Flag(topic, negative=True, key=key, threshold=threshold, fold=fold)


def negative_draws(state: DataFrame, spec: EnsembleSpec, hashed: str = "row_hash") -> DataFrame:
    """(doc_id, topic, i, j): the negatives each classifier of a rare topic trains on.

    Topics that keep all their negatives have no rows here.
    """
    plan = sampling_thresholds(state, spec)
    models = []
    for t in spec.topics:
        if plan[t]["threshold"] is None:
            continue
        for i, j in spec.replicates:
            a, b = draw_coefficients(*spec.key(t, i, j))
            models.append(
                {"topic": t, "i": i, "j": j, "threshold": plan[t]["threshold"], "a": a, "b": b}
            )
    if not models:
        return state.select(
            "doc_id", *[F.lit(0).alias(c) for c in ("topic", "i", "j")]
        ).where(F.lit(False))
    known = (
        F.coalesce(F.array_contains("neg_topics", F.col("m.topic")), F.lit(False))
        if "neg_topics" in state.columns
        else F.lit(False)
    )
    return (
        state.withColumn("m", F.explode(constant_rows(models)))
        .where((in_train() | known) & ~F.col("label").eqNullSafe(F.col("m.topic")))
        .where((F.col(hashed) * F.col("m.a") + F.col("m.b")) % F.lit(P) < F.col("m.threshold"))
        .select("doc_id", "m.topic", "m.i", "m.j")
    )


def sample_number_log(state: DataFrame, spec: EnsembleSpec) -> DataFrame:
    """(topic, i, j, label, non_label_all, non_label_sample, train_all) as trained on. The sampled
    rows of all models are counted in one pass."""
    plan = sampling_thresholds(state, spec)
    slots = [(t, i, j, negatives_flag(plan, spec, t, i, j)) for t in spec.topics for i, j in spec.replicates]
    flags = list(dict.fromkeys(flag for *_, flag in slots if flag.threshold is not None))
    drawn = {}
    if flags:
        sums = flagged_sums(state, flags, with_terms=False)
        drawn = {flag: n for flag, _, n in flag_vectors(sums, 0)}
    rows = []
    for t, i, j, flag in slots:
        label, others = plan[t]["label"], plan[t]["non_label_all"]
        sample = others if flag.threshold is None else drawn[flag]
        rows.append((t, i, j, label, others, sample, label + sample))
    names = ["topic", "i", "j", "label", "non_label_all", "non_label_sample", "train_all"]
    kinds = ["int"] * 3 + ["bigint"] * 4
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
    return state.sparkSession.createDataFrame(rows, schema)


def required_sample_size(n: str | Column) -> Column:
    """Rows to check out of ``n``: all up to 100, at least 100 beyond; never above 385."""
    total = F.col(n) if isinstance(n, str) else n
    z_delta = SAMPLE_Z * SAMPLE_Z * 0.5 * 0.5 / (SAMPLE_DELTA * SAMPLE_DELTA)
    wanted = F.ceil(F.lit(z_delta) / (1 + F.lit(1.0) / total * F.lit(z_delta - 1)))
    return F.when(total <= SAMPLE_MINIMUM, total).otherwise(
        F.greatest(wanted, F.lit(SAMPLE_MINIMUM).cast("bigint"))
    )


DRAW_BINS = 2048


def sample_per_group(df: DataFrame, group: str, order: str, key: str = "doc_id") -> DataFrame:
    """The required sample of every group: its rows with the smallest draws (``order``, in [0, P)).

    Rows are first counted by group and ``DRAW_BINS`` equal ranges of the draw. The counts tell the
    size of a group and the range in which its sample ends, so that little more than the sample
    itself is ranked, whatever the group's size.
    """
    place = (F.col(order) * DRAW_BINS / F.lit(P)).cast("int")
    bins = df.groupBy(group, place.alias("bin")).agg(F.count("*").alias("n"))
    whole = W.partitionBy(group)
    total, before = F.sum("n").over(whole), F.sum("n").over(whole.orderBy("bin")) - F.col("n")
    cuts = (
        bins.select(group, "bin", before.alias("before"), required_sample_size(total).alias("sample_size"))
        .where(F.col("before") < F.col("sample_size"))
        .groupBy(group)
        .agg(F.max("bin").alias("last_bin"), F.first("sample_size").alias("sample_size"))
    )
    rank = F.row_number().over(W.partitionBy(group).orderBy(order, key))
    return (
        df.join(F.broadcast(cuts), group)
        .where(place <= F.col("last_bin"))
        .withColumn("rank", rank)
        .where(F.col("rank") <= F.col("sample_size"))
        .drop("rank", "last_bin", "sample_size")
    )
