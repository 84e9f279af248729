"""Evaluation: everything is derived from counts of (fold, true topic, verdict).

That count is the only pass over the documents; what follows works on a few hundred rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare_flags(df: DataFrame, truth: str = "label", verdict: str = "verdict") -> DataFrame:
    """Adds correct, classified, fp and tp; a null verdict is 'not classified'."""
    classified = F.coalesce(F.col(verdict) >= 1, F.lit(False))
    correct = F.coalesce(F.col(truth) == F.col(verdict), F.lit(False))
    return (
        df.withColumn("correct", correct.cast("int"))
        .withColumn("classified", F.when(classified, "classified").otherwise("not classified"))
        .withColumn("fp", (classified & ~correct).cast("int"))
        .withColumn("tp", (classified & correct).cast("int"))
    )


def confusion_cells(
    df: DataFrame, truth: str = "label", verdict: str = "verdict", by: Sequence[str] = ()
) -> DataFrame:
    """(by..., topic, verdict, n)"""
    return df.groupBy(*by, F.col(truth).alias("topic"), F.col(verdict).alias("verdict")).agg(
        F.count("*").alias("n")
    )


def confusion_matrix(cells: DataFrame, topics: Sequence[int]) -> DataFrame:
    """One row per verdict, a column ``actual_<topic>`` per true topic."""
    named = cells.where(F.col("verdict").isNotNull()).withColumn(
        "actual", F.concat(F.lit("actual_"), F.col("topic"))
    )
    names = [f"actual_{t}" for t in topics]
    return named.groupBy("verdict").pivot("actual", names).agg(F.sum("n")).na.fill(0)


def _ratio(part: Column, whole: Column) -> Column:
    return part / F.nullif(whole, F.lit(0))


def f1(precision: str = "precision", recall: str = "recall") -> Column:
    p, r = F.col(precision), F.col(recall)
    return 2 * p * r / F.nullif(p + r, F.lit(0.0))


def pr_by_topic(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, n_items, precision and recall of every topic that has documents.

    Counts are joined by topic: one without any verdict has null precision and recall 0.
    """
    roles = F.array(
        F.struct(
            F.col("topic").alias("topic"),
            F.col("n").alias("n_items"),
            F.lit(0).cast("bigint").alias("tp"),
            F.lit(0).cast("bigint").alias("fp"),
        ),
        F.struct(
            F.col("verdict").alias("topic"),
            F.lit(0).cast("bigint").alias("n_items"),
            F.when(F.col("topic") == F.col("verdict"), F.col("n")).otherwise(0).alias("tp"),
            F.when(F.col("topic") != F.col("verdict"), F.col("n")).otherwise(0).alias("fp"),
        ),
    )
    sums = (
        cells.select(*by, F.explode(roles).alias("r"))
        .where(F.col("r.topic").isNotNull())
        .groupBy(*by, F.col("r.topic").alias("topic"))
        .agg(*[F.sum(f"r.{c}").alias(c) for c in ("tp", "fp", "n_items")])
        .where(F.col("n_items") > 0)
    )
    return sums.select(
        *by,
        "topic",
        "tp",
        "fp",
        "n_items",
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _ratio(F.col("tp"), F.col("n_items")).alias("recall"),
    )


def pr_total(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pooled precision and recall; the verdicts of all topics count alike."""
    hit = F.col("topic") == F.col("verdict")
    given = F.col("verdict").isNotNull()
    sums = cells.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(given & ~hit, F.col("n"))), F.lit(0)).alias("fp"),
        F.sum("n").alias("n_items"),
    )
    return sums.select(
        "*",
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _ratio(F.col("tp"), F.col("n_items")).alias("recall"),
    ).withColumn("f1", f1())


def fold_mean(pr: DataFrame, by: Sequence[str] = ("topic",), n_folds: int = 3) -> DataFrame:
    """Mean of precision and recall over the folds; null where a fold has no value."""

    def mean(name: str) -> Column:
        whole = F.count(name) == n_folds
        return F.when(whole, F.sum(name) / n_folds).alias(name)

    return pr.groupBy(*by).agg(mean("precision"), mean("recall"))


def with_column_means(df: DataFrame, label: str, digits: int = 2) -> DataFrame:
    """Appends a row of column means (label null) and rounds every number."""
    numbers = [c for c, kind in df.dtypes if c != label and kind in ("double", "float")]
    kind = df.schema[label].dataType
    means = df.agg(*[F.avg(c).alias(c) for c in numbers]).withColumn(label, F.lit(None).cast(kind))
    both = df.select(label, *numbers).unionByName(means)
    return both.select(label, *[F.round(c, digits).alias(c) for c in numbers])


def with_suffix(df: DataFrame, suffix: str, key: str = "topic") -> DataFrame:
    """precision, recall -> precision_<suffix>, recall_<suffix>"""
    return df.select(
        key, *[F.col(c).alias(f"{c}_{suffix}") for c in ("precision", "recall")]
    )


def side_by_side(tables: dict[str, DataFrame], key: str = "topic") -> DataFrame:
    """Joins the precision and recall of several models by topic; a missing one is null."""
    named = [with_suffix(df, name, key) for name, df in tables.items()]
    out = named[0]
    for other in named[1:]:
        out = out.join(other, key, "left")
    return out


def columns_like(df: DataFrame, prefix: str = "", suffix: str = "") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix) and c.endswith(suffix)]


def metrics_long(wide: DataFrame, key: str = "topic", metric: str = "precision") -> DataFrame:
    """(key, model, score) from the columns ``<metric>_<model>``."""
    names = columns_like(wide, f"{metric}_")
    return wide.select(key, *names).unpivot(
        key, names, "model", "score"
    ).withColumn("model", F.substring_index("model", "_", -1))


def metrics_wide(long: DataFrame, key: str, names_from: str, names: Sequence[str]) -> DataFrame:
    """One ``precision_<name>`` and ``recall_<name>`` column per name."""
    wide = long.groupBy(key).pivot(names_from, list(names)).agg(
        F.max("precision").alias("precision"), F.max("recall").alias("recall")
    )
    return wide.select(
        key,
        *[F.col(f"{n}_{m}").alias(f"{m}_{n}") for m in ("precision", "recall") for n in names],
    )


def model_wins(wide: DataFrame, first: str, second: str) -> DataFrame:
    """How often the first model beats the second, and how many topics reach a threshold."""

    def wins(metric: str) -> Column:
        return F.count_if(F.col(f"{metric}_{first}") > F.col(f"{metric}_{second}"))

    return wide.agg(
        wins("precision").alias("precision_wins"),
        wins("recall").alias("recall_wins"),
        F.count_if(F.col(f"precision_{first}") >= 0.85).alias("precision_085"),
        F.count_if(F.col(f"precision_{first}") >= 0.8).alias("precision_080"),
    )


def highlights(long: DataFrame, least: float, score: str = "score") -> DataFrame:
    return long.where(F.col(score) >= least)


VALIDATION_SUMS = (
    "num_classified",
    "num_sample",
    "num_non_sample",
    "num_correct",
    "num_incorrect",
    "num_added_to_training",
)


def variant_summary(cells: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """Per topic: right (one), wrong (zero) and all results, items, the mean precision and recall
    of the folds, and the validation counters summed over rounds and folds. The total row has a
    null topic and pooled precision and recall.

    ``cells`` has the columns sim, topic, verdict, n.
    """
    by_fold = pr_by_topic(cells, ["sim"])
    topics = by_fold.groupBy("topic").agg(
        F.sum("tp").alias("one"),
        F.sum("fp").alias("zero"),
        F.sum(F.col("tp") + F.col("fp")).alias("total_result"),
        F.sum("n_items").alias("n_items"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
    )
    if numbers is not None:
        counters = numbers.groupBy("topic").agg(*[F.sum(c).alias(c) for c in VALIDATION_SUMS])
        topics = topics.join(counters, "topic", "left")
    sums = ["one", "zero", "total_result", "n_items"]
    if numbers is not None:
        sums += VALIDATION_SUMS
    total = topics.agg(*[F.sum(c).alias(c) for c in sums]).select(
        F.lit(None).cast("int").alias("topic"),
        *sums,
        _ratio(F.col("one"), F.col("total_result")).alias("precision"),
        _ratio(F.col("one"), F.col("n_items")).alias("recall"),
    )
    return topics.unionByName(total)


def convergence(numbers: DataFrame, n_folds: int = 3) -> DataFrame:
    """Per variant and round: classified, added and checked documents, averaged over the folds."""
    return numbers.groupBy("variant", "round").agg(
        *[
            (F.sum(c) / n_folds).alias(c)
            for c in ("num_classified", "num_added_to_training", "num_sample")
        ]
    )
