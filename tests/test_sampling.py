import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from topicvote.functions.hashing import P, draw, draw_coefficients, row_hash
from topicvote.operators.rounds import start_state
from topicvote.operators.sampling import (
    EnsembleSpec,
    negative_draws,
    required_sample_size,
    sample_number_log,
    sample_per_group,
    training_class_counts,
    with_fraction,
)


@pytest.mark.parametrize(
    "n, size", [(1, 1), (100, 100), (101, 100), (134, 100), (135, 101), (200, 132), (1000, 278), (10**9, 385)]
)
def test_required_sample_size(spark, n, size):
    df = spark.createDataFrame([(n,)], "n bigint")
    assert df.select(required_sample_size("n")).first()[0] == size


def fraction(spark, label, non):
    row = (1, label, non, label + non)
    df = spark.createDataFrame([row], "topic int, label bigint, non_label_all bigint, train_all bigint")
    return with_fraction(df).first().fraction


def test_fraction_branches(spark):
    assert fraction(spark, 0, 50) == pytest.approx(5 / 50)
    assert fraction(spark, 5, 0) is None
    assert fraction(spark, 10, 100) is None
    assert fraction(spark, 9, 100) == pytest.approx(90 / 100)
    assert fraction(spark, 1, 999) == pytest.approx(100 / 999)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, P - 1), st.integers(1, 100), st.integers(1, 10))
def test_draws_permute_the_range(x, topic, i):
    a, b = draw_coefficients(1830, topic, i)
    assert 1 <= a < P and 0 <= b < P
    assert (a * x + b) % P != (a * ((x + 1) % P) + b) % P


def corpus(spark, n=600):
    """Two thirds of the rows have one topic; topic 5 is rare."""
    label = F.when(F.col("id") % 3 < 2, 1).when(F.col("id") % 30 == 2, 5).otherwise(100)
    rows = spark.range(n).select(
        F.col("id").alias("doc_id"), label.alias("label"), (F.col("id") % 2 + 1).cast("int").alias("sim")
    )
    return start_state(rows, fold=2)


def test_class_counts_with_known_negatives(spark):
    state = corpus(spark)
    state = state.withColumn(
        "neg_topics",
        F.when(F.col("doc_id").isin(1, 3, 5), F.array(F.lit(5))).otherwise(F.col("neg_topics")),
    )
    rows = {r.topic: r for r in training_class_counts(state).collect()}
    local = state.toPandas()
    train = local[local.in_train == 1]
    assert rows[1].label == (train.label == 1).sum()
    assert rows[5].train_all == len(train) + 3
    assert rows[1].train_all == len(train)
    assert rows[7].label == 0


def test_negative_draws_match_brute_force(spark):
    spec = EnsembleSpec(topics=[1, 5, 100], outer=2, inner=2)
    state = corpus(spark)
    drawn = {tuple(r) for r in negative_draws(state, spec).collect()}
    counts = {r.topic: r for r in with_fraction(training_class_counts(state, spec.topics)).collect()}
    assert counts[1].fraction is None and counts[5].fraction is not None
    expected = set()
    for r in state.where("in_train = 1").collect():
        for t in (1, 5, 100):
            if counts[t].fraction is None or r.label == t:
                continue
            for i, j in spec.replicates:
                a, b = draw_coefficients(*spec.key(t, i, j))
                if (r.row_hash * a + b) % P < counts[t].fraction * P:
                    expected.add((r.doc_id, t, i, j))
    assert drawn == expected
    assert len({(i, j) for _, _, i, j in drawn}) == 4


def test_same_sample_repeats_share_the_draw(spark):
    spec = EnsembleSpec(topics=[5], outer=2, inner=2, repeats="same-sample")
    drawn = {tuple(r) for r in negative_draws(corpus(spark), spec).collect()}
    by_rep = {(i, j): {d for d, _, a, b in drawn if (a, b) == (i, j)} for i, j in spec.replicates}
    assert by_rep[1, 1] == by_rep[1, 2] != by_rep[2, 1]


def test_sample_log_adds_up(spark):
    spec = EnsembleSpec(outer=2, inner=1)
    rows = sample_number_log(corpus(spark), spec).collect()
    assert len(rows) == 21 * 2
    for r in rows:
        assert r.train_all == r.label + r.non_label_sample
        assert r.non_label_sample <= r.non_label_all


def test_group_sample_is_exact_for_a_hot_group(spark):
    rows = spark.range(6000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, 2).when(F.col("id") % 100 == 1, 3).otherwise(1).alias("verdict"),
        draw(row_hash(F.col("id")), "test").alias("draw"),
    )
    got = {(r.verdict, r.doc_id) for r in sample_per_group(rows, "verdict", "draw").collect()}
    local = rows.toPandas()
    expected = set()
    for verdict, group in local.groupby("verdict"):
        n = len(group)
        size = spark.createDataFrame([(n,)], "n bigint").select(required_sample_size("n")).first()[0]
        best = group.sort_values(["draw", "doc_id"]).head(size)
        expected |= {(verdict, d) for d in best.doc_id}
    assert got == expected
