import pytest
from pyspark.sql import functions as F

from test_votes import corpus_rows
from topicvote.operators import rounds, validation
from topicvote.operators.features import count_vectors, fit_vocabulary, with_words
from topicvote.operators.sampling import EnsembleSpec
from topicvote.session import materialise

CLASSIFIED = (
    "doc_id bigint, sim int, row_hash bigint, label int, original_label int, in_train int, "
    "neg_topics array<int>, full_topics array<int>, verdict int, draw bigint"
)


def classified(spark, rows):
    """rows: (doc_id, label, verdict)"""
    full = [(d, 3, d, l, l, 0, [], [v], v, d) for d, l, v in rows]
    return spark.createDataFrame(full, CLASSIFIED)


def test_gate_is_inclusive(spark):
    rows = [(d, 1 if d < 3 else 2, 1) for d in range(4)]
    df = classified(spark, rows)
    for gate, passes in ((0.75, True), (0.76, False), (None, False)):
        numbers = {r.topic: r for r in validation.validation_numbers(df, gate).collect()}
        assert numbers[1].precision_in_sample == 0.75
        assert numbers[1].passes is passes


def test_topic_without_verdicts_does_not_pass(spark):
    numbers = validation.validation_numbers(classified(spark, [(1, 1, 1)]), 0.75).collect()
    other = next(r for r in numbers if r.topic == 2)
    assert other.num_classified == 0 and other.precision_in_sample is None and not other.passes


def test_counters_are_consistent_and_route_follows_the_check(spark):
    rows = [(d, 1 if d % 10 else 2, 1) for d in range(300)] + [(1000 + d, 5, 7) for d in range(20)]
    df = classified(spark, rows)
    for gate in (0.75, None):
        numbers = validation.validation_numbers(df, gate)
        for r in numbers.collect():
            assert r.num_sample == r.num_correct + r.num_incorrect
            assert r.num_classified == r.num_sample + r.num_non_sample
        n = {r.topic: r for r in numbers.collect()}
        assert n[1].num_sample == 169
        after = validation.route(df, numbers, keep_negatives=True).toPandas()
        assert len(after) == len(rows)
        sample = {r.doc_id for r in validation.validation_sample(df).collect()}
        for r in after.itertuples():
            verdict = 1 if r.doc_id < 1000 else 7
            right = r.original_label == verdict
            accepted = right if r.doc_id in sample else (gate is not None and verdict == 1)
            assert r.in_train == int(accepted)
            assert r.label == (verdict if accepted else r.original_label)
            assert list(r.neg_topics) == ([verdict] if r.doc_id in sample and not right else [])
        assert after[after.in_train == 1].shape[0] == sum(r.num_added_to_training for r in n.values())
        plain = validation.route(df, numbers, keep_negatives=False)
        assert plain.where(F.size("neg_topics") > 0).count() == 0


def test_known_negative_trains_and_is_not_tested(spark):
    state = spark.createDataFrame(
        [(1, 0, [5]), (2, 1, []), (3, 0, [])], "doc_id int, in_train int, neg_topics array<int>"
    )
    train, test = rounds.train_test_rows(state, 5)
    assert {r.doc_id for r in train.collect()} == {1, 2}
    assert {r.doc_id for r in test.collect()} == {3}
    assert [tuple(r) for r in rounds.known_negatives(state).collect()] == [(1, 5)]


def test_self_training_takes_every_verdict(spark):
    df = spark.createDataFrame(
        [(1, 3, 1, 2, 2, 0, [], [5], 5), (2, 3, 2, 2, 2, 0, [], [], None)],
        CLASSIFIED.removesuffix(", draw bigint"),
    )
    rows = {r.doc_id: (r.label, r.original_label, r.in_train) for r in rounds.self_trained(df).collect()}
    assert rows == {1: (5, 2, 1), 2: (2, 2, 0)}


@pytest.fixture(scope="module")
def counts(spark):
    noisy = [(d, 100 if d % 7 == 0 else l, t, s) for d, l, t, s in corpus_rows()]
    docs = with_words(spark.createDataFrame(noisy, "doc_id bigint, label int, text string, sim int"))
    vocabulary = fit_vocabulary(docs)
    return materialise(count_vectors(docs, vocabulary).drop("words")), vocabulary


def states(results):
    return [
        {(r.doc_id, r.label, r.in_train, tuple(r.neg_topics)) for r in x.state.collect()} for x in results
    ]


@pytest.mark.parametrize("variant", ["v0", "v1", "v2", "v4"])
def test_workflow_invariants(counts, variant):
    rows, vocabulary = counts
    config = rounds.WorkflowConfig(variant, rounds=2, spec=EnsembleSpec(outer=2, inner=1))
    results = rounds.run(rows, vocabulary, config)
    size = rows.count()
    trained = 0
    for r in results:
        assert r.state.count() == size == r.state.select("doc_id").distinct().count()
        now = r.state.where("in_train = 1").count()
        added = r.numbers.agg(F.sum("num_added_to_training")).first()[0] or 0
        before = trained or rows.where("sim <> 3").count()
        tied = r.coded.where(F.size("full_topics") > 1).count() if variant == "v4" else 0
        assert now == before + added + tied
        trained = now
    history = rounds.label_history(results)
    assert history.where("in_train = 0 AND label <> original_label").count() == 0
    if variant == "v1":
        assert results[-1].state.where(F.size("neg_topics") > 0).count() == 0
    final = rounds.final_verdicts(results[-1].state, 3)
    assert final.where("verdict IS NOT NULL").count() == trained - rows.where("sim <> 3").count()


def test_the_number_of_buckets_does_not_matter(spark, counts):
    rows, vocabulary = counts
    spec = EnsembleSpec(outer=2, inner=1)
    one = rounds.run(rows, vocabulary, rounds.WorkflowConfig("v3", rounds=2, spec=spec, buckets=1))
    more = rounds.run(rows, vocabulary, rounds.WorkflowConfig("v3", rounds=2, spec=spec, buckets=5))
    assert states(one) == states(more)


def test_buckets_follow_the_size(spark, counts):
    rows, _ = counts
    entries = sum(len(r.raw_features.indices) for r in rows.collect())
    assert rounds.bucket_number(rows) == spark.sparkContext.defaultParallelism
    assert rounds.bucket_number(rows, 60) == -(-entries * rounds.ENTRY_BYTES // 60)


def test_bucketed_tables_join_in_place(spark, counts):
    from topicvote.session import materialise_bucketed

    rows, _ = counts
    left = materialise_bucketed(rows, "left", "doc_id", 4)
    right = materialise_bucketed(rows.select("doc_id", "sim"), "right", "doc_id", 4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = left.join(right, "doc_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "Exchange" not in plan and "SortMergeJoin" in plan
