import pytest

from topicvote.operators import metrics

CELLS = "sim int, topic int, verdict int, n bigint"


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame(
        [(1, 1, 1, 8), (1, 1, 2, 2), (1, 2, 1, 1), (1, 2, None, 3), (2, 1, 1, 5), (2, 2, None, 4)], CELLS
    )


def test_pr_by_topic(cells):
    rows = {(r.sim, r.topic): r for r in metrics.pr_by_topic(cells, ["sim"]).collect()}
    assert rows[1, 1].precision == pytest.approx(8 / 9) and rows[1, 1].recall == 0.8
    assert rows[1, 2].precision == 0 and rows[1, 2].n_items == 4
    assert rows[2, 2].precision is None and rows[2, 2].recall == 0


def test_totals_and_means(cells):
    total = metrics.pr_total(cells).first()
    assert (total.tp, total.fp, total.n_items) == (13, 3, 23)
    assert total.f1 == pytest.approx(2 * 13 / (16 + 23))
    means = {r.topic: r for r in metrics.fold_mean(metrics.pr_by_topic(cells, ["sim"]), n_folds=2).collect()}
    assert means[1].precision == pytest.approx((8 / 9 + 1) / 2)
    assert means[2].precision is None


def test_published_totals(spark):
    """Published totals of the basic variant: 17230 right and 578 wrong of 28547."""
    df = spark.createDataFrame([(1, 1, 1, 17230), (1, 1, 2, 578), (1, 1, None, 28547 - 17808)], CELLS)
    total = metrics.pr_total(df).first()
    assert total.precision == pytest.approx(0.9675426774483378)
    assert total.recall == pytest.approx(0.6035660489718709)


def test_published_f1(spark):
    df = spark.createDataFrame([(0.8337056985733896, 0.5671904524668023)], "precision double, recall double")
    assert df.select(metrics.f1()).first()[0] == pytest.approx(0.6750799227319643, abs=1e-4)


def test_flags(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, None)], "label int, verdict int")
    rows = [(r.correct, r.classified, r.fp, r.tp) for r in metrics.compare_flags(df).collect()]
    assert rows == [(1, "classified", 0, 1), (0, "classified", 1, 0), (0, "not classified", 0, 0)]


def test_confusion_matrix(cells):
    rows = {r.verdict: r for r in metrics.confusion_matrix(cells, [1, 2]).collect()}
    assert (rows[1].actual_1, rows[1].actual_2) == (13, 1)
    assert (rows[2].actual_1, rows[2].actual_2) == (2, 0)


def test_reshaping_and_wins(spark):
    a = spark.createDataFrame([(1, 0.9, 0.5), (2, 0.4, 0.7)], "topic int, precision double, recall double")
    b = spark.createDataFrame([(1, 0.8, 0.6)], "topic int, precision double, recall double")
    wide = metrics.side_by_side({"svm": a, "nb": b})
    assert metrics.columns_like(wide, suffix="_svm") == ["precision_svm", "recall_svm"]
    win = metrics.model_wins(wide, "svm", "nb").first()
    assert tuple(win) == (1, 0, 1, 1)
    long = metrics.metrics_long(wide)
    assert long.count() == 4
    assert [r.model for r in metrics.highlights(long, 0.85).collect()] == ["svm"]
    means = {r.topic: r for r in metrics.with_column_means(wide, "topic").collect()}
    assert means[None].precision_svm == 0.65
    both = a.selectExpr("*", "'x' AS kind")
    row = metrics.metrics_wide(both, "topic", "kind", ["x"]).where("topic = 1").first()
    assert (row.precision_x, row.recall_x) == (0.9, 0.5)


def test_summary_and_convergence(spark, cells):
    numbers = spark.createDataFrame(
        [("v1", f, r, 1, 10, 6, 4, 5, 1, 9) for f in (1, 2) for r in (1, 2)],
        "variant string, fold int, round int, topic int, num_classified bigint, num_sample bigint, "
        "num_non_sample bigint, num_correct bigint, num_incorrect bigint, num_added_to_training bigint",
    )
    rows = {r.topic: r for r in metrics.variant_summary(cells, numbers).collect()}
    assert rows[1].num_classified == 40 and rows[None].num_classified == 40
    assert rows[None].precision == pytest.approx(rows[None].one / rows[None].total_result)
    assert rows[1].precision == pytest.approx((8 / 9 + 1) / 2)
    mean = metrics.convergence(numbers, n_folds=2).collect()
    assert {(r["round"], r.num_classified) for r in mean} == {(1, 10.0), (2, 10.0)}
    total = sum(r.num_classified for r in mean) * 2
    assert total == rows[None].num_classified
