import numpy as np
import pytest

from topicvote.operators import scoring, votes
from topicvote.operators.sampling import EnsembleSpec
from topicvote.operators.scoring import LinearEnsemble, vote_table, wide_vote_table


@pytest.mark.parametrize("bits", [62, 4])
def test_wide_votes_are_those_of_the_long_table(spark, monkeypatch, bits):
    """Ids may repeat: of their votes the largest count, as in the long table."""
    monkeypatch.setattr(scoring, "BITS", bits)
    rng = np.random.default_rng(3)
    spec = EnsembleSpec(topics=[5, 7, 100], outer=3, inner=3)
    model_of = np.array([0, *range(2, 10), *[1] * 9, *range(9, 18)])
    ensemble = LinearEnsemble(spec, rng.normal(size=(6, 18)), rng.normal(size=18), model_of)
    rows = [(n % 30, sorted({n % 6, (n * n) % 6, (n // 6) % 6}), n) for n in range(40)]
    rows = [(d, ids, [1 + (n + i) % 3 for i in ids]) for d, ids, n in rows] + [(77, [], [])]
    counted = spark.createDataFrame(rows, "doc_id bigint, term_ids array<int>, tfs array<int>")
    wanted, got = votes.wide_votes(vote_table(counted, ensemble), spec.topics), wide_vote_table(counted, ensemble)
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in wanted.schema]
    assert len({r[3:] for r in got.collect()}) > 3
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


def test_no_row_for_a_vote_is_grouped(spark):
    """The exchange of the wide table has a row for each document (F16)."""
    spec = EnsembleSpec(topics=[5, 7], outer=7, inner=7)
    ensemble = LinearEnsemble(spec, np.zeros((2, 98)), np.ones(98), np.arange(98))
    counted = spark.createDataFrame([(1, [0], [1])], "doc_id bigint, term_ids array<int>, tfs array<int>")
    plan = wide_vote_table(counted, ensemble)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")  # the exploding comes after the exchange
    assert wide_vote_table(counted, ensemble).where("prediction_5 = 5 AND prediction_7 = 7").count() == 49
