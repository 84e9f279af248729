"""The convergence table has all variants and rounds, and runs that start alike share round 1."""

import pytest

from test_rounds import counts, states  # noqa: F401
from topicvote.constants import VARIANT_NAMES
from topicvote.operators import rounds
from topicvote.operators.sampling import EnsembleSpec
from topicvote.plans import oracles, queries


def test_every_variant_and_round_has_a_row(spark, monkeypatch):
    asked = []

    def runs(session, folder, variants, n_rounds):
        asked.append((list(variants), n_rounds))
        names = "variant string, fold int, round int, topic int, num_classified long, num_added_to_training long, num_sample long"
        numbers = spark.createDataFrame([("v0", 1, 1, 5, 6, 6, 0), ("v2", 3, 5, 7, 3, 1, 2)], names)
        return [(1, [rounds.RoundResult(1, None, None, numbers)])]

    monkeypatch.setattr(queries, "_runs", runs)
    found = {(r.variant, r["round"]): tuple(r)[2:] for r in queries.QUERIES["convergence"](spark, "").collect()}
    assert asked == [(list(VARIANT_NAMES), 5)]
    assert set(found) == {(v, n) for v in VARIANT_NAMES for n in range(1, 6)}
    assert found.pop(("v0", 1)) == (2.0, 2.0, 0.0) and found.pop(("v2", 5)) == (1.0, pytest.approx(1 / 3, abs=1e-6), pytest.approx(2 / 3, abs=1e-6))
    assert set(found.values()) == {(0.0, 0.0, 0.0)}
    sql = oracles.oracle_sql()["convergence"]
    assert all(f"'{v}' AS variant, 5 AS round" in sql for v in VARIANT_NAMES)


def test_runs_share_what_they_start_from(counts, monkeypatch):  # noqa: F811
    rows, vocabulary = counts
    spec = EnsembleSpec(outer=2, inner=1)
    configs = [rounds.WorkflowConfig(v, fold=f, rounds=2, spec=spec) for v in ("v0", "v2") for f in (2, 3)]
    alone = [states(rounds.run(rows, vocabulary, c)) for c in configs]
    written, classified, write, classify = [], [], rounds.materialise_bucketed, rounds.classify
    monkeypatch.setattr(rounds, "materialise_bucketed", lambda df, name, *a: (written.append(name), write(df, name, *a))[1])
    monkeypatch.setattr(rounds, "classify", lambda *a: (classified.append(a[3].fold), classify(*a))[1])
    together = rounds.run_all(rows, vocabulary, configs)
    assert [states(r) for r in together] == alone
    assert written.count("counts") == 1
    assert sorted(classified) == [2] * 3 + [3] * 3  # round 1 of each fold once, round 2 of each run
