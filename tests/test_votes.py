import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC, NaiveBayes
from pyspark.sql import functions as F

from topicvote.functions.hashing import draw
from topicvote.functions.labels import binary_label
from topicvote.operators import features, flags, hinge, linear_svm, naive_bayes, scoring, votes
from topicvote.operators.features import (
    count_vectors,
    fit_vocabulary,
    tfidf_terms,
    tfidf_vectors,
    vocabulary_terms,
    with_arrays,
    with_words,
)
from topicvote.operators.flags import Flag, flag_vectors, flagged_sums
from topicvote.operators.rounds import start_state
from topicvote.operators.sampling import EnsembleSpec, negatives_flag, sampling_thresholds
from topicvote.operators.scoring import (
    LinearEnsemble,
    ensemble_verdicts,
    score_tallies,
    strictness_verdicts,
    tally_rows,
    vote_table,
)
from topicvote.session import materialise

WORDS = {1: "tax budget growth bank", 5: "union strike wage worker", 100: "film music song dance"}


def corpus_rows(n=240):
    rng = np.random.default_rng(5)
    shared = "the of and to in".split()
    rows = []
    for d in range(n):
        topic = 1 if d % 3 else (5 if d % 15 == 0 else 100)
        own = WORDS[topic].split()
        text = " ".join(rng.choice(own + shared, size=12))
        rows.append((d, topic, text, d // 3 % 3 + 1))
    rows.append((n, 1, "a b", 3))
    return rows


@pytest.fixture(scope="module")
def prepared(spark):
    docs = with_words(
        spark.createDataFrame(corpus_rows(), "doc_id bigint, label int, text string, sim int")
    )
    vocabulary = fit_vocabulary(docs)
    counts = materialise(count_vectors(docs, vocabulary))
    return docs, vocabulary, start_state(with_arrays(counts), fold=3)


def test_vocabulary_and_tfidf(spark):
    docs = spark.createDataFrame(
        [(1, ["aa", "aa", "bb"]), (2, ["aa"]), (3, ["bb", "cc"]), (4, [])],
        "doc_id int, words array<string>",
    )
    assert {tuple(r) for r in vocabulary_terms(docs, min_df=2).collect()} == {("aa", 2, 3), ("bb", 2, 2)}
    assert {r.term for r in vocabulary_terms(docs, min_df=1, size=2).collect()} == {"aa", "bb"}
    assert {r.term for r in vocabulary_terms(docs, min_df=1, max_df=1).collect()} == {"cc"}
    rows = {(r.doc_id, r.term): r for r in tfidf_terms(docs, fit_vocabulary(docs, min_df=2)).collect()}
    assert rows[1, "aa"].tf == 2
    assert rows[1, "aa"].tfidf == pytest.approx(2 * np.log(5 / 3))
    assert (4, "aa") not in rows


@pytest.mark.parametrize("size", [1, 3, 10, 25, 40])
def test_vocabulary_cut_matches_a_full_sort(spark, size):
    counts = {f"t{n:02d}": n // 3 + 1 for n in range(30)}
    words = [t for t, c in counts.items() for _ in range(c)]
    docs = spark.createDataFrame([(1, words)], "doc_id int, words array<string>")
    expected = sorted(counts, key=lambda t: (-counts[t], t))[:size]
    assert {r.term for r in vocabulary_terms(docs, min_df=1, size=size).collect()} == set(expected)


@pytest.mark.parametrize("size", [1, 7, 150, 151, 399, 400, 1000])
def test_vocabulary_cut_with_many_ties(spark, monkeypatch, size):
    """Counts from 1 to very large ones, narrowed down in few ranges; most terms have the same count."""
    monkeypatch.setattr(features, "RANGES", 3)
    counts = {f"t{n:03d}": 7 if n % 8 else n * n + 1 for n in range(400)}
    stats = spark.createDataFrame([(t, c, c) for t, c in counts.items()], "term string, df bigint, tc bigint")
    monkeypatch.setattr(features, "term_statistics", lambda docs, words: stats.repartition(5))
    expected = sorted(counts, key=lambda t: (-counts[t], t))[:size]
    cut = vocabulary_terms(stats, min_df=1, size=size)
    assert sorted(r.term for r in cut.collect()) == sorted(expected)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "TakeOrdered" not in plan


def test_trimmed_counts_in_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    docs = [(d, [f"w{int(x)}" for x in rng.geometric(0.12, 25)]) for d in range(80)] + [(80, []), (81, ["w1", "w1"])]
    frame = spark.createDataFrame(docs, "doc_id bigint, words array<string>")
    df = {w: sum(w in words for _, words in docs) for w in {w for _, words in docs for w in words}}
    kept = {w for w, n in df.items() if 5 <= n <= 0.8 * len(docs)}
    expected = {(d, w, words.count(w)) for d, words in docs for w in set(words) & kept}
    for block in (1 << 19, 4):
        monkeypatch.setattr(features, "BLOCK_TERMS", block)
        counts = features.trimmed_counts(materialise(frame, "words"), min_df=5, max_share=0.8)
        assert {tuple(r) for r in counts.collect()} == expected
        assert "Exchange hashpartitioning" not in counts._jdf.queryExecution().executedPlan().toString()
    assert features.trimmed_counts(frame, min_df=500, max_share=0.8).collect() == []


def test_null_rows_are_dropped(spark):
    df = spark.createDataFrame([(1, None), (2, "some text")], "doc_id int, text string")
    assert [r.doc_id for r in with_words(df).collect()] == [2]


def test_ensemble_agrees_with_the_library_model(spark, prepared):
    _, vocabulary, rows = prepared
    spec = EnsembleSpec(topics=[1], outer=1, inner=1)
    ensemble = naive_bayes.fit_ensemble(rows, vocabulary, spec)
    mine = {r.doc_id: r.vote for r in vote_table(rows.where("in_train = 0"), ensemble).collect()}
    vectors = tfidf_vectors(rows, vocabulary).withColumn("y", binary_label("label", 1))
    model = NaiveBayes(labelCol="y", smoothing=0.1).fit(vectors.where("in_train = 1"))
    theirs = {
        r.doc_id: int(r.prediction) for r in model.transform(vectors.where("in_train = 0")).collect()
    }
    assert mine == theirs


def test_document_without_terms_gets_the_prior(prepared):
    _, vocabulary, rows = prepared
    ensemble = naive_bayes.fit_ensemble(rows, vocabulary, EnsembleSpec(topics=[1, 5], outer=1, inner=1))
    got = {r.topic: r.vote for r in vote_table(rows.where("doc_id = 240"), ensemble).collect()}
    assert got == {1: 1, 5: 0}


def test_narrow_and_long_verdicts_agree(prepared):
    _, vocabulary, rows = prepared
    spec = EnsembleSpec(outer=2, inner=2)
    ensemble = naive_bayes.fit_ensemble(rows, vocabulary, spec)
    test = rows.where("in_train = 0")
    tally = votes.vote_tally(vote_table(test, ensemble))
    long = {r.doc_id: r.verdict for r in votes.unanimous_verdicts(tally, 4).collect()}
    narrow = ensemble_verdicts(test, ensemble)
    assert {r.doc_id: r.verdict for r in narrow.where("verdict IS NOT NULL").collect()} == long
    assert long


def test_tallies_and_strictness_match_the_long_table(prepared):
    _, vocabulary, rows = prepared
    spec = EnsembleSpec(outer=2, inner=2)
    ensemble = naive_bayes.fit_ensemble(rows, vocabulary, spec)
    table = vote_table(rows, ensemble)
    long = {(r.doc_id, r.topic): r.tally for r in votes.vote_tally(table).collect()}
    tallies = score_tallies(rows, ensemble).select("doc_id", F.inline(tally_rows(spec.topics)))
    assert {(r.doc_id, r.topic): r.tally for r in tallies.collect()} == long
    swept = {tuple(r) for r in strictness_verdicts(rows, ensemble).collect()}
    assert swept == {tuple(r) for r in votes.strictness_verdicts(table, 2).collect()}
    assert swept


def test_one_python_step_and_no_shuffle(prepared):
    _, vocabulary, rows = prepared
    ensemble = naive_bayes.fit_ensemble(rows, vocabulary, EnsembleSpec(outer=2, inner=2))
    plan = strictness_verdicts(rows, ensemble)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert "Exchange" not in plan


def test_sums_of_few_buffered_entries(prepared, monkeypatch):
    """Flushing early, in small chunks and reading block by block changes nothing."""
    _, vocabulary, rows = prepared
    wanted = [Flag(1), Flag(1, True), *[Flag(1, True, (7, k), 1 << 29) for k in range(40)]]
    whole = list(flag_vectors(flagged_sums(rows, wanted), len(vocabulary)))
    monkeypatch.setattr(flags, "CHUNK_ENTRIES", 50)
    monkeypatch.setattr(flags, "BUFFERED_ENTRIES", 300)
    parts = list(flag_vectors(flagged_sums(rows, wanted), len(vocabulary), read_bytes=1))
    assert [flag for flag, *_ in parts] == wanted
    for (_, a, n), (_, b, m) in zip(whole, parts, strict=True):
        assert n == m > 0
        assert a.tolist() == b.tolist()


def test_missing_votes(spark):
    spec = EnsembleSpec(topics=[1, 5], outer=1, inner=1)
    ensemble = LinearEnsemble(spec, np.zeros((1, 2)), np.array([np.inf, np.inf]), np.array([0, 1]))
    df = spark.createDataFrame(
        [(1, [5], [0], [1]), (2, [], [0], [1]), (3, [1, 5], [0], [1])],
        "doc_id int, neg_topics array<int>, term_ids array<int>, tfs array<int>",
    )
    abstain = {r.doc_id: r.verdict for r in ensemble_verdicts(df, ensemble, "abstain").collect()}
    exclude = {r.doc_id: r.verdict for r in ensemble_verdicts(df, ensemble, "exclude").collect()}
    assert abstain == {1: 1, 2: None, 3: None}
    assert exclude == {1: None, 2: None, 3: None}
    with pytest.raises(ValueError):
        ensemble_verdicts(df, ensemble, "other")


def test_verdict_rules(spark):
    rows = [(9, 1, 9), (9, 5, 8), (49, 1, 8), (49, 5, 8), (3, 1, 9), (3, 5, 9)]
    tally = spark.createDataFrame(rows, "doc_id int, topic int, tally bigint")
    full = {r.doc_id: (r.max_tally, r.n_full, r.verdict) for r in votes.full_votes(tally, 9).collect()}
    assert full == {9: (9, 1, 1), 49: (8, 0, None), 3: (9, 2, None)}
    assert [tuple(r) for r in votes.tied_documents(tally, 9).collect()] == [(3, 2)]


def test_strictness(spark):
    rows = []
    for i in (1, 2):
        for j in (1, 2):
            rows.append((1, 5, i, j, 1))
            rows.append((1, 7, i, j, int(i == j == 1)))
    table = spark.createDataFrame(rows, "doc_id int, topic int, i int, j int, vote int")
    assert {(r.g, r.verdict) for r in votes.strictness_verdicts(table, 2).collect()} == {(2, 5)}


def test_wide_votes(spark):
    table = spark.createDataFrame(
        [(1, 5, 1, 1, 1), (1, 7, 1, 1, 0)], "doc_id int, topic int, i int, j int, vote int"
    )
    row = votes.wide_votes(table, [5, 7]).first()
    assert (row.prediction_5, row.prediction_7) == (5, 0)


def test_svm_ensemble(prepared):
    _, vocabulary, rows = prepared
    ensemble = linear_svm.fit_ensemble(rows, vocabulary, EnsembleSpec(topics=[1, 5, 7], outer=1, inner=1))
    table = vote_table(rows.where("in_train = 0 AND size(term_ids) > 0"), ensemble)
    hits = table.join(rows.select("doc_id", "label"), "doc_id").where(F.col("topic") == 1)
    right = hits.where((F.col("label") == 1).cast("int") == F.col("vote")).count()
    assert right / hits.count() > 0.9
    assert table.where("topic = 7 AND vote = 1").count() == 0


def test_multiclass_naive_bayes(prepared):
    _, vocabulary, rows = prepared
    coded = naive_bayes.multiclass_verdicts(tfidf_vectors(rows, vocabulary), 3)
    assert {r.verdict for r in coded.collect()} <= {1, 5, 100}
    assert coded.where("label = verdict").count() / coded.count() > 0.9


def test_a_tile_of_models_at_a_time_gives_the_same_tallies(prepared):
    _, vocabulary, rows = prepared
    ensemble = naive_bayes.fit_ensemble(rows, vocabulary, EnsembleSpec(outer=2, inner=2))
    small = 8 * len(vocabulary) * 3
    assert scoring.tile_models(len(vocabulary), small) == 3 < ensemble.weights.shape[1]
    assert scoring.tile_models(262_144) * 262_144 * 8 <= scoring.TILE_BYTES
    whole, tiled = (
        {r.doc_id: r.tallies for r in score_tallies(rows, ensemble, tile_bytes=b).collect()}
        for b in (scoring.TILE_BYTES, small)
    )
    assert whole == tiled


def test_folds_of_one_pass(prepared):
    """All folds fitted and scored together equal folds of their own."""
    _, vocabulary, rows = prepared
    spec = EnsembleSpec(outer=2, inner=2)
    every = start_state(rows.drop("row_hash", "original_label", "in_train", "neg_topics"), 0)
    together = naive_bayes.fit_folds(every, vocabulary, spec)
    coded = {r.doc_id: r.verdict for r in ensemble_verdicts(every, together, keep=["doc_id", "sim"]).collect()}
    for fold in (1, 2, 3):
        state = start_state(every.drop("row_hash", "original_label", "in_train", "neg_topics"), fold)
        alone = naive_bayes.fit_ensemble(state, vocabulary, spec)
        assert np.array_equal(alone.weights, together[fold].weights)
        assert np.array_equal(alone.intercepts, together[fold].intercepts)
        test = ensemble_verdicts(state.where("in_train = 0"), alone)
        assert {r.doc_id: r.verdict for r in test.collect()}.items() <= coded.items()
    assert any(coded.values())


def test_sums_of_what_has_changed(prepared):
    """Models from the sums of the round before and the changes equal those of a full pass."""
    _, vocabulary, rows = prepared
    spec = EnsembleSpec(outer=2, inner=2)
    before = naive_bayes.fit_ensemble(rows, vocabulary, spec).sums
    moved = F.col("doc_id") % 7 == 3
    changed = rows.select(
        *[c for c in rows.columns if c not in ("label", "in_train", "neg_topics")],
        *[F.col(c).alias(flags.BEFORE + c) for c in ("label", "in_train", "neg_topics")],
        F.when(F.col("doc_id") % 20 == 1, 5).otherwise(F.col("label")).alias("label"),
        F.when(moved, 1 - F.col("in_train")).otherwise(F.col("in_train")).alias("in_train"),
        F.when(F.col("doc_id") % 11 == 2, F.array(F.lit(1))).otherwise(F.col("neg_topics")).alias("neg_topics"),
    )
    full = naive_bayes.fit_ensemble(changed, vocabulary, spec)
    step = naive_bayes.fit_ensemble(changed, vocabulary, spec, before=before)
    assert np.array_equal(full.intercepts[full.model_of], step.intercepts[step.model_of])
    assert np.array_equal(full.weights[:, full.model_of], step.weights[:, step.model_of])
    assert 0 < step.sums.touched < full.sums.touched
    same = changed.drop("label", "in_train", "neg_topics").withColumnsRenamed(
        {flags.BEFORE + c: c for c in ("label", "in_train", "neg_topics")}
    )
    same = same.withColumns({flags.BEFORE + c: F.col(c) for c in ("label", "in_train", "neg_topics")})
    assert naive_bayes.fit_ensemble(same, vocabulary, spec, before=before).sums.touched == 0


def _objective(vectors, weight, intercept, penalty=0.1):
    """Mean hinge loss of standardised features and the penalty, as the library states it."""
    rows = [(r.features.toArray(), 2 * r.y - 1) for r in vectors.collect()]
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    scaled = weight * x.std(axis=0, ddof=1)
    return np.maximum(0, 1 - y * (x @ weight + intercept)).mean() + penalty / 2 * (scaled @ scaled)


def test_machines_fitted_together_against_the_library(prepared):
    """No worse an objective than the library's own learner after as many steps."""
    _, vocabulary, rows = prepared
    spec = EnsembleSpec(topics=[1, 5, 100], outer=2, inner=1)
    rows = rows.cache()
    for steps, worse in ((20, 2e-3), (60, 1e-4)):
        ensemble = linear_svm.fit_ensemble(rows, vocabulary, spec, max_iter=steps)
        for n, topic in enumerate((1, 5, 100)):
            flag = negatives_flag(sampling_thresholds(rows, spec), spec, topic, 1, 1)
            chosen = F.col("label") == topic
            if flag.threshold is not None:
                chosen = chosen | (draw("row_hash", *flag.key) < flag.threshold)
            train = tfidf_vectors(rows.where("in_train = 1").where(chosen | F.lit(flag.threshold is None)), vocabulary)
            train = train.withColumn("y", binary_label("label", topic)).cache()
            model = LinearSVC(labelCol="y", maxIter=steps, regParam=0.1).fit(train)
            at = ensemble.model_of[2 * n]
            mine = ensemble.weights[:, at] / np.where(vocabulary.idf > 0, vocabulary.idf, 1)
            theirs = model.coefficients.toArray()
            here = _objective(train, mine, ensemble.intercepts[at])
            assert here <= _objective(train, theirs, model.intercept) + worse


def test_machines_in_tiles_and_summed_on_executors(prepared, monkeypatch):
    _, vocabulary, rows = prepared
    spec = EnsembleSpec(topics=[1, 5, 100], outer=2, inner=2)
    whole = linear_svm.fit_ensemble(rows, vocabulary, spec, max_iter=6)
    monkeypatch.setattr(hinge, "DIRECT_BYTES", 0)
    monkeypatch.setattr(hinge, "CHUNK_TERMS", 5)
    machines = [hinge.Machine(Flag(1), Flag(1, True)), hinge.Machine(Flag(5), Flag(100))]
    vectors = linear_svm.training_vectors(rows)
    one = dict((k, (w, b)) for k, w, b in hinge.fit(vectors, machines, len(vocabulary), vocabulary.idf > 0, 6, state_bytes=1))
    at = whole.model_of[0]
    assert np.allclose(one[0][0], whole.weights[:, at]) and np.isclose(one[0][1], whole.intercepts[at])
    assert sorted(one) == [0, 1]


def test_pairwise_votes_and_ties(prepared, monkeypatch):
    _, vocabulary, rows = prepared
    rows = rows.where("size(term_ids) > 0")
    coded = linear_svm.pairwise_verdicts(rows, vocabulary, [1, 5, 100]).collect()
    assert sum(r.label == r.verdict for r in coded) / len(coded) > 0.9
    assert {r.verdict for r in linear_svm.pairwise_verdicts(rows, vocabulary, [5]).collect()} == {5}
    every = start_state(rows.drop("row_hash", "original_label", "in_train", "neg_topics"), 0)
    together = linear_svm.pairwise_verdicts(every, vocabulary, [1, 5, 100], ["doc_id", "sim"], (1, 2, 3)).collect()
    assert {r.doc_id: r.verdict for r in coded}.items() <= {r.doc_id: r.verdict for r in together}.items()
    assert len(together) == every.count()
    # 1 beats 5, 5 beats 100, 100 beats 1: the first of equal ones; a margin of 0 is a vote for the second
    margins = {(1, 5): 1.0, (1, 100): -1.0, (5, 100): 1.0}

    def fixed(rows, machines, n_terms, *_):
        for k, m in enumerate(machines):
            yield k, np.zeros(n_terms), margins[m.yes.topic, m.no.topic]

    monkeypatch.setattr(linear_svm, "fit", fixed)
    assert {r.verdict for r in linear_svm.pairwise_verdicts(rows, vocabulary, [1, 5, 100]).collect()} == {1}
    margins[1, 5] = 0.0
    assert {r.verdict for r in linear_svm.pairwise_verdicts(rows, vocabulary, [1, 5, 100]).collect()} == {5}


def test_weights_are_made_by_tasks(prepared, monkeypatch):
    """No vector of the vocabulary's length comes to the driver, and small chunks give the same models."""
    _, vocabulary, rows = prepared
    spec = EnsembleSpec(outer=2, inner=2)
    whole = naive_bayes.fit_ensemble(rows, vocabulary, spec)
    for module in (flags, naive_bayes):
        monkeypatch.setattr(module, "CHUNK_TERMS", 7)
        monkeypatch.setattr(module, "flag_vectors", None, raising=False)
    chunked = naive_bayes.fit_ensemble(rows, vocabulary, spec)
    assert isinstance(chunked.weights, scoring.StoredWeights)
    assert np.allclose(np.asarray(whole.weights), np.asarray(chunked.weights), rtol=1e-12)
    tallies = [{r.doc_id: r.tallies for r in score_tallies(rows, e).collect()} for e in (whole, chunked)]
    assert tallies[0] == tallies[1]


def test_directions_from_inner_products():
    """The driver's recursion over inner products equals the one over the vectors, and no step brings vectors."""
    rng = np.random.default_rng(4)
    g = rng.normal(size=30)
    pairs = {i: (s, s + 0.1 * rng.normal(size=30)) for i, s in enumerate(rng.normal(size=(4, 30)))}
    history = [3, 2, 1, 0]
    out, shares = g.copy(), []
    for i in history:
        s, y = pairs[i]
        shares.append((s @ out) / (s @ y))
        out -= shares[-1] * y
    s, y = pairs[3]
    out *= (s @ y) / (y @ y)
    for i, share in zip(reversed(history), reversed(shares), strict=True):
        s, y = pairs[i]
        out += (share - (y @ out) / (s @ y)) * s
    known = hinge._Products(
        g @ g,
        {i: g @ s for i, (s, _) in pairs.items()},
        {i: g @ y for i, (_, y) in pairs.items()},
        {(i, j): pairs[i][0] @ pairs[j][1] for i in pairs for j in pairs},
        {(i, j): pairs[i][1] @ pairs[j][1] for i in pairs for j in pairs},
    )
    of_gradient, of_step, of_change = hinge._direction(known, history)
    mine = of_gradient * g + sum(of_step[i] * pairs[i][0] + of_change[i] * pairs[i][1] for i in history)
    assert np.allclose(mine, out)


def test_machines_stay_in_the_shared_folder(prepared):
    _, vocabulary, rows = prepared
    ensemble = linear_svm.fit_ensemble(rows, vocabulary, EnsembleSpec(topics=[1, 5], outer=1, inner=1), max_iter=2)
    assert isinstance(ensemble.weights, scoring.StoredWeights)
    assert ensemble.weights.shape == (len(vocabulary), 4) and np.asarray(ensemble.weights)[:, 2:].any()
