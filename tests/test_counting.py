from collections import Counter

import pyarrow as pa

from topicvote.functions.text import split_tokens, tokenize
from topicvote.operators import features
from topicvote.operators.features import count_vectors, fit_vocabulary, term_statistics, trimmed_rows, trimmed_terms, with_plain, with_words

TEXTS = [
    "The cat  sat\ton the mat. THE end",
    " \x0b leading\x0cand trailing \r\n",
    "a b \U0001d518 é éé \U0001f600 x\x1cy no break İstanbul ΣΑΣ",
    "",
    "one " * 50 + "two",
    "a",
]


def _docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(99, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_text_is_split_as_tokens_are(spark):
    df = _docs(spark).na.drop().selectExpr("lower(text) AS lowered", "text")
    rows = df.select("lowered", tokenize("text").alias("tokens")).collect()
    lowered = pa.array([r.lowered for r in rows])
    assert split_tokens(lowered).to_pylist() == [r.tokens for r in rows]
    assert split_tokens(lowered.slice(2, 5)).to_pylist() == [r.tokens for r in rows][2:7]
    assert split_tokens(pa.array([None, "ab c"], pa.string())).to_pylist() == [[], ["ab"]]


def test_statistics_of_text_and_of_tokens(spark, monkeypatch):
    words = with_words(_docs(spark))
    df, tc = Counter(), Counter()
    for r in words.collect():
        df.update(set(r.words))
        tc.update(r.words)
    for tokens in (features.PIECE_TOKENS, 4):
        monkeypatch.setattr(features, "PIECE_TOKENS", tokens)
        for docs in (words, with_plain(_docs(spark))):
            rows = term_statistics(docs).collect()
            assert {r.term: (r.df, r.tc) for r in rows} == {t: (df[t], tc[t]) for t in df} and len(rows) == len(df)


def test_vectors_are_the_count_models(spark):
    words, plain = with_words(_docs(spark)), with_plain(_docs(spark))
    vocabulary = fit_vocabulary(words, min_df=1, size=8)
    assert len(vocabulary) == 8
    wanted = {r.doc_id: r.raw_features for r in vocabulary.model.transform(words).collect()}
    for docs in (words, plain):
        got = {r.doc_id: r.raw_features for r in count_vectors(docs, vocabulary).collect()}
        assert got == wanted


def test_tokens_are_not_counted_one_by_one(spark):
    """The statistics' plan makes no row for a token, which took most of the time of the vote queries (F13 to F22)."""
    plan = term_statistics(with_plain(_docs(spark)))._jdf.queryExecution().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_trimmed_rows_by_blocks(spark, monkeypatch):
    words = with_words(_docs(spark))
    terms = trimmed_terms(words, 2, 1.0)
    names, rows = trimmed_rows(words, terms)
    monkeypatch.setattr(features, "BLOCK_TERMS", 3)
    again, blocked = trimmed_rows(words, trimmed_terms(words, 2, 1.0))
    assert again == names and len(names) > 3
    assert sorted(map(tuple, blocked.collect())) == sorted(map(tuple, rows.collect()))
    tokens = {r.doc_id: Counter(r.words) for r in words.collect()}
    for r in rows.collect():
        assert r.term_ids == sorted(r.term_ids)
        counts = {names[i]: n for i, n in zip(r.term_ids, r.tfs, strict=True)}
        assert counts == {t: n for t, n in tokens[r.doc_id].items() if t in names}
