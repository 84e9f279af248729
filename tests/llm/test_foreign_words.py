"""Texts that only the histogram of common words can reject."""

import random

from topicvote.llm import quality_rules


def language(draw, letters):
    """A maker of texts: 30 words make 40 % of them, 3,000 rare ones the rest."""
    word = lambda n: "".join(draw.choice(letters) for _ in range(n))
    common, rare = [word(3) for _ in range(30)], [word(6) for _ in range(3000)]
    return lambda n: " ".join(draw.choice(common if draw.random() < 0.4 else rare) for _ in range(n))


def test_foreign_and_random_words_fail(spark):
    draw = random.Random(21)
    first, second = language(draw, "abcdefghijklm"), language(draw, "nopqrstuvwxyz")
    texts = [(first(400), "aa") for _ in range(80)] + [(second(400), "bb") for _ in range(80)]
    wrong = [(second(400), "aa"), (first(400), "bb")]
    wrong.append((" ".join("".join(draw.choice("abcdefghijklm") for _ in range(6)) for _ in range(400)), "aa"))
    rows = [(i, *x) for i, x in enumerate(texts + wrong)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in quality_rules.verdicts(df, quality_rules.references(df)).collect()}
    assert all(got[i]["kept"] for i in range(160))
    for i in range(160, 163):
        r = got[i]
        assert not r["base_failed"] and r["char_distance"] <= quality_rules.MAX_CHAR_DISTANCE
        assert r["word_distance"] <= quality_rules.MAX_WORD_DISTANCE and not r["kept"]


def test_short_expectation_is_not_judged():
    rare = quality_rules.Reference(quality_rules.char_classes(b"abc " * 400), {b"the": 0}, quality_rules.np.array([5.0, 95.0]))
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150))
    assert quality_rules.judge(text, rare)[6]
