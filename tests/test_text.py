import pytest
from pyspark.sql import functions as F

from topicvote.constants import STOPWORDS
from topicvote.functions import text as tx
from topicvote.functions.dates import compact_date, parse_mdy, year_month
from topicvote.functions.labels import class_name_to_code, index_to_label, label_index, recode_topic
from topicvote.functions.stemmer import stem, stem_text, stem_tokens
from topicvote.operators.features import trimmed_counts


def value(spark, column, **cells):
    schema = ", ".join(
        f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in cells.items()
    )
    return spark.createDataFrame([tuple(cells.values())], schema).select(column).first()[0]


def test_stopword_list():
    assert len(STOPWORDS) == len(set(STOPWORDS)) + 0
    assert {"i", "very", "shouldn't"} <= set(STOPWORDS)


def test_clean_text(spark):
    raw = "The  3 Senators' plan —\tto cut\n taxes!"
    assert value(spark, tx.clean_text("t", stem=False), t=raw) == " senators plan cut taxes"


def test_clean_text_stems_and_filters_again(spark):
    assert value(spark, tx.clean_text("t"), t="Running taxes hers").strip() == "run tax"


@pytest.mark.parametrize(
    "text, left",
    [("the cat", " cat"), ("thecat", "thecat"), ("über an", "über "), ("the–cat", "–cat"), ("", ""),
     ("i don't know she's", "  know "), ("'tis cat's", "'tis cat's"), ("she'd've", "'ve")],
)
def test_remove_words(spark, text, left):
    assert value(spark, tx.remove_words("t"), t=text) == left


def test_tokenize_drops_short_tokens(spark):
    assert value(spark, tx.tokenize("t"), t="A bc  DEF\n g") == ["bc", "def"]
    assert value(spark, tx.tokenize("t"), t="a b c") == []


def test_assemble_text_takes_null_as_empty(spark):
    df = spark.createDataFrame([("a", None, "c")], "x string, y string, z string")
    assert df.select(tx.assemble_text("x", "y", "z")).first()[0] == "a  c"


def test_query_titles(spark):
    title = "The Fight, for Clean Water"
    assert value(spark, tx.query_title("t"), t=title) == "fight+clean+water"
    assert value(spark, tx.short_query_title("t"), t=title) == "the+fight,+for"


@pytest.mark.parametrize(
    "word, expected",
    [
        ("consign", "consign"), ("consigned", "consign"), ("consisting", "consist"),
        ("consistency", "consist"), ("consolation", "consol"), ("consolatory", "consolatori"),
        ("knackeries", "knackeri"), ("knightly", "knight"), ("knots", "knot"),
        ("skies", "sky"), ("dying", "die"), ("news", "news"), ("proceed", "proceed"),
        ("hopping", "hop"), ("hoping", "hope"), ("happy", "happi"), ("cried", "cri"),
        ("ties", "tie"), ("gas", "gas"), ("gaps", "gap"), ("kiwis", "kiwi"),
        ("generously", "generous"), ("national", "nation"), ("relational", "relat"),
        ("adoption", "adopt"), ("controlling", "control"), ("controll", "control"),
        ("say", "say"), ("by", "by"), ("luxuriated", "luxuri"), ("bed", "bed"),
    ],
)
def test_stem(word, expected):
    assert stem(word) == expected


def test_dates(spark):
    df = spark.createDataFrame([("7/4/1997",), ("x",)], "d string").select(parse_mdy("d").alias("d"))
    rows = df.select(compact_date("d").alias("q"), year_month("d").alias("k")).collect()
    assert rows[0] == ("19970704", "1997_7")
    assert rows[1].q is None


@pytest.mark.parametrize("code, over23, over21", [(22, 22, 100), (23, 23, 100), (24, 100, 100), (105, 100, 100)])
def test_recode(spark, code, over23, over21):
    assert value(spark, recode_topic("c"), c=code) == over23
    assert value(spark, recode_topic("c", above=21), c=code) == over21


def test_label_positions(spark):
    df = spark.createDataFrame([(12,), (1,), (100,), (12,), (None,)], "label int")
    rows = {r["index"]: r["label"] for r in label_index(df, "label").collect()}
    assert rows == {0: 1, 1: 12, 2: 100}
    back = spark.range(3).select(index_to_label(F.col("id").cast("double"), [1, 12, 100]))
    assert [r[0] for r in back.collect()] == [1, 12, 100]


def test_class_names(spark):
    assert value(spark, class_name_to_code("c"), c="Class: 12") == 12


def test_tokens_are_measured_in_utf16_units(spark):
    assert value(spark, tx.tokenize("t"), t="a \U0001f600 é bc") == ["\U0001f600", "bc"]


def test_titles_lose_the_punctuation_of_any_script(spark):
    assert value(spark, tx.query_title("t"), t="“Costs” rise by $5 – taxes") == "costs+rise+$5++taxes"


def test_stemming_keeps_nulls_blanks_and_order(spark):
    rows = [("running  dogs ",), (None,), ("",)]
    df = spark.createDataFrame(rows, "t string").coalesce(1)
    assert [r[0] for r in df.select(stem_text("t")).collect()] == ["run  dog ", None, ""]
    df = spark.createDataFrame([(["running", "dogs"],), (None,), ([],)], "t array<string>").coalesce(1)
    assert [r[0] for r in df.select(stem_tokens("t")).collect()] == [["run", "dog"], None, []]


def test_trimmed_counts_have_no_cap(spark, monkeypatch):
    monkeypatch.setattr("topicvote.operators.features.VOCABULARY_SIZE", 2)
    rows = [(i, ["a", "b", "c", "d", "d", f"x{i}"]) for i in range(6)] + [(9, ["e"])]
    for limit in (1 << 26, 0):
        monkeypatch.setattr("topicvote.operators.features.BROADCAST_BYTES", limit)
        got = trimmed_counts(spark.createDataFrame(rows, "doc_id bigint, words array<string>"), 2, 0.9).collect()
        assert {tuple(r) for r in got} == {(i, t, 1 + (t == "d")) for i in range(6) for t in "abcd"}
