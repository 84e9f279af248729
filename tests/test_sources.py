import json

from pyspark.sql import functions as F

from topicvote.operators import audit
from topicvote.operators.corpus import build_corpus, fold_sizes, holdout, with_folds
from topicvote.session import new_path
from topicvote.sources.responses import flatten_response
from topicvote.sources.tables import (
    START_CORPUS,
    read_csv,
    read_logs,
    read_votes,
    replace_votes,
    write_csv,
    write_votes,
)


def test_csv_round_trip(spark):
    text = 'line one\nsaid "so"; twice, \\ and ;'
    df = spark.createDataFrame([(1, 5, "20240101", text, 2), (2, 6, "20240102", "", 3)], START_CORPUS)
    path = new_path(spark, "corpus.csv")
    write_csv(df, path, sep=";")
    back = read_csv(spark, path, START_CORPUS, line_breaks=True)
    assert sorted(map(tuple, back.collect()))[0] == (1, 5, "20240101", text, 2)
    small = new_path(spark, "small.csv")
    write_csv(df, small, drop=("text",))
    assert spark.read.csv(small, header=True).columns == ["doc_id", "majortopic", "date", "sim"]


def test_vote_table_layout(spark):
    rows = [(d, t, i, j, d % 2) for d in range(10) for t in (1, 5) for i in (1, 2) for j in (1, 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, topic int, i int, j int, vote int")
    path = new_path(spark, "votes")
    write_votes(df, path)
    back = read_votes(spark, path)
    assert {tuple(r) for r in back.select(*df.columns).collect()} == set(rows)
    plan = back.where("topic = 5")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(topic" in plan


def test_logs_and_errors(spark, tmp_path):
    lines = [
        "header, with comma",
        "URL 1 added;",
        "ERROR : HTTP error 429 ;",
        "ERROR : subscript out of bounds ;",
        "ERROR : replacement has length zero ;",
        "ERROR : HTTP error 429 ;",
    ]
    (tmp_path / "a_log.txt").write_text("\n".join(lines))
    (tmp_path / "b_log.txt").write_text("first line\nERROR : undefined columns selected, sorry ;\n")
    logs = read_logs(spark, str(tmp_path / "*_log.txt"))
    assert logs.count() == 6
    errors = audit.error_lines(logs)
    assert errors.count() == 4
    assert errors.agg(F.sum("http_error"), F.sum("length_zero"), F.sum("undefined_columns")).first() == (2, 1, 1)
    counts = {r.api_logs: r.n_errortype for r in audit.error_counts(errors).collect()}
    assert counts["ERROR : HTTP error 429 ;"] == 2


def test_flatten_response(spark):
    doc = {
        "web_url": "u", "lead_paragraph": "l", "headline": {"main": "m"},
        "keywords": [{"name": "subject", "value": "Water"}, {"name": "x", "value": "y"}],
        "byline": {"original": "By A"}, "word_count": 12,
    }
    full = json.dumps({"response": {"docs": [doc, {"web_url": "other"}], "meta": {"hits": 2}}})
    bare = json.dumps({"response": {"docs": [{"web_url": "v", "keywords": [], "byline": None}], "meta": {}}})
    none = json.dumps({"response": {"docs": [], "meta": {"hits": 0}}})
    df = spark.createDataFrame([(1, full), (2, bare), (3, none), (4, "not json")], "id int, json string")
    rows = {r.id: r for r in flatten_response(df).collect()}
    assert (rows[1].url_api, rows[1].keywords, rows[1].byline, rows[1].word_count) == ("u", "Water", "By A", 12)
    assert rows[1].headline_main == "m" and rows[1].headline_print is None and rows[1].api_hits == 2
    assert rows[2].url_api == "v" and rows[2].keywords is None and rows[2].byline is None
    assert rows[3].url_api is None and rows[3].api_hits == 0
    assert rows[4].url_api is None


def test_build_corpus(spark):
    articles = spark.createDataFrame(
        [("1", "d", "T", "u", "lead", None), ("2", "d", None, "u", "l", "h"), ("3", "d", "T", None, "l", "h"),
         ("4", "d", "T", "u", "l", "h")],
        "id string, date string, title string, url_api string, lead_paragraph string, headline_print string",
    )
    types = spark.createDataFrame([(str(i), "article") for i in (1, 2, 3)] + [("4", "caption")],
                                  "id string, text_type string")
    topics = spark.createDataFrame([(str(i), 5) for i in range(1, 5)], "id string, majortopic int")
    rows = with_folds(build_corpus(articles, types, topics)).collect()
    assert [(r.doc_id, r.text) for r in rows] == [("1", "T lead ")]
    assert rows[0].sim in (1, 2, 3)


def test_folds(spark):
    df = spark.range(30).select(F.col("id").alias("doc_id"), F.lit(1).alias("label"),
                                (F.col("id") % 3 + 1).cast("int").alias("sim"))
    assert {(r.fold, r.n_train, r.n_test) for r in fold_sizes(df).collect()} == {(f, 20, 10) for f in (1, 2, 3)}
    train, test = holdout(df, 2)
    assert train.count() == 20 and test.count() == 10


def test_repair(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, None)], "id int, url string")
    fixes = spark.createDataFrame([(2, "b", "x"), (1, "never", "x")], "id int, url string, note string")
    got = {r.id: (r.url, r.note) for r in audit.repair(rows, fixes, "id", "url").collect()}
    assert got == {1: ("a", None), 2: ("b", "x"), 3: (None, None)}


def test_row_numbers(spark):
    df = spark.range(0, 1000, 7).select(F.col("id").alias("k")).orderBy(F.rand(1))
    numbers = {r.k: r.row_nr for r in audit.numbered_rows(df, "k").collect()}
    assert numbers == {k: n + 1 for n, k in enumerate(range(0, 1000, 7))}
    assert sorted(r.k for r in audit.row_range(df, "k", 3, 4).collect()) == [14, 21]


def test_null_counts(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, "x")], "a int, b string")
    assert {r["column"]: r.n_null for r in audit.null_counts(df).collect()} == {"a": 1, "b": 2}


def test_votes_of_a_replicate_are_replaced(spark):
    """One replicate is rewritten, one emptied, others stay; doing it again changes nothing."""
    schema = "doc_id bigint, topic int, i int, j int, vote int"
    rows = [(d, t, i, j, 0) for d in range(6) for t in (1, 5) for i in (1, 2) for j in (1, 2)]
    path = new_path(spark, "votes")
    write_votes(spark.createDataFrame(rows, schema), path)
    new = [(d, 1, 2, 1, 1) for d in range(3)]
    stray = [(9, 5, 2, 2, 1)]
    replicates = spark.createDataFrame([(1, 2, 1), (5, 1, 1)], "topic int, i int, j int")
    expected = {r for r in rows if r[1:4] not in ((1, 2, 1), (5, 1, 1))} | set(new)
    for _ in range(2):
        replace_votes(spark.createDataFrame(new + stray, schema), path, replicates)
        got = [(r.doc_id, r.topic, r.i, r.j, r.vote) for r in read_votes(spark, path).collect()]
        assert sorted(got) == sorted(expected)
    again = [(7, 5, 1, 1, 1)]
    replace_votes(spark.createDataFrame(again, schema), path, replicates.where("topic = 5"))
    assert read_votes(spark, path).where("topic = 5 AND i = 1 AND j = 1").count() == 1


def test_logs_of_at_most_so_many_lines(spark, tmp_path):
    """Files over and under the bound, one of them split between tasks."""
    for name, n in (("a", 3), ("b", 40), ("c", 0), ("d", 2000)):
        text = "\n".join(["header"] + [f"{name} {k} " + "x" * 60 for k in range(n)])
        (tmp_path / f"{name}_log.txt").write_text(text + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = sorted(r.api_logs.split(" ")[:2] for r in read_logs(spark, str(tmp_path / "*_log.txt"), 1500).collect())
        small = read_logs(spark, str(tmp_path / "*_log.txt"), 3)
        assert sorted(r.api_logs[:3] for r in small.collect()) == [f"{f} {k}" for f in "abd" for k in range(3)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted([f, str(k)] for f, n in (("a", 3), ("b", 40), ("d", 1500)) for k in range(n))
