"""The registered queries: each reads the tables of a folder and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicvote.constants import TOPICS, VARIANT_NAMES
from topicvote.functions import text as tx
from topicvote.functions.dates import compact_date, parse_mdy, year_month
from topicvote.functions.hashing import split_by_share, split_number
from topicvote.functions.labels import class_name_to_code, label_index, recode_topic, with_category
from topicvote.functions.stemmer import stem_word
from topicvote.operators import audit, baselines, linear_svm, metrics, naive_bayes, rounds, validation
from topicvote.operators import corpus as start
from topicvote.operators.features import (
    count_vectors,
    entries,
    tfidf_terms,
    tfidf_vectors,
    trimmed_counts,
    trimmed_rows,
    trimmed_terms,
    vocabulary_terms,
    with_arrays,
)
from topicvote.operators.features import fit_vocabulary as fit_terms
from topicvote.operators.sampling import (
    EnsembleSpec,
    negative_draws,
    sample_number_log,
    training_class_counts,
)
from topicvote.operators.scoring import (
    ensemble_verdicts,
    full_topics,
    only_topic,
    score_tallies,
    strictness_verdicts,
    tally_rows,
    vote_table,
    wide_vote_table,
)
from topicvote.plans.inputs import (
    FOLD,
    corpus,
    counted,
    raw_corpus,
    raw_topic,
    tokenised,
    training_rows,
)
from topicvote.session import materialise, new_path
from topicvote.sources.responses import flatten_response
from topicvote.sources.tables import (
    START_CORPUS,
    read_csv,
    read_logs,
    read_table,
    read_votes,
    spread,
    write_csv,
    write_votes,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SPEC = EnsembleSpec(outer=7, inner=7)
GRID = EnsembleSpec(outer=10, inner=10)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def six(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def _union(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# --- corpus ---------------------------------------------------------------------------------


@query
def topic_recode_counts(spark, folder):
    rows = raw_corpus(spark, folder).select(recode_topic("majortopic").alias("label"))
    return start.topic_counts(rows)


@query
def topic_recode_21_counts(spark, folder):
    shifted = F.col("majortopic") + F.when(F.col("majortopic") == 20, 2).otherwise(0)
    rows = raw_corpus(spark, folder).select(recode_topic(shifted, above=21).alias("label"))
    return start.topic_counts(rows)


@query
def sim_topic_counts(spark, folder):
    counts = start.fold_topic_counts(corpus(spark, folder)).withColumnRenamed("label", "topic")
    return with_category(counts)


def _tag(name: str):
    return F.nullif(F.regexp_extract("html", f"<{name}>([^<]*)</{name}>", 1), F.lit(""))


def _articles(spark, folder) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    pages = read_table(spark, folder, "pages").select(
        F.col("page_id").alias("doc_id"),
        F.col("url").alias("url_api"),
        _tag("title").alias("title"),
        _tag("h1").alias("headline_print"),
    )
    return docs.join(pages, "doc_id").select(
        F.col("doc_id").alias("id"),
        F.lit("20240101").alias("date"),
        "title",
        "url_api",
        F.col("text").alias("lead_paragraph"),
        "headline_print",
    )


@query
def start_corpus_build(spark, folder):
    types = read_table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("quality") == 1, "article").otherwise("caption").alias("text_type"),
    )
    topics = read_table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), raw_topic().alias("majortopic")
    )
    return start.with_folds(start.build_corpus(_articles(spark, folder), types, topics))


@query
def start_corpus_csv(spark, folder):
    path = new_path(spark, "start_corpus.csv")
    rows = raw_corpus(spark, folder).select(
        "doc_id", "majortopic", F.lit("20240101").alias("date"), "text", "sim"
    )
    write_csv(rows, path, sep=";")
    return read_csv(spark, path, START_CORPUS, sep=";", line_breaks=True)


@query
def csv_without_wide_columns(spark, folder):
    path = new_path(spark, "export.csv")
    write_csv(raw_corpus(spark, folder), path, drop=("text",))
    return read_csv(spark, path, "doc_id bigint, majortopic int, sim int", sep=",")


@query
def class_name_codes(spark, folder):
    """Topic codes back from the class names of a report."""
    names = corpus(spark, folder).select(F.concat(F.lit("Class: "), "label").alias("class"))
    counts = names.groupBy("class").agg(F.count("*").alias("n"))
    return counts.select("class", class_name_to_code("class").alias("topic"), "n")


@query
def fold_split(spark, folder):
    return start.fold_sizes(corpus(spark, folder))


@query
def random_split(spark, folder):
    return read_table(spark, folder, "documents").select(
        "doc_id", split_number("doc_id", 3).alias("sim"), split_by_share("doc_id", 0.8).alias("part")
    )


# --- text -----------------------------------------------------------------------------------


@query
def text_clean(spark, folder):
    docs = spread(read_table(spark, folder, "documents"))
    return docs.select("doc_id", tx.clean_text("text", stem=False).alias("text"))


@query
def text_clean_stemmed(spark, folder):
    docs = spread(read_table(spark, folder, "documents"))
    return docs.select("doc_id", tx.clean_text("text").alias("text"))


@query
def stopword_filter(spark, folder):
    docs = spread(read_table(spark, folder, "documents"))
    return docs.select("doc_id", tx.remove_words(F.lower("text")).alias("text"))


@query
def stem_vocabulary(spark, folder):
    docs = spread(read_table(spark, folder, "documents"))
    terms = docs.select(F.explode(tx.feature_tokens("text", stem=False)).alias("term")).distinct()
    return terms.select("term", stem_word("term").alias("stem"))


@query
def tokens_vocab(spark, folder):
    return vocabulary_terms(tokenised(spark, folder))


@query
def tfidf_terms_by_document(spark, folder):
    docs = tokenised(spark, folder)
    return tfidf_terms(docs, fit_terms(docs)).select("doc_id", "term", "tf", *six("tfidf"))


@query
def top_terms_by_topic(spark, folder):
    return top_terms(tokenised(spark, folder))


def top_terms(docs: DataFrame, k: int = 10) -> DataFrame:
    """The k terms with the largest summed TF-IDF per topic. Sums are per (topic, term), so the
    ranking sees a vocabulary per topic and no documents."""
    vocabulary = fit_terms(docs)
    counts = with_arrays(count_vectors(docs.select("label", "words"), vocabulary))
    sums = entries(counts, "label").groupBy("label", "term_id").agg(F.sum("tf").alias("tf"))
    scored = sums.join(vocabulary.table(docs), "term_id").select(
        "label", "term", F.round(F.col("tf") * F.col("idf"), 6).alias("score")
    )
    rank = F.row_number().over(W.partitionBy("label").orderBy(F.desc("score"), "term"))
    return with_category(
        scored.withColumn("rank", rank).where(F.col("rank") <= k).withColumnRenamed("label", "topic")
    )


@query
def trimmed_dfm(spark, folder):
    docs = spread(read_table(spark, folder, "documents"))
    words = docs.select("doc_id", tx.feature_tokens("text", stem=False).alias("words"))
    counts = trimmed_counts(materialise(words, "words"), min_df=50, max_share=0.8)
    return counts.withColumnRenamed("term", "feature")


@query
def trimmed_dfm_stemmed(spark, folder):
    """The matrix that the baselines read."""
    docs = spread(read_table(spark, folder, "documents"))
    words = docs.select("doc_id", tx.feature_tokens("text").alias("words"))
    counts = trimmed_counts(materialise(words, "words"), min_df=50, max_share=0.8)
    return counts.withColumnRenamed("term", "feature")


# --- sampling -------------------------------------------------------------------------------


def _labelled(spark, folder) -> DataFrame:
    return rounds.start_state(corpus(spark, folder).drop("text"), FOLD)


@query
def ovr_class_counts(spark, folder):
    return training_class_counts(_labelled(spark, folder))


@query
def negative_sample_numbers(spark, folder):
    return sample_number_log(_labelled(spark, folder), SPEC)


@query
def negative_sample(spark, folder):
    return negative_draws(_labelled(spark, folder), SPEC)


@query
def negative_sample_shared(spark, folder):
    shared = EnsembleSpec(outer=7, inner=7, repeats="same-sample")
    return negative_draws(_labelled(spark, folder), shared)


# --- naive Bayes and votes ------------------------------------------------------------------


def _nb_multiclass(spark, folder, folds=(1, 2, 3), features=None) -> DataFrame:
    rows, vocabulary = features or counted(spark, folder)
    vectors = tfidf_vectors(rows, vocabulary)
    with ThreadPoolExecutor(3) as pool:
        return _union(pool.map(lambda f: naive_bayes.multiclass_verdicts(vectors, f), folds))


@query
def nb_multiclass(spark, folder):
    return _nb_multiclass(spark, folder, [FOLD])


@query
def nb_index_map(spark, folder):
    return label_index(corpus(spark, folder), "label")


def _nb_votes(spark, folder, spec=SPEC) -> DataFrame:
    rows, vocabulary = training_rows(spark, folder)
    ensemble = naive_bayes.fit_ensemble(rows, vocabulary, spec)
    return vote_table(rows.where(F.col("in_train") == 0), ensemble)


@query
def nb_votes(spark, folder):
    return _nb_votes(spark, folder)


@query
def nb_votes_partitioned(spark, folder):
    path = new_path(spark, "votes")
    write_votes(_nb_votes(spark, folder), path)
    return read_votes(spark, path)


@query
def votes_wide(spark, folder):
    rows, vocabulary = training_rows(spark, folder)
    ensemble = naive_bayes.fit_ensemble(rows, vocabulary, SPEC)
    return wide_vote_table(rows.where(F.col("in_train") == 0), ensemble)


def _tallies(spark, folder, keep=("doc_id",)) -> DataFrame:
    """Tallies of the test rows, inside their rows."""
    rows, vocabulary = training_rows(spark, folder)
    ensemble = naive_bayes.fit_ensemble(rows, vocabulary, SPEC)
    return score_tallies(rows.where(F.col("in_train") == 0), ensemble, keep)


def _full(spark, folder) -> DataFrame:
    full = full_topics(SPEC.topics, SPEC.votes, F.col("tallies"))
    return _tallies(spark, folder).select("doc_id", full.alias("full"))


@query
def vote_tally(spark, folder):
    return _tallies(spark, folder).select("doc_id", F.inline(tally_rows(SPEC.topics)))


@query
def unanimous_verdict(spark, folder):
    full = _full(spark, folder)
    return full.where(F.size("full") == 1).select("doc_id", only_topic("full").alias("verdict"))


@query
def tied_docs(spark, folder):
    full = _full(spark, folder)
    return full.where(F.size("full") > 1).select("doc_id", F.size("full").cast("bigint").alias("n_full"))


@query
def verdict_strictness_sweep(spark, folder):
    rows, vocabulary = training_rows(spark, folder)
    ensemble = naive_bayes.fit_ensemble(rows, vocabulary, GRID)
    test = rows.where(F.col("in_train") == 0)
    given = strictness_verdicts(test, ensemble, ["doc_id", "label"])
    hits = given.groupBy("g").agg(
        F.count("*").alias("n_verdicts"),
        F.count_if(F.col("label") == F.col("verdict")).alias("tp"),
    )
    n_test = test.count()
    return hits.select(
        "g",
        "n_verdicts",
        "tp",
        (F.col("tp") / F.col("n_verdicts")).alias("precision"),
        (F.col("tp") / F.lit(n_test)).alias("recall"),
    ).select("g", "n_verdicts", "tp", *six("precision", "recall"), F.round(metrics.f1(), 6).alias("f1"))


def _coded(spark, folder) -> DataFrame:
    """Test rows after the first classification, written once."""
    rows, vocabulary = training_rows(spark, folder)
    ensemble = naive_bayes.fit_ensemble(rows, vocabulary, SPEC)
    test = rows.where(F.col("in_train") == 0)
    return materialise(rounds.classify_with(test, ensemble, "exclude"), "coded")


@query
def ensemble_verdict(spark, folder):
    return _coded(spark, folder).select(
        "doc_id",
        "label",
        F.size("full_topics").alias("n_full"),
        F.coalesce("verdict", F.lit(0)).alias("verdict"),
    )


# --- rounds ---------------------------------------------------------------------------------


@query
def self_training_labels(spark, folder):
    docs = corpus(spark, folder).select("doc_id", "label")
    verdicts = _coded(spark, folder).where("verdict IS NOT NULL").select("doc_id", "verdict")
    return docs.join(verdicts, "doc_id", "left").select(
        "doc_id",
        F.col("label").alias("old_label"),
        F.coalesce("verdict", "label").alias("new_label"),
    )


@query
def train_test_split_round(spark, folder):
    before = _labelled(spark, folder).where(F.col("in_train") == 1)
    state = before.select(*validation.STATE_COLUMNS).unionByName(
        rounds.self_trained(_coded(spark, folder))
    )
    return state.groupBy("label").agg(
        F.count_if(F.col("in_train") == 1).alias("n_train"),
        F.count_if(F.col("in_train") == 0).alias("n_test"),
    )


@query
def classified_remaining_split(spark, folder):
    classified, remaining = rounds.split_coded(_coded(spark, folder))
    return classified.select("doc_id", F.lit("classified").alias("part")).unionByName(
        remaining.select("doc_id", F.lit("remaining").alias("part"))
    )


def _checked(spark, folder) -> DataFrame:
    classified, _ = rounds.split_coded(_coded(spark, folder))
    return classified.withColumn("draw", validation.check_order(1))


@query
def validation_sample_size(spark, folder):
    return validation.sample_sizes(_checked(spark, folder))


@query
def validation_sample(spark, folder):
    return validation.validation_sample(_checked(spark, folder)).select("doc_id", "verdict", "correct")


@query
def validation_numbers(spark, folder):
    numbers = validation.validation_numbers(_checked(spark, folder), 0.75)
    return numbers.withColumns(
        {
            "passes": F.col("passes").cast("int"),
            "precision_in_sample": F.round("precision_in_sample", 6),
        }
    ).drop("cut")


def _routed(spark, folder, gate, keep_negatives) -> DataFrame:
    classified = _checked(spark, folder)
    numbers = validation.validation_numbers(classified, gate)
    return validation.route(classified, numbers, keep_negatives).select(
        "doc_id",
        "label",
        "original_label",
        "in_train",
        F.array_join("neg_topics", ",").alias("negatives"),
    )


@query
def gate_route_basic(spark, folder):
    return _routed(spark, folder, None, False)


@query
def gate_route_gated(spark, folder):
    return _routed(spark, folder, 0.75, False)


@query
def gate_route_stepwise(spark, folder):
    return _routed(spark, folder, 0.85, True)


@query
def active_learning_route(spark, folder):
    tied = _coded(spark, folder).where(F.size("full_topics") > 1)
    return validation.learn_tied(tied).select("doc_id", "label", "in_train")


@query
def known_negative_training(spark, folder):
    """Class counts of round 2 when round 1 rejected topics of single documents."""
    coded = _coded(spark, folder)
    config = rounds.WorkflowConfig(variant="v2")
    before = _labelled(spark, folder).select(*validation.STATE_COLUMNS)
    state, _ = rounds.next_state(before, coded, config, 1)
    return training_class_counts(state)


def _workflow(variant: str, n_rounds: int = 5) -> Query:
    def run(spark, folder):
        rows, vocabulary = counted(spark, folder)
        config = rounds.WorkflowConfig(variant=variant, rounds=n_rounds, fold=FOLD)
        last = rounds.run(rows, vocabulary, config)[-1]
        return last.state.select(
            "doc_id",
            "label",
            "original_label",
            "in_train",
            F.array_join(F.array_sort("neg_topics"), ",").alias("negatives"),
        )

    run.__name__ = f"workflow_{variant}"
    return run


for _variant in VARIANT_NAMES:
    query(_workflow(_variant))


# --- evaluation -----------------------------------------------------------------------------


def _nb_cells(spark, folder, features=None) -> DataFrame:
    """Counts of (sim, topic, verdict) of the multiclass model over all folds."""
    cells = metrics.confusion_cells(_nb_multiclass(spark, folder, features=features), by=["sim"])
    return materialise(cells, "cells")


def _vote_cells(spark, folder, features=None) -> DataFrame:
    """The same counts of the unanimous votes, over all folds: the counts are read once to fit all
    folds and once to score every row by the ensemble of its fold."""
    rows, vocabulary = features or counted(spark, folder)
    state = rounds.start_state(with_arrays(rows), 0)
    ensembles = naive_bayes.fit_folds(state, vocabulary, SPEC)
    coded = ensemble_verdicts(state, ensembles, keep=["doc_id", "sim", "label"])
    return materialise(metrics.confusion_cells(coded, by=["sim"]), "cells")


@query
def verdict_flags(spark, folder):
    coded = _coded(spark, folder).select("doc_id", "sim", "label", "verdict")
    return metrics.compare_flags(coded).na.fill(0, ["verdict"])


@query
def pr_by_topic(spark, folder):
    pr = metrics.pr_by_topic(_vote_cells(spark, folder), ["sim"])
    return pr.select("sim", "topic", "tp", "fp", "n_items", *six("precision", "recall"))


@query
def pr_total(spark, folder):
    total = metrics.pr_total(_vote_cells(spark, folder))
    return total.select("tp", "fp", "n_items", *six("precision", "recall", "f1"))


@query
def fold_mean_pr(spark, folder):
    pr = metrics.fold_mean(metrics.pr_by_topic(_nb_cells(spark, folder), ["sim"]))
    return pr.select("topic", *six("precision", "recall"))


@query
def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(_nb_cells(spark, folder), TOPICS)


@query
def class_report(spark, folder):
    """Precision, recall and F1 of every topic, folds pooled."""
    cells = _nb_cells(spark, folder).groupBy("topic", "verdict").agg(F.sum("n").alias("n"))
    report = metrics.pr_by_topic(cells).withColumn("f1", metrics.f1())
    return report.select("topic", "tp", "fp", "n_items", *six("precision", "recall", "f1"))


def _both_models(spark, folder) -> DataFrame:
    features = counted(spark, folder)
    return metrics.side_by_side(
        {
            "nb": metrics.fold_mean(metrics.pr_by_topic(_nb_cells(spark, folder, features), ["sim"])),
            "vote": metrics.fold_mean(metrics.pr_by_topic(_vote_cells(spark, folder, features), ["sim"])),
        }
    )


@query
def model_wins(spark, folder):
    return metrics.model_wins(_both_models(spark, folder), "vote", "nb")


@query
def pr_comparison(spark, folder):
    wide = _both_models(spark, folder)
    names = metrics.columns_like(wide, suffix="_nb") + metrics.columns_like(wide, suffix="_vote")
    return with_category(wide).select("topic", "category", *six(*names))


@query
def pr_comparison_means(spark, folder):
    return metrics.with_column_means(_both_models(spark, folder), "topic").na.fill(0, ["topic"])


@query
def pr_highlights(spark, folder):
    """Named topics of at least 0.8 precision or 0.5 recall, best first within a metric."""
    wide = materialise(_both_models(spark, folder), "pr")
    parts = []
    for metric, least in (("precision", 0.8), ("recall", 0.5)):
        long = metrics.highlights(metrics.metrics_long(wide, "topic", metric), least)
        best_first = W.orderBy(F.desc(F.round("score", 6)), "topic", "model")
        parts.append(
            long.select(
                F.lit(metric).alias("metric"),
                "topic",
                "model",
                F.round("score", 6).alias("score"),
                F.row_number().over(best_first).alias("rank"),
            )
        )
    return with_category(parts[0].unionByName(parts[1]))


@query
def metrics_long(spark, folder):
    wide = materialise(_both_models(spark, folder), "pr")
    long = metrics.metrics_long(wide, metric="precision").withColumnRenamed("score", "precision")
    recall = metrics.metrics_long(wide, metric="recall").withColumnRenamed("score", "recall")
    return long.join(recall, ["topic", "model"]).select("topic", "model", *six("precision", "recall"))


@query
def metrics_wide(spark, folder):
    pr = metrics.pr_by_topic(_nb_cells(spark, folder), ["sim"])
    named = pr.withColumn("fold", F.concat(F.lit("fold"), "sim"))
    wide = metrics.metrics_wide(named, "topic", "fold", ["fold1", "fold2", "fold3"])
    return wide.select("topic", *six(*[c for c in wide.columns if c != "topic"]))


def _runs(spark, folder, variants, n_rounds: int) -> list[tuple[int, list]]:
    """(fold, rounds) of every variant and fold."""
    rows, vocabulary = counted(spark, folder)
    configs = [
        rounds.WorkflowConfig(variant=v, fold=f, rounds=n_rounds) for v in variants for f in (1, 2, 3)
    ]
    results = rounds.run_all(rows, vocabulary, configs)
    return [(c.fold, r) for c, r in zip(configs, results, strict=True)]


def _summary(name: str, variant: str) -> Query:
    """Five rounds of three folds of a variant that checks samples."""

    def run(spark, folder):
        runs = _runs(spark, folder, [variant], 5)
        final = _union(rounds.final_verdicts(done[-1].state, fold) for fold, done in runs)
        numbers = _union(r.numbers for _, done in runs for r in done)
        summary = metrics.variant_summary(metrics.confusion_cells(final, by=["sim"]), numbers)
        rest = [c for c in summary.columns if c not in ("precision", "recall")]
        return summary.select(*rest, *six("precision", "recall")).na.fill(0, ["topic"])

    run.__name__ = name
    return run


def _convergence(name: str, variants: list[str], every_round: bool = False) -> Query:
    """Counters of five rounds, means of three folds. With ``every_round`` there is a row for a round without any
    verdict too."""

    def run(spark, folder):
        runs = _runs(spark, folder, variants, 5)
        numbers = _union(r.numbers for _, done in runs for r in done)
        if every_round:
            none = [(v, n, 0, 0, 0) for v in variants for n in range(1, 6)]
            kinds = "variant string, round int, num_classified long, num_added_to_training long, num_sample long"
            numbers = numbers.unionByName(spark.createDataFrame(none, kinds), allowMissingColumns=True)
        rows = metrics.convergence(numbers)
        names = ["num_classified", "num_added_to_training", "num_sample"]
        return rows.select("variant", "round", *six(*names))

    run.__name__ = name
    return run


for _variant in list(VARIANT_NAMES)[1:]:
    query(_summary("variant_summary" if _variant == "v3" else f"variant_summary_{_variant}", _variant))
query(_convergence("convergence", list(VARIANT_NAMES), every_round=True))
query(_convergence("convergence_gated", ["v2", "v3", "v4"]))


# --- metadata -------------------------------------------------------------------------------


@query
def null_audit(spark, folder):
    pages = read_table(spark, folder, "pages").select(
        F.col("page_id").alias("doc_id"), _tag("title").alias("title"), _tag("h2").alias("subtitle")
    )
    rows = read_table(spark, folder, "documents").join(pages, "doc_id", "left")
    return audit.null_counts(rows.select("doc_id", "lang", "title", "subtitle"))


def _logs(spark, folder) -> DataFrame:
    """Log lines made of the events, in the form of a fetch log."""
    kind = (
        F.when(F.col("event_type") == "error", "ERROR : HTTP error 429 ;")
        .when(F.col("event_type") == "signup", "ERROR : replacement has length zero ;")
        .when(F.col("event_type") == "click", "ERROR : undefined columns selected ;")
        .when(F.col("event_type") == "purchase", "ERROR : subscript out of bounds ;")
        .otherwise(F.concat(F.lit("URL "), F.col("user_id"), F.lit(" added;")))
    )
    return read_table(spark, folder, "events").select(kind.alias("api_logs"))


@query
def error_kinds(spark, folder):
    """Every log line with the flags of its kinds of error, counted."""
    flagged = audit.error_flags(_logs(spark, folder))
    return flagged.groupBy("api_logs", *audit.ERROR_MARKS).agg(F.count("*").alias("n"))


@query
def error_counts(spark, folder):
    return audit.error_counts(audit.error_lines(_logs(spark, folder)))


@query
def log_files(spark, folder):
    path = new_path(spark, "logs")
    _logs(spark, folder).write.option("header", True).option("sep", "\u0001").option(
        "quote", ""
    ).csv(path)
    return audit.error_counts(audit.error_lines(read_logs(spark, path)))


@query
def repair_merge(spark, folder):
    docs = read_table(spark, folder, "documents").select("doc_id", "lang")
    pages = read_table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), "url")
    rows = docs.join(pages, "doc_id", "left").withColumnRenamed("url", "url_api")
    fixes = (
        read_table(spark, folder, "labels")
        .join(docs, "doc_id")
        .select(
            "doc_id",
            "lang",
            F.when(F.col("quality") == 1, F.concat(F.lit("fixed/"), "doc_id")).alias("url_api"),
            F.lit("second").alias("attempt"),
        )
    )
    return audit.repair(rows, fixes, "doc_id", "url_api")


@query
def row_range(spark, folder):
    events = read_table(spark, folder, "events").select("event_id", "user_id", "event_type")
    return audit.row_range(events, "event_id", 301, 700)


@query
def query_titles(spark, folder):
    pages = read_table(spark, folder, "pages").select("page_id", _tag("title").alias("title"))
    return pages.select(
        "page_id",
        tx.query_title("title").alias("title_q"),
        tx.short_query_title("title").alias("short_q"),
    )


@query
def date_keys(spark, folder):
    events = read_table(spark, folder, "events")
    written = F.date_format("ts", "M/d/yyyy")
    rows = events.select("event_id", parse_mdy(written).alias("date"))
    return rows.select(
        "event_id",
        compact_date("date").alias("date_q"),
        F.year("date").alias("article_year"),
        F.month("date").alias("month_year"),
        year_month("date").alias("year_month"),
    )


@query
def json_flatten(spark, folder):
    """Responses as saved JSON text, one document each (none where the page has no even number)."""
    pages = read_table(spark, folder, "pages")
    doc = F.struct(
        F.col("url").alias("web_url"),
        _tag("title").alias("abstract"),
        F.struct(_tag("h1").alias("main"), _tag("h2").alias("print_headline")).alias("headline"),
        F.array(
            F.struct(F.lit("subject").alias("name"), F.concat(F.lit("k"), "page_id").alias("value"))
        ).alias("keywords"),
        F.struct(F.concat(F.lit("By "), "page_id").alias("original")).alias("byline"),
        F.length("html").alias("word_count"),
    )
    even = F.col("page_id") % 2 == 0
    docs = F.filter(F.array(doc), lambda d: even)
    response = F.struct(docs.alias("docs"), F.struct(F.col("page_id").alias("hits")).alias("meta"))
    saved = pages.select("page_id", F.to_json(F.struct(response.alias("response"))).alias("json"))
    return flatten_response(saved).withColumn("word_count", F.col("word_count").cast("string"))


@query
def event_props(spark, folder):
    props = F.from_json("props", "k bigint")
    return read_table(spark, folder, "events").select("event_id", props.getField("k").alias("k"))


# --- learned models without a SQL form ------------------------------------------------------


@query
def svm_votes(spark, folder):
    rows, vocabulary = training_rows(spark, folder)
    ensemble = linear_svm.fit_ensemble(rows, vocabulary, SPEC)
    return vote_table(rows.where(F.col("in_train") == 0), ensemble)


@query
def svm_workflow(spark, folder):
    """Counters of five rounds of the variant with active learning, by support vector machines."""
    rows, vocabulary = counted(spark, folder)
    config = rounds.WorkflowConfig(variant="v4", rounds=5, fold=FOLD, learner=linear_svm.fit_ensemble)
    return _union(r.numbers for r in rounds.run(rows, vocabulary, config))


def _pairwise(rows: DataFrame, vocabulary, keep, folds=None) -> DataFrame:
    rows = materialise(rows, "split")
    train = rows.where(F.col("in_train") == 1)
    labels = [r[0] for r in train.select("label").distinct().orderBy("label").collect()]
    return linear_svm.pairwise_verdicts(rows, vocabulary, labels, keep, folds)


@query
def svm_multiclass(spark, folder):
    """One-vs-one over all three folds, fitted together."""
    rows, vocabulary = counted(spark, folder)
    state = rounds.start_state(with_arrays(rows), 0)
    return _pairwise(state, vocabulary, ["doc_id", "sim", "label"], (1, 2, 3))


@query
def svm_80_20(spark, folder):
    """One-vs-one on four fifths of the documents."""
    rows, vocabulary = counted(spark, folder)
    state = rounds.start_state(with_arrays(rows), FOLD)
    split = state.withColumn("in_train", (split_by_share("doc_id", 0.8) == "train").cast("int"))
    return _pairwise(split, vocabulary, ["doc_id", "label"])


def _trimmed(spark, folder) -> tuple[list[str], DataFrame]:
    """All terms, and the documents' stemmed, trimmed counts with their label, written. Topics of a few documents
    only would leave folds without them and are left out."""
    docs = spread(corpus(spark, folder))
    words = materialise(docs.select("doc_id", "label", tx.feature_tokens("text").alias("words")), "words")
    terms, counts = trimmed_rows(words, trimmed_terms(words, min_df=50, max_share=0.8))
    common = words.groupBy("label").count().where("count >= 10").select("label")
    return terms, materialise(counts.join(F.broadcast(common), "label"), "counts")


@query
def lasso_cv(spark, folder):
    terms, rows = _trimmed(spark, folder)
    train = split_by_share("doc_id", 0.8) == "train"
    return baselines.lasso_verdicts(rows, len(terms), train, max_iter=30)


@query
def forest(spark, folder):
    terms, rows = _trimmed(spark, folder)
    train = split_by_share("doc_id", 0.8) == "train"
    return baselines.forest_verdicts(rows, len(terms), train)


@query
def forest_importance(spark, folder):
    """Importance of the terms that any tree of the forest splits at."""
    terms, rows = _trimmed(spark, folder)
    train = split_by_share("doc_id", 0.8) == "train"
    return baselines.forest_importance(rows, train, terms)
