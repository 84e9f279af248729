"""The registered queries of these operators: thin, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicvote.llm import (
    bpe,
    collocations,
    conversation_repair,
    exact_dedup,
    license_scan,
    nn_descent,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    secret_scan,
    simhash,
    url_filter,
)
from topicvote.llm.common import documents
from topicvote.session import materialise

FIRST_DAY = 19723  # 2024-01-01
YEAR = 365


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.mark_copies(documents(spark, folder))


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """The pages as captures; the table has no times, so the id gives the day of the fetch."""
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    day = (F.lit(FIRST_DAY) + F.pmod(F.col("page_id") * 7919, F.lit(YEAR))).cast("int")
    rows = pages.select(F.monotonically_increasing_id().alias("capture_id"), "page_id", "url", day.alias("day"))
    return materialise(rows, "captures")


def dated_entries(rows: DataFrame) -> DataFrame:
    """A list of the hosts and first folders of the pages: hashes choose what is listed and when."""
    address = url_filter.bare(F.col("url"))
    values = (
        rows.select(address.alias("address"))
        .distinct()
        .select(F.explode(url_filter.candidates(F.col("address"))).alias("c"))
        .select("c.rule", "c.value", "c.weight")
        .filter("(rule = 'host' AND weight >= 1) OR (rule = 'prefix' AND weight = 1002)")
        .select("rule", "value")
        .distinct()
    )
    k = F.conv(F.substring(F.md5("value"), 1, 8), 16, 10).cast("long")
    start = FIRST_DAY + F.pmod(k, F.lit(300))
    entry = lambda day, action: F.struct(day.cast("int").alias("day"), F.lit(action).alias("action"))
    none = F.lit(None).cast("struct<day:int,action:string>")
    listed = (F.col("rule") == "host") & (k % 3 == 0)
    entries = F.array(
        F.when(listed, entry(start, "block")).otherwise(none),
        F.when(listed & (k % 2 == 0), entry(start + 40, "remove")).otherwise(none),
        F.when(listed & (k % 5 == 0), entry(start + 90, "block")).otherwise(none),
        F.when((F.col("rule") == "prefix") & (k % 4 == 0), entry(start, "allow")).otherwise(none),
    )
    return values.select("rule", "value", F.explode(entries).alias("e")).filter("e IS NOT NULL").select(
        "rule", "value", "e.day", "e.action"
    )


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = captures(spark, folder)
    return url_filter.judge(rows, dated_entries(rows)).drop("capture_id")


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_groups(documents(spark, folder))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    repository = F.concat_ws("/", "source", "lang")
    return secret_scan.report(documents(spark, folder), F.col("source"), repository)


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(documents(spark, folder))


def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(documents(spark, folder))


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    machine = quality_classifier.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return quality_classifier.score(docs, machine).select(
        "doc_id",
        quality_classifier.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return quality_rules.verdicts(docs, quality_rules.references(docs))


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(documents(spark, folder))


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return pii.spans(docs, pii.fit(docs))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults that a checksum of conversation and turn chooses."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    text = F.coalesce("text", F.lit(" "))
    changed = rows.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )
    return changed.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("_", "copies")


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/conversations.parquet")
    fixed = conversation_repair.repair(damaged(rows))
    texts = conversation_repair.digests(fixed.steps).withColumnRenamed("conv_id", "id")
    found = fixed.summary.join(texts, F.col("conv_id").eqNullSafe(F.col("id"))).drop("id")
    every = rows.select(F.col("conv_id").alias("id")).distinct()
    counters = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left").select(
        F.col("id").alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counters],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op12_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    found = nn_descent.nearest(vectors, vectors.filter("vec_id % 20 = 0"))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(documents(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_url_filter,
        op3_simhash,
        op4_secret_scan,
        op5_license_scan,
        op6_best_fit_packing,
        op7_quality_classifier,
        op8_quality_rules,
        op9_bpe,
        op10_pii,
        op11_conversation_repair,
        op12_nearest_neighbours,
        op13_collocations,
    )
}
