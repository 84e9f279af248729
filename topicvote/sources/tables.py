"""Readers and writers of the study's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicvote.session import materialise

START_CORPUS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("majortopic", T.IntegerType()),
        T.StructField("date", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("sim", T.IntegerType()),
    ]
)

ARTICLES = "id string, date string, title string, majortopic int"
TEXT_TYPES = "id string, text_type string"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Spreads a table that comes in fewer partitions than there are cores, such as one small
    file; larger tables stay as they were read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    sep: str = ";",
    line_breaks: bool = False,
) -> DataFrame:
    """CSV with a header and a declared schema. ``line_breaks`` allows them inside quoted fields;
    a file then cannot be split between tasks."""
    return spark.read.schema(schema).csv(
        path, sep=sep, header=True, quote='"', escape='"', multiLine=line_breaks
    )


def write_csv(df: DataFrame, path: str, sep: str = ",", drop: tuple[str, ...] = ()) -> None:
    """CSV with a header, without the named wide columns."""
    df.drop(*drop).write.csv(
        path, sep=sep, header=True, quote='"', escape='"', mode="overwrite", emptyValue=""
    )


def write_votes(votes: DataFrame, path: str) -> None:
    """All classifiers' votes as one table, laid out by topic and replicate, and its manifest, which
    lists the replicates that were replaced since."""
    _write_votes(votes, path, "static")
    _write_manifest(votes.select("topic", "i", "j").limit(0), path, "static")


def replace_votes(votes: DataFrame, path: str, replicates: DataFrame) -> None:
    """Replaces the votes of ``replicates`` (topic, i, j) in a written table and leaves all others as
    they are. ``votes`` of other replicates are left out; a replicate without votes has none
    afterwards. Doing it again changes nothing. The manifest is written last."""
    wanted = replicates.select("topic", "i", "j").distinct()
    own = votes.join(wanted, ["topic", "i", "j"], "left_semi")
    _write_votes(own, path, "dynamic")
    _write_manifest(wanted.join(own.select("topic", "i", "j").distinct().withColumn("filled", F.lit(1)), ["topic", "i", "j"], "left"), path, "dynamic")


def _write_votes(votes: DataFrame, path: str, mode: str) -> None:
    """Rows are first brought together by folder; adaptive execution splits the folders that are large
    and lets a task write many small ones, so that a folder has few files."""
    dealt = votes.hint("rebalance", "topic", "i", "j").write.partitionBy("topic", "i", "j")
    dealt.option("partitionOverwriteMode", mode).parquet(path, mode="overwrite")


def _write_manifest(replicates: DataFrame, path: str, mode: str) -> None:
    """(topic, i, j, filled): whether a replicate that was replaced has votes."""
    filled = F.col("filled").isNotNull() if "filled" in replicates.columns else F.lit(True)
    rows = replicates.select("topic", "i", "j", filled.alias("filled"))
    few = rows.repartition("topic").write.partitionBy("topic", "i", "j")
    few.option("partitionOverwriteMode", mode).parquet(f"{path.rstrip('/')}.manifest", mode="overwrite")


def read_votes(spark: SparkSession, path: str) -> DataFrame:
    """The vote table; filters on topic, i and j choose folders. Replicates that the manifest calls
    empty are left out."""
    place = "topic int, i int, j int"
    votes = spark.read.schema(f"doc_id bigint, vote int, {place}").parquet(path)
    manifest = spark.read.schema(f"filled boolean, {place}").parquet(f"{path.rstrip('/')}.manifest")
    empty = manifest.where(~F.col("filled")).select("topic", "i", "j")
    return votes.join(empty, ["topic", "i", "j"], "left_anti").select("doc_id", "vote", "topic", "i", "j")


def read_logs(spark: SparkSession, path: str, n_max: int | None = None) -> DataFrame:
    """One row per log line; the first line of every file is left out. With ``n_max`` only so many
    lines of each file are kept: a line's number is its place in its part of the file and the lines
    of the parts before, which are counted, so that large files are still read by many tasks."""
    lines = spark.read.schema("api_logs string").csv(
        path, sep="\u0001", header=True, quote="", ignoreLeadingWhiteSpace=False
    )
    if n_max is None:
        return lines
    part = ["file", "start"]
    placed = materialise(
        lines.select(
            "api_logs",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("place"),
        ),
        "log_lines",
    )
    sizes = placed.groupBy(*part).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("start")) - F.col("n")
    kept = sizes.withColumn("before", before).where(F.col("before") < n_max).drop("n")
    number = F.col("before") + F.col("place") - F.col("first")
    return placed.join(kept, part).where(number < n_max).select("api_logs")
