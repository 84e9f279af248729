"""Documents to packed training sequences: five stages, each written before the next.

Every stage takes null texts as empty, texts of any length as a whole, and repeated rows and ids row by
row; all but the last return the columns of documents, and of an empty table an empty one. A row of
which nothing tells it apart from another is an exact copy of it, and one of them stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from topicvote.llm import exact_dedup, packing, pii, quality_classifier, simhash
from topicvote.llm.common import documents
from topicvote.session import materialise


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, takes for good."""
    machine = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.keep_good(docs, machine)


def one_of_each_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text (blanks aside): the longest, then the one with the smallest id."""
    return exact_dedup.drop_copies(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints of four-word shingles that at most four bits part: the
    one with the smallest id (null last), of equal ids the first."""
    return simhash.drop_near_copies(docs, words=4, bits=4)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by the name of its kind."""
    return pii.mask(docs, pii.fit(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their sequence and place in it; every document has at least one."""
    return packing.pack_documents(docs, keep_ids=True)


STAGES = [
    ("quality_classifier", good_quality),
    ("exact_dedup", one_of_each_text),
    ("simhash_near_dedup", one_of_near_copies),
    ("pii", without_personal_data),
    ("best_fit_packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
