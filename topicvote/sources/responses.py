"""Saved article search responses (JSON text) as flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESPONSE = """
response struct<
  docs: array<struct<
    web_url: string, abstract: string, lead_paragraph: string, print_section: string,
    print_page: string, headline: struct<main: string, print_headline: string>,
    keywords: array<struct<name: string, value: string>>, pub_date: string,
    document_type: string, news_desk: string, section_name: string,
    byline: struct<original: string>, word_count: bigint>>,
  meta: struct<hits: bigint>>
"""


def flatten_response(df: DataFrame, json: str = "json") -> DataFrame:
    """The first document of each response as columns; whatever is missing is null. ``keywords``
    is the value of the first keyword."""
    parsed = df.withColumn("_r", F.from_json(json, RESPONSE)["response"])
    first = F.get(F.col("_r.docs"), F.lit(0))

    def field(name: str) -> Column:
        return first.getField(name)

    return parsed.select(
        *[c for c in df.columns if c != json],
        field("web_url").alias("url_api"),
        field("abstract").alias("abstract"),
        field("lead_paragraph").alias("lead_paragraph"),
        field("print_section").alias("print_section"),
        field("print_page").alias("print_page"),
        field("headline").getField("main").alias("headline_main"),
        field("headline").getField("print_headline").alias("headline_print"),
        F.get(field("keywords"), F.lit(0)).getField("value").alias("keywords"),
        field("pub_date").alias("pub_date"),
        field("document_type").alias("document_type"),
        field("news_desk").alias("news_desk"),
        field("section_name").alias("section_name"),
        field("byline").getField("original").alias("byline"),
        field("word_count").alias("word_count"),
        F.col("_r.meta.hits").alias("api_hits"),
    )
