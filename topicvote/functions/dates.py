"""Date keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_mdy(date: str | Column) -> Column:
    """'7/4/1997' -> date; null where it is none."""
    column = F.col(date) if isinstance(date, str) else date
    return F.try_to_timestamp(column, F.lit("M/d/yyyy")).cast("date")


def compact_date(date: str | Column) -> Column:
    """Date without dashes: '19970704'."""
    return F.date_format(date, "yyyyMMdd")


def year_month(date: str | Column) -> Column:
    """'1997_7'"""
    return F.concat_ws("_", F.year(date).cast("string"), F.month(date).cast("string"))
