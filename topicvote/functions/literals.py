"""Small constant tables inside an expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(value: object) -> str:
    if isinstance(value, dict):
        fields = ", ".join(f"'{k}', {_text(v)}" for k, v in value.items())
        return f"named_struct({fields})"
    if isinstance(value, list):
        return f"array({', '.join(map(_text, value))})"
    if isinstance(value, int):
        return f"{value}L" if abs(value) >= 2**31 - 1 else str(value)
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    raise TypeError(type(value).__name__)


def constant_rows(rows: Sequence[dict]) -> Column:
    """An array of structs of integers, ready to explode; written as one SQL text because
    building thousands of literals one by one is slow."""
    return F.expr(_text(list(rows)))


def constant_array(values: Sequence[int]) -> Column:
    return F.expr(_text(list(values)))


def constant_table(df: DataFrame, columns: Sequence[str], rows: Sequence[tuple]) -> DataFrame:
    """A few fixed rows as a table of the session of ``df``."""
    values = ", ".join(f"({', '.join(map(_text, row))})" for row in rows)
    return df.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")
