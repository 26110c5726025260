"""Search over reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import contains_ignoring_case


def search(rows: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows with the query, taken literally and without case, in any of the columns."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | contains_ignoring_case(F.col(c), query)
    return rows.where(hit)
