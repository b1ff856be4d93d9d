"""Documents as rows: a heading, lines in order, a total. One form for a document of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADING, LINE, TOTAL = 0, 1, 2


def as_rows(heads: DataFrame, lines: DataFrame, keys: list[str], order: str, heading: Column, body: Column, total: Column) -> DataFrame:
    """``keys, section, position, line``: sort a document's rows by section and position to read it.

    ``heads`` has one row per document, ``lines`` one per line with its place in ``order``. Nothing is gathered, so a
    document of any length is written by as many tasks as its lines need.
    """

    def part(rows: DataFrame, section: int, position: Column, text: Column) -> DataFrame:
        return rows.select(*keys, F.lit(section).alias("section"), position.cast("long").alias("position"), text.alias("line"))

    none = F.lit(0)
    return part(heads, HEADING, none, heading).unionByName(part(lines, LINE, F.col(order), body)).unionByName(part(heads, TOTAL, none, total))
