"""Scalar lookups in the key/value settings table.

Each lookup is an uncorrelated scalar subquery over a global aggregate (always one row); Spark merges all
lookups of a query into a single pass over the table and runs it once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def setting(settings: DataFrame, key: str) -> Column:
    return settings.agg(F.max(F.when(F.col("key") == key, F.col("value")))).scalar()


def is_set(settings: DataFrame, key: str) -> Column:
    """True when the key has a row, even one whose value is NULL."""
    return settings.agg(F.count(F.when(F.col("key") == key, F.lit(1))) > 0).scalar()


def setting_or(settings: DataFrame, key: str, default: str) -> Column:
    return F.coalesce(setting(settings, key), F.lit(default))


def number_prefix(settings: DataFrame) -> Column:
    """Invoice prefix: a NULL value means 'INV', a missing row means no number at all."""
    return F.when(is_set(settings, "invoice_prefix"), setting_or(settings, "invoice_prefix", "INV"))
