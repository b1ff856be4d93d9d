"""Frostline: storm field-service analytics as Spark DataFrame jobs."""

from frostline.sources.tables import OpsTables

__all__ = ["OpsTables"]
