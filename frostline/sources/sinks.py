"""Outgoing files: request outboxes, invoice documents, payout statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_outbox(requests: DataFrame, path: str, fmt: str = "json", key: str = "idempotency_key") -> None:
    """One line per request of this call, of equal keys the least. To send a key once over many calls use
    :class:`frostline.sources.outbox_ledger.Ledger`."""
    rest = F.struct(*[c for c in requests.columns if c != key])
    once = requests.groupBy(key).agg(F.min(rest).alias("_r"))
    once.select(*[F.col(c) if c == key else F.col(f"_r.{c}").alias(c) for c in requests.columns]).write.format(fmt).save(path)


def write_documents(documents: DataFrame, path: str, name: str, body: str = "document") -> None:
    """Documents as JSON lines of (name, part, text), spread over many files."""
    documents.select(F.col(name), "part", F.col(body)).write.json(path)


def write_text(documents: DataFrame, path: str, body: str = "document") -> None:
    """Plain text, one document after the other, spread over many files."""
    documents.select(body).write.text(path)
