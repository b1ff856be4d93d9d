"""Outgoing requests, each idempotency key once: over runs, over streams, and over batches that are replayed.

A ledger is a folder of claims, ``claim=<id>``: the requests that one batch was the first to ask for, whole. A batch
claims before anything goes out: of its requests it keeps one for each key that no other claim holds (the least of
equal keys, so that a replay keeps the same), and writes them as its claim. What is sent is read back from the claim. A
batch that is replayed finds its own claim, changes nothing and sends the same rows to the same place. One batch claims
at a time: streams that share a ledger take turns in one query.

At scale: the batch's keys meet the claimed keys in one anti join, of which the keys are the only column read; nothing
is collected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

KEY = "idempotency_key"


class Ledger:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str = KEY):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = StructType([f for f in schema.fields if f.name != "claim"])

    def _there(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def claims(self) -> DataFrame:
        """All requests claimed so far, with the claim."""
        schema = StructType([*self.schema.fields, StructField("claim", StringType())])
        if not self._there(self.path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def claimed(self, claim: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/claim={claim}")

    def claim(self, requests: DataFrame, claim: str) -> DataFrame:
        """The requests that ``claim`` is the first to make. Asked again, the same rows, whatever has come since."""
        if not self._there(f"{self.path}/claim={claim}/_SUCCESS"):
            names = self.schema.names
            rest = F.struct(*[c for c in names if c != self.key])
            wanted = requests.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.min(rest).alias("_r"))
            known = self.claims().where(F.col("claim") != claim).select(self.key)
            fresh = wanted.join(known, self.key, "left_anti").select(
                *[F.col(c) if c == self.key else F.col(f"_r.{c}").alias(c) for c in names]
            )
            # An attempt that broke off left no mark; its files are replaced.
            fresh.write.mode("overwrite").parquet(f"{self.path}/claim={claim}")
        return self.claimed(claim)


def send_batch(ledger: Ledger, requests: DataFrame, claim: str, out: str, fmt: str = "json") -> DataFrame:
    """Claim, then write what was claimed to ``out/claim=<claim>``, over whatever an earlier attempt left there."""
    fresh = ledger.claim(requests, claim)
    fresh.write.mode("overwrite").format(fmt).save(f"{out.rstrip('/')}/claim={claim}")
    return fresh


def sender(ledger: Ledger, out: str, name: str, fmt: str = "json") -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: a micro-batch is the claim ``<name>-<batch id>``, so a replayed one has no effect.
    ``name`` belongs to one checkpoint: a new checkpoint counts its batches anew and needs a new name."""

    def send(batch: DataFrame, number: int) -> None:
        send_batch(ledger, batch, f"{name}-{number}", out, fmt)

    return send
