"""A folder every executor can reach, for stream checkpoints and intermediate tables."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``; where that is unset, in the warehouse, which is shared as well."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/frostline-scratch"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written_once(df, purpose: str):
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives a lost executor."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let_workers_import(spark: SparkSession) -> None:
    """Python workers that do not have the package installed find it where the driver does."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
