"""Helpers the text operators share: shared folder, written tables, free column names."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; where it is unset, a folder in the warehouse, shared too."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    return (root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/frostline-scratch").rstrip("/")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, purpose: str) -> DataFrame:
    """``stored``, bucketed by ``key``: joins on it move the other side only."""
    spark = df.sparkSession
    name = f"{purpose.replace('-', '_')}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, key).option("path", f"{shared_root(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()``: like ``stored``, and Spark's cleaner may delete the files of past rounds."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(f"{shared_root(spark)}/rounds")
    return df.checkpoint()


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` does not use yet."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def named(name: str) -> Column:
    """The column of exactly this name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def words_of(text: Column) -> Column:
    """Words between white space; an empty array for null and empty texts."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def held(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: bound as the variable of a lambda over a one-element array."""
    return F.transform(F.array(value), use)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers that do not have the package installed find it where the driver does.
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
