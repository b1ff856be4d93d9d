"""The nine operations tables as one bundle of DataFrames, and their Parquet form."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.functions.clock import month_of
from frostline.schemas import TABLES, conform


@dataclasses.dataclass(frozen=True)
class OpsTables:
    settings: DataFrame
    contracts: DataFrame
    sites: DataFrame
    operators: DataFrame
    storms: DataFrame
    clears: DataFrame
    mileage: DataFrame
    invoices: DataFrame
    payouts: DataFrame

    def having(self, **changed: DataFrame) -> OpsTables:
        """The same bundle with some tables replaced by a newer version."""
        return dataclasses.replace(self, **changed)

    @property
    def spark(self) -> SparkSession:
        return self.clears.sparkSession

    @classmethod
    def of(cls, spark: SparkSession, **frames: DataFrame) -> OpsTables:
        """Bundle from whatever frames are at hand; absent tables are empty, absent columns NULL."""
        bundle = {}
        for name, schema in TABLES.items():
            frame = frames.get(name)
            bundle[name] = spark.createDataFrame([], schema) if frame is None else conform(frame, schema)
        return cls(**bundle)


def merged(dimension: DataFrame) -> DataFrame:
    """Contracts or sites for a join that must not pass them through the driver. They grow with the business, but Spark takes a
    few columns of a compressed table for a fraction of what they are and would broadcast millions of rows."""
    return dimension.hint("merge")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def read_tables(spark: SparkSession, root: str) -> OpsTables:
    """Tables written by :func:`write_tables`; ``clears`` keeps its month partitions for pruning."""
    return OpsTables(**{name: read_table(spark, root, name) for name in TABLES})


def write_table(df: DataFrame, root: str, name: str) -> None:
    """Write one table version to a fresh directory (a path being read is never overwritten).

    The fact table is partitioned by storm month. The rebalance hint lets Spark size the writers at run time: a
    month that holds most of the rows is split over many tasks, small months share one.
    """
    out = conform(df, TABLES[name])
    if name == "clears":
        out.hint("rebalance", F.col("storm_month")).write.partitionBy("storm_month").parquet(f"{root}/{name}")
    else:
        out.write.parquet(f"{root}/{name}")


def write_tables(tables: OpsTables, root: str) -> None:
    for name in TABLES:
        write_table(getattr(tables, name), root, name)


def storm_month(storm_date: Column) -> Column:
    """Partition value of a storm's clears; a storm without a readable date still has one."""
    return F.coalesce(month_of(storm_date), F.lit("undated"))


def with_storm_month(clears: DataFrame, storms: DataFrame) -> DataFrame:
    """Fill the partition column from the clear's storm (NULL for an orphan)."""
    months = storms.select("storm_id", storm_month(F.col("storm_date")).alias("storm_month"))
    return clears.drop("storm_month").join(months, "storm_id", "left")
