"""Run a streaming plan over what is there now and hand back its sink as a table."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

from frostline.sources.shared import shared_folder

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def on_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's own choice is put back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def as_stream(feed: DataFrame, purpose: str) -> DataFrame:
    """Land a feed as Parquet files in the shared folder and open the folder as a stream."""
    spark = feed.sparkSession
    path = shared_folder(spark, f"feed-{purpose}")
    feed.write.option("compression", "zstd").parquet(path)
    return spark.readStream.schema(feed.schema).parquet(path)


def drain(stream: DataFrame, purpose: str, checkpoint: str | None = None, sink: str | None = None, rocksdb: bool = False) -> DataFrame:
    """Process everything available, then read the sink. Checkpoint and sink lie in the shared folder. Streams with
    timers need their state in RocksDB."""
    spark = stream.sparkSession
    checkpoint = checkpoint or shared_folder(spark, f"checkpoint-{purpose}")
    sink = sink or shared_folder(spark, f"sink-{purpose}")
    with on_rocksdb(spark) if rocksdb else nullcontext():
        query = (
            stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
            .option("path", sink).option("compression", "zstd").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return read_sink(spark, sink, stream)


def read_sink(spark: SparkSession, sink: str, stream: DataFrame) -> DataFrame:
    return spark.read.schema(stream.schema).parquet(sink)
