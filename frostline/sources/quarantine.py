"""Feed lines that cannot be used are set aside with a reason, in batch and in streams: accepted + rejected = lines in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from frostline.schemas import PROOFS, PUNCHES

_BROKEN = "_broken"


def read_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The lines of a folder of JSON lines with the file they are from; blank lines are none."""
    reader = spark.readStream if stream else spark.read
    lines = reader.format("text").load(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    return lines.where(F.trim("line") != "")


def _judged(lines: DataFrame, schema: StructType, reasons: dict[str, Column]) -> DataFrame:
    """Lines parsed into ``r`` with ``reason``: the first of ``reasons`` whose condition is not false, else null."""
    with_broken = StructType([*schema.fields, StructField(_BROKEN, StringType())])
    parsed = lines.withColumn("r", F.from_json("line", with_broken, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}))
    verdict = F.when(F.col("r").isNull() | F.col(f"r.{_BROKEN}").isNotNull(), "unreadable")
    for reason, broken in reasons.items():
        verdict = verdict.when(F.coalesce(broken, F.lit(True)), reason)
    return parsed.withColumn("reason", verdict)


def _no_instant(text: str) -> Column:
    return F.substring(F.col(text), 1, 19).try_cast("timestamp").isNull()


def judge_punches(lines: DataFrame) -> DataFrame:
    """``line, file, r, reason``: unreadable, no shift, unknown punch type or no time; null for a good line."""
    return _judged(lines, PUNCHES, {
        "no shift": F.col("r.shift_id").isNull(),
        "unknown punch type": ~F.col("r.punch_type").isin("in", "out"),
        "no time": _no_instant("r.punched_at"),
    })


def judge_proofs(lines: DataFrame) -> DataFrame:
    """``line, file, r, reason``: unreadable, no submission, no event or no time; null for a good line."""
    return _judged(lines, PROOFS, {
        "no submission": F.col("r.submission_id").isNull(), "no event": F.col("r.event_id").isNull(),
        "no time": _no_instant("r.submitted_at"),
    })


def accepted(judged: DataFrame, schema: StructType) -> DataFrame:
    return judged.where(F.col("reason").isNull()).select(*[F.col(f"r.{name}").alias(name) for name in schema.names])


def rejected(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("reason").isNotNull()).select("line", "reason", "file")


def splitter(schema: StructType, good: str, bad: str) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch`` over judged lines: good rows and rejects of a micro-batch in a folder each, so a
    batch that is run again after a stop replaces what it wrote."""

    def split(judged: DataFrame, number: int) -> None:
        held = judged.persist()
        try:
            accepted(held, schema).write.mode("overwrite").parquet(f"{good}/batch={number}")
            rejected(held).write.mode("overwrite").parquet(f"{bad}/batch={number}")
        finally:
            held.unpersist()

    return split


def split_stream(judged: DataFrame, schema: StructType, good: str, bad: str, checkpoint: str) -> None:
    """Process every line that is there and has not been processed yet."""
    stream = judged.writeStream.foreachBatch(splitter(schema, good, bad)).option("checkpointLocation", checkpoint)
    stream.trigger(availableNow=True).start().awaitTermination()
