"""The SLA clock of a clear: site, else contract, else storm, else settings, else 07:00."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.functions.settings import setting

LAST_RESORT = "07:00"


def _typed(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def with_sla(df: DataFrame, settings: DataFrame) -> DataFrame:
    """Adds ``sla_deadline``, ``sla_deadline_at`` (text) and ``deadline_ts``.

    Needs ``site_sla``, ``contract_sla``, ``storm_sla`` and ``storm_date``.
    """
    clock = F.coalesce(
        _typed("site_sla"), _typed("contract_sla"), _typed("storm_sla"),
        setting(settings, "default_sla_deadline"), F.lit(LAST_RESORT),
    )
    return (
        df.withColumn("sla_deadline", clock)
        .withColumn("sla_deadline_at", F.concat(F.col("storm_date").cast("string"), F.lit("T"), F.col("sla_deadline")))
        .withColumn("deadline_ts", F.col("sla_deadline_at").try_cast("timestamp_ntz"))
    )
