"""What the store fills in when a row is written: numbers, snapshots, amounts, change stamps.

Every function maps a batch of new or changed rows to the same rows completed; none touches rows that already
carry a value. Dimension joins carry no broadcast hint: Spark broadcasts a side only when its measured size
allows it and splits skewed partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.functions.labels import numbered
from frostline.functions.money import deduction, or_zero, payout_amount
from frostline.functions.settings import number_prefix, setting, setting_or
from frostline.schemas import CLEARS, MILEAGE, MONEY, RATE, conform
from frostline.sources.tables import merged

# What a column gets when a new row leaves it out.
COLUMN_DEFAULTS: dict[str, dict[str, str | int]] = {
    "contracts": {"contract_type": "commercial", "payment_terms_days": 30, "is_active": 1},
    "sites": {"surface": "driveway", "is_active": 1},
    "operators": {"is_owner": 0, "is_active": 1},
    "storms": {"storm_type": "snow", "status": "active"},
    "clears": {"is_adhoc": 0, "status": "planned", "photo_count": 0, "invoiced": 0, "paid_out": 0},
    "invoices": {"paid": 0},
    "payouts": {"paid": 0},
}

# Columns of a storm or clear whose change moves ``updated_at``.
STORM_STAMPED = ("storm_ref", "storm_name", "storm_date", "storm_type", "sla_deadline", "status", "notes")
CLEAR_STAMPED = tuple(
    f.name for f in CLEARS.fields if f.name not in ("clear_id", "created_at", "updated_at", "storm_month")
)


def stamp(audit_now: datetime) -> Column:
    """``audit_now`` (UTC) as an instant, whatever the session time zone."""
    return F.lit(audit_now.strftime("%Y-%m-%dT%H:%M:%SZ")).cast("timestamp")


def touch(df: DataFrame, changed: Column, audit_now: datetime) -> DataFrame:
    """Move ``updated_at`` of the changed rows (contracts, sites, operators, storms, clears alike)."""
    return df.withColumn("updated_at", F.when(changed, stamp(audit_now)).otherwise(F.col("updated_at")))


def stamp_changes(before: DataFrame, after: DataFrame, key: str, audit_now: datetime, columns: tuple[str, ...]) -> DataFrame:
    """Move ``updated_at`` of the rows of ``after`` in which any of ``columns`` differs from ``before``.

    For edits made elsewhere; NULLs compare equal and new rows are left alone.
    """
    known = before.select(key, F.struct(*columns).alias("_was"))
    joined = after.join(known, key, "left")
    changed = F.col("_was").isNotNull() & ~F.struct(*columns).eqNullSafe(F.col("_was"))
    return touch(joined, changed, audit_now).select(*after.columns)


def column_defaults(rows: DataFrame, table: str) -> DataFrame:
    """New rows of ``table`` with left-out columns set to their declared defaults."""
    have = set(rows.columns)
    return rows.withColumns({
        name: F.coalesce(F.col(name), F.lit(value)) if name in have else F.lit(value)
        for name, value in COLUMN_DEFAULTS[table].items()
    })


def number_storms(storms: DataFrame) -> DataFrame:
    auto = numbered(F.lit("ST"), F.col("storm_date"), F.col("storm_id"))
    return storms.withColumn("storm_ref", F.coalesce("storm_ref", auto))


def fill_storm_defaults(storms: DataFrame, settings: DataFrame) -> DataFrame:
    clock = setting_or(settings, "default_sla_deadline", "07:00")
    return storms.withColumn("sla_deadline", F.coalesce(F.col("sla_deadline"), clock))


def fill_clear_defaults(
    clears: DataFrame, storms: DataFrame, sites: DataFrame, contracts: DataFrame, settings: DataFrame,
    made: Callable[[DataFrame], DataFrame] = lambda joined: joined,
) -> DataFrame:
    """Start, length, operator and fee snapshots of new clears.

    Where a clear's columns derive from fewer ones, pass those with ``storm_id`` and ``site_id``, and the derivation as
    ``made``: it takes the joined rows, keeps their underscored columns, and the joins move the few columns only.
    """
    terms = sites.select("site_id", "contract_id").join(
        merged(contracts.select("contract_id", F.col("per_clear_fee").alias("_fee"), F.col("salt_fee").alias("_salt_fee"))),
        "contract_id",
    ).drop("contract_id")
    mornings = storms.select("storm_id", F.col("storm_date").alias("_morning"))
    start = F.concat(
        F.col("_morning").cast("string"), F.lit("T"), setting_or(settings, "default_clear_start", "04:00")
    )
    minutes = F.coalesce(setting(settings, "default_clear_minutes").try_cast("int"), F.lit(180))
    operator = setting(settings, "default_operator_id").try_cast("bigint")
    joined = clears.join(terms, "site_id", "left").join(mornings, "storm_id", "left")
    filled = made(joined).withColumns({
        "scheduled_start": F.coalesce(F.col("scheduled_start"), start),
        "duration_minutes": F.coalesce(F.col("duration_minutes"), minutes),
        "operator_id": F.coalesce(F.col("operator_id"), operator),
        "fee": or_zero(F.coalesce("fee", "_fee")),
        "salt_fee": or_zero(F.coalesce("salt_fee", "_salt_fee")),
        "other_fee": or_zero(F.col("other_fee")),
    })
    return conform(filled, CLEARS)


def fill_mileage(mileage: DataFrame, settings: DataFrame) -> DataFrame:
    standard = setting(settings, "irs_mileage_rate").try_cast(RATE)
    rated = mileage.withColumn("rate", F.coalesce(F.col("rate"), standard, F.lit(0).cast(RATE)).cast(RATE))
    return conform(rated.withColumn("deduction", deduction(F.col("miles"), F.col("rate"))), MILEAGE)


def recompute_mileage(mileage: DataFrame) -> DataFrame:
    """After an edit of miles or rate; a rate that was removed counts as zero."""
    rate = F.coalesce(F.col("rate"), F.lit(0).cast(RATE))
    return mileage.withColumn("deduction", deduction(F.col("miles"), rate))


def number_invoices(invoices: DataFrame, settings: DataFrame) -> DataFrame:
    auto = numbered(number_prefix(settings), F.col("invoice_date"), F.col("invoice_id"))
    return invoices.withColumn("invoice_number", F.coalesce(F.col("invoice_number"), auto))


def fill_payout_amount(payouts: DataFrame, operators: DataFrame, billable: DataFrame) -> DataFrame:
    """Price payouts that carry no amount. ``billable``: one row (clear_id, billable_total) per clear."""
    splits = operators.select("operator_id", "payout_type", "payout_value")
    priced = (
        payouts.join(splits, "operator_id", "left")
        .join(billable.select("clear_id", "billable_total"), "clear_id", "left")
        .withColumn("amount", F.coalesce(F.col("amount"), payout_amount(F.col("billable_total"))).cast(MONEY))
    )
    return priced.select(*payouts.columns)
