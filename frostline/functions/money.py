"""The one place that knows what a clear bills and what it pays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from frostline.schemas import FINISHED, MONEY, SALTED


def zero() -> Column:
    return F.lit(0).cast(MONEY)


def or_zero(amount: Column) -> Column:
    return F.coalesce(amount, zero())


def salt_billed() -> Column:
    salted = (F.col("status") == "completed") & F.col("salt_applied").isin(*SALTED)
    return F.when(salted, or_zero(F.col("salt_fee"))).otherwise(zero())


def billable_total() -> Column:
    """A finished clear bills its extras; only a completed one adds the visit and salt fees."""
    visit = F.when(F.col("status") == "completed", or_zero(F.col("fee")) + salt_billed()).otherwise(zero())
    extras = F.when(F.col("status").isin(*FINISHED), or_zero(F.col("other_fee"))).otherwise(zero())
    return (visit + extras).cast(MONEY)


def payout_amount(billable: Column) -> Column:
    share = F.round(billable * F.col("payout_value") / 100, 2)
    return (
        F.when(F.col("payout_type") == "per_clear", F.col("payout_value"))
        .when(F.col("payout_type") == "percent", share)
        .cast(MONEY)
    )


def deduction(miles: Column, rate: Column) -> Column:
    return F.round(miles * rate, 2).cast(MONEY)
