"""What subcontracted operators are owed."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.functions.clock import day
from frostline.operators.billing import STORM_KEY, billable_facts, storm_facts, work_date
from frostline.operators.boards import flag
from frostline.operators.defaults import fill_payout_amount, touch
from frostline.operators.documents import as_rows
from frostline.operators.transitions import latest
from frostline.schemas import PAYOUTS, conform
from frostline.sources.tables import OpsTables


def _billed_work(t: OpsTables, clears: DataFrame) -> DataFrame:
    """Clears that have a storm, a site and a contract, with label, day and billable total."""
    sites = t.sites.select("site_id", "contract_id", F.coalesce("street_name", "address").alias("site_label")).join(
        t.contracts.select("contract_id"), "contract_id", "left_semi"
    )
    return (
        billable_facts(clears)
        .join(storm_facts(t.storms).select(*STORM_KEY, "storm_ref"), STORM_KEY)
        .join(sites, "site_id")
        .withColumn("work_date", work_date())
    )


def due_rows(t: OpsTables) -> DataFrame:
    """Unpaid payouts of subs with the work behind them and the operator's total, unsorted.

    The total is an aggregate joined back rather than a window, so one operator with most of the rows does not
    end up in a single task.
    """
    subs = t.operators.where(F.col("is_owner") == 0).select(
        "operator_id", "operator_name", "email", "payout_type", "payout_value"
    )
    unpaid = t.payouts.where(F.col("paid") == 0).select("payout_id", "operator_id", "clear_id", "amount")
    # The payout names its own operator, which need not be the one on the clear.
    # The few unpaid payouts meet the clears first; storms and sites join what is left.
    work = _billed_work(t, t.clears.join(unpaid.select("clear_id"), "clear_id", "left_semi")).select(
        "clear_id", "storm_id", "storm_ref", "site_label", F.col("status").alias("clear_status"), "work_date",
        "surface", "condition", "salt_applied", "billable_total", F.col("invoiced").alias("contract_invoiced"),
    )
    rows = unpaid.join(work, "clear_id").join(subs, "operator_id")
    totals = rows.groupBy("operator_id").agg(
        F.sum("amount").alias("operator_total_due"), F.count("*").alias("operator_rows")
    )
    return rows.join(totals, "operator_id")


def payouts_due(t: OpsTables) -> DataFrame:
    return due_rows(t).orderBy("operator_name", "work_date", "payout_id").select(
        "payout_id", "operator_id", "operator_name", "email", "payout_type", "payout_value", "clear_id", "storm_id",
        "storm_ref", "site_label", "clear_status", "work_date", "surface", "condition", "salt_applied",
        "billable_total", "amount", flag(F.col("amount").isNull()).alias("needs_amount"), "operator_total_due",
        "contract_invoiced",
    )


def missing_rows(t: OpsTables) -> DataFrame:
    """Completed clears of subs that have no payout yet, unsorted."""
    subs = t.operators.where(F.col("is_owner") == 0).select(
        "operator_id", "operator_name", "payout_type", "payout_value"
    )
    unpaid = t.clears.where(F.col("status") == "completed").join(
        t.payouts.select("clear_id"), "clear_id", "left_anti"
    )
    return _billed_work(t, unpaid).join(subs, "operator_id")


def payouts_missing(t: OpsTables) -> DataFrame:
    return missing_rows(t).orderBy("work_date", "clear_id").select(
        "clear_id", "storm_ref", "site_label", "status", "work_date", "surface", "condition", "operator_id",
        "operator_name", "payout_type", "payout_value", "billable_total",
    )


def payout_run(t: OpsTables) -> DataFrame:
    """New payout rows, one per missing clear, priced by the operator's split. The payout takes the clear's id."""
    missing = missing_rows(t).select("operator_id", "clear_id", "billable_total")
    fresh = conform(missing.withColumns({"payout_id": F.col("clear_id"), "paid": F.lit(0)}), PAYOUTS)
    return fill_payout_amount(fresh, t.operators, missing)


def set_amounts(t: OpsTables, commands: DataFrame) -> DataFrame:
    """The payouts table after ``commands(payout_id, new_amount)`` priced unpaid payouts that have no amount."""
    orders = latest(commands, "payout_id")
    open_price = F.col("amount").isNull() & (F.col("paid") == 0) & F.col("new_amount").isNotNull()
    priced = F.when(open_price, F.col("new_amount")).otherwise(F.col("amount")).cast(t.payouts.schema["amount"].dataType)
    return t.payouts.join(orders, "payout_id", "left").withColumn("amount", priced).select(*t.payouts.columns)


def settle_payouts(t: OpsTables, operators: DataFrame, as_of: datetime) -> DataFrame:
    """The payouts table once everything unpaid of ``operators(operator_id)`` has been paid."""
    named = operators.select("operator_id").distinct().withColumn("_paid_now", F.lit(True))
    hit = F.col("_paid_now").isNotNull() & (F.col("paid") == 0)
    return (
        t.payouts.join(named, "operator_id", "left")
        .withColumn("_hit", hit)
        .withColumns({
            "paid": F.when(F.col("_hit"), 1).otherwise(F.col("paid")),
            "paid_date": F.when(F.col("_hit"), day(as_of)).otherwise(F.col("paid_date")),
        })
        .select(*t.payouts.columns)
    )


def paid_clears(t: OpsTables, operators: DataFrame) -> DataFrame:
    """``clear_id`` of the clears of which a payout of ``operators`` is paid, once each."""
    paid = t.payouts.where(F.col("paid") == 1).join(operators.select("operator_id"), "operator_id", "left_semi")
    return paid.select("clear_id").distinct()


def set_paid_out(clears: DataFrame, audit_now: datetime) -> DataFrame:
    """``paid_out`` set where ``_marked``."""
    marked = touch(clears, F.col("_marked").isNotNull(), audit_now)
    return marked.withColumn("paid_out", F.when(F.col("_marked"), 1).otherwise(F.col("paid_out"))).drop("_marked")


def flag_paid_out(t: OpsTables, operators: DataFrame, audit_now: datetime, delta: bool = False) -> DataFrame:
    """The clears table with ``paid_out`` set where a payout of ``operators`` is paid, or the changed rows only."""
    marks = paid_clears(t, operators).withColumn("_marked", F.lit(True))
    found = t.clears.join(marks, "clear_id", "left")
    return set_paid_out(found.where("_marked") if delta else found, audit_now).select(*t.clears.columns)


def payout_totals(t: OpsTables) -> DataFrame:
    """What each sub is owed, one row per operator."""
    return due_rows(t).groupBy("operator_id", "operator_name", "email").agg(
        F.count("*").alias("clear_count"), F.sum("amount").alias("total_due"),
        F.sum(flag(F.col("amount").isNull())).alias("missing_amounts"),
        F.min("work_date").alias("first_date"), F.max("work_date").alias("last_date"),
    )


def payout_statements(t: OpsTables) -> DataFrame:
    """A plain-text statement per operator as rows (:func:`as_rows`), lines ordered by payout."""
    dollars = F.format_string("$%.2f", F.col("amount").cast("double"))
    amount = F.when(F.col("amount").isNull(), "amount open").otherwise(dollars)
    line = F.concat_ws(
        "  ", F.lit(""), F.col("work_date").cast("string"), F.col("storm_ref"), F.col("site_label"),
        F.coalesce(F.col("condition"), F.lit("-")), amount,
    )
    total = F.format_string("Total due: $%.2f", F.coalesce(F.col("total_due"), F.lit(0)).cast("double"))
    heading = F.concat(F.lit("Statement for "), F.col("operator_name"))
    return as_rows(payout_totals(t), due_rows(t), ["operator_id", "operator_name"], "payout_id", heading, line, total)
