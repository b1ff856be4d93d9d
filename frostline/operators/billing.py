"""What can be billed, who owes what, and the invoice run."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.functions.clock import day, local_date
from frostline.functions.labels import street_address
from frostline.functions.money import billable_total, salt_billed
from frostline.functions.settings import setting
from frostline.operators.defaults import number_invoices, touch
from frostline.operators.documents import as_rows
from frostline.schemas import FINISHED, INVOICES, LINE_ITEM, MONEY, conform
from frostline.sources.tables import OpsTables, merged, storm_month

STORM_KEY = ["storm_id", "storm_month"]


def storm_facts(storms: DataFrame) -> DataFrame:
    """Storm columns under names that cannot clash with a clear's, plus the partition month.

    Joining clears on both key columns lets Spark prune the fact table's month partitions at run time.
    """
    return storms.select(
        "storm_id", storm_month(F.col("storm_date")).alias("storm_month"), "storm_ref", "storm_name", "storm_date",
        "storm_type", F.col("sla_deadline").alias("storm_sla"), F.col("status").alias("storm_status"),
    )


def completed_date():
    """Day of the work: check-in, else planned start, else the storm's morning; read from text, not converted."""
    said = F.coalesce(F.substring("checked_in_at", 1, 19), F.col("scheduled_start"), F.col("storm_date").cast("string"))
    return local_date(said)


def work_date():
    return local_date(F.coalesce(F.substring("checked_in_at", 1, 19), F.col("scheduled_start")))


def billable_facts(clears: DataFrame) -> DataFrame:
    """Clears with what they bill; no join."""
    return clears.withColumns({"salt_fee_billed": salt_billed(), "billable_total": billable_total()})


def billable_clears(t: OpsTables, clears: DataFrame | None = None) -> DataFrame:
    """One row per clear with its storm, site, contract and billable total."""
    sites = t.sites.select("site_id", "contract_id", "address", "city", "state", "zip", "street_name")
    contracts = t.contracts.select("contract_id", "contract_name", "contract_type")
    joined = (
        billable_facts(t.clears if clears is None else clears)
        .join(storm_facts(t.storms), STORM_KEY)
        .join(sites, "site_id")
        .join(contracts, "contract_id")
    )
    return joined.select(
        "clear_id", "storm_id", "storm_ref", "storm_name", "storm_date", "storm_type", "site_id", "contract_id",
        "contract_name", "contract_type", "address", "street_name", street_address().alias("street_address"), "status",
        "surface", "condition", "salt_applied", "is_adhoc", completed_date().alias("completed_date"), "fee",
        "salt_fee_billed", "other_fee", "billable_total", "invoiced", "paid_out", "operator_id",
    )


def _open_items(t: OpsTables) -> DataFrame:
    """Finished, uninvoiced clears that bill something, keyed by contract; filtered before any join."""
    due = billable_facts(
        t.clears.where((F.col("invoiced") == 0) & F.col("status").isin(*FINISHED))
    ).where(F.col("billable_total") > 0)
    return due.join(storm_facts(t.storms), STORM_KEY).join(
        t.sites.select("site_id", "contract_id", "address", "street_name"), "site_id"
    )


def receivables_by_contract(t: OpsTables) -> DataFrame:
    """Per contract: uninvoiced work. Totals are built before the contract's columns are joined on."""

    def counted(status: str):
        return F.sum(F.when(F.col("status") == status, 1).otherwise(0))

    totals = _open_items(t).groupBy("contract_id").agg(
        F.count("clear_id").alias("clear_count"),
        counted("completed").alias("completed_count"),
        counted("skipped").alias("skipped_count"),
        F.sum("billable_total").alias("total_billable"),
        F.min("storm_date").alias("first_date"),
        F.max(F.coalesce(completed_date(), F.col("storm_date"))).alias("last_date"),
    )
    return receivables_of(t, totals)


def receivables_of(t: OpsTables, totals: DataFrame) -> DataFrame:
    """Totals by contract with the contract's columns, largest first."""
    who = t.contracts.select(
        "contract_id", "contract_name", "contract_type", "contact_name", "billing_email", "payment_terms_days"
    )
    return totals.join(merged(who), "contract_id").select(
        *who.columns, "clear_count", "completed_count", "skipped_count", "total_billable", "first_date", "last_date"
    ).orderBy(F.desc("total_billable"), "contract_id")


def with_aging(invoices: DataFrame, as_of: datetime) -> DataFrame:
    """Days past due, bucket and overdue flag; without a due date an invoice is in the last bucket, not overdue."""
    late = F.datediff(day(as_of), F.col("due_date"))
    bucket = F.when(late <= 0, "current").when(late <= 30, "30").when(late <= 60, "60").otherwise("90+")
    return invoices.withColumns({
        "days_past_due": late,
        "aging_bucket": bucket,
        "overdue": F.when(F.col("due_date") < day(as_of), 1).otherwise(0),
    })


def invoices_outstanding(t: OpsTables, as_of: datetime) -> DataFrame:
    who = t.contracts.select(
        "contract_id", "contract_name", "contract_type", "contact_name", "billing_email", "payment_terms_days"
    )
    unpaid = with_aging(t.invoices.where(F.col("paid") == 0), as_of)
    return unpaid.join(who, "contract_id").select(
        "invoice_id", "invoice_number", *who.columns, "invoice_date", "due_date", "sent_date", "total_amount",
        "days_past_due", "aging_bucket", "overdue",
    ).orderBy("due_date", "invoice_id")


def aging_summary(t: OpsTables, as_of: datetime) -> DataFrame:
    """Open invoices by bucket, worst bucket first."""
    unpaid = with_aging(t.invoices.where(F.col("paid") == 0), as_of)
    totals = unpaid.join(t.contracts.select("contract_id"), "contract_id").groupBy("aging_bucket").agg(
        F.count("*").alias("invoice_count"),
        F.sum("total_amount").alias("amount_due"),
        F.max("days_past_due").alias("oldest_days"),
    )
    rank = F.create_map(*[F.lit(x) for kv in (("90+", 1), ("60", 2), ("30", 3), ("current", 4)) for x in kv])
    return totals.withColumn("bucket_rank", rank[F.col("aging_bucket")]).orderBy("bucket_rank")


def next_invoice_id(t: OpsTables) -> Column:
    """Ids of a run start after the largest one in the table."""
    return t.invoices.agg(F.coalesce(F.max("invoice_id"), F.lit(0).cast("long"))).scalar()


def invoice_run(t: OpsTables, as_of: datetime, first_id: int | None = None) -> DataFrame:
    """One invoice per contract with open items, completed and numbered.

    Ids are the contract's id above the largest id so far (or above ``first_id``): no two runs over the tables they left
    behind share an id or a number, and no global ordering is needed. Line items are a table of their own
    (:func:`invoice_lines`), so no invoice is gathered into one row here.
    """
    totals = _open_items(t).groupBy("contract_id").agg(
        F.sum("billable_total").alias("total_amount"), F.count("*").alias("line_count")
    )
    terms = t.contracts.select("contract_id", "payment_terms_days")
    base = next_invoice_id(t) if first_id is None else F.lit(first_id).cast("long")
    issued = totals.join(terms, "contract_id").select(
        (F.col("contract_id") + base).alias("invoice_id"),
        "contract_id",
        F.lit(None).cast("string").alias("invoice_number"),
        day(as_of).alias("invoice_date"),
        F.date_add(day(as_of), F.col("payment_terms_days")).alias("due_date"),
        "total_amount", "line_count",
    )
    return number_invoices(issued, t.settings)


def invoices_after_run(t: OpsTables, as_of: datetime, first_id: int | None = None) -> DataFrame:
    """The invoice table with the run appended."""
    fresh = invoice_run(t, as_of, first_id).withColumn("paid", F.lit(0))
    return t.invoices.unionByName(conform(fresh, INVOICES))


def invoice_lines(t: OpsTables, as_of: datetime, first_id: int | None = None) -> DataFrame:
    """One row per billed clear, with the number of the invoice it is on."""
    numbers = invoice_run(t, as_of, first_id).select("contract_id", "invoice_number", "line_count")
    return _open_items(t).join(numbers, "contract_id").select(
        "invoice_number", "contract_id", "line_count", "clear_id", "storm_ref", "storm_date",
        F.col("street_name").alias("street"), "surface", "condition", "salt_applied", "status", "fee",
        F.col("salt_fee_billed").alias("salt_fee"), "other_fee", F.col("billable_total").alias("billable"),
        F.coalesce("street_name", "address").alias("street_label"),
    )


def invoice_line_items(t: OpsTables, as_of: datetime, first_id: int | None = None) -> DataFrame:
    """The line items of every invoice, as an array for each of its storms, ordered by clear.

    Invoice and storm are the unit at every size: a contract has one standing clear per site and storm.
    """
    item = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LINE_ITEM.fields])
    lines = invoice_lines(t, as_of, first_id).select("invoice_number", "storm_ref", F.struct("clear_id", item.alias("item")).alias("x"))
    return lines.groupBy("invoice_number", "storm_ref").agg(F.count("*").alias("lines"), F.sort_array(F.collect_list("x"))["item"].alias("line_items"))


def invoices_with_items(t: OpsTables, as_of: datetime, first_id: int | None = None) -> DataFrame:
    """The invoices of a run with their line items: a row for each invoice and storm, which is the unit of the items."""
    return invoice_run(t, as_of, first_id).join(as_json(invoice_line_items(t, as_of, first_id)), "invoice_number").select(
        "invoice_id", "contract_id", "invoice_number", "invoice_date", "due_date", "total_amount", "storm_ref", "lines", "line_items"
    )


def as_json(items: DataFrame) -> DataFrame:
    """Line items as JSON text; NULL fields stay in."""
    kinds = {f.name: "double" if f.dataType == MONEY else "string" for f in LINE_ITEM.fields}
    plain = F.transform("line_items", lambda x: F.struct(*[x[name].cast(kind).alias(name) for name, kind in kinds.items()]))
    return items.withColumn("line_items", F.to_json(plain, {"ignoreNullFields": "false"}))


def mark_invoiced(t: OpsTables, audit_now: datetime, contract_ids: DataFrame | None = None, delta: bool = False) -> DataFrame:
    """The clears table after an invoice run, or with ``delta`` the changed rows only.

    Sweeps every finished uninvoiced clear of the contracts, also those that bill nothing.
    """
    billed = _open_items(t).select("contract_id").distinct() if contract_ids is None else contract_ids.select("contract_id")
    swept = t.sites.select("site_id", "contract_id").join(merged(billed), "contract_id", "left_semi").select(
        "site_id", F.lit(True).alias("_swept")
    )
    # The few clears of a delta meet a hash of the sites; a whole table is moved only where Spark finds the sites too large.
    joined = t.clears.join(swept.hint("shuffle_hash") if delta else swept, "site_id", "left")
    hit = (
        F.coalesce(F.col("_swept"), F.lit(False)) & (F.col("invoiced") == 0) & F.col("status").isin(*FINISHED)
    )
    marked = (joined.where(hit) if delta else joined).withColumn("_hit", hit)
    marked = touch(marked, F.col("_hit"), audit_now)
    return marked.withColumn("invoiced", F.when(F.col("_hit"), 1).otherwise(F.col("invoiced"))).select(
        *t.clears.columns
    )


def mark_invoices(invoices: DataFrame, commands: DataFrame) -> DataFrame:
    """Apply ``commands(invoice_number, paid_date, sent_date)`` in the order of their ``seq``, if they have one; a NULL
    date leaves that side alone."""
    seq = F.col("seq") if "seq" in commands.columns else F.lit(0)

    def last(name: str) -> Column:
        return F.max(F.when(F.col(name).isNotNull(), F.struct(seq.alias("seq"), F.col(name).alias("at"))))["at"].alias(f"_{name}")

    orders = commands.groupBy("invoice_number").agg(last("paid_date"), last("sent_date"))
    return (
        invoices.join(orders, "invoice_number", "left")
        .withColumns({
            "paid": F.when(F.col("_paid_date").isNotNull(), 1).otherwise(F.col("paid")),
            "paid_date": F.coalesce("_paid_date", "paid_date"),
            "sent_date": F.coalesce("_sent_date", "sent_date"),
        })
        .select(*invoices.columns)
    )


def invoice_documents(t: OpsTables, as_of: datetime, first_id: int | None = None) -> DataFrame:
    """Plain-text invoices as rows (:func:`as_rows`), lines ordered by clear. No local-only field is read."""
    salt = (
        F.when(F.col("salt_applied") == "yes", "Salted").when(F.col("salt_applied") == "pretreated", "Pretreated")
        .when(F.col("salt_applied") == "no", "No salt").otherwise("-")
    )
    line = F.concat_ws(
        "  ", F.lit(""), F.col("storm_ref"), F.col("street_label"), F.initcap(F.coalesce("surface", "status")),
        F.initcap(F.coalesce(F.col("condition"), F.lit("-"))), salt, F.format_string("$%.2f", F.col("billable").cast("double")),
    )
    heads = invoice_run(t, as_of, first_id).join(
        t.contracts.select("contract_id", "contract_name", "billing_email", "payment_terms_days"), "contract_id"
    )

    def said(d):
        return F.date_format(d, "MMM d, yyyy")

    heading = F.concat_ws(
        "\n",
        setting(t.settings, "business_name"),
        F.concat(F.lit("Invoice "), F.col("invoice_number")),
        F.concat(F.lit("To: "), F.col("contract_name"), F.coalesce(F.concat(F.lit(" ("), F.col("billing_email"), F.lit(")")), F.lit(""))),
        F.concat(
            F.lit("Date: "), said(F.col("invoice_date")), F.lit("    Due: "), said(F.col("due_date")),
            F.lit(" (net "), F.col("payment_terms_days").cast("string"), F.lit(")"),
        ),
    )
    total = F.format_string("Total due: $%.2f", F.col("total_amount").cast("double"))
    return as_rows(heads, invoice_lines(t, as_of, first_id), ["invoice_number", "contract_id"], "clear_id", heading, line, total)
