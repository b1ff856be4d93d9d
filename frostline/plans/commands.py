"""Command batches, responses and feeds for the catalogue, derived from the whole operations tables.

Each batch is what a dispatcher would decide from the data: all windows of a storm type move, all windows of an
inactive operator change hands, and so on.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.functions.clock import day, iso_seconds, local_date, local_ts, ntz, plus_minutes
from frostline.functions.settings import setting
from frostline.operators import outbox
from frostline.operators.billing import billable_facts
from frostline.schemas import MONEY
from frostline.sources.tables import OpsTables, merged

AS_OF_A = datetime(2001, 8, 1, 5, 40)
AS_OF_B = datetime(2001, 7, 20, 5, 40)
AUDIT = datetime(2001, 8, 1, 11, 40)


def planned(t: OpsTables) -> DataFrame:
    return t.clears.where(F.col("status") == "planned")


def minute_text(ts: Column) -> Column:
    return F.substring(iso_seconds(ts), 1, 16)


def delay_ice(t: OpsTables) -> DataFrame:
    """Half an hour later for every planned clear of an ice storm."""
    ice = t.storms.where(F.col("storm_type") == "ice").select("storm_id")
    later = plus_minutes(local_ts(F.col("scheduled_start")), F.lit(30))
    return planned(t).join(ice, "storm_id", "left_semi").select("clear_id", minute_text(later).alias("new_start"))


def move_mix(t: OpsTables) -> DataFrame:
    """Planned clears of mixed storms move a day; the replacement has the negated id of the old clear."""
    mix = t.storms.where(F.col("storm_type") == "mix").select("storm_id")
    tomorrow = plus_minutes(local_ts(F.col("scheduled_start")), F.lit(1440))
    return planned(t).join(mix, "storm_id", "left_semi").select(
        "clear_id", (-F.col("clear_id")).alias("new_clear_id"), minute_text(tomorrow).alias("new_start")
    )


def withdraw_inactive(t: OpsTables) -> DataFrame:
    """Planned clears at sites of inactive contracts are called off."""
    gone = t.sites.join(merged(t.contracts.where(F.col("is_active") == 0).select("contract_id")), "contract_id", "left_semi")
    return planned(t).join(merged(gone.select("site_id")), "site_id", "left_semi").select("clear_id")


def skip_walks(t: OpsTables) -> DataFrame:
    """Planned clears of walks are skipped; the trip is charged where the contract charges salt."""
    walks = t.sites.where(F.col("surface") == "walk").select("site_id", "contract_id").join(
        merged(t.contracts.select("contract_id", "salt_fee")), "contract_id"
    )
    return planned(t).join(walks.select("site_id", F.col("salt_fee").alias("new_other_fee")), "site_id").select(
        "clear_id", "new_other_fee"
    )


def hand_over(t: OpsTables) -> DataFrame:
    """Planned clears of inactive operators go to the default operator."""
    gone = t.operators.where(F.col("is_active") == 0).select("operator_id")
    heir = setting(t.settings, "default_operator_id").try_cast("bigint")
    return planned(t).join(gone, "operator_id", "left_semi").select("clear_id", heir.alias("new_operator_id"))


def money_in(t: OpsTables, as_of: datetime) -> DataFrame:
    """Commercial contracts pay what is due; everything unsent of the last 60 days goes out."""
    payers = t.contracts.where(F.col("contract_type") == "commercial").select("contract_id")
    none = F.lit(None).cast("date")
    paid = t.invoices.where((F.col("paid") == 0) & (F.col("due_date") <= day(as_of))).join(
        payers, "contract_id", "left_semi"
    ).select("invoice_number", day(as_of).alias("paid_date"), none.alias("sent_date"))
    sent = t.invoices.where(
        F.col("sent_date").isNull() & (F.col("invoice_date") >= day(as_of - timedelta(days=60)))
    ).select("invoice_number", none.alias("paid_date"), day(as_of).alias("sent_date"))
    return paid.unionByName(sent)


def here_now(t: OpsTables, as_of: datetime) -> DataFrame:
    """The default operator reports from every pinned lot."""
    operator = setting(t.settings, "default_operator_id").try_cast("bigint")
    lots = t.sites.where((F.col("surface") == "lot") & F.col("ext_location_id").isNotNull())
    return lots.select(
        (-F.col("site_id")).alias("clear_id"), "site_id", operator.alias("operator_id"), ntz(as_of).alias("at")
    )


def agreed_amounts(t: OpsTables) -> DataFrame:
    """Operators without a split are paid what the clear bills; a first offer of half of it came before."""
    bills = billable_facts(t.clears).select("clear_id", "billable_total")
    open_rows = t.payouts.where(F.col("amount").isNull()).select("payout_id", "clear_id").join(bills, "clear_id")
    offers = F.explode(F.array(
        F.struct(F.lit(1).alias("seq"), (F.col("billable_total") / 2).cast(MONEY).alias("new_amount")),
        F.struct(F.lit(2).alias("seq"), F.col("billable_total").cast(MONEY).alias("new_amount")),
    ))
    return open_rows.select("payout_id", offers.alias("o")).select("payout_id", "o.*")


def contract_entries(t: OpsTables) -> DataFrame:
    """Every contract entered again twice, under its own billing address and under a new one."""
    twice = F.explode(F.array(F.lit(1_000_000_000), F.lit(2_000_000_000))).alias("base")
    rows = t.contracts.select("contract_id", "contract_name", "contract_type", "billing_email", twice)
    fresh = F.when(F.col("contract_type") == "hoa", F.concat(F.lit("new-"), "billing_email")).otherwise(F.col("billing_email"))
    return rows.withColumns({"contract_id": F.col("base") + F.col("contract_id"), "billing_email": fresh}).drop("base")


def location_answers(t: OpsTables, as_of: datetime) -> DataFrame:
    return outbox.outbox_locations(t, as_of).select(
        "idempotency_key", (F.col("site_id") + 500_000_000).alias("ext_id")
    )


def event_answers(t: OpsTables, as_of: datetime) -> DataFrame:
    stamp = F.date_format("start_date", "yyyyMMdd").cast("long")
    return outbox.outbox_events(t, as_of).select(
        "idempotency_key", (F.col("site_id") * 100_000_000 + stamp).alias("ext_id")
    )


def shift_answers(t: OpsTables, as_of: datetime) -> DataFrame:
    return outbox.outbox_shifts(t, as_of).select("idempotency_key", (-F.col("clear_id")).alias("ext_id"))


def punch_feed(t: OpsTables) -> DataFrame:
    """Punches of every clear with a shift.

    A completed clear punched as recorded. A planned one of an hour or more is in and out on its window, a shorter
    one has only checked in so far.
    """
    start = local_ts(F.col("scheduled_start"))
    offset = F.lit("-06:00")
    window_in = F.concat(iso_seconds(start), offset)
    window_out = F.concat(iso_seconds(plus_minutes(start, F.col("duration_minutes"))), offset)
    is_planned = F.col("status") == "planned"
    came = F.when(is_planned, window_in).otherwise(F.col("checked_in_at"))
    went = F.when(is_planned & (F.col("duration_minutes") >= 60), window_out).when(
        ~is_planned, F.col("checked_out_at")
    )
    metres = F.coalesce(F.col("checkin_distance_m"), F.col("duration_minutes"))
    verified = F.coalesce(F.col("gps_verified"), F.lit(1))
    both = F.array(
        F.struct(F.lit("in").alias("punch_type"), came.alias("punched_at")),
        F.struct(F.lit("out").alias("punch_type"), went.alias("punched_at")),
    )
    return (
        t.clears.where(F.col("ext_shift_id").isNotNull() & F.col("status").isin("planned", "completed"))
        .select(
            F.col("ext_shift_id").alias("shift_id"), F.col("operator_id").alias("worker_id"),
            F.col("ext_event_id").alias("event_id"), F.explode(both).alias("p"), verified.alias("gps_verified"),
            metres.alias("distance_m"),
        )
        .select("shift_id", "worker_id", "event_id", "p.punch_type", "p.punched_at", "gps_verified", "distance_m")
        .where(F.col("punched_at").isNotNull())
    )


def closing_tick(t: OpsTables) -> DataFrame:
    """A clock tick long after everything in the tables, which lets a drained stream finish."""
    return t.storms.agg(F.date_add(F.max("storm_date"), 60).cast("timestamp").alias("at"))


def proof_feed(t: OpsTables) -> DataFrame:
    """One submission per completed clear (already stored) and per planned clear with an event (not yet read)."""
    photos = F.transform(
        F.sequence(F.lit(1), F.coalesce(F.col("photos"), F.lit(0))),
        lambda i: F.struct(F.lit("after").alias("field"), F.concat(F.lit("p"), i.cast("string")).alias("cdn_url")),
    )
    is_planned = F.col("status") == "planned"
    base = t.clears.where(
        F.col("report_id").isNotNull() | (is_planned & F.col("ext_event_id").isNotNull())
    ).withColumns({
        "photos": F.when(is_planned, 2).otherwise(F.col("photo_count")),
        "said_surface": F.when(is_planned, "Lot").otherwise(F.col("surface")),
        "said_condition": F.when(is_planned, "bare").otherwise(F.col("condition")),
        "said_salt": F.when(is_planned, F.lit(None)).otherwise(F.col("salt_applied")),
    })
    return base.select(
        F.coalesce("report_id", -F.col("clear_id")).alias("submission_id"), F.col("operator_id").alias("worker_id"),
        F.col("ext_event_id").alias("event_id"),
        F.coalesce("checked_out_at", "scheduled_start").alias("submitted_at"),
        F.struct(
            F.col("said_surface").alias("surface"), F.col("said_condition").alias("condition"),
            F.col("said_salt").alias("salt_applied"), "notes",
        ).alias("data"),
        F.when(F.col("photos") > 0, photos).otherwise(F.array().cast("array<struct<field:string,cdn_url:string>>")).alias("media"),
    )


def trips_to_log(t: OpsTables, as_of: datetime) -> DataFrame:
    """A trip for every clear completed in the last 30 days: a tenth of a mile per planned minute."""
    since = day(as_of - timedelta(days=30))
    done = t.clears.where((F.col("status") == "completed") & (local_date(F.col("checked_in_at")) >= since))
    return done.select(
        (-F.col("clear_id")).alias("trip_id"), "clear_id", local_date(F.col("checked_in_at")).alias("trip_date"),
        (F.col("duration_minutes").cast("decimal(10,0)") / 10).cast("decimal(10,2)").alias("miles"),
        F.lit("Yard").alias("from_label"), F.concat(F.lit("site "), F.col("site_id").cast("string")).alias("to_label"),
    )


def raise_hoa_fees(t: OpsTables) -> DataFrame:
    """Five dollars more per clear and an earlier clock for every HOA."""
    return t.contracts.where(F.col("contract_type") == "hoa").select(
        "contract_id", (F.col("per_clear_fee") + 5).cast(MONEY).alias("new_per_clear_fee"),
        F.lit(None).cast(MONEY).alias("new_salt_fee"), F.lit("06:15").alias("new_sla_deadline"),
    )


def typed_addresses(t: OpsTables) -> DataFrame:
    """Every site's address as an owner might type it: shouted, punctuated, with a city where the book has none."""
    return t.sites.select(
        F.col("site_id").alias("entry_id"), F.concat(F.lit("#"), F.upper("address"), F.lit(".,")).alias("address"),
        F.concat(F.lit("  "), F.coalesce(F.col("city"), F.lit("Edina"))).alias("city"), "state", "zip",
        (F.col("contract_id") + F.when(F.col("surface") == "mixed", 1_000_000_000).otherwise(0)).alias("contract_id"),
        "street_name",
    )


def site_entries(t: OpsTables) -> DataFrame:
    """The typed addresses as new site rows, every one entered twice."""
    rows = typed_addresses(t).withColumn("surface", F.lit(None).cast("string"))
    twice = F.explode(F.array(F.lit(1_000_000_000), F.lit(2_000_000_000)))
    return rows.withColumn("base", twice).withColumn("site_id", F.col("base") + F.col("entry_id")).drop("entry_id", "base")


def chosen_settings(t: OpsTables) -> DataFrame:
    """Settings an owner would take from the books: busiest operator, usual length, earliest start."""
    done = t.clears.where((F.col("status") == "completed") & F.col("operator_id").isNotNull())
    busiest = done.groupBy("operator_id").agg(F.count("*").alias("n")).agg(
        F.max(F.struct("n", "operator_id"))["operator_id"].cast("string").alias("value")
    )
    usual = t.clears.groupBy("duration_minutes").agg(F.count("*").alias("n")).agg(
        F.max(F.struct("n", "duration_minutes"))["duration_minutes"].cast("string").alias("value")
    )
    earliest = t.clears.agg(F.min(F.substring("scheduled_start", 12, 5)).alias("value"))
    parts = (("default_operator_id", busiest), ("default_clear_minutes", usual), ("default_clear_start", earliest))
    out = None
    for key, frame in parts:
        row = frame.select(F.lit(key).alias("key"), "value")
        out = row if out is None else out.unionByName(row)
    return out
