"""Looking back: activity, mileage, SLA outcome, evidence, hours, cost."""

from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.functions.clock import day, local_ts, month_of, wall_seconds, whole_minutes
from frostline.operators.billing import STORM_KEY, billable_clears, storm_facts, work_date
from frostline.operators.boards import active_sites, flag, open_storms, served_sites, with_surroundings
from frostline.schemas import MILES, SALTED
from frostline.sources.tables import OpsTables, merged

# Metered prices in dollars.
PRICE_NEW_LOCATION = Decimal("0.03")
PRICE_PUNCH = Decimal("0.10")
PRICE_PROOF_WITH_PHOTOS = Decimal("0.15")
PRICE_PROOF = Decimal("0.05")


def mileage_by_month(t: OpsTables) -> DataFrame:
    off_clear = F.when(F.col("clear_id").isNull(), F.col("miles")).otherwise(F.lit(0).cast(MILES))
    return t.mileage.groupBy(month_of(F.col("trip_date")).alias("month")).agg(
        F.count("trip_id").alias("trips"), F.sum("miles").alias("miles"), F.sum("deduction").alias("deduction"),
        F.sum(off_clear).alias("non_clear_miles"),
    ).orderBy(F.desc("month"))


def operator_activity(t: OpsTables, as_of: datetime, days: int = 30) -> DataFrame:
    """Per operator: completed work of the last ``days`` days (both ends included, no upper bound) and plans ahead."""
    first = as_of - timedelta(days=days)
    since, unseen = first.strftime("%Y-%m-%d"), F.col("checked_in_at").isNull()
    # The raw texts on their own, so that the range reaches the scan; the exact day beside it.
    raw = (F.col("checked_in_at") >= since) | (unseen & (F.col("scheduled_start") >= since))
    recent = t.clears.where((F.col("status") == "completed") & raw & (work_date() >= day(first)))

    def counted(condition: Column) -> Column:
        return F.sum(flag(condition))

    done = recent.groupBy("operator_id").agg(
        F.count("*").alias("clears"),
        counted(F.col("condition") == "bare").alias("bare"),
        counted(F.col("condition") == "packed").alias("packed"),
        counted(F.col("condition") == "icy").alias("icy"),
        counted(F.col("salt_applied").isin(*SALTED)).alias("salted"),
        counted(F.col("is_adhoc") == 1).alias("adhoc"),
        counted(F.col("gps_verified") == 1).alias("verified"),
        counted(F.col("photo_count") > 0).alias("photos"),
        F.max(F.coalesce(F.substring("checked_in_at", 1, 16), F.col("scheduled_start"))).alias("last_clear_at"),
    )
    # Starts are compared as text, as they are stored: 'HH:MM' sorts before 'HH:MM:SS' of the same minute.
    this_minute = as_of.strftime("%Y-%m-%dT%H:%M")
    ahead = t.clears.where(
        (F.col("status") == "planned") & (F.col("scheduled_start") >= F.lit(this_minute))
    ).groupBy("operator_id").agg(F.count("*").alias("ahead"))
    none = F.lit(0).cast("long")

    def shown(name: str, out: str) -> Column:
        return F.coalesce(F.col(name), none).alias(out)

    share = F.round(F.col("verified") * F.lit(Decimal("100.0")) / F.col("clears"), 1).cast("decimal(5,1)")
    return (
        t.operators.join(done, "operator_id", "left").join(ahead, "operator_id", "left")
        .select(
            "operator_id", "operator_name", "is_owner", "is_active", shown("clears", "clears_30d"),
            shown("bare", "bare_30d"), shown("packed", "packed_30d"), shown("icy", "icy_30d"),
            shown("salted", "salted_30d"), shown("adhoc", "adhoc_30d"), shown("verified", "gps_verified_30d"),
            F.when(F.col("clears") > 0, share).alias("gps_verified_pct"), shown("photos", "with_photo_30d"),
            "last_clear_at", shown("ahead", "planned_ahead"),
        )
        .orderBy(F.desc("clears_30d"), "operator_name", "operator_id")
    )


def sla_outcome(t: OpsTables) -> DataFrame:
    """Per completed clear: minutes between check-in (cut to the minute) and the deadline; late is a logged miss."""
    done = t.clears.where((F.col("status") == "completed") & F.col("checked_in_at").isNotNull())
    rows = with_surroundings(t, done)
    arrived = local_ts(F.concat(F.substring("checked_in_at", 1, 16), F.lit(":00")))
    margin = whole_minutes(wall_seconds(F.col("deadline_ts")) - wall_seconds(arrived))
    return rows.withColumn("margin_minutes", margin).select(
        "clear_id", "storm_id", "storm_ref", "storm_date", "site_id", "contract_id", "contract_name", "operator_id",
        "operator_name", "checked_in_at", "sla_deadline_at", "margin_minutes",
        flag(F.col("margin_minutes") < 0).alias("missed"),
    )


def sla_outcome_by(t: OpsTables, *keys: str) -> DataFrame:
    """Outcome rolled up, for example by contract, operator or storm."""
    return sla_outcome(t).groupBy(*keys).agg(
        F.count("*").alias("clears"), F.sum("missed").alias("missed"),
        F.min("margin_minutes").alias("worst_margin"), F.max("margin_minutes").alias("best_margin"),
    )


def visit_evidence(t: OpsTables) -> DataFrame:
    """Was the site visited: punches, distance, proof and a plain verdict for every clear that is not cancelled."""
    rows = with_surroundings(t, t.clears.where(F.col("status") != "cancelled"))
    verdict = (
        F.when(F.col("checked_in_at").isNull(), "no check-in")
        .when(F.col("gps_verified") == 1, "verified on site")
        .when(F.col("gps_verified") == 0, "phone not at the site")
        .otherwise("checked in, not verified")
    )
    return rows.select(
        "clear_id", "storm_ref", "site_id", F.coalesce("street_name", "address").alias("site_label"), "operator_id",
        "operator_name", "status", "checked_in_at", "checked_out_at", "gps_verified", "checkin_distance_m",
        "surface", "condition", "salt_applied", "photo_count", verdict.alias("verdict"),
    )


def _dollars(price: Decimal) -> Column:
    return F.lit(price).cast("decimal(6,2)")


def storm_cost(t: OpsTables) -> DataFrame:
    """Metered cost per storm: pins still to buy, two punches per visited clear, one proof read each.

    A site that several storms are waiting for is pinned once, by its earliest planned clear.
    """
    unpinned = t.sites.where(F.col("ext_location_id").isNull()).select("site_id")
    pins = (
        t.clears.where(F.col("status") == "planned").join(unpinned, "site_id", "left_semi")
        .groupBy("site_id").agg(F.min_by("storm_id", "clear_id").alias("storm_id"))
        .groupBy("storm_id").agg(F.count("*").alias("new_locations"))
    )
    billed = t.clears.where(F.col("status").isin("planned", "completed"))
    # Planned visits are budgeted with photos, which the form requires.
    bare_proof = (F.col("status") == "completed") & (F.coalesce(F.col("photo_count"), F.lit(0)) == 0)
    visits = billed.groupBy("storm_id").agg(
        F.count("*").alias("visits"), F.sum(flag(bare_proof)).alias("proofs_without_photos")
    )
    none = F.lit(0).cast("long")
    counted = t.storms.join(visits, "storm_id").join(pins, "storm_id", "left").select(
        "storm_id", "storm_ref", "visits", F.coalesce("proofs_without_photos", none).alias("proofs_without_photos"),
        F.coalesce("new_locations", none).alias("new_locations"),
    )
    cost = (
        F.col("new_locations") * _dollars(PRICE_NEW_LOCATION)
        + F.col("visits") * 2 * _dollars(PRICE_PUNCH)
        + (F.col("visits") - F.col("proofs_without_photos")) * _dollars(PRICE_PROOF_WITH_PHOTOS)
        + F.col("proofs_without_photos") * _dollars(PRICE_PROOF)
    )
    return counted.withColumn("cost", cost.cast("decimal(18,2)"))


def storm_recap(t: OpsTables) -> DataFrame:
    """Per storm and contract: what was done, in what condition, what it bills and (open storms) what is left.

    The contracts that have no clear at all on an open storm share one row without a contract: the count of their sites.
    """

    def counted(condition: Column) -> Column:
        return F.sum(flag(condition))

    done = F.col("status") == "completed"
    work = billable_clears(t).groupBy("storm_id", "contract_id").agg(
        counted(done).alias("completed"),
        counted(done & F.col("salt_applied").isin(*SALTED)).alias("salted"),
        counted(done & (F.col("condition") == "bare")).alias("bare"),
        counted(done & (F.col("condition") == "packed")).alias("packed"),
        counted(done & (F.col("condition") == "icy")).alias("icy"),
        counted(F.col("status") == "skipped").alias("skipped"),
        F.sum("billable_total").alias("billable"),
        F.sum(F.when(F.col("invoiced") == 0, F.col("billable_total"))).alias("receivable"),
    )
    return recap_of(t, work, served_sites(t))


def recap_of(t: OpsTables, work: DataFrame, served: DataFrame) -> DataFrame:
    """The recap from the work by storm and contract and the sites served by storm and contract (of open storms)."""
    names = merged(t.contracts.select("contract_id", "contract_name"))
    storms = t.storms.select("storm_id", "storm_ref", "storm_date")
    none = F.lit(0).cast("long")
    # What is left of a contract: its active sites less the served ones, plus what is still planned there. No pairs.
    sites = active_sites(t).groupBy("contract_id").agg(F.count("*").alias("_sites"))
    counts = work.join(sites, "contract_id", "left").join(served, ["storm_id", "contract_id"], "left")
    counts = counts.join(open_storms(t).select("storm_id", F.lit(True).alias("_open")), "storm_id", "left")
    left = F.coalesce("_sites", none) - F.coalesce("served", none) + F.coalesce("planned", none)
    counts = counts.withColumn("uncleared", F.when(F.col("_open"), left).otherwise(none))
    # Contracts without a clear on an open storm share a row: all active sites less those of the contracts above.
    every = active_sites(t).agg(F.count("*")).scalar()
    seen = counts.where("_open").groupBy("storm_id").agg(F.sum(F.coalesce("_sites", none)).alias("_seen"))
    rest = open_storms(t).select("storm_id").join(seen, "storm_id", "left").select(
        "storm_id", (every - F.coalesce("_seen", none)).alias("uncleared")
    ).where("uncleared > 0")
    zero = [F.lit(0).cast("long").alias(c) for c in ("completed", "salted", "bare", "packed", "icy", "skipped")]
    money = [F.lit(None).cast(counts.schema[c].dataType).alias(c) for c in ("billable", "receivable")]
    rest = rest.join(storms, "storm_id").select(
        "storm_id", "storm_ref", "storm_date", F.lit(None).cast("long").alias("contract_id"),
        F.lit(None).cast("string").alias("contract_name"), *zero, "uncleared", *money,
    )
    return counts.join(storms, "storm_id").join(names, "contract_id").select(*rest.columns).unionByName(rest)


def operator_hours(t: OpsTables) -> DataFrame:
    """Hours per operator and day from check-in to check-out of every clear with both punches."""
    came, went = local_ts(F.col("checked_in_at")), local_ts(F.col("checked_out_at"))
    stays = t.clears.where(
        F.col("operator_id").isNotNull() & F.col("checked_in_at").isNotNull() & F.col("checked_out_at").isNotNull()
    ).select(
        "operator_id", came.cast("date").alias("work_date"), (wall_seconds(went) - wall_seconds(came)).alias("stay")
    )
    return stays.groupBy("operator_id", "work_date").agg(
        F.count("*").alias("visits"), F.sum("stay").alias("seconds"),
    ).join(t.operators.select("operator_id", "operator_name"), "operator_id").select(
        "operator_id", "operator_name", "work_date", "visits", "seconds",
        F.round(F.col("seconds").cast("decimal(18,0)") / 3600, 2).cast("decimal(12,2)").alias("hours"),
    )


def punch_rows(t: OpsTables) -> DataFrame:
    """The raw time sheet: one row per punch kept on a clear."""
    punches = F.explode(F.array(
        F.struct(F.lit("in").alias("punch_type"), F.col("checked_in_at").alias("punched_at")),
        F.struct(F.lit("out").alias("punch_type"), F.col("checked_out_at").alias("punched_at")),
    ))
    return t.clears.select("clear_id", "operator_id", "ext_shift_id", punches.alias("p")).select(
        "clear_id", "operator_id", "ext_shift_id", "p.*"
    ).where(F.col("punched_at").isNotNull())
