"""Operational boards: what is planned, what is on today, what is left, what is about to be missed."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.functions import labels
from frostline.functions.clock import (
    day,
    epoch_wall_seconds,
    iso_seconds,
    local_date,
    on_days,
    local_ts,
    minutes_until,
    plus_minutes,
    wall_seconds,
)
from frostline.functions.settings import setting
from frostline.functions.sla import with_sla
from frostline.operators.billing import STORM_KEY, storm_facts
from frostline.schemas import OPEN_STORM
from frostline.sources.tables import OpsTables, merged

WARNING_MINUTES = 60


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def site_facts(sites: DataFrame) -> DataFrame:
    return sites.select(
        "site_id", "contract_id", "address", "city", "state", "zip", "street_name", "place_label",
        F.col("surface").alias("site_surface"), F.col("sla_deadline").alias("site_sla"),
        F.col("access_notes").alias("site_access_notes"), "ext_location_id",
    )


def contract_facts(contracts: DataFrame) -> DataFrame:
    return contracts.select("contract_id", "contract_name", "contract_type", F.col("sla_deadline").alias("contract_sla"))


def crew_facts(operators: DataFrame) -> DataFrame:
    return operators.select("operator_id", "operator_name", "ext_worker_id")


def with_surroundings(t: OpsTables, clears: DataFrame) -> DataFrame:
    """Clears joined to storm, site, contract and (if any) operator, with the SLA clock worked out.

    Sites meet their contracts first, so clears are shuffled for neither alone.
    """
    sites = site_facts(t.sites).join(merged(contract_facts(t.contracts)), "contract_id")
    joined = (
        clears.join(storm_facts(t.storms), STORM_KEY)
        .join(sites, "site_id")
        .join(crew_facts(t.operators), "operator_id", "left")
    )
    return with_sla(joined, t.settings)


def site_day_events(clears: DataFrame, wanted: DataFrame) -> DataFrame:
    """The event of a site and day: that of the lowest clear id, whatever that clear's status.

    ``wanted`` narrows the fact table to the site-days asked for before anything is shuffled. The aggregate
    combines on the map side, so a site-day with very many clears costs one row per task.
    """
    dated = clears.where(F.col("ext_event_id").isNotNull()).select(
        "site_id", local_date(F.col("scheduled_start")).alias("start_day"), "clear_id", "ext_event_id"
    )
    return (
        dated.join(wanted.select("site_id", "start_day").distinct(), ["site_id", "start_day"], "left_semi")
        .groupBy("site_id", "start_day")
        .agg(F.min_by("ext_event_id", "clear_id").alias("day_event_id"))
    )


def dispatch_rows(t: OpsTables, clears: DataFrame, as_of: datetime, default_minutes: int | None = None) -> DataFrame:
    """Everything needed to dispatch ``clears``: every column either board shows, unsorted.

    ``default_minutes`` replaces a missing duration when the end of the window is worked out.
    """
    own = clears.withColumn("start_day", local_date(F.col("scheduled_start")))
    events = site_day_events(t.clears, own.where(F.col("ext_event_id").isNull()))
    rows = with_surroundings(t, own.join(events, ["site_id", "start_day"], "left"))
    start = local_ts(F.col("scheduled_start"))
    minutes = F.col("duration_minutes")
    if default_minutes is not None:
        minutes = F.coalesce(minutes, F.lit(default_minutes))
    offset = setting(t.settings, "timezone_offset")
    event = F.coalesce("ext_event_id", "day_event_id")
    return rows.withColumns({
        "start_iso": F.concat(iso_seconds(start), offset),
        "end_iso": F.concat(iso_seconds(plus_minutes(start, minutes)), offset),
        "minutes_to_deadline": minutes_until(F.col("deadline_ts"), as_of),
        "street_address": labels.street_address(),
        "location_name": labels.location_name(),
        "event_title": labels.event_title(F.col("storm_date")),
        "needs_location": flag(F.col("ext_location_id").isNull()),
        "ext_event_id": event,
        "needs_event": flag(event.isNull()),
        "event_start_date": F.col("start_day"),
        "event_end_date": F.col("start_day"),
        "needs_shift": flag(F.col("ext_shift_id").isNull() & (F.col("status") == "planned")),
        "loc_idempotency_key": labels.keyed(labels.LOCATION_KEY, F.col("site_id")),
        "event_idempotency_key": labels.event_key(F.col("site_id"), F.col("start_day")),
        "shift_idempotency_key": labels.keyed(labels.SHIFT_KEY, F.col("clear_id")),
    })


# The columns of the boards, in the order they are shown.
_WINDOW = ("clear_id", "status", "is_adhoc", "scheduled_start", "duration_minutes", "start_iso", "end_iso")
_STORM = ("storm_id", "storm_ref", "storm_name", "storm_date", "storm_type", "storm_status")
_CLOCK = ("sla_deadline", "sla_deadline_at", "minutes_to_deadline")
_PLACE = (
    "site_id", "address", "city", "state", "zip", "street_address", "location_name", "event_title", "site_surface",
    "site_access_notes", "ext_location_id", "needs_location",
)
_DISPATCH = ("ext_event_id", "needs_event", "event_start_date", "event_end_date", "ext_shift_id", "needs_shift")
_CREW = ("operator_id", "operator_name", "ext_worker_id")
_PAYER = ("contract_id", "contract_name", "contract_type")
_PROOF = (
    "surface", "condition", "salt_applied", "photo_count", "gps_verified", "checkin_distance_m", "checked_in_at",
    "checked_out_at",
)
_KEYS = ("loc_idempotency_key", "event_idempotency_key", "shift_idempotency_key")

PLANNED_COLUMNS = (*_WINDOW, *_STORM, *_CLOCK, *_PLACE, *_DISPATCH, *_CREW, *_PAYER, "notes", *_KEYS)
TODAY_COLUMNS = (*_WINDOW, *_STORM, *_CLOCK, *_PLACE, *_DISPATCH, *_CREW, *_PAYER, *_PROOF, "notes", *_KEYS)


def planned_rows(t: OpsTables, as_of: datetime, among: Column | None = None) -> DataFrame:
    """Planned clears ready for dispatch, unsorted; ``among`` narrows them on the clear's own columns."""
    planned = t.clears.where(F.col("status") == "planned")
    if among is not None:
        planned = planned.where(among)
    return dispatch_rows(t, planned, as_of)


def clears_planned(t: OpsTables, as_of: datetime) -> DataFrame:
    return planned_rows(t, as_of).orderBy("scheduled_start", "street_name", "clear_id").select(*PLANNED_COLUMNS)


def clears_upcoming(t: OpsTables, as_of: datetime, days: int = 7) -> DataFrame:
    """Planned clears from today through the next ``days - 1`` days."""
    week = on_days("scheduled_start", as_of, as_of + timedelta(days=days - 1))
    return planned_rows(t, as_of, week).orderBy("scheduled_start", "clear_id").select(*PLANNED_COLUMNS)


def clears_today(t: OpsTables, as_of: datetime) -> DataFrame:
    """Planned and completed clears that start today."""
    on_board = F.col("status").isin("planned", "completed") & on_days("scheduled_start", as_of, as_of)
    rows = dispatch_rows(t, t.clears.where(on_board), as_of, default_minutes=180)
    return rows.orderBy("scheduled_start", "street_name", "clear_id").select(*TODAY_COLUMNS)


def open_storms(t: OpsTables) -> DataFrame:
    return t.storms.where(F.col("status").isin(*OPEN_STORM))


def active_sites(t: OpsTables) -> DataFrame:
    """Active sites of active contracts (a NULL flag is not active)."""
    contracts = t.contracts.where(F.col("is_active") == 1)
    return site_facts(t.sites.where(F.col("is_active") == 1)).join(merged(contract_facts(contracts)), "contract_id")


def storm_site_pairs(storms: DataFrame, sites: DataFrame, blocks: int = 64) -> DataFrame:
    """One row per open storm and active site, which is the board's grain.

    Done as an equi join on a block number: sites are dealt evenly into blocks by a hash of their id and the few
    open storms are repeated per block. Spark can broadcast the storms if they measure small or shuffle both sides
    by block otherwise; no side has to fit one task. Sites are spread over the shuffle partitions first because
    every row is about to become as many rows as there are open storms.
    """
    spread = int(sites.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sites.withColumn("_block", F.pmod(F.xxhash64("site_id"), F.lit(blocks)).cast("int"))
    # By both columns: a spread by the id alone is left out where a join has dealt the sites already, to few tasks.
    dealt = dealt.repartition(spread, "site_id", "_block")
    repeated = storms.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return dealt.join(repeated, "_block").drop("_block")


def served_sites(t: OpsTables) -> DataFrame:
    """``(storm_id, contract_id, served, planned)`` of open storms: active sites with a clear that stands, and clears
    that are still planned there. Combined per site first, so one big storm is spread over its sites."""
    sites = active_sites(t).select("site_id", "contract_id")
    standing = t.clears.where(F.col("status") != "cancelled").join(
        storm_facts(open_storms(t)).select(*STORM_KEY), STORM_KEY, "left_semi"
    )
    per_site = standing.groupBy("storm_id", "site_id").agg(F.sum(flag(F.col("status") == "planned")).alias("planned"))
    return per_site.join(sites, "site_id").groupBy("storm_id", "contract_id").agg(
        F.count("*").alias("served"), F.sum("planned").alias("planned")
    )


UNCLEARED_COLUMNS = (
    *_STORM, "site_id", "address", "city", "state", "zip", "street_name", "street_address", "location_name",
    "event_title", "site_surface", "site_access_notes", "ext_location_id", "needs_location", *_PAYER, "sla_deadline",
    "sla_deadline_at", "clear_id", "clear_status", "scheduled_start", "ext_event_id", "ext_shift_id", *_CREW,
    "needs_clear", "needs_shift", *_KEYS,
)


def _uncleared(t: OpsTables) -> DataFrame:
    """Open storm x active site without a completed or skipped clear, with its SLA clock but without derived text.

    Pairs that no clear stands for are made from sites that carry the open storms they were served in (no more than
    there are open storms) and need no join of their own; the clears that are left over, and the crews on them, are
    joined to the few pairs they stand for. So the rows of the board are made without being shuffled.
    """
    storms, sites = storm_facts(open_storms(t)), active_sites(t)
    standing = (
        t.clears.where(F.col("status") != "cancelled")
        .join(storms.select(*STORM_KEY), STORM_KEY, "left_semi")
        .select(
            "storm_id", "site_id", "clear_id", F.col("status").alias("clear_status"), "scheduled_start",
            "ext_event_id", "ext_shift_id", "operator_id",
        )
    )
    served = standing.groupBy("site_id").agg(F.collect_set("storm_id").alias("_served"))
    pairs = storm_site_pairs(storms, sites.join(served, "site_id", "left"))
    untouched = pairs.where(~F.coalesce(F.array_contains("_served", F.col("storm_id")), F.lit(False))).drop("_served")
    left_over = (
        standing.where(F.col("clear_id").isNull() | (F.col("clear_status") == "planned"))
        .join(storms, "storm_id").join(sites, "site_id").join(crew_facts(t.operators), "operator_id", "left")
    )
    return with_sla(left_over.unionByName(untouched, allowMissingColumns=True), t.settings)


def _with_texts(rows: DataFrame) -> DataFrame:
    """The derived columns of the board; they need no other row."""
    has_clear = F.col("clear_id").isNotNull()
    return rows.withColumns({
        "street_address": labels.street_address(),
        "location_name": labels.location_name(),
        "event_title": labels.event_title(F.col("storm_date")),
        "needs_location": flag(F.col("ext_location_id").isNull()),
        "needs_clear": flag(~has_clear),
        "needs_shift": flag(has_clear & F.col("ext_shift_id").isNull()),
        "loc_idempotency_key": labels.keyed(labels.LOCATION_KEY, F.col("site_id")),
        "event_idempotency_key": labels.event_key(F.col("site_id"), F.col("storm_date")),
        "shift_idempotency_key": F.when(has_clear, labels.keyed(labels.SHIFT_KEY, F.col("clear_id"))),
    })


def uncleared_rows(t: OpsTables) -> DataFrame:
    """Open storm x active site without a completed or skipped clear, unsorted."""
    return _with_texts(_uncleared(t))


def sites_uncleared(t: OpsTables) -> DataFrame:
    """Text is derived behind the sort, whose shuffle is the only one that all rows of the board pass."""
    in_order = _uncleared(t).orderBy("storm_date", "sla_deadline_at", "street_name", "storm_id", "site_id")
    return _with_texts(in_order).select(*UNCLEARED_COLUMNS)


RISK_COLUMNS = (
    "clear_id", "status", "scheduled_start", "checked_in_at", "ext_shift_id", "needs_shift", *_STORM, *_CLOCK,
    "deadline_passed", "site_id", "address", "street_name", "street_address", "site_access_notes", "contract_id",
    "contract_name", *_CREW,
)


def sla_at_risk(t: OpsTables, as_of: datetime, open_storms_only: bool = False) -> DataFrame:
    """Planned, not checked in, and the deadline is within the hour or past."""
    now = F.lit(epoch_wall_seconds(as_of))
    waiting = t.clears.where((F.col("status") == "planned") & F.col("checked_in_at").isNull())
    # A deadline lies on its storm's date or later, so storms past this day cannot be due: prunes the storm scan
    # and, through the month, the clears partitions.
    last_day = day(as_of + timedelta(minutes=WARNING_MINUTES))
    storms = t.storms.where(F.col("storm_date") <= last_day)
    if open_storms_only:
        storms = storms.where(F.col("status").isin(*OPEN_STORM))
    rows = with_surroundings(t.having(storms=storms), waiting)
    due = wall_seconds(F.col("deadline_ts"))
    return (
        rows.where(due <= now + WARNING_MINUTES * 60)
        .withColumns({
            "minutes_to_deadline": minutes_until(F.col("deadline_ts"), as_of),
            "deadline_passed": flag(due <= now),
            "needs_shift": flag(F.col("ext_shift_id").isNull()),
            "street_address": labels.street_address(),
        })
        .orderBy("minutes_to_deadline", "street_name", "clear_id")
        .select(*RISK_COLUMNS)
    )


def storms_open(t: OpsTables) -> DataFrame:
    """One row per open storm with its clear counts and the active sites that have no clear at all."""
    storms = open_storms(t)
    sites = active_sites(t).select("site_id", F.lit(1).alias("_active"))
    mine = t.clears.where(F.col("status") != "cancelled").join(
        storm_facts(storms).select(*STORM_KEY), STORM_KEY, "left_semi"
    ).select("storm_id", "site_id", "status")

    def counted(status: str) -> Column:
        return F.sum(flag(F.col("status") == status))

    # Per (storm, site) first: both levels combine on the map side, so one big storm is spread over its sites.
    per_site = mine.groupBy("storm_id", "site_id").agg(
        counted("planned").alias("planned"), counted("completed").alias("completed"),
        counted("skipped").alias("skipped"),
    )
    per_storm = per_site.join(sites, "site_id", "left").groupBy("storm_id").agg(
        F.sum("planned").alias("planned_clears"), F.sum("completed").alias("completed_clears"),
        F.sum("skipped").alias("skipped_clears"), F.count("_active").alias("_served"),
    )
    total = sites.agg(F.count("*")).scalar()
    none = F.lit(0).cast("long")
    return (
        storms.join(per_storm, "storm_id", "left")
        .select(
            "storm_id", "storm_ref", "storm_name", "storm_date", "storm_type", "sla_deadline", "status",
            total.alias("active_sites"),
            F.coalesce(F.col("planned_clears"), none).alias("planned_clears"),
            F.coalesce(F.col("completed_clears"), none).alias("completed_clears"),
            F.coalesce(F.col("skipped_clears"), none).alias("skipped_clears"),
            (total - F.coalesce(F.col("_served"), none)).alias("sites_without_clear"),
        )
        .orderBy("storm_date", "storm_id")
    )


def needs_location(t: OpsTables) -> DataFrame:
    """Active sites without a location that have a planned clear, or any at all while a storm is open."""
    unpinned = t.sites.where(F.col("ext_location_id").isNull() & (F.col("is_active") == 1))
    planned = t.clears.where(F.col("status") == "planned").groupBy("site_id").agg(
        F.count("*").alias("planned_clears")
    )
    storm_on = open_storms(t).agg(F.count("*") > 0).scalar()
    return (
        unpinned.join(planned, "site_id", "left")
        .where(F.col("planned_clears").isNotNull() | storm_on)
        .select(
            "site_id", "address", "city", "state", "zip", "street_name",
            labels.street_address().alias("street_address"), labels.location_name().alias("location_name"),
            "ext_location_id", "access_notes", "surface", "contract_id", F.lit(1).alias("needs_location"),
            labels.keyed(labels.LOCATION_KEY, F.col("site_id")).alias("loc_idempotency_key"),
            F.coalesce(F.col("planned_clears"), F.lit(0).cast("long")).alias("planned_clears"),
        )
        .orderBy("site_id")
    )
