"""State changes as table-to-table jobs: the old tables and a batch of commands in, the new rows out.

Nothing is updated in place. A job returns the whole new table, only the rows it adds, or with ``delta`` only the rows
it changes, whole: :class:`frostline.sources.versions.Store` rewrites the months those rows are in. Commands for the
same row are reduced to one before the join, so feeding a batch twice gives the same table.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostline.functions.clock import iso_seconds, local_date
from frostline.functions.labels import (
    CANCEL_KEY,
    LOCATION_KEY,
    SHIFT_KEY,
    SWAP_SUFFIX,
    event_key,
    keyed,
    normalized_address,
)
from frostline.operators.boards import active_sites, open_storms, served_sites, storm_site_pairs
from frostline.operators.defaults import column_defaults, fill_clear_defaults, fill_mileage, touch
from frostline.schemas import CLEARS, MILEAGE, SITES, conform
from frostline.sources.tables import OpsTables, storm_month


def latest(commands: DataFrame, key: str) -> DataFrame:
    """One command per key: the one with the highest ``seq``, whole. Without a ``seq`` a batch has no order; of several
    commands for a key the largest one counts. Combines before the shuffle."""
    rest = [c for c in commands.columns if c not in (key, "seq")]
    if not rest and "seq" not in commands.columns:
        return commands.distinct()
    ordered = F.struct(*[c for c in ("seq",) if c in commands.columns], *rest)
    return commands.groupBy(key).agg(F.max(ordered).alias("_last")).select(key, *[F.col(f"_last.{c}").alias(c) for c in rest])


def apply_commands(
    table: DataFrame, commands: DataFrame, key: str, changes: dict[str, Column], audit_now: datetime,
    only: Column | None = None, delta: bool = False,
) -> DataFrame:
    """Set ``changes`` on the rows named by ``commands`` (whose columns arrive prefixed ``new_``).

    Returns the whole table, or with ``delta`` the changed rows only: then the join is an inner one, and a small
    batch of commands is all that meets the table, without moving it. Commands for clears may name their ``storm_month``;
    then a delta reads those months only.
    """
    if "storm_month" in commands.columns:
        if delta:
            table = table.join(commands.select("storm_month").distinct(), "storm_month", "left_semi").select(*table.columns)
        commands = commands.drop("storm_month")
    orders = latest(commands, key)
    orders = orders.select(key, F.lit(True).alias("_named"), *[F.col(c) for c in orders.columns if c != key])
    hit = F.col("_named").isNotNull() if only is None else F.col("_named").isNotNull() & only
    if delta:
        joined = table.join(orders, key).where(hit).withColumn("_hit", F.lit(True))
    else:
        joined = table.join(orders, key, "left").withColumn("_hit", F.coalesce(hit, F.lit(False)))
    joined = touch(joined, F.col("_hit"), audit_now)
    changed = {
        name: F.when(F.col("_hit"), value).otherwise(F.col(name)).cast(table.schema[name].dataType)
        for name, value in changes.items()
    }
    return joined.withColumns(changed).select(*table.columns)


def _is_planned() -> Column:
    return F.col("status") == "planned"


# -- opening and closing storms -------------------------------------------------------------------------------


def taken_slots(clears: DataFrame) -> DataFrame:
    """(storm, site) pairs that already hold a clear which is not cancelled."""
    return clears.where(F.col("status") != "cancelled").select("storm_id", "site_id")


def new_clears(t: OpsTables, rows: DataFrame) -> DataFrame:
    """Complete freshly inserted clears: planned, unpaid, without external ids, defaults filled."""
    months = t.storms.select("storm_id", storm_month(F.col("storm_date")).alias("storm_month"))
    blank = column_defaults(rows, "clears").join(months, "storm_id", "left")
    return fill_clear_defaults(conform(blank, CLEARS), t.storms, t.sites, t.contracts, t.settings)


def open_storm(
    t: OpsTables, opening: DataFrame, require_active_contract: bool = False, among: Column | None = None,
    id_stride: int = 1_000_000_000, again_stride: int = 10_000_000_000_000_000,
) -> DataFrame:
    """The planned clears of the storms being opened: one per active site, except where one already stands.

    ``opening`` holds storm rows. ``among`` restricts the sites (a contract, a list). Only clears of the storms being
    opened are read: their months are pruned to. Ids are reproducible: ``storm_id * id_stride + site_id``, plus
    ``again_stride`` for every clear the storm and site had before, as long as neither sum reaches the next stride nor
    the largest id; beyond that a 62-bit hash of storm, site and number of earlier clears, negative, so that it never
    meets an id of the first kind.
    """
    if require_active_contract:
        sites = active_sites(t)
    else:
        sites = t.sites.where(F.col("is_active") == 1)
    if among is not None:
        sites = sites.where(among)
    pairs = storm_site_pairs(opening.select("storm_id"), sites.select("site_id"))
    named = opening.select("storm_id", storm_month(F.col("storm_date")).alias("storm_month")).distinct()
    held = t.clears.join(named, ["storm_month", "storm_id"], "left_semi")
    before = held.groupBy("storm_id", "site_id").agg(
        F.count("*").alias("_before"), F.sum(F.when(F.col("status") != "cancelled", 1).otherwise(0)).alias("_standing")
    )
    free = pairs.join(before, ["storm_id", "site_id"], "left").where(F.coalesce("_standing", F.lit(0).cast("long")) == 0)
    times = F.coalesce(F.col("_before"), F.lit(0).cast("long"))
    fits = F.lit(True)  # strides of nothing promise nothing: the caller's ids are as unique as the caller knows
    if id_stride > 0 and again_stride > 0:
        fits = F.col("storm_id").between(0, again_stride // id_stride - 1) & F.col("site_id").between(0, id_stride - 1)
        fits = fits & (times < (1 << 63) // again_stride)
    plain = F.col("storm_id") * id_stride + F.col("site_id") + times * again_stride
    hashed = -F.shiftrightunsigned(F.xxhash64("storm_id", "site_id", times), 2) - 1
    return new_clears(t, free.select("storm_id", "site_id", F.when(fits, plain).otherwise(hashed).alias("clear_id")))


def close_storms(t: OpsTables, audit_now: datetime) -> DataFrame:
    """The storms table with every open storm closed that has nothing left to clear: as many active sites served as
    there are, and none of their clears planned."""
    every = active_sites(t).agg(F.count("*")).scalar()
    served = served_sites(t).groupBy("storm_id").agg(F.sum("served").alias("served"), F.sum("planned").alias("planned"))
    none = F.lit(0).cast("long")
    left = every - F.coalesce("served", none) + F.coalesce("planned", none)
    done = open_storms(t).select("storm_id").join(served, "storm_id", "left").where(left == 0).select("storm_id")
    return apply_commands(t.storms, done, "storm_id", {"status": F.lit("closed")}, audit_now)


# -- answers from the scheduling service ----------------------------------------------------------------------


def _answers(responses: DataFrame) -> DataFrame:
    """``responses(idempotency_key, ext_id)``; a retried key answers with the same id, the lowest is kept."""
    return responses.groupBy(F.col("idempotency_key").alias("_key")).agg(F.min("ext_id").alias("_ext_id"))


def pin_locations(t: OpsTables, responses: DataFrame, audit_now: datetime) -> DataFrame:
    """The sites table with new location ids; a site that is pinned keeps its pin."""
    keyed_sites = t.sites.withColumn("_key", keyed(LOCATION_KEY, F.col("site_id")))
    joined = keyed_sites.join(_answers(responses), "_key", "left")
    hit = F.col("ext_location_id").isNull() & F.col("_ext_id").isNotNull()
    return touch(joined, hit, audit_now).withColumn(
        "ext_location_id", F.coalesce("ext_location_id", "_ext_id")
    ).select(*t.sites.columns)


def _answered(joined: DataFrame, column: str, audit_now: datetime, delta: bool) -> DataFrame:
    """Rows that lack ``column`` take the answer. With ``delta`` the others go, which makes the join an inner one."""
    hit = F.col(column).isNull() & F.col("_ext_id").isNotNull()
    rows = joined.where(hit) if delta else joined
    return touch(rows, hit, audit_now).withColumn(column, F.coalesce(column, "_ext_id"))


def record_events(t: OpsTables, responses: DataFrame, audit_now: datetime, delta: bool = False) -> DataFrame:
    """The clears table with new event ids, set on every clear of the site and day that has none."""
    start_day = local_date(F.col("scheduled_start"))
    joined = t.clears.withColumn("_key", event_key(F.col("site_id"), start_day)).join(
        _answers(responses), "_key", "left"
    )
    return _answered(joined, "ext_event_id", audit_now, delta).select(*t.clears.columns)


def record_shifts(t: OpsTables, responses: DataFrame, audit_now: datetime, delta: bool = False) -> DataFrame:
    """The clears table with new shift ids; answers to a swapped shift carry the suffixed key."""
    plain = F.regexp_replace("idempotency_key", f"^({SHIFT_KEY}-?[0-9]+){SWAP_SUFFIX}$", "$1")
    answers = _answers(responses.withColumn("idempotency_key", plain))
    joined = t.clears.withColumn("_key", keyed(SHIFT_KEY, F.col("clear_id"))).join(answers, "_key", "left")
    return _answered(joined, "ext_shift_id", audit_now, delta).select(*t.clears.columns)


# -- "I'm here now" -------------------------------------------------------------------------------------------


def planned_windows(t: OpsTables) -> DataFrame:
    return t.clears.where(_is_planned()).select("site_id", "clear_id", "storm_id", "ext_event_id", "ext_shift_id", "scheduled_start")


def adhoc_candidates(t: OpsTables, pattern: str) -> DataFrame:
    """Sites whose street or address matches, each with its planned clears (storm only while it is open)."""
    planned = planned_windows(t)
    storms = open_storms(t).select("storm_id", "storm_ref")
    matching = t.sites.where(F.col("street_name").ilike(pattern) | F.col("address").ilike(pattern))
    return (
        matching.select("site_id", "street_name", "address", "ext_location_id")
        .join(planned, "site_id", "left")
        .join(storms, "storm_id", "left")
        .select(
            "site_id", "street_name", "address", "ext_location_id", "clear_id", "ext_event_id", "ext_shift_id",
            "scheduled_start", "storm_ref",
        )
    )


def latest_open_storm(t: OpsTables) -> Column:
    """Id of the open storm with the latest date (the highest id when several share it)."""
    stamped = F.struct("storm_date", "storm_id")
    return open_storms(t).agg(F.max(stamped)["storm_id"]).scalar()


def adhoc_verdicts(t: OpsTables, requests: DataFrame) -> DataFrame:
    """What becomes of every request: ``planned clear`` (use that one), ``already served`` (needs a new storm),
    ``no open storm``, ``unknown site``, ``repeated`` (another request for the site counts) or ``inserted``."""
    counted = latest(requests, "site_id").select(F.col("clear_id").alias("_counts"), F.col("site_id"))
    planned = t.clears.where(_is_planned()).select("site_id").distinct().withColumn("_planned", F.lit(True))
    storm = latest_open_storm(t)
    served = taken_slots(t.clears).where(F.col("storm_id") == storm).select("site_id").distinct().withColumn("_served", F.lit(True))
    known = t.sites.select("site_id").withColumn("_site", F.lit(True))
    verdict = (
        F.when(F.col("_site").isNull(), "unknown site")
        .when(F.col("_planned"), "planned clear")
        .when(storm.isNull(), "no open storm")
        .when(F.col("_served"), "already served")
        .when(F.col("clear_id") != F.col("_counts"), "repeated")
        .otherwise("inserted")
    )
    judged = requests.join(counted, "site_id", "left").join(planned, "site_id", "left").join(served, "site_id", "left").join(known, "site_id", "left")
    return judged.select("clear_id", "site_id", "operator_id", verdict.alias("verdict"))


def adhoc_inserts(t: OpsTables, requests: DataFrame, minutes: int = 30) -> DataFrame:
    """Clears to insert for ``requests(clear_id, site_id, operator_id, at)``.

    A site with a planned clear uses that one; a site already cleared on the storm needs a new storm. Both are
    left out here. ``at`` is a wall-clock TIMESTAMP_NTZ.
    """
    asked = latest(requests, "site_id").withColumn("storm_id", latest_open_storm(t)).where(
        F.col("storm_id").isNotNull()
    )
    free = asked.join(
        t.clears.where(_is_planned()).select("site_id"), "site_id", "left_anti"
    ).join(taken_slots(t.clears), ["storm_id", "site_id"], "left_anti")
    return new_clears(t, free.select(
        "clear_id", "storm_id", "site_id", "operator_id", F.substring(iso_seconds(F.col("at")), 1, 16).alias("scheduled_start"),
        F.lit(minutes).alias("duration_minutes"), F.lit(1).alias("is_adhoc"),
    ))


# -- results --------------------------------------------------------------------------------------------------


def shift_results(punches: DataFrame) -> DataFrame:
    """One row per shift that was checked into and out of: first in, last out, how the check-in was verified."""
    came = F.when(F.col("punch_type") == "in", F.col("punched_at"))
    went = F.when(F.col("punch_type") == "out", F.col("punched_at"))
    first_in = F.when(F.col("punch_type") == "in", F.struct("punched_at", "gps_verified", "distance_m"))
    return punches.groupBy("shift_id").agg(
        F.min(came).alias("in_at"), F.max(went).alias("out_at"), F.min(first_in).alias("first_in")
    ).where(F.col("in_at").isNotNull() & F.col("out_at").isNotNull()).select(
        F.col("shift_id").alias("ext_shift_id"), "in_at", "out_at",
        F.col("first_in.gps_verified").alias("in_verified"), F.col("first_in.distance_m").alias("in_distance"),
    )


def unread_proofs(t: OpsTables, proofs: DataFrame) -> DataFrame:
    """Submissions that are not stored on any clear yet, numbered within their event by time."""
    known = t.clears.where(F.col("report_id").isNotNull()).select(F.col("report_id").alias("submission_id"))
    photos = F.size(F.filter("media", lambda m: m["field"] == "after"))
    fresh = proofs.where(F.col("event_id").isNotNull()).join(known, "submission_id", "left_anti").dropDuplicates(["submission_id"]).select(
        F.col("event_id").alias("ext_event_id"), "submitted_at",
        F.struct("submission_id", "data.*", F.greatest(photos, F.lit(0)).alias("photos")).alias("p"),
    )
    # An event is one site on one day, so its window is a handful of rows.
    by_time = Window.partitionBy("ext_event_id").orderBy("submitted_at", "p.submission_id")
    return fresh.select("ext_event_id", "p", F.row_number().over(by_time).alias("turn"))


def apply_results(t: OpsTables, punches: DataFrame, proofs: DataFrame, audit_now: datetime, delta: bool = False) -> DataFrame:
    """The clears table after a pull: planned clears whose shift was checked out become completed.

    A shift without punches changes nothing, and a submission that is already on a clear is never read again.
    """
    planned = t.clears.where(_is_planned() & F.col("ext_shift_id").isNotNull()).select(
        "clear_id", "ext_shift_id", "ext_event_id"
    )
    # The visits of an event in order of check-in take its submissions in order of time, each one once. A visit without
    # an event has none to take and is not numbered: all of them would be one group.
    by_time = Window.partitionBy("ext_event_id").orderBy("in_at", "clear_id")
    visits = planned.join(shift_results(punches), "ext_shift_id")
    turns = visits.where(F.col("ext_event_id").isNotNull()).select(
        "clear_id", "ext_event_id", F.row_number().over(by_time).alias("turn")
    )
    taken = turns.join(unread_proofs(t, proofs), ["ext_event_id", "turn"]).select("clear_id", "p")
    pulled = visits.join(taken, "clear_id", "left").select("clear_id", "in_at", "out_at", "in_verified", "in_distance", "p")
    hit = F.col("in_at").isNotNull()
    found = t.clears.join(pulled, "clear_id", "left")
    joined = touch(found.where(hit) if delta else found, hit, audit_now)

    def replaced(value: Column, name: str) -> Column:
        return F.when(hit, value).otherwise(F.col(name))

    return joined.withColumns({
        "status": replaced(F.lit("completed"), "status"),
        "surface": replaced(F.col("p.surface"), "surface"),
        "condition": replaced(F.col("p.condition"), "condition"),
        "salt_applied": replaced(F.col("p.salt_applied"), "salt_applied"),
        "photo_count": replaced(F.coalesce(F.col("p.photos"), F.lit(0)), "photo_count"),
        "report_id": replaced(F.col("p.submission_id"), "report_id"),
        "checked_in_at": replaced(F.col("in_at"), "checked_in_at"),
        "checked_out_at": replaced(F.col("out_at"), "checked_out_at"),
        "gps_verified": replaced(F.col("in_verified"), "gps_verified"),
        "checkin_distance_m": replaced(F.col("in_distance"), "checkin_distance_m"),
        "notes": replaced(F.coalesce(F.col("p.notes"), F.col("notes")), "notes"),
    }).select(*t.clears.columns)


def append_trips(t: OpsTables, trips: DataFrame) -> DataFrame:
    """Mileage rows to append, with the rate of today as a snapshot."""
    return fill_mileage(conform(trips, MILEAGE), t.settings)


# -- changes to planned clears --------------------------------------------------------------------------------


def reschedule(t: OpsTables, commands: DataFrame, audit_now: datetime, delta: bool = False) -> DataFrame:
    """``commands(clear_id, new_start)``: same day, new time; event and shift stay."""
    return apply_commands(
        t.clears, commands, "clear_id", {"scheduled_start": F.col("new_start")}, audit_now, _is_planned(), delta
    )


def cancel(t: OpsTables, commands: DataFrame, audit_now: datetime, delta: bool = False) -> DataFrame:
    """``commands(clear_id)``: planned windows that are called off."""
    return apply_commands(
        t.clears, commands, "clear_id", {"status": F.lit("cancelled")}, audit_now, _is_planned(), delta
    )


def skip(t: OpsTables, commands: DataFrame, audit_now: datetime, delta: bool = False) -> DataFrame:
    """``commands(clear_id, new_other_fee)``: closed without a visit; a fee may be charged."""
    fee = F.coalesce(F.col("new_other_fee"), F.lit(0))
    return apply_commands(
        t.clears, commands, "clear_id", {"status": F.lit("skipped"), "other_fee": fee}, audit_now, _is_planned(), delta
    )


def swap_operator(t: OpsTables, commands: DataFrame, audit_now: datetime, delta: bool = False) -> DataFrame:
    """``commands(clear_id, new_operator_id)``: another operator takes over, the old shift is given up."""
    changes = {"operator_id": F.col("new_operator_id"), "ext_shift_id": F.lit(None)}
    return apply_commands(t.clears, commands, "clear_id", changes, audit_now, _is_planned(), delta)


def cancellations(t: OpsTables, commands: DataFrame) -> DataFrame:
    """Requests to give up the shifts of the named planned clears. The reason is generic: operators see it."""
    return (
        t.clears.where(_is_planned() & F.col("ext_shift_id").isNotNull())
        .join(commands.select("clear_id"), "clear_id", "left_semi")
        .select(
            "clear_id", "ext_shift_id", F.lit("cancelled").alias("reason"),
            keyed(CANCEL_KEY, F.col("ext_shift_id")).alias("idempotency_key"),
        )
    )


def move_day(t: OpsTables, commands: DataFrame, audit_now: datetime, delta: bool = False) -> DataFrame:
    """``commands(clear_id, new_clear_id, new_start)``: the clears table after moving clears to another day.

    A same-day event cannot move, so the old clear is cancelled and a new one without event or shift takes its
    slot. The slot is checked again: a clear that still stands on the storm and site blocks the replacement.
    """
    cancelled = cancel(t, commands, audit_now)
    moved = t.clears.where(_is_planned()).select(
        "clear_id", "storm_id", "site_id", "operator_id", "duration_minutes"
    ).join(latest(commands, "clear_id"), "clear_id")
    fresh = moved.select(
        F.col("new_clear_id").alias("clear_id"), "storm_id", "site_id", "operator_id", "duration_minutes",
        F.col("new_start").alias("scheduled_start"),
    ).join(taken_slots(cancelled), ["storm_id", "site_id"], "left_anti")
    changed = cancel(t, commands, audit_now, delta) if delta else cancelled
    return changed.unionByName(new_clears(t, fresh))


# -- dimensions and settings ----------------------------------------------------------------------------------


def change_terms(contracts: DataFrame, commands: DataFrame, audit_now: datetime) -> DataFrame:
    """``commands(contract_id, new_per_clear_fee, new_salt_fee, new_sla_deadline)``; NULL leaves a term as it is.

    Only the contract changes. Fees already on clears are snapshots; deadlines follow because views compute them.
    """
    changes = {
        name: F.coalesce(F.col(f"new_{name}"), F.col(name)) for name in ("per_clear_fee", "salt_fee", "sla_deadline")
    }
    return apply_commands(contracts, commands, "contract_id", changes, audit_now)


def change_sla(table: DataFrame, commands: DataFrame, key: str, audit_now: datetime) -> DataFrame:
    """``commands(<key>, new_sla_deadline)`` for contracts, sites or storms."""
    return apply_commands(table, commands, key, {"sla_deadline": F.col("new_sla_deadline")}, audit_now)


def deactivate(table: DataFrame, commands: DataFrame, key: str, audit_now: datetime) -> DataFrame:
    """``commands(<key>)`` for contracts, sites or operators."""
    return apply_commands(table, commands, key, {"is_active": F.lit(0)}, audit_now)


def upsert_settings(settings: DataFrame, seeds: DataFrame, updates: DataFrame) -> DataFrame:
    """Seeds fill missing keys only; updates win over what is there."""
    ranked = (
        settings.select("key", "value", F.lit(2).alias("rank"))
        .unionByName(seeds.select("key", "value", F.lit(1).alias("rank")))
        .unionByName(updates.select("key", "value", F.lit(3).alias("rank")))
    )
    return ranked.groupBy("key").agg(F.max(F.struct("rank", "value"))["value"].alias("value"))


def look_up_addresses(t: OpsTables, entries: DataFrame) -> DataFrame:
    """Find the site of each typed ``(entry_id, address, city, state, zip)``; a miss has a NULL site.

    Should the book hold an address twice, the lowest site answers, so the result keeps one row per entry.
    """
    known = t.sites.groupBy("normalized_address").agg(
        F.min("site_id").alias("site_id"), F.min_by("ext_location_id", "site_id").alias("ext_location_id")
    )
    typed = entries.withColumn(
        "normalized_address", normalized_address(*[F.col(c) for c in ("address", "city", "state", "zip")])
    )
    return typed.join(known, "normalized_address", "left").select(
        "entry_id", "normalized_address", "site_id", "ext_location_id",
        F.when(F.col("site_id").isNull(), 1).otherwise(0).alias("is_new"),
    )


def append_sites(t: OpsTables, entries: DataFrame) -> DataFrame:
    """Judge new site rows: ``verdict`` is accepted, known address, repeated in batch or unknown contract.

    Columns left out get their declared defaults.

    Within the batch the lowest ``site_id`` of an address wins. Write the accepted rows, hand back the others.
    """
    rows = column_defaults(entries, "sites").withColumn(
        "normalized_address", normalized_address(*[F.col(c) for c in ("address", "city", "state", "zip")])
    )
    first = rows.groupBy("normalized_address").agg(F.min("site_id").alias("_first"))
    known = t.sites.select("normalized_address").distinct().withColumn("_known", F.lit(True))
    payers = t.contracts.select("contract_id").distinct().withColumn("_payer", F.lit(True))
    verdict = (
        F.when(F.col("_payer").isNull(), "unknown contract")
        .when(F.col("_known").isNotNull(), "known address")
        .when(F.col("site_id") != F.col("_first"), "repeated in batch")
        .otherwise("accepted")
    )
    judged = (
        rows.join(first, "normalized_address").join(known, "normalized_address", "left")
        .join(payers, "contract_id", "left").withColumn("verdict", verdict)
    )
    return judged.select(*[c for c in SITES.names if c in judged.columns], "verdict")


def append_unique(table: DataFrame, entries: DataFrame, key: str, ident: str) -> DataFrame:
    """Judge new contracts or operators by a key that must be unique when it is present."""
    if key not in entries.columns:
        raise ValueError(f"entries lack {key}")
    first = entries.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(ident).alias("_first"))
    known = table.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_known", F.lit(True))
    verdict = (
        F.when(F.col("_known").isNotNull(), "known key")
        .when(F.col(ident) != F.col("_first"), "repeated in batch")
        .otherwise("accepted")
    )
    return entries.join(first, key, "left").join(known, key, "left").withColumn("verdict", verdict).drop(
        "_first", "_known"
    )


def merge_sites(t: OpsTables, same: Column) -> DataFrame:
    """Sites that stand for one lot (equal, non-NULL ``same``) mapped to the one that is kept, the lowest id.

    ``kept_location_id`` is the kept site's pin, else that of the lowest pinned duplicate. ``clears_moved`` counts
    the clears to repoint and ``blocked`` those that would meet a standing clear of the kept lot on the same storm;
    these are reported, not dropped.
    """
    lots = t.sites.withColumn("_lot", same).where(F.col("_lot").isNotNull())
    kept = lots.groupBy("_lot").agg(
        F.min("site_id").alias("kept_site_id"),
        F.min_by("ext_location_id", F.when(F.col("ext_location_id").isNotNull(), F.col("site_id"))).alias("kept_location_id"),
        F.count("*").alias("_n"),
    ).where(F.col("_n") > 1)
    members = lots.select("site_id", "_lot").join(kept, "_lot")
    moved = t.clears.join(members.select("site_id", "kept_site_id"), "site_id")
    standing = moved.where(F.col("status") != "cancelled").groupBy("storm_id", "kept_site_id").agg(
        F.min("clear_id").alias("_first"), F.count("*").alias("_claims")
    ).where(F.col("_claims") > 1).drop("_claims")
    per_site = moved.join(standing, ["storm_id", "kept_site_id"], "left").groupBy("site_id").agg(
        F.count("*").alias("clears_moved"),
        F.sum(F.when((F.col("status") != "cancelled") & (F.col("clear_id") > F.col("_first")), 1).otherwise(0)).alias("blocked"),
    )
    none = F.lit(0).cast("long")
    return members.where(F.col("site_id") != F.col("kept_site_id")).join(per_site, "site_id", "left").select(
        "site_id", "kept_site_id", "kept_location_id", F.coalesce("clears_moved", none).alias("clears_moved"),
        F.coalesce("blocked", none).alias("blocked"),
    )


def repoint_clears(t: OpsTables, merges: DataFrame, audit_now: datetime, delta: bool = False) -> DataFrame:
    """The clears table with merged sites replaced by the kept one."""
    moves = merges.select("site_id", F.col("kept_site_id").alias("new_site_id"))
    return apply_commands(t.clears, moves, "site_id", {"site_id": F.col("new_site_id")}, audit_now, delta=delta)


# -- deletion -------------------------------------------------------------------------------------------------


def delete_plan(
    t: OpsTables, storms: DataFrame | None = None, contracts: DataFrame | None = None,
    operators: DataFrame | None = None, sites: DataFrame | None = None,
) -> DataFrame:
    """What deleting the named parents does: rows ``(table, row_id, action, cause)``.

    ``delete`` and ``blocked`` for the parents, ``delete`` and ``set null`` for the rows that depend on them. A
    contract is blocked by its sites and a site by its clears; a blocked parent stays and nothing under it moves.
    """
    steps: list[DataFrame] = []

    def step(rows: DataFrame, table: str, ident: str, action: str, cause: str) -> None:
        steps.append(rows.select(
            F.lit(table).alias("table"), F.col(ident).alias("row_id"), F.lit(action).alias("action"),
            F.lit(cause).alias("cause"),
        ))

    gone_clears = None
    if storms is not None:
        named = t.storms.select("storm_id").join(storms.select("storm_id"), "storm_id", "left_semi")
        gone_clears = t.clears.join(named, "storm_id", "left_semi").select("clear_id")
        step(named, "storms", "storm_id", "delete", "named")
        step(gone_clears, "clears", "clear_id", "delete", "storm")
        # Payouts and trips stream past a hash of the clears that go; a merge would sort all of them, a task its whole part.
        lost = gone_clears.hint("shuffle_hash")
        step(t.payouts.join(lost, "clear_id", "left_semi"), "payouts", "payout_id", "delete", "clear")
        step(t.mileage.join(lost, "clear_id", "left_semi"), "mileage", "trip_id", "set null", "clear")
    if operators is not None:
        named = t.operators.select("operator_id").join(operators.select("operator_id"), "operator_id", "left_semi")
        step(named, "operators", "operator_id", "delete", "named")
        step(t.payouts.join(named, "operator_id", "left_semi"), "payouts", "payout_id", "delete", "operator")
        step(t.clears.join(named, "operator_id", "left_semi"), "clears", "clear_id", "set null", "operator")
    if contracts is not None:
        named = t.contracts.select("contract_id").join(contracts.select("contract_id"), "contract_id", "left_semi")
        held = t.sites.select("contract_id").distinct()
        free = named.join(held, "contract_id", "left_anti")
        step(named.join(held, "contract_id", "left_semi"), "contracts", "contract_id", "blocked", "sites")
        step(free, "contracts", "contract_id", "delete", "named")
        step(t.invoices.join(free, "contract_id", "left_semi"), "invoices", "invoice_id", "delete", "contract")
    if sites is not None:
        named = t.sites.select("site_id").join(sites.select("site_id"), "site_id", "left_semi")
        # Each site once: a task would else sort the sites of all clears, which compress to so little that they meet in one.
        held = t.clears.select("site_id").distinct()
        step(named.join(held, "site_id", "left_semi"), "sites", "site_id", "blocked", "clears")
        step(named.join(held, "site_id", "left_anti"), "sites", "site_id", "delete", "named")
    if not steps:
        raise ValueError("name at least one batch of parents to delete")
    plan = steps[0]
    for more in steps[1:]:
        plan = plan.unionByName(more)
    return plan


def delete_storms(t: OpsTables, storms: DataFrame) -> OpsTables:
    """The tables after deleting storms with everything that hangs on them."""
    named = storms.select("storm_id")
    gone = t.clears.join(named, "storm_id", "left_semi").select("clear_id")
    lost = gone.withColumn("_gone", F.lit(True))
    mileage = t.mileage.join(lost, "clear_id", "left").withColumn(
        "clear_id", F.when(F.col("_gone").isNull(), F.col("clear_id"))
    ).select(*t.mileage.columns)
    return t.having(
        storms=t.storms.join(named, "storm_id", "left_anti"),
        clears=t.clears.join(named, "storm_id", "left_anti"),
        payouts=t.payouts.join(gone, "clear_id", "left_anti"),
        mileage=mileage,
    )


def delete_operators(t: OpsTables, operators: DataFrame) -> OpsTables:
    """The tables after deleting operators: their payouts go, their clears lose the operator."""
    named = operators.select("operator_id").distinct()
    lost = named.withColumn("_gone", F.lit(True))
    clears = t.clears.join(lost, "operator_id", "left").withColumn(
        "operator_id", F.when(F.col("_gone").isNull(), F.col("operator_id"))
    ).select(*t.clears.columns)
    return t.having(
        operators=t.operators.join(named, "operator_id", "left_anti"),
        payouts=t.payouts.join(named, "operator_id", "left_anti"),
        clears=clears,
    )


def delete_contracts(t: OpsTables, contracts: DataFrame) -> OpsTables:
    """The tables after deleting contracts that hold no site; the others stay."""
    free = contracts.select("contract_id").join(t.sites.select("contract_id").distinct(), "contract_id", "left_anti")
    return t.having(
        contracts=t.contracts.join(free, "contract_id", "left_anti"),
        invoices=t.invoices.join(free, "contract_id", "left_anti"),
    )


def delete_sites(t: OpsTables, sites: DataFrame) -> OpsTables:
    """The tables after deleting sites that hold no clear; the others stay."""
    free = sites.select("site_id").join(t.clears.select("site_id").distinct(), "site_id", "left_anti")
    return t.having(sites=t.sites.join(free, "site_id", "left_anti"))
