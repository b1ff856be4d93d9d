"""Requests to the scheduling service: what to create for the planned clears, and what must never be in them."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.functions.labels import ASSIGN_KEY, SHIFT_KEY, SWAP_SUFFIX, WORKER_KEY, keyed
from frostline.functions.settings import setting
from frostline.operators.boards import planned_rows
from frostline.sources.tables import OpsTables

# Fixed value: check-in radius in metres that location requests carry.
CHECKIN_RADIUS_M = 150


def outbox_locations(t: OpsTables, as_of: datetime) -> DataFrame:
    """One request per site that is not pinned: label and street address, nothing else."""
    wanted = planned_rows(t, as_of).where(F.col("needs_location") == 1)
    return wanted.select(
        "site_id", "contract_id", F.col("location_name").alias("name"), "street_address",
        F.lit(CHECKIN_RADIUS_M).alias("checkin_radius_m"), F.col("loc_idempotency_key").alias("idempotency_key"),
    ).dropDuplicates(["site_id"])


def outbox_events(t: OpsTables, as_of: datetime) -> DataFrame:
    """One request per site and day without an event; the lowest clear of the day names it."""
    wanted = planned_rows(t, as_of).where((F.col("needs_event") == 1) & F.col("start_day").isNotNull())
    return wanted.groupBy("site_id", "start_day").agg(
        F.min(F.struct("clear_id", "event_title", "contract_id", "ext_location_id", "event_idempotency_key")).alias("r")
    ).select(
        "site_id", F.col("r.contract_id").alias("contract_id"), F.col("r.ext_location_id").alias("ext_location_id"),
        F.col("r.event_title").alias("title"), F.col("start_day").alias("start_date"),
        F.col("start_day").alias("end_date"), F.col("r.event_idempotency_key").alias("idempotency_key"),
    )


def outbox_form_assign(t: OpsTables, event_responses: DataFrame) -> DataFrame:
    """One proof form per new event; ``event_responses(idempotency_key, ext_id)``."""
    events = event_responses.select(F.col("ext_id").alias("event_id")).distinct()
    form = setting(t.settings, "proof_form_id").try_cast("bigint")
    return events.select(
        form.alias("form_id"), "event_id", keyed(ASSIGN_KEY, F.col("event_id")).alias("idempotency_key")
    )


def outbox_shifts(t: OpsTables, as_of: datetime) -> DataFrame:
    """One request per planned clear that is not on a phone yet."""
    return planned_rows(t, as_of).where(F.col("needs_shift") == 1).select(
        "clear_id", F.col("ext_event_id").alias("event_id"), F.col("ext_worker_id").alias("worker_id"),
        F.col("start_iso").alias("start"), F.col("end_iso").alias("end"),
        F.col("shift_idempotency_key").alias("idempotency_key"),
    )


def outbox_swapped_shifts(t: OpsTables, as_of: datetime, swapped: DataFrame) -> DataFrame:
    """Shift requests for clears whose operator was swapped: same event, suffixed key. ``t`` is after the swap."""
    return (
        outbox_shifts(t, as_of).join(swapped.select("clear_id"), "clear_id", "left_semi")
        .withColumn("idempotency_key", F.concat(keyed(SHIFT_KEY, F.col("clear_id")), F.lit(SWAP_SUFFIX)))
    )


def outbox_workers(operators: DataFrame) -> DataFrame:
    """One invitation per operator with an address and no worker id yet."""
    asked = operators.where(F.col("ext_worker_id").isNull() & F.col("email").isNotNull())
    return asked.groupBy("email").agg(F.min("operator_id").alias("operator_id")).select(
        "operator_id", "email", keyed(WORKER_KEY, F.col("email")).alias("idempotency_key")
    )


def leaks(t: OpsTables, requests: DataFrame, *texts: str) -> DataFrame:
    """Requests whose text contains the contact name or access note of their own site or contract.

    ``requests`` carries ``site_id`` and ``contract_id``; each row meets exactly its own secrets (an equi join).
    """
    secrets = t.sites.select("site_id", "access_notes")
    contacts = t.contracts.select("contract_id", "contact_name")
    said = F.lower(F.concat_ws(" ", *texts))

    def contains(secret: str):
        return F.coalesce((F.length(secret) > 0) & F.contains(said, F.lower(secret)), F.lit(False))

    return requests.join(secrets, "site_id", "left").join(contacts, "contract_id", "left").withColumns({
        "leaks_access": F.when(contains("access_notes"), 1).otherwise(0),
        "leaks_contact": F.when(contains("contact_name"), 1).otherwise(0),
    }).drop("access_notes", "contact_name")


def audit_of_clears(t: OpsTables, outboxes: dict[str, DataFrame]) -> DataFrame:
    """The same audit for outboxes whose requests name a clear: all that a request says, keys included, against the
    secrets of the clear's site and contract."""
    places = t.clears.select("clear_id", "site_id").join(t.sites.select("site_id", "contract_id"), "site_id")
    audited = []
    for name, requests in outboxes.items():
        said = requests.join(places, "clear_id").select("site_id", "contract_id", F.concat_ws(" ", *[F.col(c).cast("string") for c in requests.columns]).alias("said"))
        audited.append(leaks(t, said, "said").select(F.lit(name).alias("outbox"), "leaks_access", "leaks_contact"))
    return reduce(DataFrame.unionByName, audited).groupBy("outbox").agg(
        F.count("*").alias("requests"), F.sum("leaks_access").alias("leaks_access"), F.sum("leaks_contact").alias("leaks_contact")
    )


def outbox_privacy_audit(t: OpsTables, as_of: datetime) -> DataFrame:
    """Per outbox: requests audited and requests that give away a contact or an access note."""
    locations = leaks(t, outbox_locations(t, as_of), "name", "street_address")
    events = leaks(t, outbox_events(t, as_of), "title")
    columns = (F.col("leaks_access"), F.col("leaks_contact"))
    audited = locations.select(F.lit("locations").alias("outbox"), *columns).unionByName(
        events.select(F.lit("events").alias("outbox"), *columns)
    )
    return audited.groupBy("outbox").agg(
        F.count("*").alias("requests"), F.sum("leaks_access").alias("leaks_access"),
        F.sum("leaks_contact").alias("leaks_contact"),
    )
