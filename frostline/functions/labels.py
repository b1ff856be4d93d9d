"""Text shown to people or sent out: addresses, titles, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from frostline.functions.clock import compact_date

# Key formats, so a repeated request cannot create a second object.
LOCATION_KEY = "loc-site-"
EVENT_KEY = "event-site-"
SHIFT_KEY = "shift-clear-"
ASSIGN_KEY = "assign-proof-"
CANCEL_KEY = "cancel-shift-"
WORKER_KEY = "worker-"
SWAP_SUFFIX = "-2"


def optional(prefix: str, part: Column) -> Column:
    return F.coalesce(F.concat(F.lit(prefix), part), F.lit(""))


def street_address() -> Column:
    return F.concat(
        F.col("address"), optional(", ", F.col("city")), optional(", ", F.col("state")), optional(" ", F.col("zip"))
    )


def street_label() -> Column:
    return F.coalesce(F.col("street_name"), F.col("address"))


def location_name() -> Column:
    return F.coalesce(F.col("place_label"), F.concat(F.lit("Site - "), street_label()))


def event_title(storm_date: Column) -> Column:
    return F.concat(F.lit("Clear "), storm_date.cast("string"), F.lit(" - "), street_label())


def keyed(prefix: str, ident: Column) -> Column:
    return F.concat(F.lit(prefix), ident.cast("string"))


def event_key(site_id: Column, on: Column) -> Column:
    return F.concat(F.lit(EVENT_KEY), site_id.cast("string"), F.lit("-"), compact_date(on))


def numbered(prefix: Column, on: Column, ident: Column) -> Column:
    """``PREFIX-YYYY-0001``; ids past 9999 widen instead of being cut."""
    return F.concat(prefix, F.lit("-"), F.date_format(on, "yyyy"), F.lit("-"), F.format_string("%04d", ident))


def normalized_address(*parts: Column) -> Column:
    """The de-duplication key of an address: lower case, no commas, periods or '#', single spaces."""
    joined = F.lower(F.concat_ws(" ", *parts))
    return F.trim(F.regexp_replace(F.regexp_replace(joined, "[,.#]", ""), r"\s+", " "))


def option_key(label: Column) -> Column:
    """Key of a form option: lower case, anything but a-z and 0-9 becomes '_', 30 characters by definition."""
    return F.substring(F.regexp_replace(F.lower(label), "[^a-z0-9]", "_"), 1, 30)
