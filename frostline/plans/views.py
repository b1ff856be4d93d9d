"""The fourteen views under their names, for SQL: ``SELECT * FROM clears_planned WHERE storm_id = 7``.

A view is the plan of its function, not its rows: the caller's filter and columns are planned together with it. A storm
filter reaches the scan of the clears and, over the storms' months, its partitions. "Now" is part of the registration;
register again for another instant, which costs no work.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame

from frostline.operators import activity, billing, boards, payouts
from frostline.sources.tables import OpsTables

VIEWS: dict[str, Callable[[OpsTables, datetime], DataFrame]] = {
    "billable_clears": lambda t, now: billing.billable_clears(t),
    "clears_planned": boards.clears_planned,
    "clears_today": boards.clears_today,
    "clears_upcoming": boards.clears_upcoming,
    "sites_uncleared": lambda t, now: boards.sites_uncleared(t),
    "sla_at_risk": boards.sla_at_risk,
    "storms_open": lambda t, now: boards.storms_open(t),
    "needs_location": lambda t, now: boards.needs_location(t),
    "receivables_by_contract": lambda t, now: billing.receivables_by_contract(t),
    "invoices_outstanding": billing.invoices_outstanding,
    "mileage_by_month": lambda t, now: activity.mileage_by_month(t),
    "payouts_due": lambda t, now: payouts.payouts_due(t),
    "payouts_missing": lambda t, now: payouts.payouts_missing(t),
    "operator_activity": activity.operator_activity,
}


def register_views(t: OpsTables, as_of: datetime, prefix: str = "") -> list[str]:
    """Make temporary views of the session, named ``prefix`` and the view's name; tables go by their own names with a
    ``raw_`` before them. Returns the names of the views."""
    for name, view in VIEWS.items():
        view(t, as_of).createOrReplaceTempView(f"{prefix}{name}")
    for name in ("contracts", "sites", "operators", "storms", "clears", "mileage", "invoices", "payouts", "settings"):
        getattr(t, name).createOrReplaceTempView(f"{prefix}raw_{name}")
    return [f"{prefix}{name}" for name in VIEWS]
