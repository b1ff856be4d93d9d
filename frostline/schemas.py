"""Table schemas and value domains of the operations model.

Money is ``DECIMAL(12,2)``, dates are ``DATE``. Wall-clock text (``scheduled_start``, punches, SLA
clocks) keeps its raw text form because the views echo it; typed values are derived from it where needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import (
    ArrayType,
    DateType,
    DecimalType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)

MONEY = DecimalType(12, 2)
RATE = DecimalType(10, 4)
MILES = DecimalType(10, 2)

# The settings every business starts with.
SETTING_SEEDS: dict[str, str | None] = {
    "business_name": "My Snow Service",
    "timezone_offset": "-06:00",
    "state": None,
    "default_operator_id": None,
    "default_clear_minutes": "180",
    "default_clear_start": "04:00",
    "default_sla_deadline": "07:00",
    "invoice_due_days": "30",
    "invoice_prefix": "INV",
    "proof_form_id": None,
    "irs_mileage_rate": "0.70",
}

# The allowed values of the enumerated columns.
CONTRACT_TYPES = ("hoa", "commercial", "municipal", "residential", "other")
SITE_SURFACES = ("driveway", "lot", "walk", "mixed")
PAYOUT_TYPES = ("per_clear", "percent")
STORM_TYPES = ("snow", "ice", "mix")
STORM_STATUSES = ("forecast", "active", "closed", "cancelled")
CLEAR_STATUSES = ("planned", "completed", "cancelled", "skipped")
PROOF_SURFACES = ("driveway", "lot", "walk", "all")
PROOF_CONDITIONS = ("bare", "packed", "icy")
PROOF_SALT = ("yes", "no", "pretreated")

OPEN_STORM = ("forecast", "active")
SALTED = ("yes", "pretreated")
FINISHED = ("completed", "skipped", "cancelled")


def _struct(**columns) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns.items()])


_L, _I, _S, _D, _T = LongType(), IntegerType(), StringType(), DateType(), TimestampType()

SETTINGS = _struct(key=_S, value=_S)

CONTRACTS = _struct(
    contract_id=_L, contract_name=_S, contract_type=_S, contact_name=_S, contact_phone=_S, billing_email=_S,
    payment_terms_days=_I, per_clear_fee=MONEY, salt_fee=MONEY, seasonal_fee=MONEY, sla_deadline=_S, notes=_S,
    is_active=_I, created_at=_T, updated_at=_T,
)

SITES = _struct(
    site_id=_L, contract_id=_L, normalized_address=_S, address=_S, city=_S, state=_S, zip=_S, street_name=_S,
    place_label=_S, surface=_S, sla_deadline=_S, ext_location_id=_L, access_notes=_S, is_active=_I, created_at=_T,
    updated_at=_T,
)

OPERATORS = _struct(
    operator_id=_L, operator_name=_S, email=_S, phone=_S, ext_worker_id=_L, is_owner=_I, payout_type=_S,
    payout_value=MONEY, is_active=_I, notes=_S, created_at=_T, updated_at=_T,
)

STORMS = _struct(
    storm_id=_L, storm_ref=_S, storm_name=_S, storm_date=_D, storm_type=_S, sla_deadline=_S, status=_S, notes=_S,
    created_at=_T, updated_at=_T,
)

# storm_month ('yyyy-MM' of the storm's date) is the partition column of the fact table.
CLEARS = _struct(
    clear_id=_L, storm_id=_L, site_id=_L, operator_id=_L, scheduled_start=_S, duration_minutes=_I, is_adhoc=_I,
    status=_S, surface=_S, condition=_S, salt_applied=_S, photo_count=_I, fee=MONEY, salt_fee=MONEY,
    other_fee=MONEY, invoiced=_I, paid_out=_I, ext_event_id=_L, ext_shift_id=_L, report_id=_L, checked_in_at=_S,
    checked_out_at=_S, gps_verified=_I, checkin_distance_m=_I, notes=_S, created_at=_T, updated_at=_T,
    storm_month=_S,
)

MILEAGE = _struct(
    trip_id=_L, clear_id=_L, trip_date=_D, miles=MILES, from_label=_S, to_label=_S, purpose=_S, rate=RATE,
    deduction=MONEY, created_at=_T,
)

LINE_ITEM = _struct(
    storm_ref=_S, storm_date=_D, street=_S, surface=_S, condition=_S, salt_applied=_S, status=_S, fee=MONEY,
    salt_fee=MONEY, other_fee=MONEY, billable=MONEY,
)

INVOICES = _struct(
    invoice_id=_L, contract_id=_L, invoice_number=_S, invoice_date=_D, due_date=_D, total_amount=MONEY, paid=_I,
    paid_date=_D, sent_date=_D, notes=_S, created_at=_T,
)

PAYOUTS = _struct(
    payout_id=_L, operator_id=_L, clear_id=_L, amount=MONEY, paid=_I, paid_date=_D, notes=_S, created_at=_T,
)

TABLES: dict[str, StructType] = {
    "settings": SETTINGS, "contracts": CONTRACTS, "sites": SITES, "operators": OPERATORS, "storms": STORMS,
    "clears": CLEARS, "mileage": MILEAGE, "invoices": INVOICES, "payouts": PAYOUTS,
}

# Feeds that arrive from the field.
PUNCHES = _struct(
    shift_id=_L, worker_id=_L, event_id=_L, punch_type=_S, punched_at=_S, gps_verified=_I, distance_m=_I,
)

PROOF_DATA = _struct(surface=_S, condition=_S, salt_applied=_S, notes=_S)
PROOF_MEDIA = ArrayType(_struct(field=_S, cdn_url=_S))
PROOFS = _struct(
    submission_id=_L, worker_id=_L, event_id=_L, submitted_at=_S, data=PROOF_DATA, media=PROOF_MEDIA,
)

WALL_CLOCK = TimestampNTZType()


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: cast what is there, add absent columns as NULL, drop the rest.

    What does not fit its type becomes NULL instead of stopping the job; the quality rules report it.
    """
    have = set(df.columns)
    return df.selectExpr(*[
        f"TRY_CAST({f'`{f.name}`' if f.name in have else 'NULL'} AS {f.dataType.simpleString()}) AS `{f.name}`"
        for f in schema.fields
    ])
