"""Small tables for tests, written as keyword rows."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DateType, DecimalType, StructType

from frostline.operators import defaults
from frostline.operators.defaults import COLUMN_DEFAULTS
from frostline.schemas import PROOFS, PUNCHES, SETTING_SEEDS, TABLES
from frostline.sources.tables import OpsTables, with_storm_month

def rows(spark: SparkSession, schema: StructType, *records: dict) -> DataFrame:
    def value(field, record):
        v = record.get(field.name)
        if v is None:
            return None
        if isinstance(field.dataType, DecimalType):
            return Decimal(str(v)).quantize(Decimal(1).scaleb(-field.dataType.scale))
        if isinstance(field.dataType, DateType) and isinstance(v, str):
            return date.fromisoformat(v)
        return v

    unknown = {k for r in records for k in r} - set(schema.names)
    assert not unknown, unknown
    return spark.createDataFrame([tuple(value(f, r) for f in schema.fields) for r in records], schema)


def table(spark: SparkSession, name: str, *records: dict) -> DataFrame:
    return rows(spark, TABLES[name], *[{**COLUMN_DEFAULTS.get(name, {}), **r} for r in records])


def settings(spark: SparkSession, **changed) -> DataFrame:
    return table(spark, "settings", *[{"key": k, "value": v} for k, v in {**SETTING_SEEDS, **changed}.items()])


def punches(spark: SparkSession, *records: dict) -> DataFrame:
    return rows(spark, PUNCHES, *records)


def proofs(spark: SparkSession, *records: dict) -> DataFrame:
    return spark.createDataFrame([tuple(r.get(n) for n in PROOFS.names) for r in records], PROOFS)


def tables(spark: SparkSession, filled: bool = True, **records) -> OpsTables:
    """Tables from lists of keyword rows; ``filled`` completes them the way the store does on insert."""
    given = {n: v if isinstance(v, DataFrame) else table(spark, n, *v) for n, v in records.items()}
    given.setdefault("settings", settings(spark))
    t = OpsTables.of(spark, **given)
    if filled:
        storms = defaults.fill_storm_defaults(defaults.number_storms(t.storms), t.settings)
        t = t.having(storms=storms)
        t = t.having(clears=defaults.fill_clear_defaults(t.clears, t.storms, t.sites, t.contracts, t.settings))
        t = t.having(mileage=defaults.fill_mileage(t.mileage, t.settings))
    return t.having(clears=with_storm_month(t.clears, t.storms))


def worked_example(spark: SparkSession) -> OpsTables:
    """Two contracts, four sites, one storm, two operators: the book before the storm is opened."""
    town = {"city": "Ashfield", "state": "MN", "zip": "55002"}
    return tables(
        spark,
        settings=settings(
            spark, business_name="Halvorsen Winter Works", state="MN", default_operator_id="1", proof_form_id="601"
        ),
        operators=[
            {"operator_id": 1, "operator_name": "Tove Lindqvist", "ext_worker_id": 801, "is_owner": 1},
            {"operator_id": 2, "operator_name": "Ines Halvorsen", "ext_worker_id": 802, "payout_type": "per_clear", "payout_value": 40},
        ],
        contracts=[
            {"contract_id": 1, "contract_name": "Larkspur Row HOA", "contract_type": "hoa", "contact_name": "Oskar",
             "billing_email": "books@larkspurrow.example", "per_clear_fee": 45, "salt_fee": 15, "sla_deadline": "07:00"},
            {"contract_id": 2, "contract_name": "Quarry Market LLC", "billing_email": "pay@quarrymarket.example",
             "per_clear_fee": 150, "salt_fee": 40, "sla_deadline": "06:00"},
        ],
        sites=[
            {"site_id": 1, "contract_id": 1, "address": "31 Thistle Way", "street_name": "Thistle Way",
             "place_label": "Driveway - Thistle Way", "access_notes": "Gate 9037", "normalized_address": "31 thistle way ashfield mn 55002", **town},
            {"site_id": 2, "contract_id": 1, "address": "602 Heron Loop", "street_name": "Heron Loop",
             "place_label": "Driveway - Heron Loop", "normalized_address": "602 heron loop ashfield mn 55002", **town},
            {"site_id": 3, "contract_id": 1, "address": "7 Tansy Ct", "street_name": "Tansy Ct",
             "place_label": "Driveway - Tansy Ct", "normalized_address": "7 tansy ct ashfield mn 55002", **town},
            {"site_id": 4, "contract_id": 2, "address": "118 Mill Pond Rd", "city": "Brookmoor", "state": "MN", "zip": "55003",
             "street_name": "Mill Pond Rd", "place_label": "Lot - Mill Pond Rd", "surface": "lot", "sla_deadline": "06:00",
             "access_notes": "Ring at the side door.", "normalized_address": "118 mill pond rd brookmoor mn 55003"},
        ],
        storms=[{"storm_id": 1, "storm_name": "January squall", "storm_date": "2026-01-14", "sla_deadline": "07:00"}],
        clears=[],
    )
