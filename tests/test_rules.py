"""The finer points of the rules, one small table each."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest
from frames import settings, table, tables
from pyspark.sql import functions as F

from frostline.functions import clock, labels
from frostline.operators import activity, billing, boards, defaults, payouts, transitions

NOW = datetime(2026, 1, 14, 6, 0)


def small(spark, clears, **more):
    book = {
        "contracts": [{"contract_id": 1, "contract_name": "C", "per_clear_fee": 45, "salt_fee": 15, "sla_deadline": "07:00"}],
        "sites": [{"site_id": i, "contract_id": 1, "address": f"{i} Elm", "normalized_address": f"{i} elm"} for i in (1, 2, 3)],
        "storms": [{"storm_id": 1, "storm_date": "2026-01-14"}, {"storm_id": 2, "storm_date": "2026-01-14"}],
        "operators": [{"operator_id": 1, "operator_name": "Owner", "is_owner": 1}],
        "clears": [{"storm_id": 1, "site_id": 1, **c} for c in clears],
    }
    return tables(spark, **{**book, **more})


def values(df, column, key="clear_id"):
    return {r[key]: r[column] for r in df.collect()}


def test_billable_totals(spark):
    t = small(spark, [
        {"clear_id": 1, "status": "completed"},
        {"clear_id": 2, "status": "completed", "salt_applied": "yes"},
        {"clear_id": 3, "status": "completed", "salt_applied": "pretreated", "fee": 150, "salt_fee": 40},
        {"clear_id": 4, "status": "planned", "other_fee": 9},
        {"clear_id": 5, "status": "skipped", "other_fee": 12},
        {"clear_id": 6, "status": "cancelled", "other_fee": 8},
        {"clear_id": 7, "status": "completed", "salt_applied": "yes", "fee": 150, "salt_fee": 40, "other_fee": 25},
        {"clear_id": 8, "status": "completed", "salt_applied": "no", "fee": 0},
    ])
    got = values(billing.billable_clears(t), "billable_total")
    assert {k: float(v) for k, v in got.items()} == {1: 45, 2: 60, 3: 190, 4: 0, 5: 12, 6: 8, 7: 215, 8: 0}


def test_payout_splits(spark):
    t = small(
        spark,
        [{"clear_id": 7, "status": "completed", "salt_applied": "yes", "fee": 150, "salt_fee": 40, "other_fee": 25}],
        operators=[
            {"operator_id": 1, "operator_name": "a", "payout_type": "per_clear", "payout_value": 40},
            {"operator_id": 2, "operator_name": "b", "payout_type": "percent", "payout_value": 50},
            {"operator_id": 3, "operator_name": "c"},
        ],
    )
    fresh = table(spark, "payouts", *[{"payout_id": i, "operator_id": i, "clear_id": 7} for i in (1, 2, 3)],
                  {"payout_id": 4, "operator_id": 2, "clear_id": 7, "amount": 9})
    priced = defaults.fill_payout_amount(fresh, t.operators, billing.billable_facts(t.clears))
    assert values(priced, "amount", "payout_id") == {1: Decimal("40.00"), 2: Decimal("107.50"), 3: None, 4: Decimal("9.00")}
    due = payouts.payouts_due(t.having(payouts=priced))
    assert values(due, "needs_amount", "payout_id") == {1: 0, 2: 0, 3: 1, 4: 0}
    assert values(due, "operator_total_due", "payout_id")[2] == Decimal("116.50")
    assert values(due, "operator_total_due", "payout_id")[3] is None


def test_owner_flag_of_null_is_neither(spark):
    t = small(spark, [{"clear_id": 1, "status": "completed", "operator_id": 5}],
              operators=[{"operator_id": 5, "operator_name": "x", "is_owner": None}])
    assert payouts.payouts_missing(t).isEmpty()


def test_mileage(spark):
    t = tables(spark, mileage=[
        {"trip_id": 1, "clear_id": 1, "trip_date": "2026-01-14", "miles": 23.4},
        {"trip_id": 2, "trip_date": "2026-01-20", "miles": 10, "rate": 0.5},
        {"trip_id": 3, "trip_date": "2026-02-01", "miles": 1},
    ])
    assert values(t.mileage, "deduction", "trip_id") == {1: Decimal("16.38"), 2: Decimal("5.00"), 3: Decimal("0.70")}
    months = activity.mileage_by_month(t).collect()
    assert [(r.month, r.trips, r.non_clear_miles) for r in months] == [
        ("2026-02", 1, Decimal("1.00")), ("2026-01", 2, Decimal("10.00"))
    ]
    edited = t.mileage.withColumn("rate", F.when(F.col("trip_id") != 2, F.col("rate")))
    assert values(defaults.recompute_mileage(edited), "deduction", "trip_id")[2] == Decimal("0.00")


def test_storm_numbers_and_clock(spark):
    storms = table(spark, "storms", {"storm_id": 1, "storm_date": "2026-01-14"}, {"storm_id": 12345, "storm_date": "2026-01-14"},
                   {"storm_id": 3, "storm_date": "2026-01-14", "storm_ref": "MINE", "sla_deadline": "05:00"})
    numbered = defaults.number_storms(storms)
    assert values(numbered, "storm_ref", "storm_id") == {1: "ST-2026-0001", 12345: "ST-2026-12345", 3: "MINE"}
    filled = defaults.fill_storm_defaults(storms, settings(spark, default_sla_deadline="06:30"))
    assert values(filled, "sla_deadline", "storm_id") == {1: "06:30", 12345: "06:30", 3: "05:00"}
    assert values(defaults.fill_storm_defaults(storms, settings(spark, default_sla_deadline=None)), "sla_deadline", "storm_id")[1] == "07:00"


def test_invoice_prefix_missing_or_null(spark):
    invoice = table(spark, "invoices", {"invoice_id": 7, "contract_id": 1, "invoice_date": "2026-01-14", "total_amount": 1})
    assert defaults.number_invoices(invoice, settings(spark)).first().invoice_number == "INV-2026-0007"
    assert defaults.number_invoices(invoice, settings(spark, invoice_prefix=None)).first().invoice_number == "INV-2026-0007"
    without = settings(spark).where("key <> 'invoice_prefix'")
    assert defaults.number_invoices(invoice, without).first().invoice_number is None


def test_clear_defaults_follow_settings(spark):
    changed = settings(spark, default_clear_start="03:15", default_clear_minutes="90", default_operator_id="9")
    t = small(spark, [{"clear_id": 1}, {"clear_id": 2, "site_id": 2, "scheduled_start": "2026-01-13T22:00", "operator_id": 4,
                       "duration_minutes": 20, "fee": 1}], settings=changed)
    rows = {r.clear_id: r for r in t.clears.collect()}
    assert (rows[1].scheduled_start, rows[1].duration_minutes, rows[1].operator_id, rows[1].fee) == (
        "2026-01-14T03:15", 90, 9, Decimal("45.00"))
    assert (rows[2].scheduled_start, rows[2].duration_minutes, rows[2].operator_id, rows[2].fee) == (
        "2026-01-13T22:00", 20, 4, Decimal("1.00"))
    bad = small(spark, [{"clear_id": 1}], settings=settings(spark, default_clear_minutes="soon"))
    assert bad.clears.first().duration_minutes == 180


def test_sla_order_site_contract_storm(spark):
    t = small(
        spark, [{"clear_id": i, "site_id": i} for i in (1, 2, 3)],
        contracts=[{"contract_id": 1, "contract_name": "a", "sla_deadline": "07:00"}, {"contract_id": 2, "contract_name": "b", "sla_deadline": ""}],
        sites=[{"site_id": 1, "contract_id": 1, "address": "a", "sla_deadline": "06:00"},
               {"site_id": 2, "contract_id": 1, "address": "b", "sla_deadline": ""},
               {"site_id": 3, "contract_id": 2, "address": "c"}],
        storms=[{"storm_id": 1, "storm_date": "2026-01-14", "sla_deadline": "05:45"}],
    )
    assert values(boards.clears_planned(t, NOW), "sla_deadline") == {1: "06:00", 2: "07:00", 3: "05:45"}


def test_planned_window_forms(spark):
    t = small(spark, [
        {"clear_id": 1, "scheduled_start": "2026-01-14T04:00:30", "duration_minutes": 20},
        {"clear_id": 2, "site_id": 2, "scheduled_start": "2026-01-13T22:30"},
        {"clear_id": 3, "site_id": 3, "scheduled_start": "2026-01-14T25:00"},
    ])
    rows = {r.clear_id: r for r in boards.clears_planned(t, NOW).collect()}
    assert (rows[1].start_iso, rows[1].end_iso) == ("2026-01-14T04:00:30-06:00", "2026-01-14T04:20:30-06:00")
    assert rows[1].scheduled_start == "2026-01-14T04:00:30"
    assert (rows[2].event_start_date, rows[2].event_idempotency_key) == (date(2026, 1, 13), "event-site-2-20260113")
    assert (rows[3].start_iso, rows[3].event_start_date, rows[3].needs_event) == (None, None, 1)
    uncleared = {r.site_id: r for r in boards.sites_uncleared(t).collect() if r.storm_id == 1}
    assert uncleared[2].event_idempotency_key == "event-site-2-20260114"


def test_missing_duration_only_matters_when_planned(spark):
    t = small(spark, [{"clear_id": 1}])
    t = t.having(clears=t.clears.withColumn("duration_minutes", F.lit(None).cast("int")))
    assert boards.clears_planned(t, NOW).first().end_iso is None
    assert boards.clears_today(t, NOW).first().end_iso == "2026-01-14T07:00:00-06:00"


def test_sibling_event_of_any_status(spark):
    t = small(spark, [
        {"clear_id": 1, "status": "cancelled", "ext_event_id": 71},
        {"clear_id": 2, "status": "completed", "storm_id": 2, "ext_event_id": 70},
        {"clear_id": 3},
        {"clear_id": 4, "site_id": 2, "scheduled_start": "2026-01-15T04:00"},
        {"clear_id": 5, "site_id": 2, "storm_id": 2, "status": "skipped", "ext_event_id": 80},
    ])
    planned = boards.clears_planned(t, NOW)
    assert values(planned, "ext_event_id") == {3: 71, 4: None}
    assert values(planned, "needs_event") == {3: 0, 4: 1}
    own = {r.site_id: r.ext_event_id for r in boards.sites_uncleared(t).collect() if r.clear_id == 3}
    assert own == {1: None}


@pytest.mark.parametrize(("now", "listed", "minutes", "passed"), [
    (datetime(2026, 1, 14, 5, 59), False, None, None),
    (datetime(2026, 1, 14, 6, 0), True, 60, 0),
    (datetime(2026, 1, 14, 6, 0, 30), True, 59, 0),
    (datetime(2026, 1, 14, 7, 0), True, 0, 1),
    (datetime(2026, 1, 14, 7, 12), True, -12, 1),
    (datetime(2026, 1, 14, 7, 12, 40), True, -12, 1),
    (datetime(2026, 3, 1, 0, 0), True, -65820, 1),
])
def test_at_risk_window(spark, now, listed, minutes, passed):
    t = small(spark, [{"clear_id": 1}, {"clear_id": 2, "site_id": 2, "checked_in_at": "2026-01-14T08:00:00-06:00"},
                      {"clear_id": 3, "site_id": 3, "status": "completed"}])
    rows = boards.sla_at_risk(t, now).collect()
    assert [(r.clear_id, r.minutes_to_deadline, r.deadline_passed) for r in rows] == ([(1, minutes, passed)] if listed else [])


def test_at_risk_keeps_closed_storms_unless_asked(spark):
    t = small(spark, [{"clear_id": 1}], storms=[{"storm_id": 1, "storm_date": "2026-01-10", "status": "closed"}])
    assert boards.sla_at_risk(t, NOW).count() == 1
    assert boards.sla_at_risk(t, NOW, open_storms_only=True).isEmpty()


def test_uncleared_and_open_storms(spark):
    t = small(
        spark,
        [{"clear_id": 1, "status": "completed"}, {"clear_id": 2, "site_id": 2, "status": "skipped"},
         {"clear_id": 3, "site_id": 3, "status": "cancelled"}, {"clear_id": 4, "site_id": 4}],
        sites=[{"site_id": i, "contract_id": 1, "address": "x"} for i in (1, 2, 3)]
        + [{"site_id": 4, "contract_id": 1, "address": "x", "is_active": 0}, {"site_id": 5, "contract_id": 1, "address": "x", "is_active": None},
           {"site_id": 6, "contract_id": 2, "address": "x"}],
        contracts=[{"contract_id": 1, "contract_name": "a"}, {"contract_id": 2, "contract_name": "b", "is_active": 0}],
        storms=[{"storm_id": 1, "storm_date": "2026-01-14"}, {"storm_id": 2, "storm_date": "2026-01-15", "status": "closed"}],
    )
    left = boards.sites_uncleared(t).collect()
    assert [(r.storm_id, r.site_id, r.needs_clear, r.needs_shift, r.shift_idempotency_key) for r in left] == [(1, 3, 1, 0, None)]
    board = boards.storms_open(t).collect()
    assert [(r.storm_id, r.active_sites, r.planned_clears, r.completed_clears, r.skipped_clears, r.sites_without_clear) for r in board] == [
        (1, 3, 1, 1, 1, 1)
    ]


def test_upcoming_is_seven_days(spark):
    t = small(spark, [{"clear_id": i, "scheduled_start": f"2026-01-{13 + i:02d}T04:00", "status": "planned" if i != 3 else "cancelled"} for i in range(0, 9)])
    assert sorted(values(boards.clears_upcoming(t, NOW), "status")) == [1, 2, 4, 5, 6, 7]


def test_location_needed_only_with_work(spark):
    sites = [{"site_id": 1, "contract_id": 1, "address": "a"}, {"site_id": 2, "contract_id": 1, "address": "b"},
             {"site_id": 3, "contract_id": 1, "address": "c", "ext_location_id": 5}]
    closed = [{"storm_id": 1, "storm_date": "2026-01-14", "status": "closed"}]
    t = small(spark, [{"clear_id": 1}, {"clear_id": 3, "site_id": 3}], sites=sites, storms=closed)
    assert values(boards.needs_location(t), "planned_clears", "site_id") == {1: 1}
    t = small(spark, [{"clear_id": 1}], sites=sites)
    assert values(boards.needs_location(t), "planned_clears", "site_id") == {1: 1, 2: 0}


def test_aging(spark):
    days = {1: 0, 2: -5, 3: 1, 4: 30, 5: 31, 6: 60, 7: 61}
    due = {i: date.fromordinal(date(2026, 3, 1).toordinal() - d) for i, d in days.items()}
    t = small(spark, [], invoices=[
        {"invoice_id": i, "contract_id": 1, "invoice_date": "2026-01-01", "due_date": d, "total_amount": 10} for i, d in due.items()
    ] + [{"invoice_id": 8, "contract_id": 1, "invoice_date": "2026-01-01", "total_amount": 10},
         {"invoice_id": 9, "contract_id": 1, "invoice_date": "2026-01-01", "total_amount": 10, "paid": 1}])
    rows = {r.invoice_id: (r.days_past_due, r.aging_bucket, r.overdue) for r in billing.invoices_outstanding(t, datetime(2026, 3, 1, 9)).collect()}
    assert rows == {1: (0, "current", 0), 2: (-5, "current", 0), 3: (1, "30", 1), 4: (30, "30", 1), 5: (31, "60", 1),
                    6: (60, "60", 1), 7: (61, "90+", 1), 8: (None, "90+", 0)}
    summary = billing.aging_summary(t, datetime(2026, 3, 1, 9)).collect()
    assert [(r.aging_bucket, r.invoice_count) for r in summary] == [("90+", 2), ("60", 2), ("30", 2), ("current", 2)]


def test_sweep_marks_clears_that_bill_nothing(spark):
    t = small(spark, [{"clear_id": 1, "status": "completed"}, {"clear_id": 2, "site_id": 2, "status": "skipped"},
                      {"clear_id": 3, "site_id": 3, "status": "planned"}])
    run = billing.invoice_run(t, NOW).collect()
    assert [(r.line_count, r.total_amount) for r in run] == [(1, Decimal("45.00"))]
    assert values(billing.mark_invoiced(t, NOW), "invoiced") == {1: 1, 2: 1, 3: 0}


def test_work_day_reads_the_text(spark):
    t = small(spark, [{"clear_id": 1, "status": "completed", "checked_in_at": "2026-01-13T22:08:00-06:00"}])
    assert billing.billable_clears(t).first().completed_date == date(2026, 1, 13)


def test_activity_window_and_plans(spark):
    t = small(spark, [
        {"clear_id": 1, "status": "completed", "operator_id": 1, "checked_in_at": "2025-12-15T04:00:00-06:00", "photo_count": 1, "gps_verified": 1},
        {"clear_id": 2, "site_id": 2, "status": "completed", "operator_id": 1, "checked_in_at": "2025-12-14T04:00:00-06:00"},
        {"clear_id": 3, "site_id": 3, "status": "completed", "operator_id": 1, "scheduled_start": "2026-01-20T04:00", "gps_verified": 0},
        {"clear_id": 4, "storm_id": 2, "operator_id": 1, "scheduled_start": "2026-01-14T06:00"},
        {"clear_id": 5, "storm_id": 2, "site_id": 2, "operator_id": 1, "scheduled_start": "2026-01-14T05:59"},
    ], operators=[{"operator_id": 1, "operator_name": "a"}, {"operator_id": 2, "operator_name": "b"}])
    rows = {r.operator_id: r for r in activity.operator_activity(t, NOW).collect()}
    one = rows[1]
    assert (one.clears_30d, one.gps_verified_pct, one.with_photo_30d, one.last_clear_at, one.planned_ahead) == (
        2, Decimal("50.0"), 1, "2026-01-20T04:00", 1)
    assert (rows[2].clears_30d, rows[2].gps_verified_pct, rows[2].last_clear_at) == (0, None, None)


def test_labels(spark):
    row = spark.createDataFrame([("12  Main St., #4", "Yes, with salt & sand (pretreated again)")], "a string, b string").select(
        labels.normalized_address(F.col("a"), F.lit("Brookmoor"), F.lit(None), F.lit("55003")).alias("a"),
        labels.option_key(F.col("b")).alias("b"),
    ).first()
    assert tuple(row) == ("12 main st 4 brookmoor 55003", "yes__with_salt___sand__pretrea")


def test_clock_ignores_session_zone(spark):
    frame = spark.createDataFrame([("2026-03-08T02:30:00-06:00", "2026-03-08T03:30:00-06:00")], "a string, b string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Chicago")
        gap = clock.wall_seconds(clock.local_ts(F.col("b"))) - clock.wall_seconds(clock.local_ts(F.col("a")))
        row = frame.select(gap.alias("gap"), clock.iso_seconds(clock.local_ts(F.col("a"))).alias("iso")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert (row.gap, row.iso) == (3600, "2026-03-08T02:30:00")


def test_touch_stamps_only_changed_rows(spark):
    t = small(spark, [])
    order = spark.createDataFrame([(1,)], "contract_id long").withColumns({
        "new_per_clear_fee": F.lit(50).cast("decimal(12,2)"), "new_salt_fee": F.lit(None).cast("decimal(12,2)"),
        "new_sla_deadline": F.lit(None).cast("string")})
    changed = transitions.change_terms(t.contracts, order, NOW).first()
    assert (changed.per_clear_fee, changed.salt_fee, changed.sla_deadline) == (Decimal("50.00"), Decimal("15.00"), "07:00")
    assert changed.updated_at == NOW
    assert transitions.deactivate(t.sites, spark.createDataFrame([(2,)], "site_id long"), "site_id", NOW).where(
        "updated_at is not null").first().site_id == 2
