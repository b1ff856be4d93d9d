"""One storm from opening to invoices, with the results stated for the worked example."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest
from frames import proofs, punches, worked_example
from pyspark.sql import functions as F

from frostline.operators import activity, billing, boards, outbox, payouts, transitions
from frostline.sources.tables import OpsTables

NIGHT = datetime(2026, 1, 13, 21, 0)
MORNING = datetime(2026, 1, 14, 9, 0)


def kept(df):
    """Materialise a small table so later steps do not repeat the whole chain."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def by(df, key):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def opened(spark) -> OpsTables:
    t = worked_example(spark)
    clears = transitions.open_storm(t, t.storms, id_stride=0)
    return t.having(clears=kept(clears.withColumn("clear_id", F.col("site_id"))))


@pytest.fixture(scope="module")
def dispatched(spark, opened) -> OpsTables:
    t = opened
    answers = outbox.outbox_locations(t, NIGHT).select("idempotency_key", (F.col("site_id") + 9300).alias("ext_id"))
    t = t.having(sites=kept(transitions.pin_locations(t, answers, NIGHT)))
    answers = outbox.outbox_events(t, NIGHT).select("idempotency_key", (F.col("site_id") + 7400).alias("ext_id"))
    t = t.having(clears=kept(transitions.record_events(t, answers, NIGHT)))
    answers = outbox.outbox_shifts(t, NIGHT).select("idempotency_key", (F.col("clear_id") + 90000).alias("ext_id"))
    return t.having(clears=kept(transitions.record_shifts(t, answers, NIGHT)))


@pytest.fixture(scope="module")
def swapped(spark, dispatched) -> OpsTables:
    t = dispatched
    order = spark.createDataFrame([(4, 2)], "clear_id long, new_operator_id long")
    cancelled = transitions.cancellations(t, order).collect()
    assert [r.idempotency_key for r in cancelled] == ["cancel-shift-90004"]
    t = t.having(clears=kept(transitions.swap_operator(t, order, NIGHT)))
    request = outbox.outbox_swapped_shifts(t, NIGHT, order).collect()
    assert [(r.worker_id, r.event_id, r.idempotency_key) for r in request] == [(802, 7404, "shift-clear-4-2")]
    answer = spark.createDataFrame([("shift-clear-4-2", 90005)], "idempotency_key string, ext_id long")
    t = t.having(clears=kept(transitions.record_shifts(t, answer, NIGHT)))
    start = spark.createDataFrame([(4, "2026-01-14T05:12")], "clear_id long, new_start string")
    return t.having(clears=kept(transitions.reschedule(t, start, NIGHT)))


@pytest.fixture(scope="module")
def logged(spark, swapped) -> OpsTables:
    def stay(shift, came, went, metres):
        return [
            {"shift_id": shift, "punch_type": kind, "punched_at": f"2026-01-14T{at}-06:00", "gps_verified": 1, "distance_m": metres}
            for kind, at in (("in", came), ("out", went))
        ]

    seen = punches(
        spark, *stay(90001, "04:17:20", "04:33:55", 12), *stay(90002, "04:36:10", "04:51:30", 9),
        *stay(90003, "05:07:45", "05:19:10", 14), *stay(90005, "05:14:00", "05:36:20", 22),
    )

    def proof(number, event, surface, condition, salt, photos):
        return {"submission_id": number, "event_id": event, "data": (surface, condition, salt, None),
                "media": [("after", f"a{i}.jpg") for i in range(photos)]}

    read = proofs(
        spark, proof(5501, 7401, "driveway", "bare", "yes", 3), proof(5502, 7402, "driveway", "packed", "yes", 2),
        proof(5503, 7403, "driveway", "bare", "no", 2), proof(5504, 7404, "lot", "bare", "pretreated", 4),
    )
    t = swapped.having(clears=kept(transitions.apply_results(swapped, seen, read, MORNING)))
    again = transitions.apply_results(t, seen, read, datetime(2026, 1, 15))
    assert again.exceptAll(t.clears).isEmpty(), "pulling the same results twice changes nothing"
    return t


def test_opened_clears(opened):
    rows = by(boards.clears_planned(opened, NIGHT), "clear_id")
    assert len(rows) == 4
    thistle, mill = rows[1], rows[4]
    assert (thistle.start_iso, thistle.end_iso) == ("2026-01-14T04:00:00-06:00", "2026-01-14T07:00:00-06:00")
    assert thistle.event_title == "Clear 2026-01-14 - Thistle Way"
    assert thistle.location_name == "Driveway - Thistle Way"
    assert thistle.street_address == "31 Thistle Way, Ashfield, MN 55002"
    assert thistle.loc_idempotency_key == "loc-site-1"
    assert thistle.event_idempotency_key == "event-site-1-20260114"
    assert thistle.shift_idempotency_key == "shift-clear-1"
    assert (thistle.needs_location, thistle.needs_event, thistle.needs_shift) == (1, 1, 1)
    assert (thistle.storm_ref, thistle.sla_deadline, mill.sla_deadline) == ("ST-2026-0001", "07:00", "06:00")
    assert mill.sla_deadline_at == "2026-01-14T06:00"
    assert thistle.minutes_to_deadline == 600
    assert rows[1].asDict().keys() == dict.fromkeys(boards.PLANNED_COLUMNS).keys()


def test_opening_twice_adds_nothing(opened):
    assert transitions.open_storm(opened, opened.storms).isEmpty()


def test_fee_snapshots(opened):
    fees = {r.site_id: (r.fee, r.salt_fee, r.operator_id, r.duration_minutes) for r in opened.clears.collect()}
    assert fees[1] == (Decimal("45.00"), Decimal("15.00"), 1, 180)
    assert fees[4] == (Decimal("150.00"), Decimal("40.00"), 1, 180)


def test_privacy(opened):
    audit = by(outbox.outbox_privacy_audit(opened, NIGHT), "outbox")
    assert audit["locations"].requests == 4 and audit["events"].requests == 4
    assert all(r.leaks_access == 0 and r.leaks_contact == 0 for r in audit.values())
    leaky = opened.sites.select("site_id", "contract_id", F.lit("ask oskar, gate 9037").alias("note"))
    found = by(outbox.leaks(opened, leaky, "note"), "site_id")
    assert (found[1].leaks_access, found[1].leaks_contact) == (1, 1)
    assert (found[4].leaks_access, found[4].leaks_contact) == (0, 0)


def test_dispatched(dispatched):
    rows = by(boards.clears_planned(dispatched, NIGHT), "clear_id")
    assert [(rows[i].ext_location_id, rows[i].ext_event_id, rows[i].ext_shift_id) for i in (1, 4)] == [
        (9301, 7401, 90001), (9304, 7404, 90004)
    ]
    assert all(r.needs_location + r.needs_event + r.needs_shift == 0 for r in rows.values())
    assert boards.needs_location(dispatched).isEmpty()
    form = outbox.outbox_form_assign(dispatched, dispatched.spark.createDataFrame([("k", 7401)], "idempotency_key string, ext_id long"))
    assert [tuple(r) for r in form.collect()] == [(601, 7401, "assign-proof-7401")]


def test_at_risk_before_the_punches(dispatched):
    risk = by(boards.sla_at_risk(dispatched, datetime(2026, 1, 14, 6, 50)), "clear_id")
    assert (risk[3].minutes_to_deadline, risk[3].deadline_passed) == (10, 0)
    assert (risk[4].minutes_to_deadline, risk[4].deadline_passed) == (-50, 1)
    late = by(boards.sla_at_risk(dispatched, datetime(2026, 1, 14, 7, 12)), "clear_id")
    assert late[1].minutes_to_deadline == -12


def test_board_of_the_day(logged, swapped):
    before = boards.clears_today(swapped, MORNING)
    assert before.columns == list(boards.TODAY_COLUMNS)
    assert {r.status for r in before.collect()} == {"planned"}
    after = by(boards.clears_today(logged, MORNING), "clear_id")
    assert {r.status for r in after.values()} == {"completed"} and after[4].operator_name == "Ines Halvorsen"
    assert (after[1].photo_count, after[1].condition, after[1].needs_shift) == (3, "bare", 0)
    assert boards.clears_planned(logged, MORNING).isEmpty()
    assert boards.sites_uncleared(logged).isEmpty()
    assert boards.sla_at_risk(logged, datetime(2026, 1, 14, 23)).isEmpty()


def test_margins(logged):
    margins = {r.clear_id: r.margin_minutes for r in activity.sla_outcome(logged).collect()}
    assert margins[1] == 2 * 60 + 43 and margins[4] == 46


def test_storm_closes(logged, swapped):
    assert [r.status for r in transitions.close_storms(logged, MORNING).collect()] == ["closed"]
    assert [r.status for r in transitions.close_storms(swapped, MORNING).collect()] == ["active"]


def test_receivables(logged):
    rows = by(billing.receivables_by_contract(logged), "contract_id")
    assert (rows[1].clear_count, rows[1].total_billable) == (3, Decimal("165.00"))
    assert (rows[2].clear_count, rows[2].total_billable) == (1, Decimal("190.00"))
    assert rows[1].first_date == date(2026, 1, 14)


def test_payout(logged):
    missing = payouts.payouts_missing(logged).collect()
    assert [(r.operator_name, r.site_label, r.condition) for r in missing] == [("Ines Halvorsen", "Mill Pond Rd", "bare")]
    t = logged.having(payouts=payouts.payout_run(logged))
    due = payouts.payouts_due(t).collect()
    assert [(r.amount, r.operator_total_due, r.needs_amount) for r in due] == [(Decimal("40.00"), Decimal("40.00"), 0)]
    assert payouts.payouts_missing(t).isEmpty()
    pat = t.operators.where("operator_id = 2")
    paid = t.having(payouts=payouts.settle_payouts(t, pat, MORNING))
    assert payouts.payouts_due(paid).isEmpty()
    assert [r.clear_id for r in payouts.flag_paid_out(paid, pat, MORNING).where("paid_out = 1").collect()] == [4]
    statement = [r.line for r in payouts.payout_statements(t).orderBy("section", "position").collect()]
    assert len(statement) == 3 and (statement[0], statement[2]) == ("Statement for Ines Halvorsen", "Total due: $40.00")


def test_invoices(logged):
    run = by(billing.invoice_run(logged, datetime(2026, 1, 14, 18)), "contract_id")
    assert (run[1].invoice_number, run[1].total_amount, run[1].due_date) == (
        "INV-2026-0001", Decimal("165.00"), date(2026, 2, 13)
    )
    assert (run[2].invoice_number, run[2].total_amount) == ("INV-2026-0002", Decimal("190.00"))
    marked = billing.mark_invoiced(logged, MORNING)
    assert marked.where("invoiced = 1").count() == 4
    assert billing.receivables_by_contract(logged.having(clears=marked)).isEmpty()


def test_invoice_text_and_json(logged):
    day = datetime(2026, 1, 14, 18)
    rows = billing.invoice_documents(logged, day).where("contract_id = 1").orderBy("section", "position").collect()
    text = [r.line for r in rows]
    assert text[0].split("\n") == [
        "Halvorsen Winter Works", "Invoice INV-2026-0001", "To: Larkspur Row HOA (books@larkspurrow.example)",
        "Date: Jan 14, 2026    Due: Feb 13, 2026 (net 30)",
    ]
    assert text[1] == "  ST-2026-0001  Thistle Way  Driveway  Bare  Salted  $60.00"
    assert text[-1] == "Total due: $165.00"
    assert "9037" not in "\n".join(text) and "Oskar" not in "\n".join(text)
    units = billing.as_json(billing.invoice_line_items(logged, day)).where("invoice_number = 'INV-2026-0002'").collect()
    assert [(u.storm_ref, u.lines) for u in units] == [("ST-2026-0001", 1)]
    items = units[0].line_items
    assert '"salt_applied":"pretreated"' in items and '"billable":190.0' in items and '"street":"Mill Pond Rd"' in items


def test_runs_never_share_ids_or_numbers(logged):
    first = logged.having(invoices=billing.invoices_after_run(logged, datetime(2026, 1, 14)))
    both = billing.invoices_after_run(first, datetime(2026, 2, 14))
    assert both.count() == 4
    assert both.select("invoice_id").distinct().count() == 4 and both.select("invoice_number").distinct().count() == 4


def test_cost(dispatched, opened):
    # 0.03 per address still to pin, 0.20 for two punches and 0.15 for the proof of each visit.
    assert activity.storm_cost(opened).collect()[0].cost == Decimal("1.52")
    assert activity.storm_cost(dispatched).collect()[0].cost == Decimal("1.40")


def test_recap_and_hours(logged):
    recap = by(activity.storm_recap(logged), "contract_id")
    assert (recap[1].completed, recap[1].salted, recap[1].packed, recap[1].uncleared, recap[1].receivable) == (
        3, 2, 1, 0, Decimal("165.00")
    )
    hours = by(activity.operator_hours(logged), "operator_id")
    assert (hours[2].visits, hours[2].seconds, hours[2].hours) == (1, 1340, Decimal("0.37"))
    assert activity.punch_rows(logged).count() == 8


def test_evidence_and_activity(logged):
    assert {r.verdict for r in activity.visit_evidence(logged).collect()} == {"verified on site"}
    rows = by(activity.operator_activity(logged, MORNING), "operator_id")
    assert (rows[1].clears_30d, rows[1].gps_verified_pct, rows[1].salted_30d) == (3, Decimal("100.0"), 2)
    assert rows[2].last_clear_at == "2026-01-14T05:14"
