"""State changes: guards, idempotence, deletion, merging."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from frames import proofs, punches, settings, table, tables
from pyspark.sql import functions as F

from frostline.operators import defaults, outbox, quality, transitions
from frostline.operators.proofs import name_mentions, notes_leak_scan, option_keys, proof_validation

NOW = datetime(2026, 1, 14, 5, 41)


def book(spark, clears=(), **more):
    given = {
        "settings": settings(spark, default_operator_id="1"),
        "contracts": [{"contract_id": 1, "contract_name": "C", "per_clear_fee": 45, "salt_fee": 15}, {"contract_id": 2, "contract_name": "D", "is_active": 0}],
        "sites": [{"site_id": i, "contract_id": 1, "address": f"{i} Thistle Way", "street_name": "Thistle Way", "normalized_address": f"{i} thistle way"} for i in (1, 2)]
        + [{"site_id": 3, "contract_id": 2, "address": "3 Oak", "normalized_address": "3 oak"},
           {"site_id": 4, "contract_id": 1, "address": "4 Oak", "normalized_address": "4 oak", "is_active": 0}],
        "storms": [{"storm_id": 1, "storm_date": "2026-01-14"}, {"storm_id": 2, "storm_date": "2026-01-15"}, {"storm_id": 3, "storm_date": "2026-01-16", "status": "closed"}],
        "operators": [{"operator_id": 1, "operator_name": "Tove", "ext_worker_id": 801}, {"operator_id": 2, "operator_name": "Ines"}],
        "clears": [{"storm_id": 1, "site_id": 1, **c} for c in clears],
    }
    return tables(spark, **{**given, **more})


def ids(df, *columns):
    return {tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()}


def test_open_storm_guards(spark):
    t = book(spark, [{"clear_id": 1}, {"clear_id": 2, "site_id": 2, "status": "cancelled"}])
    storm = t.storms.where("storm_id = 1")
    assert ids(transitions.open_storm(t, storm), "site_id") == {2, 3}
    assert ids(transitions.open_storm(t, storm, require_active_contract=True), "site_id") == {2}
    assert ids(transitions.open_storm(t, storm, among=F.col("contract_id") == 2), "site_id") == {3}
    both = t.clears.unionByName(transitions.open_storm(t, storm))
    assert quality.double_bookings(both).isEmpty()


def test_adhoc(spark):
    t = book(spark, [{"clear_id": 1}, {"clear_id": 2, "site_id": 2, "storm_id": 2, "status": "completed"}])
    assert ids(transitions.adhoc_candidates(t, "%THISTLE%"), "site_id", "clear_id", "storm_ref") == {
        (1, 1, "ST-2026-0001"), (2, None, None)}
    asked = spark.createDataFrame([(10, 1, 2), (11, 2, 2), (12, 3, 2), (12, 3, 2)], "clear_id long, site_id long, operator_id long")
    rows = transitions.adhoc_inserts(t, asked.withColumn("at", F.lit("2026-01-14 05:36:20").cast("timestamp_ntz"))).collect()
    assert [(r.clear_id, r.storm_id, r.scheduled_start, r.duration_minutes, r.is_adhoc, r.operator_id) for r in rows] == [
        (12, 2, "2026-01-14T05:36", 30, 1, 2)]


def test_results_need_both_punches_and_are_read_once(spark):
    t = book(spark, [
        {"clear_id": 1, "ext_shift_id": 901, "ext_event_id": 71}, {"clear_id": 2, "site_id": 2, "ext_shift_id": 902, "ext_event_id": 72},
        {"clear_id": 3, "site_id": 3, "ext_shift_id": 903, "ext_event_id": 73},
        {"clear_id": 4, "storm_id": 2, "status": "completed", "ext_shift_id": 904, "ext_event_id": 71, "report_id": 55},
    ])
    seen = punches(
        spark, {"shift_id": 901, "punch_type": "in", "punched_at": "2026-01-14T04:17:20-06:00", "gps_verified": 1, "distance_m": 12},
        {"shift_id": 901, "punch_type": "in", "punched_at": "2026-01-14T04:19:00-06:00", "gps_verified": 0, "distance_m": 900},
        {"shift_id": 901, "punch_type": "out", "punched_at": "2026-01-14T04:33:55-06:00"},
        {"shift_id": 902, "punch_type": "in", "punched_at": "2026-01-14T04:17:20-06:00"},
        {"shift_id": 903, "punch_type": "in", "punched_at": "2026-01-14T04:17:20-06:00"},
        {"shift_id": 903, "punch_type": "out", "punched_at": "2026-01-14T04:28:10-06:00"},
    )
    read = proofs(
        spark, {"submission_id": 55, "event_id": 71, "data": ("walk", "icy", "no", None), "media": []},
        {"submission_id": 57, "event_id": 71, "data": ("lot", "bare", "yes", "n"), "media": [("after", "a"), ("before", "b"), ("after", "c")]},
    )
    rows = {r.clear_id: r for r in transitions.apply_results(t, seen, read, NOW).collect()}
    one = rows[1]
    assert (one.status, one.report_id, one.photo_count, one.surface, one.gps_verified, one.checkin_distance_m, one.notes) == (
        "completed", 57, 2, "lot", 1, 12, "n")
    assert (rows[2].status, rows[2].checked_in_at) == ("planned", None)
    assert (rows[3].status, rows[3].report_id, rows[3].photo_count) == ("completed", None, 0)
    assert rows[4].report_id == 55 and rows[4].updated_at is None and one.updated_at == NOW


def test_move_day_frees_and_refills_the_slot(spark):
    t = book(spark, [{"clear_id": 1, "ext_event_id": 7, "ext_shift_id": 8, "fee": 99}, {"clear_id": 2, "site_id": 2, "status": "completed"}])
    order = spark.createDataFrame([(1, 21, "2026-01-15T04:00"), (2, 22, "2026-01-15T04:00")], "clear_id long, new_clear_id long, new_start string")
    rows = {r.clear_id: r for r in transitions.move_day(t, order, NOW).collect()}
    assert set(rows) == {1, 2, 21}
    assert rows[1].status == "cancelled"
    assert (rows[21].status, rows[21].ext_event_id, rows[21].ext_shift_id, rows[21].scheduled_start, rows[21].fee) == (
        "planned", None, None, "2026-01-15T04:00", Decimal("45.00"))


def test_commands_touch_planned_clears_only(spark):
    t = book(spark, [{"clear_id": 1, "other_fee": 3}, {"clear_id": 2, "site_id": 2, "status": "completed"}])
    order = spark.createDataFrame([(1, None), (2, 5.0), (1, 12.5)], "clear_id long, new_other_fee double").withColumn(
        "new_other_fee", F.col("new_other_fee").cast("decimal(12,2)"))
    rows = {r.clear_id: (r.status, r.other_fee) for r in transitions.skip(t, order, NOW).collect()}
    assert rows == {1: ("skipped", Decimal("12.50")), 2: ("completed", Decimal("0.00"))}


def test_settings(spark):
    have = table(spark, "settings", {"key": "state", "value": "MN"}, {"key": "invoice_prefix"})
    seeds = settings(spark)
    updates = table(spark, "settings", {"key": "invoice_prefix", "value": "X"})
    got = {r.key: r.value for r in transitions.upsert_settings(have, seeds, updates).collect()}
    assert got["state"] == "MN" and got["invoice_prefix"] == "X" and got["irs_mileage_rate"] == "0.70" and len(got) == 11
    assert {r.key: r.value for r in transitions.upsert_settings(have, seeds, updates.limit(0)).collect()}["invoice_prefix"] is None


def test_appends(spark):
    t = book(spark)
    entries = spark.createDataFrame(
        [(10, 1, "1 THISTLE Way."), (11, 1, "#9 Elm"), (12, 1, "9  elm"), (13, 99, "8 Elm")], "site_id long, contract_id long, address string"
    ).withColumns({c: F.lit(None).cast("string") for c in ("city", "state", "zip", "surface")})
    assert ids(transitions.append_sites(t, entries), "site_id", "verdict") == {
        (10, "known address"), (11, "accepted"), (12, "repeated in batch"), (13, "unknown contract")}
    staff = spark.createDataFrame([(5, 801), (6, 900), (7, 900), (8, None)], "operator_id long, ext_worker_id long")
    assert ids(transitions.append_unique(t.operators, staff, "ext_worker_id", "operator_id"), "operator_id", "verdict") == {
        (5, "known key"), (6, "accepted"), (7, "repeated in batch"), (8, "accepted")}


def test_merge_sites(spark):
    t = book(spark, [{"clear_id": 1}, {"clear_id": 2, "site_id": 2}, {"clear_id": 3, "site_id": 2, "storm_id": 2}, {"clear_id": 4, "site_id": 2, "status": "cancelled"}])
    t = t.having(sites=t.sites.withColumn("ext_location_id", F.when(F.col("site_id") == 2, F.lit(77).cast("long"))))
    merges = transitions.merge_sites(t, F.lower("street_name"))
    assert [tuple(r) for r in merges.collect()] == [(2, 1, 77, 3, 1)]
    moved = transitions.repoint_clears(t, merges, NOW)
    assert moved.count() == 4 and ids(moved, "site_id") == {1}
    assert ids(quality.double_bookings(moved), "row_id") == {2}


def test_deletion(spark):
    t = book(
        spark, [{"clear_id": 1}, {"clear_id": 2, "storm_id": 2, "operator_id": 2}],
        contracts=[{"contract_id": 1}, {"contract_id": 2}, {"contract_id": 3}],
        payouts=[{"payout_id": 1, "operator_id": 1, "clear_id": 1}, {"payout_id": 2, "operator_id": 2, "clear_id": 2}],
        mileage=[{"trip_id": 1, "clear_id": 1, "miles": 1, "trip_date": "2026-01-14"}],
        invoices=[{"invoice_id": 1, "contract_id": 3, "invoice_date": "2026-01-14"}],
    )
    one = t.storms.where("storm_id = 1")
    after = transitions.delete_storms(t, one)
    assert ids(after.clears, "clear_id") == {2} and ids(after.payouts, "payout_id") == {2}
    assert ids(after.mileage, "clear_id") == {None} and after.sites.count() == 4
    after = transitions.delete_operators(t, t.operators.where("operator_id = 2"))
    assert ids(after.clears, "clear_id", "operator_id") == {(1, 1), (2, None)} and ids(after.payouts, "payout_id") == {1}
    after = transitions.delete_contracts(t, t.contracts)
    assert ids(after.contracts, "contract_id") == {1, 2} and after.invoices.isEmpty()
    assert ids(transitions.delete_sites(t, t.sites).sites, "site_id") == {1}
    plan = ids(transitions.delete_plan(t, storms=one, contracts=t.contracts, sites=t.sites), "table", "row_id", "action")
    assert {("storms", 1, "delete"), ("clears", 1, "delete"), ("payouts", 1, "delete"), ("mileage", 1, "set null"),
            ("contracts", 1, "blocked"), ("contracts", 3, "delete"), ("invoices", 1, "delete"), ("sites", 1, "blocked"), ("sites", 2, "delete")} <= plan


def test_worker_invitations(spark):
    staff = table(spark, "operators", {"operator_id": 1, "email": "a@x"}, {"operator_id": 2, "email": "b@x", "ext_worker_id": 9})
    assert ids(outbox.outbox_workers(staff), "idempotency_key") == {"worker-a@x"}


def test_proof_checks(spark):
    rows = proofs(
        spark, {"submission_id": 1, "data": ("lot", "bare", "yes", None), "media": [("after", "a")]},
        {"submission_id": 2, "data": ("Lot", None, "yes", None), "media": [("after", "a")] * 5}, {"submission_id": 3})
    got = {r.submission_id: r.problems for r in proof_validation(rows).collect()}
    assert got == {2: "surface unknown; condition missing; too many photos",
                   3: "surface missing; condition missing; salt_applied missing; after photo missing"}


def test_leaks_in_notes(spark):
    names = spark.createDataFrame([("Oskar",), ("Mary Lou Smith",), ("",)], "name string")
    notes = spark.createDataFrame([
        (1, "Call building manager Oskar, gate 9037"), (2, "Bare to the curb, brine put down, pictures taken"), (3, "Oskarng trip; met mary-lou  SMITH."),
        (4, "lockbox code: 99812"), (5, None), (6, "Mary Lou")], "id long, text string")
    got = {r.id: (r.gate_code, r.names, r.first_name) for r in notes_leak_scan(notes, "id", "text", names, "name").collect()}
    assert got == {1: (1, 1, "Oskar"), 3: (0, 1, "Mary Lou Smith"), 4: (1, 0, None)}
    assert name_mentions(notes, "id", "text", names.limit(0), "name").isEmpty()


def test_option_keys(spark):
    labels = spark.createDataFrame([("Pre-treated",), ("Pre treated",), ("Lot",), ("Lot",)], "label string")
    got = {r.label: (r.option_key, r.uses, r.labels_with_key) for r in option_keys(labels, "label").collect()}
    assert got == {"Pre-treated": ("pre_treated", 1, 2), "Pre treated": ("pre_treated", 1, 2), "Lot": ("lot", 2, 1)}


def test_delta_holds_the_changed_rows_only(spark):
    t = book(spark, [{"clear_id": 1}, {"clear_id": 2, "site_id": 2}, {"clear_id": 3, "site_id": 3, "status": "completed"}])
    order = spark.createDataFrame([(1,), (3,)], "clear_id long")
    delta = transitions.cancel(t, order, NOW, delta=True)
    assert ids(delta, "clear_id", "status") == {(1, "cancelled")} and delta.columns == t.clears.columns
    whole = transitions.cancel(t, order, NOW)
    assert whole.where(F.col("updated_at").isNotNull()).exceptAll(delta).isEmpty() and whole.count() == 3


def test_change_stamps(spark):
    before = table(spark, "storms", {"storm_id": 1, "storm_date": "2026-01-14", "notes": "a"}, {"storm_id": 2, "storm_date": "2026-01-14"},
                   {"storm_id": 3, "storm_date": "2026-01-14", "notes": "c"})
    after = before.withColumn("notes", F.when(F.col("storm_id") == 1, "b").when(F.col("storm_id") == 2, F.col("notes")))
    stamped = defaults.stamp_changes(before, after, "storm_id", NOW, defaults.STORM_STAMPED)
    assert {r.storm_id: r.updated_at for r in stamped.collect()} == {1: NOW, 2: None, 3: NOW}
    unlisted = before.withColumn("created_at", F.lit("2026-01-14").cast("timestamp"))
    assert defaults.stamp_changes(before, unlisted, "storm_id", NOW, defaults.STORM_STAMPED).where("updated_at is not null").isEmpty()


def test_declared_defaults(spark):
    rows = spark.createDataFrame([(1, None), (2, "hoa")], "contract_id long, contract_type string")
    assert ids(defaults.column_defaults(rows, "contracts"), "contract_id", "contract_type", "payment_terms_days", "is_active") == {
        (1, "commercial", 30, 1), (2, "hoa", 30, 1)}


def test_opening_again_after_a_cancellation_gives_new_ids(spark):
    t = tables(
        spark, contracts=[{"contract_id": 1}], sites=[{"site_id": s, "contract_id": 1, "address": str(s)} for s in (1, 2)],
        storms=[{"storm_id": 7, "storm_date": "2026-01-14"}], clears=[],
    )
    seen = set()
    for _ in range(3):
        opened = transitions.open_storm(t, t.storms)
        now = {r.clear_id for r in opened.collect()}
        assert len(now) == 2 and not now & seen
        seen |= now
        cancelled = t.clears.unionByName(opened).withColumn("status", F.lit("cancelled"))
        t = t.having(clears=spark.createDataFrame(cancelled.collect(), cancelled.schema))


def test_the_last_command_counts_whole(spark):
    rows = [(1, 1, "05:00", 2), (1, 2, "06:00", 1), (2, 9, "06:00", 1), (2, 3, "07:00", 5)]
    for order in (rows, rows[::-1]):
        batch = spark.createDataFrame(order, "clear_id long, seq int, new_start string, new_operator_id int")
        got = {tuple(r) for r in transitions.latest(batch, "clear_id").collect()}
        assert got == {(1, "06:00", 1), (2, "06:00", 1)}


def test_each_submission_of_an_event_is_used_once(spark):
    t = tables(
        spark, contracts=[{"contract_id": 1}], sites=[{"site_id": 1, "contract_id": 1, "address": "a"}],
        storms=[{"storm_id": s, "storm_date": "2026-01-14"} for s in (1, 2)],
        clears=[{"clear_id": c, "storm_id": c, "site_id": 1, "ext_event_id": 5, "ext_shift_id": 50 + c} for c in (1, 2)],
    )
    feed = punches(spark, *[
        {"shift_id": 50 + c, "punch_type": k, "punched_at": f"2026-01-14T0{h}:00:00-06:00"}
        for c, k, h in ((2, "in", 4), (2, "out", 5), (1, "in", 6), (1, "out", 7))
    ])
    sent = proofs(spark, *[
        {"submission_id": s, "event_id": 5, "submitted_at": at, "data": ("lot", "bare", "no", None), "media": []}
        for s, at in ((11, "2026-01-14T07:01:00"), (12, "2026-01-14T05:01:00"))
    ])
    done = transitions.apply_results(t, feed, sent, NOW)
    assert {(r.clear_id, r.report_id) for r in done.collect()} == {(2, 12), (1, 11)}
