"""Every declared rule finds its bad row and nothing else."""

from __future__ import annotations

from frames import table, tables

from frostline.operators import quality
from frostline.sources.shared import written_once


def bad_book(spark):
    return tables(
        spark, filled=False,
        settings=table(spark, "settings", {"key": "state"}, {"key": "state", "value": "MN"}, {"key": "x"}),
        contracts=[{"contract_id": 1, "contract_name": "ok", "sla_deadline": "29:59"}, {"contract_id": 2, "contract_type": "golf"},
                   {"contract_id": 3, "sla_deadline": "7am"}, {"contract_id": 4, "sla_deadline": ""}, {"contract_id": 5, "contract_type": None}],
        sites=[{"site_id": 1, "contract_id": 1, "normalized_address": "a"}, {"site_id": 2, "contract_id": 1, "normalized_address": "a"},
               {"site_id": 3, "contract_id": 9, "normalized_address": "c", "surface": "roof", "sla_deadline": "06:60"}],
        operators=[{"operator_id": 1, "ext_worker_id": 8}, {"operator_id": 2, "ext_worker_id": 8, "payout_type": "hourly"},
                   {"operator_id": 3}, {"operator_id": 4}],
        storms=[{"storm_id": 1, "storm_ref": "S", "storm_date": "2026-01-14", "sla_deadline": "25:00"},
                {"storm_id": 2, "storm_ref": "S", "storm_date": "2026-01-14", "storm_type": "hail"},
                {"storm_id": 3, "storm_date": None, "status": "over"}, {"storm_id": 4, "storm_date": "2026-01-14", "sla_deadline": "0700"}],
        clears=[
            {"clear_id": 1, "storm_id": 1, "site_id": 1, "scheduled_start": "2026-01-14T04:00", "ext_shift_id": 5, "operator_id": 1},
            {"clear_id": 2, "storm_id": 1, "site_id": 1, "scheduled_start": "2026-01-14T04:00:30", "ext_shift_id": 5},
            {"clear_id": 3, "storm_id": 1, "site_id": 1, "scheduled_start": "2026-01-14T04:00-06:00", "status": "cancelled"},
            {"clear_id": 4, "storm_id": 9, "site_id": 2, "scheduled_start": "2026-01-14T04:00Z", "operator_id": 99},
            {"clear_id": 5, "storm_id": 2, "site_id": 99, "scheduled_start": "2026-01-14 04:00", "duration_minutes": 4},
            {"clear_id": 6, "storm_id": 2, "site_id": 2, "scheduled_start": "tonight", "duration_minutes": 721},
            {"clear_id": 7, "storm_id": 3, "site_id": 2, "scheduled_start": "2026-01-14T25:00", "duration_minutes": 5, "status": "done"},
            {"clear_id": 8, "storm_id": 3, "site_id": 1, "duration_minutes": 720, "surface": "roof", "condition": "wet", "salt_applied": "some"},
        ],
        mileage=[{"trip_id": 1, "clear_id": 1, "miles": 0}, {"trip_id": 2, "clear_id": 77, "miles": -1}, {"trip_id": 3}],
        invoices=[{"invoice_id": 1, "contract_id": 1, "invoice_number": "I"}, {"invoice_id": 2, "contract_id": 9, "invoice_number": "I"}],
        payouts=[{"payout_id": 1, "operator_id": 1, "clear_id": 1}, {"payout_id": 2, "operator_id": 77, "clear_id": 1},
                 {"payout_id": 3, "operator_id": 1, "clear_id": 88}],
    )


def test_each_rule(spark):
    found: dict[str, set] = {}
    for r in quality.dq_violations(bad_book(spark)).collect():
        found.setdefault(r.rule, set()).add(r.row_id)
    assert found == {
        "contract_type": {2, 5}, "contract_sla_clock": {3, 4}, "site_surface": {3}, "site_sla_clock": {3},
        "payout_type": {2}, "storm_date": {3}, "storm_type": {2}, "storm_sla_clock": {4}, "storm_status": {3},
        "storm_clock_unreal": {1}, "scheduled_start": {3, 4, 5, 6}, "duration_minutes": {5, 6}, "clear_status": {7},
        "start_unreadable": {3, 4, 6, 7}, "proof_surface": {8}, "proof_condition": {8}, "proof_salt": {8}, "miles": {2, 3},
        "unique_setting": {None}, "unique_address": {2}, "unique_worker": {2}, "unique_storm_ref": {2},
        "unique_shift": {2}, "unique_invoice_number": {2}, "unique_payout_clear": {2},
        "one_clear_per_site_storm": {2}, "site_contract": {3}, "clear_storm": {4}, "clear_site": {5},
        "clear_operator": {4}, "mileage_clear": {2}, "invoice_contract": {2}, "payout_operator": {2}, "payout_clear": {3},
    }


def test_counts(spark):
    counts = {r.rule: r.violations for r in quality.dq_violation_counts(bad_book(spark)).collect()}
    assert counts["scheduled_start"] == 4 and counts["unique_setting"] == 1


def test_clears_are_scanned_twice(spark):
    """All rules together: one scan of the fact table for keys, one for values and culprits."""
    from frostline.sources.shared import shared_folder
    from frostline.sources.tables import read_tables, write_tables

    root = shared_folder(spark, "book")
    write_tables(bad_book(spark), root)
    t = read_tables(spark, root)

    def scans(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        # A scan of clears is a leaf relation with a column that only clears have.
        return sum("ext_event_id" in line for line in plan.splitlines() if line.strip(" :+-").startswith("Relation"))

    assert scans(quality._bad_keys(quality._entries(t, whole=False))) == scans(quality.dq_violations(t)) == 1


def test_the_gate_splits_a_batch(spark):
    t = bad_book(spark)
    good, bad = quality.gate(t, "clears")
    assert {r.clear_id for r in good.collect()} == {1, 8} - {8} and good.columns == t.clears.columns
    assert {r.clear_id: set(r.rules) for r in bad.collect()}[2] == {"one_clear_per_site_storm", "unique_shift"}
    assert good.count() + bad.count() == t.clears.count()
    good, bad = quality.gate(t, "storms")
    assert {r.storm_id for r in good.collect()} == {1}  # a clock that never comes is advice only


def test_keys_are_shuffled_as_numbers(spark, monkeypatch):
    """Texts stay where they are until few are left; texts that share a number are told apart."""
    t = bad_book(spark)
    plan = quality._suspects(quality._entries(t, whole=False))._jdf.queryExecution().executedPlan()
    schema = plan.schema().toDDL()
    assert "STRING" not in schema and "k BIGINT" in schema
    found = sorted(map(str, quality.dq_violations(t).collect()))
    monkeypatch.setattr(quality.F, "xxhash64", lambda *_: quality.F.lit(1))
    assert sorted(map(str, quality.dq_violations(t).collect())) == found


def test_many_bad_keys_are_hashed_and_not_sorted_or_broadcast(spark, monkeypatch):
    """Keys that are many pass neither through the driver nor a sort of all entries, and name the same violations."""
    t = bad_book(spark)

    def joins(df, key):
        plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
        return {line.split(f"Join [{key}#")[0].split()[-1] for line in plan if f"Join [{key}#" in line}

    few = quality.dq_violations(t)
    assert joins(few, "domain") == {"BroadcastHash"}
    found, sides = sorted(map(str, few.collect())), [sorted(map(str, side.collect())) for side in quality.gate(t, "clears")]
    monkeypatch.setattr(quality, "FEW", 0)
    many = quality.dq_violations(t)
    assert joins(many, "domain") == {"ShuffledHash"} and sorted(map(str, many.collect())) == found
    split = quality.gate(t, "clears", written_once(many, "found"))
    assert all(joins(side, "clear_id") == {"ShuffledHash"} for side in split)
    assert [sorted(map(str, side.collect())) for side in split] == sides
