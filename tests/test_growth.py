"""Plans whose shuffles must not grow faster than what they are asked for."""

from __future__ import annotations

from datetime import datetime

import pytest
from frames import tables
from pyspark.sql import functions as F

from frostline.operators import activity, billing, boards, defaults, marts, place_index, transitions
from frostline.plans import projection
from frostline.sources import versions
from frostline.sources.versions import Store


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def book(spark):
    return tables(
        spark,
        contracts=[{"contract_id": 1, "contract_name": "C", "sla_deadline": "06:00"}],
        operators=[{"operator_id": 5, "operator_name": "Ines", "ext_worker_id": 805}],
        sites=[{"site_id": i, "contract_id": 1, "address": f"{i}00 Oak Street", "street_name": "Oak Street"} for i in (1, 2, 3, 4, 4)],
        storms=[{"storm_id": 1, "storm_date": "2026-01-14"}, {"storm_id": 2, "storm_date": "2026-01-15"},
                {"storm_id": 3, "storm_date": "2026-01-16", "status": "closed"}],
        clears=[
            {"clear_id": 1, "storm_id": 1, "site_id": 1, "operator_id": 5, "status": "planned"},
            {"clear_id": 2, "storm_id": 1, "site_id": 1, "operator_id": 6, "status": "planned"},
            {"clear_id": 3, "storm_id": 1, "site_id": 2, "status": "completed"},
            {"clear_id": 4, "storm_id": 2, "site_id": 2, "status": "cancelled"},
            {"clear_id": 5, "storm_id": 3, "site_id": 3, "status": "completed"},
            {"clear_id": 6, "storm_id": 2, "site_id": 4, "operator_id": 5, "status": "planned"},
        ],
    )


def test_uncleared_board_shuffles_its_rows_once(spark, no_broadcast):
    t = book(spark)
    board = boards.sites_uncleared(t)
    below_sort = plan_of(board).split("rangepartitioning", 1)[1]
    assert "Site - " not in below_sort and "event-site-" not in below_sort  # text is made behind the sort
    assert "array_contains" in below_sort  # pairs without a clear meet no join of their own
    rows = sorted((r.storm_id, r.site_id, r.clear_id or 0, r.operator_name or "", r.needs_clear, r.needs_shift) for r in board.collect())
    assert rows == [
        (1, 1, 1, "Ines", 0, 1), (1, 1, 2, "", 0, 1), (1, 3, 0, "", 1, 0), (1, 4, 0, "", 1, 0), (1, 4, 0, "", 1, 0),
        (2, 1, 0, "", 1, 0), (2, 2, 0, "", 1, 0), (2, 3, 0, "", 1, 0), *[(2, 4, 6, "Ines", 0, 1)] * 4,
    ]


def test_requests_meet_places_last(spark, no_broadcast):
    t = book(spark)
    said = [(i, "oak") for i in range(50)] + [(7, "300 Oak"), (60, "300 oak street"), (61, "elm"), (62, ""), (63, None)]
    asked = spark.createDataFrame(said, "request_id long, said string")
    found = place_index.candidates(t, asked)
    above = plan_of(found).split("says#", 1)[0]
    assert "Exchange" not in above and "HashAggregate" not in above
    rows = [(r.request_id, r.site_id, r.clear_id) for r in found.collect()]
    # Site 1 has two planned clears; site 4 comes twice, and so does its clear.
    assert len(rows) == 50 * 8 + 1 and rows.count((60, 3, None)) == 1 and rows.count((7, 3, None)) == 1
    assert rows.count((9, 4, 6)) == 4
    pairs = [tuple(r) for r in place_index.match_places(t.sites, asked).collect()]
    assert len(pairs) == len(set(pairs)) == 50 * 4 + 1


LINES = ("storm_id long, site_id long, clear_id long, l_extendedprice double, l_quantity double, l_discount double, l_tax double, "
         "l_returnflag string, l_linestatus string, o_orderdate timestamp_ntz, l_linenumber long, l_partkey long, l_suppkey long")


def lines(spark):
    """Claims on slots: one alone, one by three (two alike), two cancelled ones, one of no storm, and one by two."""
    jan, jul = datetime(2001, 1, 5), datetime(2001, 7, 20)
    rows = [
        (1, 1, 10, 5.0, 20.0, 0.09, 0.01, "A", "O", jan, 1, 1, 1), (1, 2, 12, 5.0, 20.0, 0.0, 0.01, "N", "O", jan, 2, 1, 1),
        (1, 2, 11, 9.0, 30.0, 0.0, 0.08, "R", "F", jan, 5, 1, 1), (1, 2, 11, 8.0, 30.0, 0.0, 0.08, "R", "F", jan, 6, 1, 1),
        (1, 2, 13, 5.0, 2.0, 0.0, 0.0, "N", "O", jan, 2, 1, 1), (1, 2, 14, 5.0, 2.0, 0.0, 0.0, "N", "O", jan, 2, 1, 1),
        (None, 2, 15, 5.0, 20.0, 0.0, None, "N", "O", None, 7, 1, 1), (2, 3, 16, 5.0, 5.0, 0.0, 0.0, "N", "O", jul, 1, 1, 2),
        (2, 4, 18, 5.0, 40.0, None, 0.0, None, "O", jul, 1, 1, 2), (2, 4, None, 5.0, 40.0, None, 0.0, None, "O", jul, 1, 1, 2),
    ]
    return spark.createDataFrame(rows, LINES)


def text_rows(df):
    return sorted(map(str, df.collect()))


def test_only_slots_with_several_claims_are_gathered(spark, no_broadcast):
    claimed = lines(spark)
    found = projection.settled_claims(claimed)
    assert text_rows(found) == text_rows(projection._claims(claimed)) and found.count() == 7
    alone = plan_of(found).split("SortAggregate", 1)[0]
    assert "l_tax" in alone and "hashpartitioning(storm_id" not in alone  # lines that are alone in a slot move for no aggregate


def test_text_of_clears_is_made_behind_their_shuffles(spark, no_broadcast):
    t, claims = book(spark), projection._claims(lines(spark))
    t = t.having(settings=spark.createDataFrame([("default_clear_start", "05:00")], "key string, value string"))
    wide = projection.load_raw(spark, "/root/testdata/sf0.001", claims).clears
    want = defaults.fill_clear_defaults(wide, t.storms, t.sites, t.contracts, t.settings)
    made = projection.clears_of_claims(claims, t, by_month=True)
    above, shuffled = plan_of(made).split("REBALANCE", 1)
    assert "Salted twice" in above and "Salted twice" not in shuffled
    assert made.columns == want.columns and text_rows(made) == text_rows(want)


def test_deleting_sorts_neither_payouts_nor_the_sites_of_all_clears(spark, no_broadcast):
    t = book(spark)
    plan = transitions.delete_plan(t, storms=t.storms.where("storm_id = 1"), sites=t.sites.where("site_id in (1, 3)"))
    shown = plan_of(plan)
    assert shown.count("ShuffledHashJoin [clear_id") == 2 and "SortMergeJoin [clear_id" not in shown
    joins = [part for part in shown.split("SortMergeJoin [site_id")[1:] if "LeftSemi" in part.split("\n")[0] or "LeftAnti" in part.split("\n")[0]]
    assert joins and shown.count("HashAggregate(keys=[site_id") >= 4  # each site is sorted once, however many clears it has
    rows = sorted((r.table, r.row_id, r.action, r.cause) for r in plan.collect())
    assert rows == [
        ("clears", 1, "delete", "storm"), ("clears", 2, "delete", "storm"), ("clears", 3, "delete", "storm"),
        ("sites", 1, "blocked", "clears"), ("sites", 3, "blocked", "clears"), ("storms", 1, "delete", "named"),
    ]


@pytest.fixture
def stored(spark, tmp_path):
    """The book as files: small ones, which Spark broadcasts wherever it may."""
    store = Store(spark, str(tmp_path))
    version = store.write_first(book(spark))
    return store, version, store.read(version)


def merges(df, key: str) -> bool:
    """Whether the plan joins by ``key`` and broadcasts neither side of it."""
    shown = plan_of(df)
    return f"BroadcastHashJoin [{key}#" not in shown and f"SortMergeJoin [{key}#" in shown


def test_contracts_are_not_passed_through_the_driver(stored):
    t = stored[2]
    risk = boards.sla_at_risk(t, datetime(2026, 1, 14, 9, 0))
    assert merges(risk, "contract_id")
    assert sorted((r.clear_id, r.contract_name) for r in risk.collect()) == [(1, "C"), (2, "C")]
    assert merges(defaults.fill_clear_defaults(t.clears, t.storms, t.sites, t.contracts, t.settings), "contract_id")


def test_board_merges_sites_with_their_contracts(stored):
    t = stored[2]
    board = boards.sites_uncleared(t)
    assert merges(board, "contract_id") and board.count() == 12 and merges(boards.active_sites(t), "contract_id")


def test_marts_pass_neither_sites_nor_contracts_through_the_driver(stored):
    t = stored[2]
    held = marts.build(t)
    shown = plan_of(held.work)
    assert "ShuffledHashJoin [site_id" in shown and "BroadcastHashJoin [site_id" not in shown
    shuffled = shown.split("ShuffledHashJoin [site_id", 1)[1].split("Exchange", 1)[1].split("\n")[1]
    assert "done_date" in shuffled and "checked_in_at" not in shuffled.split("AS done_date")[1]
    report = marts.recap(held, t)
    # What is broadcast here are sites counted by contract, as far as they measure small.
    broadcast = [line for line in plan_of(report).splitlines() if "BroadcastHashJoin [contract_id" in line]
    assert "SortMergeJoin [contract_id" in plan_of(report) and all("LeftOuter" in line for line in broadcast)
    assert sorted(map(str, report.collect())) == sorted(map(str, activity.storm_recap(t).collect()))


def test_receivables_merge_their_contracts(stored):
    t = stored[2]
    report = marts.receivables(marts.build(t), t)
    assert merges(report, "contract_id")
    assert sorted(map(str, report.collect())) == sorted(map(str, billing.receivables_by_contract(t).collect()))


def test_many_ids_of_a_batch_are_not_broadcast(spark, stored, monkeypatch):
    store, version, t = stored
    ids = t.clears.select("clear_id")
    assert "BroadcastHashJoin [clear_id" in plan_of(ids.join(store._met(ids), "clear_id", "left_semi"))
    monkeypatch.setattr(versions, "BLOCK", 1)
    shown = plan_of(ids.join(store._met(ids), "clear_id", "left_semi"))
    assert "ShuffledHashJoin [clear_id" in shown and "BroadcastHashJoin" not in shown
    after = store.apply(version, t.clears.where("clear_id in (1, 3)").withColumn("status", F.lit("skipped")), log=True)
    assert sorted((r.clear_id, r.sign) for r in store.logged(after).collect()) == [(1, -1), (1, 1), (3, -1), (3, 1)]
    assert {r.clear_id for r in store.read(after).clears.where("status = 'skipped'").collect()} == {1, 3}
