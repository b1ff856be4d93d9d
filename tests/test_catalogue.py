"""Every query against its checking SQL on the smallest test tables, and properties that tie queries together."""

from __future__ import annotations

from pathlib import Path

import comparing
import pytest

import __spark_entry__ as entry_points
from frostline.plans import catalogue, oracles
from frostline.operators import billing, boards, quality, transitions
from frostline.plans.commands import AS_OF_A
from frostline.plans.workspace import tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")

QUERIES = catalogue.queries()
SQL = oracles.oracle_sql()


@pytest.fixture(scope="module")
def database():
    return comparing.open_database(SF)


@pytest.fixture(scope="module")
def t(spark):
    return tables(spark, SF)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    ours = comparing.rows_of_spark(QUERIES[name](spark, SF))
    assert comparing.difference(ours, comparing.rows_of_sql(database, SQL[name])) is None


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_finished_dollar_is_billed_once(t):
    lines = billing.invoice_lines(t, AS_OF_A).agg({"billable": "sum"}).first()[0]
    assert lines == billing.invoice_run(t, AS_OF_A).agg({"total_amount": "sum"}).first()[0]
    assert lines == billing.receivables_by_contract(t).agg({"total_billable": "sum"}).first()[0]


def test_uncleared_and_done_make_up_the_board(t):
    pairs = boards.storm_site_pairs(boards.open_storms(t).select("storm_id"), boards.active_sites(t).select("site_id"))
    pairs = pairs.select("storm_id", "site_id")
    left = boards.uncleared_rows(t).select("storm_id", "site_id")
    done = t.clears.where("status in ('completed', 'skipped')").select("storm_id", "site_id")
    assert pairs.exceptAll(left).exceptAll(done.join(pairs, ["storm_id", "site_id"], "left_semi")).isEmpty()
    assert left.count() + done.join(pairs, ["storm_id", "site_id"], "left_semi").count() == pairs.count()


def test_opening_again_adds_nothing(t):
    storms = boards.open_storms(t).where("status = 'forecast'")
    added = transitions.open_storm(t, storms)
    assert added.count() > 0
    after = t.having(clears=t.clears.unionByName(added))
    assert transitions.open_storm(after, storms).isEmpty()


def test_recap_counts_what_the_board_lists(t):
    from frostline.operators import activity

    left = activity.storm_recap(t).groupBy("storm_id").agg({"uncleared": "sum"}).where("`sum(uncleared)` > 0")
    board = boards.uncleared_rows(t).groupBy("storm_id").count()
    assert {tuple(r) for r in left.collect()} == {tuple(r) for r in board.collect()}


def test_every_integrity_rule_has_rows_that_break_it(spark):
    found = {r.rule for r in QUERIES["dq_staged_violations"](spark, SF).select("rule").distinct().collect()}
    rules = {c.rule for _, checks in quality.value_checks().values() for c in checks}
    rules |= {u[0] for u in quality.UNIQUE} | {r[0] for r in quality.REFERENCES} | {"unique_setting", "one_clear_per_site_storm"}
    assert rules <= found
