"""Plans that must hold at scale: no products, no Python, pruned scans, no hot group in one row."""

from __future__ import annotations

import contextlib
import io
from pathlib import Path

import pytest
from frames import tables as small_tables
from pyspark.sql import functions as F

from frostline.operators import activity, boards, payouts
from frostline.operators.documents import as_rows
from frostline.plans import catalogue
from frostline.plans.commands import AS_OF_A
from frostline.plans.workspace import tables
from frostline.sources.shared import shared_folder
from frostline.sources.tables import read_tables, write_tables

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@needs_data
@pytest.mark.parametrize("name", sorted(n for n in catalogue.queries() if not n.startswith("stream_")))
def test_no_products_and_no_python(spark, name):
    text = plan(catalogue.queries()[name](spark, SF))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert word not in text, word


@needs_data
def test_scans_are_pruned(spark):
    t = tables(spark, SF)
    risk = plan(boards.sla_at_risk(t, AS_OF_A))
    assert "EqualTo(status,planned)" in risk and "IsNull(checked_in_at)" in risk
    assert "LessThanOrEqual(storm_date,2001-08-01)" in risk
    assert "dynamicpruning" in plan(boards.storms_open(t)), "open storms prune the month partitions of clears"
    assert "GreaterThanOrEqual(scheduled_start,2001-08-01), LessThan(scheduled_start,2001-08-02)" in plan(boards.clears_today(t, AS_OF_A))
    assert "Or(GreaterThanOrEqual(checked_in_at,2001-07-02),And(IsNull(checked_in_at),GreaterThanOrEqual(scheduled_start,2001-07-02)))" in plan(activity.operator_activity(t, AS_OF_A))
    due = plan(payouts.payouts_due(t))
    assert "EqualTo(paid,0)" in due and "Window" not in due


def test_documents_have_one_form_at_any_size(spark):
    for n in (5, 5000):
        lines = spark.range(n).select(F.lit("doc").alias("doc"), "id", F.col("id").cast("string").alias("text")).repartition(7)
        heads = spark.createDataFrame([("doc", n)], "doc string, n int")
        rows = as_rows(heads, lines, ["doc"], "id", F.lit("head"), F.col("text"), F.concat(F.lit("total "), F.col("n")))
        read = [r.line for r in rows.orderBy("doc", "section", "position").collect()]
        assert read == ["head", *map(str, range(n)), f"total {n}"]


def test_tables_survive_a_round_trip(spark):
    t = small_tables(
        spark, contracts=[{"contract_id": 1}], sites=[{"site_id": 1, "contract_id": 1, "address": "a"}],
        storms=[{"storm_id": 1, "storm_date": "2026-01-14"}, {"storm_id": 2, "storm_date": None}],
        clears=[{"clear_id": 1, "storm_id": 1, "site_id": 1}, {"clear_id": 2, "storm_id": 2, "site_id": 1}],
    )
    root = shared_folder(spark, "trip")
    write_tables(t, root)
    back = read_tables(spark, root)
    assert back.clears.exceptAll(t.clears).isEmpty() and back.clears.count() == 2
    assert {r.storm_month for r in back.clears.collect()} == {"2026-01", "undated"}
    assert boards.sites_uncleared(back).count() == boards.sites_uncleared(t).count()
