"""Batches rewrite the months they touch, readers of older versions go on, marts follow by signed rows."""

from __future__ import annotations

from datetime import datetime
from pathlib import Path

import pytest
from frames import tables
from pyspark.sql import functions as F

from frostline.operators import activity, billing, marts, transitions
from frostline.sources import versions
from frostline.sources.shared import shared_folder
from frostline.sources.versions import Store

NOW = datetime(2026, 3, 1, 12)


def book(spark):
    """Three storms in two months, four sites of two contracts, one clear of a storm nobody knows."""
    clears = [
        {"clear_id": 10 * s + i, "storm_id": s, "site_id": i, "status": "completed" if i < 3 else "planned", "ext_shift_id": 100 * s + i,
         "scheduled_start": f"2026-0{1 + s // 3}-14T04:00", "surface": "lot", "condition": "bare", "salt_applied": "yes"}
        for s in (1, 2, 3) for i in (1, 2, 3, 4)
    ]
    return tables(
        spark, contracts=[{"contract_id": c, "contract_type": "hoa", "per_clear_fee": 40, "salt_fee": 10} for c in (1, 2)],
        sites=[{"site_id": i, "contract_id": 1 + i % 2, "address": str(i)} for i in (1, 2, 3, 4)],
        storms=[{"storm_id": s, "storm_date": f"2026-0{1 + s // 3}-14"} for s in (1, 2, 3)],
        clears=[*clears, {"clear_id": 99, "storm_id": 77, "site_id": 1}],
    )


@pytest.fixture
def store(spark):
    return Store(spark, shared_folder(spark, "store"))


def files(store):
    root = Path(store.root.removeprefix("file:"))
    return {str(p.relative_to(root)) for p in (root / "clears").rglob("*.parquet")}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_a_batch_for_one_storm_rewrites_one_month(spark, store):
    first = store.write_first(book(spark))
    assert {None, "2026-01", "2026-02"} == set(first.months())
    before, old = files(store), store.read(first)
    was = rows(old.clears)
    batch = transitions.cancel(old, old.clears.where("storm_id = 3").select("clear_id", "storm_month"), NOW, delta=True)
    second = store.apply(first, batch)
    written = files(store) - before
    assert before <= files(store) and {p.split("/")[2] for p in written} == {"storm_month=2026-02"}
    changed = {k for k in first.held if first.held[k] != second.held[k]}
    assert changed == {("clears", "2026-02")}
    # Who reads the older version, also from before, sees it as it was.
    assert rows(old.clears) == rows(store.read(store.version(number=1)).clears) == was
    now = store.read().clears
    whole = transitions.cancel(old, old.clears.where("storm_id = 3").select("clear_id"), NOW)
    assert rows(now) == rows(whole.select(*now.columns)) != was
    assert now.where("storm_id = 3 and status = 'cancelled'").count() == 2


def test_new_rows_deleted_rows_and_empty_batches(spark, store):
    first = store.write_first(book(spark))
    t = store.read(first)
    extra = t.clears.where("clear_id = 31").withColumns({"clear_id": F.lit(500).cast("long"), "storm_month": F.lit("2027-05")})
    second = store.apply(first, extra, gone=t.clears.where("storm_id in (1, 2) or storm_id = 77").select("clear_id", "storm_month"))
    assert set(second.months()) == {"2026-02", "2027-05"}
    assert {r.clear_id for r in store.read(second).clears.collect()} == {31, 32, 33, 34, 500}
    third = store.apply(second, t.clears.limit(0))
    assert rows(store.read(third).clears) == rows(store.read(second).clears)
    assert (third.number, store.version().number) == (3, 3)


def test_branches_and_writers_that_collide(spark, store):
    first = store.write_first(book(spark))
    t = store.read(first)
    one = transitions.cancel(t, t.clears.where("storm_id = 1").select("clear_id"), NOW, delta=True)
    side = store.apply(first, one, branch="side")
    assert (side.branch, side.number, store.version().number, store.version("side").number) == ("side", 1, 1, 1)
    assert rows(store.read().clears) == rows(t.clears) != rows(store.read(side).clears)
    store.apply(first, one)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        store.apply(first, one)  # from a version that is not the last any more


def test_other_tables_are_replaced_whole(spark, store):
    first = store.write_first(book(spark))
    t = store.read(first)
    closed = t.storms.withColumn("status", F.lit("closed"))
    second = store.apply(first, storms=closed)
    assert {r.status for r in store.read(second).storms.collect()} == {"closed"}
    assert rows(store.read(second).clears) == rows(t.clears) and {r.status for r in t.storms.collect()} == {"active"}


def test_a_named_month_is_all_that_is_read(spark, store):
    t = store.read(store.write_first(book(spark)))
    commands = t.clears.where("storm_id = 3").select("clear_id", "storm_month")
    plan = transitions.cancel(t, commands, NOW, delta=True)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_marts_follow_batches(spark, store):
    """Taking the first or the last day of a contract away moves the days too; no clears are scanned for it."""
    version = store.write_first(book(spark))
    t = store.read(version)
    held = marts.build(t)
    batches = (
        lambda now: transitions.skip(now, now.clears.where("storm_id = 1 and status = 'planned'").select("clear_id", F.lit(7).alias("new_other_fee")), NOW, delta=True),
        lambda now: now.clears.where("storm_id in (1, 3)").withColumn("invoiced", F.lit(1)),
        lambda now: transitions.cancel(now, now.clears.select("clear_id"), NOW, delta=True),
    )
    for batch in batches:
        version = store.apply(version, batch(t), log=True)
        t = store.read(version)
        held = marts.maintain(held, t.sites, store.logged(version))
        assert rows(marts.receivables(held, t)) == rows(billing.receivables_by_contract(t))
        full = activity.storm_recap(t)
        assert rows(marts.recap(held, t).select(*full.columns)) == rows(full)
    log = store.logged(version).inputFiles()
    plan = marts.maintain(held, t.sites, store.logged(version)).work.inputFiles()
    assert log and sum("/log/" in f for f in plan) > 0
    assert all("/clears/gen=" not in f or f"gen={version.held['clears', '2026-01']}" not in f for f in plan)


@pytest.mark.parametrize("storm", [1, 9_999_999, 10_000_001, 9_300_000_000, -5])
def test_ids_of_opened_storms_are_unique(spark, storm):
    """Also where storm and earlier clears would share a sum: storm 10,000,001 once, storm 1 a second time."""
    made = []
    for ident, earlier in ((storm, 0), (storm, 1), (1, 1), (1, 2), (10_000_001, 0)):
        clears = [{"clear_id": -n - 1, "storm_id": ident, "site_id": s, "status": "cancelled"} for n in range(earlier) for s in (1, 2)]
        t = tables(spark, contracts=[{"contract_id": 1}], sites=[{"site_id": s, "contract_id": 1, "address": "x"} for s in (1, 2)],
                   storms=[{"storm_id": ident, "storm_date": "2026-01-14"}], clears=clears)
        made.append({((ident, earlier, r.site_id), r.clear_id) for r in transitions.open_storm(t, t.storms).collect()})
    pairs = set().union(*made)
    assert len({ident for _, ident in pairs}) == len({key for key, _ in pairs}) == len(pairs)
    assert all(len(m) == 2 for m in made)


def test_opening_reads_the_months_of_its_storms(spark, store):
    t = store.read(store.write_first(book(spark)))
    plan = transitions.open_storm(t, t.storms.where("storm_id = 3"))._jdf.queryExecution().executedPlan().toString()
    scans = [part for part in plan.split("FileScan parquet")[1:] if "storm_month" in part[:2000] and "clear_id" not in part[:40]]
    assert "dynamicpruning" in plan.lower() and scans


def test_a_rewrite_moves_whole_rows_once_and_marks_move_ids(spark, store, monkeypatch):
    """Clears of one id, of no id and of no storm; months of several blocks. Marked clears are found without moving notes."""
    monkeypatch.setattr(versions, "BLOCK", 2)
    t = book(spark)
    odd = t.clears.where("clear_id = 11").withColumn("notes", F.lit("again")).unionByName(
        t.clears.where("clear_id = 99").withColumn("clear_id", F.lit(None).cast("long")))
    first = store.write_first(t.having(clears=t.clears.unionByName(odd)))
    now = store.read(first)
    wrote, real = [], store.write

    def write(df, name, gen, by_month=False):
        wrote.append(df._jdf.queryExecution().executedPlan().toString())
        real(df, name, gen, by_month)

    monkeypatch.setattr(store, "write", write)
    marks = spark.createDataFrame([(11,), (11,), (32,), (99,), (1234,), (None,)], "clear_id long")
    after = store.mark(first, marks, lambda rows: rows.withColumn("paid_out", F.when(F.col("_marked"), 7).otherwise(F.col("paid_out"))), branch="marks")
    want = now.clears.withColumn("paid_out", F.when(F.col("clear_id").isin(11, 32, 99), 7).otherwise(F.col("paid_out")))
    assert rows(store.read(after).clears) == rows(want) and store.read(after).clears.where("paid_out = 7").count() == 4
    batch = now.clears.where("clear_id in (11, 32)").withColumn("paid_out", F.lit(8))
    second = store.apply(first, batch, gone=now.clears.where("clear_id = 99").select("clear_id", "storm_month"), branch="rows", log=True)
    want = now.clears.where("clear_id is null or clear_id <> 99").withColumn("paid_out", F.when(F.col("clear_id").isin(11, 32), 8).otherwise(F.col("paid_out")))
    assert rows(store.read(second).clears) == rows(want)
    assert sorted(r.sign for r in store.logged(second).collect()) == [-1, -1, -1, -1, 1, 1, 1]
    for plan in wrote:
        wide = [x for x in plan.split("Exchange hashpartitioning")[1:] if "notes" in x.split("FileScan", 1)[-1][:700]]
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "REBALANCE" not in plan
        assert len(wide) == plan.count("REPARTITION_BY_NUM") - 1 > 0  # whole rows and the batch's; the ids beside them are narrow
    # A month that is marked nowhere stays where it is.
    third = store.mark(first, spark.createDataFrame([(12,)], "clear_id long"), lambda rows: rows, branch="one")
    assert {k for k in first.held if first.held[k] != third.held[k]} == {("clears", "2026-01")}
    assert store.mark(first, marks.limit(0), lambda rows: rows, branch="none").held == first.held
