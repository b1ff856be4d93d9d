"""Marts that follow the clears by signed rows: what a batch took away and what it put there.

A mart is an aggregate whose every measure is a sum, at a grain fine enough that minima and maxima are read off its keys:
a first or last day is a key with a count, so taking rows away needs no recount. A batch's signed rows
(:meth:`frostline.sources.versions.Store.logged`) are aggregated the same way and added; keys whose count comes to zero
go. The clears themselves are read once, when a mart is first built. Reports join the few rows of a mart with storms
and contracts as they are then. A mart keeps the contract a site had when its clear last changed.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.operators.activity import recap_of
from frostline.operators.billing import billable_facts, receivables_of, storm_facts, work_date
from frostline.operators.boards import active_sites, flag, open_storms
from frostline.schemas import FINISHED, SALTED
from frostline.sources.tables import OpsTables, merged

#: Keys and sums of the two marts.
WORK_KEYS = ("storm_id", "contract_id", "status", "condition", "salted", "invoiced", "bills", "done_date")
SLOT_KEYS = ("storm_id", "site_id")


@dataclasses.dataclass(frozen=True)
class Marts:
    """``work``: clears by storm, contract and how they stand. ``slots``: standing and planned clears by storm and site."""

    work: DataFrame
    slots: DataFrame


def _work(sites: DataFrame, signed: DataFrame) -> DataFrame:
    """What clears add to ``work``. Only the keys and sums of a clear meet its site, not the texts they are read from."""
    rows = billable_facts(signed).withColumns({
        "salted": F.coalesce(F.col("salt_applied").isin(*SALTED), F.lit(False)), "bills": F.col("billable_total") > 0,
        "done_date": work_date(),
    }).select("site_id", *[k for k in WORK_KEYS if k != "contract_id"], "sign", "billable_total")
    # A hash of the sites: the clears are not sorted to meet them.
    rows = rows.join(sites.select("site_id", "contract_id").hint("shuffle_hash"), "site_id")
    return rows.groupBy(*WORK_KEYS).agg(F.sum("sign").alias("clears"), F.sum(F.col("sign") * F.col("billable_total")).alias("billable"))


def _slots(signed: DataFrame) -> DataFrame:
    standing = signed.where(F.col("status") != "cancelled")
    return standing.groupBy(*SLOT_KEYS).agg(
        F.sum("sign").alias("standing"), F.sum(F.col("sign") * flag(F.col("status") == "planned")).alias("planned")
    )


def build(t: OpsTables) -> Marts:
    signed = t.clears.withColumn("sign", F.lit(1))
    return Marts(_work(t.sites, signed), _slots(signed))


def _added(mart: DataFrame, more: DataFrame, keys: tuple[str, ...], count: str) -> DataFrame:
    sums = [F.sum(c).cast(mart.schema[c].dataType).alias(c) for c in mart.columns if c not in keys]
    return mart.unionByName(more.select(*mart.columns)).groupBy(*keys).agg(*sums).where(F.col(count) != 0)


def maintain(marts: Marts, sites: DataFrame, signed: DataFrame) -> Marts:
    """The marts after a batch; ``signed`` are its rows as they were (``sign`` -1) and as they are (1)."""
    return Marts(
        _added(marts.work, _work(sites, signed), WORK_KEYS, "clears"), _added(marts.slots, _slots(signed), SLOT_KEYS, "standing")
    )


def receivables(marts: Marts, t: OpsTables) -> DataFrame:
    """``receivables_by_contract`` from the mart."""
    due = marts.work.where((F.col("invoiced") == 0) & F.col("bills") & F.col("status").isin(*FINISHED))
    dated = due.join(storm_facts(t.storms).select("storm_id", "storm_date"), "storm_id")

    def counted(status: str):
        return F.sum(F.when(F.col("status") == status, F.col("clears")).otherwise(0))

    totals = dated.groupBy("contract_id").agg(
        F.sum("clears").alias("clear_count"), counted("completed").alias("completed_count"),
        counted("skipped").alias("skipped_count"), F.sum("billable").alias("total_billable"),
        F.min("storm_date").alias("first_date"), F.max(F.coalesce("done_date", "storm_date")).alias("last_date"),
    )
    return receivables_of(t, totals)


def recap(marts: Marts, t: OpsTables) -> DataFrame:
    """``storm_recap`` from the marts."""
    done = F.col("status") == "completed"

    def counted(condition):
        return F.sum(F.when(condition, F.col("clears")).otherwise(0))

    known = marts.work.join(t.storms.select("storm_id"), "storm_id", "left_semi").join(merged(t.contracts.select("contract_id")), "contract_id", "left_semi")
    work = known.groupBy("storm_id", "contract_id").agg(
        counted(done).alias("completed"), counted(done & F.col("salted")).alias("salted"),
        *[counted(done & (F.col("condition") == c)).alias(c) for c in ("bare", "packed", "icy")],
        counted(F.col("status") == "skipped").alias("skipped"), F.sum("billable").alias("billable"),
        F.sum(F.when(F.col("invoiced") == 0, F.col("billable"))).alias("receivable"),
    )
    sites = active_sites(t).select("site_id", "contract_id")
    standing = marts.slots.join(open_storms(t).select("storm_id"), "storm_id", "left_semi").join(sites, "site_id")
    served = standing.groupBy("storm_id", "contract_id").agg(F.count("*").alias("served"), F.sum("planned").alias("planned"))
    return recap_of(t, work, served)
