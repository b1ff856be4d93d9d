"""The operations tables as Parquet, written once per Spark application and input folder.

This is the ingest step: the generic test tables are projected, completed with defaults and written under
``spark.checkpoint.dir``, the fact table by storm month. Queries then read plain Parquet, so filters, columns and
month partitions are pruned at the scan and a lost executor costs a re-read instead of the whole projection.
"""

from __future__ import annotations

import threading
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

from frostline.operators.billing import billable_facts
from frostline.operators.defaults import fill_payout_amount
from frostline.plans.projection import clears_of_claims, load_raw, with_defaults, written_claims
from frostline.schemas import TABLES
from frostline.sources.shared import shared_folder
from frostline.sources.tables import OpsTables
from frostline.sources.versions import Store, Version

_ready: dict[tuple[str, str], tuple[Store, Version, OpsTables]] = {}
_lock = threading.Lock()


def ingest(spark: SparkSession, sf_dir: str) -> tuple[Store, Version]:
    """Write all tables as the first version of a fresh store; independent tables are written side by side."""
    store = Store(spark, shared_folder(spark, "ops"))
    claims = written_claims(spark, sf_dir)
    raw = load_raw(spark, sf_dir, claims)
    done = with_defaults(raw)
    rest = [n for n in TABLES if n not in ("clears", "payouts")]
    with ThreadPoolExecutor(max_workers=4) as pool:
        list(pool.map(lambda n: store.write(getattr(done, n), n, "first"), rest))
    # Clears are completed from tables whose sizes Spark knows, so that only the sites may need a shuffle of the claims.
    known = raw.having(**{n: store.written(n, "first") for n in ("storms", "sites", "contracts", "settings")})
    store.write(clears_of_claims(claims, known, by_month=True), "clears", "first", by_month=True)
    # Payout prices read the clears just written instead of filling the same defaults a second time.
    # Both sides are facts, which Spark takes for small by their few columns: they are merged, never broadcast.
    billable = billable_facts(store.written("clears", "first")).hint("merge")
    store.write(fill_payout_amount(raw.payouts, raw.operators, billable), "payouts", "first")
    return store, store.adopt(dict.fromkeys(TABLES, "first"))


def versioned(spark: SparkSession, sf_dir: str) -> tuple[Store, Version, OpsTables]:
    """The store of ``sf_dir`` for this application, written on first use, its first version and the tables of it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    with _lock:
        if key not in _ready:
            store, version = ingest(spark, sf_dir)
            _ready[key] = store, version, store.read(version)
        return _ready[key]


def tables(spark: SparkSession, sf_dir: str) -> OpsTables:
    """The operations tables of ``sf_dir`` as ingested."""
    return versioned(spark, sf_dir)[2]
