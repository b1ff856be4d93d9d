"""The views by SQL: all fourteen, with the caller's filter planned into the scans."""

from __future__ import annotations

from datetime import datetime

from frames import worked_example

from frostline.operators import transitions
from frostline.plans.views import VIEWS, register_views
from frostline.sources.shared import shared_folder
from frostline.sources.tables import read_tables, write_tables

NOW = datetime(2026, 1, 14, 5, 30)


def test_fourteen_views_answer_sql(spark):
    t = worked_example(spark)
    t = t.having(clears=transitions.open_storm(t, t.storms))
    assert len(register_views(t, NOW, "x_")) == 14 == len(VIEWS)
    for name in VIEWS:
        assert spark.sql(f"SELECT * FROM x_{name}").columns == VIEWS[name](t, NOW).columns
    rows = spark.sql("SELECT address, minutes_to_deadline FROM x_clears_planned WHERE storm_id = 1 AND contract_id = 2").collect()
    assert [tuple(r) for r in rows] == [("118 Mill Pond Rd", 30)]
    # Another instant is another registration.
    register_views(t, datetime(2026, 1, 14, 6, 10), "x_")
    assert spark.sql("SELECT minutes_to_deadline FROM x_clears_planned WHERE contract_id = 2").first()[0] == -10


def test_a_storm_filter_prunes_months(spark):
    t = worked_example(spark)
    t = t.having(clears=transitions.open_storm(t, t.storms))
    root = shared_folder(spark, "views")
    write_tables(t, root)
    register_views(read_tables(spark, root), NOW, "y_")
    plan = spark.sql("SELECT clear_id FROM y_clears_planned WHERE storm_id = 1")._jdf.queryExecution().executedPlan().toString()
    scan = next(part for part in plan.split("FileScan parquet") if "EqualTo(storm_id,1)" in part and "status" in part)
    assert "dynamicpruning" in scan.lower() and "EqualTo(status,planned)" in scan
