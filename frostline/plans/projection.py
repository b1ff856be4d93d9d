"""Operations tables derived from the generic test tables.

The column definitions are plain SQL expressions valid in Spark and in the checking database alike. ``{days}``,
``{ntz}`` and ``//`` are the only places where the dialects differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.functions.labels import normalized_address
from frostline.operators.defaults import (
    fill_clear_defaults,
    fill_mileage,
    fill_payout_amount,
    fill_storm_defaults,
    number_invoices,
    number_storms,
)
from frostline.operators.billing import billable_facts
from frostline.schemas import SETTING_SEEDS
from frostline.sources.shared import written_once
from frostline.sources.tables import OpsTables, storm_month

SETTINGS = {**SETTING_SEEDS, "default_operator_id": "1"}

STORM_KIND = "({days} + push) % 3"

CONTRACTS = {
    "contract_id": "c_custkey + 1",
    "contract_name": "c_name",
    "contract_type": "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'commercial' WHEN 'BUILDING' THEN 'hoa' "
                     "WHEN 'FURNITURE' THEN 'municipal' WHEN 'HOUSEHOLD' THEN 'residential' ELSE 'other' END",
    "contact_name": "'Contact ' || CAST(c_custkey AS STRING)",
    "billing_email": "'ap' || CAST(c_custkey AS STRING) || '@example.com'",
    "payment_terms_days": "CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 30 WHEN 2 THEN 45 ELSE 60 END",
    "per_clear_fee_cents": "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 3000 + (c_custkey % 20) * 500 END",
    "salt_fee_cents": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 1000 + (c_custkey % 5) * 500 END",
    "sla_deadline": "CASE c_custkey % 5 WHEN 1 THEN '' WHEN 2 THEN '06:00' WHEN 3 THEN '05:30' WHEN 4 THEN '07:00' END",
    "is_active": "CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END",
}

SITES = {
    "site_id": "p_partkey + 1",
    "contract_id": "(p_partkey * 7) % n_customer + 1",
    "address": "CAST(p_partkey * 4 + 100 AS STRING) || ' ' || p_name",
    "city": "CASE WHEN p_size % 4 = 0 THEN NULL ELSE 'City' || CAST(p_size % 7 AS STRING) END",
    "state": "CASE WHEN p_size % 5 = 0 THEN NULL ELSE 'MN' END",
    "zip": "CASE WHEN p_size % 6 = 0 THEN NULL ELSE CAST(55400 + p_size AS STRING) END",
    "street_name": "CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_name END",
    "place_label": "CASE WHEN p_size % 4 = 1 THEN NULL ELSE 'Lot - ' || p_name END",
    "surface": "CASE p_type WHEN 'ECONOMY' THEN 'driveway' WHEN 'LARGE' THEN 'lot' WHEN 'MEDIUM' THEN 'walk' "
               "WHEN 'PROMO' THEN 'mixed' WHEN 'SMALL' THEN 'driveway' ELSE 'lot' END",
    "sla_deadline": "CASE WHEN p_size % 8 = 0 THEN '06:30' WHEN p_size % 8 = 1 THEN '' END",
    "ext_location_id": "CASE WHEN p_size % 3 = 0 THEN NULL ELSE 9000 + p_partkey END",
    "access_notes": "CASE WHEN p_size % 2 = 0 THEN 'Gate ' || CAST(1000 + p_partkey % 9000 AS STRING) END",
    "is_active": "CASE WHEN p_size >= 49 THEN 0 ELSE 1 END",
}

OPERATORS = {
    "operator_id": "s_suppkey + 1",
    "operator_name": "s_name",
    "ext_worker_id": "800 + s_suppkey",
    "is_owner": "CASE WHEN s_suppkey = 0 THEN 1 ELSE 0 END",
    "payout_type": "CASE s_suppkey % 3 WHEN 0 THEN 'per_clear' WHEN 1 THEN 'percent' END",
    "payout_value": "CASE s_suppkey % 3 WHEN 2 THEN NULL ELSE 25 + s_suppkey % 40 END",
    "is_active": "CASE WHEN s_acctbal < 0 THEN 0 ELSE 1 END",
}

STORMS = {
    "storm_id": "CAST({days} * 2 + push + 1 AS BIGINT)",
    "storm_name": "'Push ' || CAST(push + 1 AS STRING)",
    "storm_date": "CAST(o_orderdate AS DATE)",
    "storm_type": f"CASE {STORM_KIND} WHEN 0 THEN 'snow' WHEN 1 THEN 'ice' ELSE 'mix' END",
    "sla_deadline": f"CASE {STORM_KIND} WHEN 1 THEN '06:45' WHEN 2 THEN '07:15' END",
    "status": "CASE WHEN o_orderdate >= {ntz} '2001-07-29' THEN 'forecast' "
              "WHEN o_orderdate >= {ntz} '2001-07-01' THEN 'active' "
              "WHEN {days} % 97 = 0 THEN 'cancelled' ELSE 'closed' END",
}

# Keys of a visit: which clear, storm and site a line stands for. Two lines may claim the same storm and site.
VISIT_KEYS = {
    "d": "CAST(CAST(o_orderdate AS DATE) AS STRING)",
    "clear_id": "((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey",
    "storm_id": "CAST({days} * 2 + l_suppkey % 2 + 1 AS BIGINT)",
    "site_id": "CASE WHEN o_orderdate >= {ntz} '2001-07-01' THEN l_partkey % n_hot_sites ELSE l_partkey END + 1",
    "status": "CASE WHEN l_quantity <= 3 THEN 'cancelled' WHEN l_quantity <= 6 THEN 'skipped' "
              "WHEN o_orderdate >= {ntz} '2001-07-01' AND l_linestatus = 'O' THEN 'planned' ELSE 'completed' END",
}
SLOT = "CASE WHEN status = 'cancelled' THEN clear_id ELSE 0 END"
# Order in which claims on the same storm and site are honoured; total, so both engines keep the same line.
CLAIM_ORDER = ("clear_id", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
CLAIM_REST = ("o_orderdate", "l_linenumber", "l_partkey", "l_suppkey")
#: Text that follows from the columns of a claim: made again instead of moved.
CLAIM_DERIVED = ("d", "status")
#: What the joins of clears move: numbers made of a line's amounts instead of the amounts, and no text but the shortest.
CLEAR_PARTS = ("clear_id", "storm_id", "site_id", "status", "l_returnflag", *CLAIM_REST)
CLEAR_NUMBERS = ("duration_minutes", "other_fee_cents", "gps_verified", "checkin_distance_m")

_START = "d || 'T0' || CAST(3 + l_linenumber % 3 AS STRING) || ':' || substr(CAST(100 + l_partkey % 60 AS STRING), 2, 2)"
_MINUTE = "substr(CAST(100 + l_suppkey % 60 AS STRING), 2, 2)"
_DONE = "CASE WHEN status = 'completed' THEN"

CLEARS = {
    "clear_id": "clear_id",
    "storm_id": "storm_id",
    "site_id": "site_id",
    "operator_id": "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_suppkey + 1 END",
    "scheduled_start": f"CASE WHEN l_linenumber <= 4 THEN NULL ELSE {_START} END",
    "duration_minutes": "CASE WHEN l_quantity < 25 THEN NULL ELSE 20 + (l_suppkey % 5) * 30 END",
    "is_adhoc": "CASE WHEN l_linenumber = 6 THEN 1 ELSE 0 END",
    "status": "status",
    "surface": f"{_DONE} CASE l_linenumber % 4 WHEN 0 THEN 'driveway' WHEN 1 THEN 'lot' WHEN 2 THEN 'walk' "
               "ELSE 'all' END END",
    "condition": f"{_DONE} CASE l_linenumber % 3 WHEN 0 THEN 'bare' WHEN 1 THEN 'packed' ELSE 'icy' END END",
    "salt_applied": f"{_DONE} CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'N' THEN 'no' ELSE 'pretreated' END END",
    "photo_count": f"{_DONE} l_linenumber % 5 ELSE 0 END",
    "fee_cents": "CASE WHEN l_linenumber <= 5 THEN NULL ELSE 5000 + l_linenumber * 100 END",
    "salt_fee_cents": "CASE WHEN l_linenumber <= 5 THEN NULL ELSE 1200 END",
    "other_fee_cents": "CASE WHEN l_discount >= 0.085 THEN CAST(round(l_discount * 10000) AS BIGINT) END",
    "invoiced": "CASE WHEN o_orderdate < {ntz} '2001-06-01' THEN 1 ELSE 0 END",
    "paid_out": "0",
    "ext_event_id": "CASE WHEN l_linenumber % 2 = 0 THEN storm_id * 100000 + site_id END",
    "ext_shift_id": "CASE WHEN status <> 'cancelled' AND l_linenumber <> 3 THEN clear_id END",
    "report_id": f"{_DONE} clear_id END",
    "checked_in_at": "CASE WHEN status = 'completed' OR (status = 'planned' AND l_linenumber = 1) THEN "
                     f"d || 'T0' || CAST(4 + l_partkey % 4 AS STRING) || ':' || {_MINUTE} || ':10-06:00' END",
    "checked_out_at": f"{_DONE} d || 'T08:' || {_MINUTE} || ':40-06:00' END",
    "gps_verified": f"{_DONE} CASE WHEN l_tax < 0.075 THEN 1 ELSE 0 END END",
    "checkin_distance_m": f"{_DONE} CAST(round(l_tax * 2500) AS INT) END",
    "notes": f"{_DONE} CASE WHEN l_linenumber = 5 THEN 'Salted twice, gate code ' || CAST(1000 + l_partkey % 9000 AS STRING) "
             "WHEN l_linenumber = 6 THEN 'Spoke to Contact ' || CAST(l_partkey AS STRING) || ' at the door' "
             "WHEN l_linenumber = 7 THEN 'Bare, salted, 3 after photos' END END",
}

MILEAGE = {
    "trip_id": "event_id + 1",
    "clear_id": "CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE event_id END",
    "trip_date": "CAST(ts AS DATE)",
    "miles_cents": "CAST(round(value * 100) AS BIGINT)",
    "rate_cents": "CASE WHEN user_id % 5 = 0 THEN 67 END",
}

INVOICES = {
    "invoice_id": "o_orderkey + 1",
    "contract_id": "o_custkey + 1",
    "invoice_date": "CAST(o_orderdate AS DATE)",
    "terms": "CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 30 "
             "WHEN 2 THEN 45 ELSE 60 END END",
    "total_cents": "CAST(round(o_totalprice * 100) AS BIGINT)",
    "paid": "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END",
    "sent_date": "CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderdate AS DATE) END",
}

PAYOUT_FILTER = "status = 'completed' AND l_linenumber <> 7 AND l_suppkey <> 0 AND l_partkey % 3 <> 0"
PAYOUTS = {
    "payout_id": "clear_id",
    "operator_id": "l_suppkey + 1",
    "clear_id": "clear_id",
    "amount_cents": "CASE WHEN l_partkey % 10 = 0 THEN 3333 END",
    "paid": "CASE WHEN o_orderdate < {ntz} '2001-05-01' THEN 1 ELSE 0 END",
}

SPARK_DIALECT = {
    "days": "datediff(CAST(o_orderdate AS DATE), DATE '1995-01-01')",
    "ntz": "TIMESTAMP_NTZ",
}


def _columns(spec: dict[str, str], *names: str) -> list[str]:
    spec = {name: spec[name] for name in names} if names else spec
    return [f"{expr.format(**SPARK_DIALECT)} AS {name}" for name, expr in spec.items()]


def _money(df: DataFrame) -> DataFrame:
    """``x_cents`` columns become exact decimal ``x`` columns."""
    return df.selectExpr(*[
        f"CAST(CAST({c} AS DECIMAL(14,0)) * 0.01BD AS DECIMAL(14,2)) AS {c.removesuffix('_cents')}"
        if c.endswith("_cents") else c for c in df.columns
    ])


def _derived(claims: DataFrame) -> DataFrame:
    """Claims with the text columns that follow from the others."""
    return claims.selectExpr("*", *_columns(VISIT_KEYS, *CLAIM_DERIVED))


def _lines(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    """Every line with the storm and site it claims."""
    hot_sites = part.select((F.count("*") / 50).cast("long").alias("n")).scalar()
    keyed = (
        lineitem.join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("n_hot_sites", hot_sites)
        .selectExpr("*", *_columns(VISIT_KEYS))
    )
    return keyed.select("storm_id", "site_id", *CLAIM_ORDER, *CLAIM_REST)


def _claims(lines: DataFrame) -> DataFrame:
    """One line per claimed (storm, site) slot: the lowest clear id wins, cancelled lines all stay.

    The winner is an aggregate, not a window: tasks keep one candidate per slot before the shuffle, so a slot
    claimed by most of the lines costs no more than any other.
    """
    claim = F.struct(*CLAIM_ORDER, *CLAIM_REST)
    return (
        _derived(lines).groupBy("storm_id", "site_id", F.expr(SLOT).alias("slot")).agg(F.min(claim).alias("c"))
        .select("storm_id", "site_id", "c.*")
    )


def settled_claims(lines: DataFrame) -> DataFrame:
    """The same from lines that are written: only the lines of slots that several claim are aggregated.

    Slots are counted by a hash, the only thing that is shuffled for every line; two slots of one hash are both
    aggregated, so the result does not depend on it. The hashes that come more than once are written, so that Spark knows
    their size: few are broadcast, many are met by a shuffle.
    """
    hashed = _derived(lines).withColumn("_slot", F.xxhash64("storm_id", "site_id", F.expr(SLOT)))
    several = hashed.groupBy("_slot").agg(F.count("*").alias("n")).where("n > 1").select("_slot")
    several = written_once(several, "slots")
    alone = hashed.join(several, "_slot", "left_anti").select(*lines.columns)
    return alone.unionByName(_claims(hashed.join(several, "_slot", "left_semi").select(*lines.columns)))


def _visit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    return _lines(read("lineitem"), read("orders"), read("part"))


def visit_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims of a folder, lazy."""
    return _claims(_visit_lines(spark, sf_dir))


def written_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims of a folder, from lines that are written first."""
    return settled_claims(written_once(_visit_lines(spark, sf_dir), "lines"))


def raw_tables(spark: SparkSession, sf_dir: str, claims: DataFrame) -> dict[str, DataFrame]:
    """The tables as they would be written, before any default is filled in."""

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    customer, part, orders = read("customer"), read("part"), read("orders")
    values = ", ".join(
        f"('{k}', {'CAST(NULL AS STRING)' if v is None else repr(v)})" for k, v in SETTINGS.items()
    )
    sites = part.withColumn("n_customer", customer.select(F.count("*")).scalar()).selectExpr(*_columns(SITES))
    dates = orders.select("o_orderdate").distinct().withColumn("push", F.explode(F.array(F.lit(0), F.lit(1))))
    invoices = orders.join(customer, F.col("c_custkey") == F.col("o_custkey")).selectExpr(*_columns(INVOICES))
    address = normalized_address(*map(F.col, ("address", "city", "state", "zip")))
    return {
        "settings": spark.sql(f"SELECT * FROM VALUES {values} AS s(key, value)"),
        "contracts": _money(customer.selectExpr(*_columns(CONTRACTS))),
        "sites": sites.withColumn("normalized_address", address),
        "operators": read("supplier").selectExpr(*_columns(OPERATORS)),
        "storms": dates.selectExpr(*_columns(STORMS)),
        "clears": _clears(claims),
        "mileage": _money(read("events").selectExpr(*_columns(MILEAGE))),
        "invoices": _money(invoices.withColumn("due_date", F.expr("date_add(invoice_date, terms)"))).withColumnRenamed(
            "total", "total_amount"
        ),
        "payouts": _money(_derived(claims).where(PAYOUT_FILTER).selectExpr(*_columns(PAYOUTS))),
    }


def _month() -> Column:
    return storm_month(F.expr("CAST(o_orderdate AS DATE)"))


def _clears(claims: DataFrame) -> DataFrame:
    """The clears that claims stand for."""
    return _money(_derived(claims).selectExpr(*_columns(CLEARS), "o_orderdate")).withColumn("storm_month", _month())


def clears_of_claims(claims: DataFrame, t: OpsTables, by_month: bool = False) -> DataFrame:
    """The clears of claims, completed from the storms, sites, contracts and settings of ``t``. Joins move the parts of a
    clear; its text is made behind them, and behind the one shuffle that brings the rows of a month together where
    ``by_month`` asks for it."""

    def made(joined: DataFrame) -> DataFrame:
        joined = joined.withColumn("storm_month", _month())
        if by_month:
            # The writer of month partitions needs the sort; here it sorts narrow rows.
            joined = joined.hint("rebalance", F.col("storm_month")).sortWithinPartitions("storm_month")
        dated = joined.selectExpr("*", *_columns(VISIT_KEYS, "d"))
        columns = [*_columns({**CLEARS, **{n: n for n in CLEAR_NUMBERS}}), "storm_month", "_morning", "_fee", "_salt_fee"]
        return _money(dated.selectExpr(*columns))

    numbers = _columns(CLEARS, *CLEAR_NUMBERS)
    parts = _derived(claims).selectExpr(*CLEAR_PARTS, *numbers)
    return fill_clear_defaults(parts, t.storms, t.sites, t.contracts, t.settings, made)


def load_raw(spark: SparkSession, sf_dir: str, claims: DataFrame | None = None) -> OpsTables:
    """Tables without defaults, all lazy."""
    if claims is None:
        claims = visit_claims(spark, sf_dir)
    return OpsTables.of(spark, **raw_tables(spark, sf_dir, claims))


def with_defaults(raw: OpsTables) -> OpsTables:
    """Every table completed the way the store completes it on insert."""
    storms = fill_storm_defaults(number_storms(raw.storms), raw.settings)
    clears = fill_clear_defaults(raw.clears, storms, raw.sites, raw.contracts, raw.settings)
    return raw.having(
        storms=storms,
        clears=clears,
        mileage=fill_mileage(raw.mileage, raw.settings),
        invoices=number_invoices(raw.invoices, raw.settings),
        payouts=fill_payout_amount(raw.payouts, raw.operators, billable_facts(clears)),
    )


def load(spark: SparkSession, sf_dir: str) -> OpsTables:
    """Complete tables, all lazy."""
    return with_defaults(load_raw(spark, sf_dir))
