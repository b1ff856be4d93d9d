"""Declared integrity rules as data-quality jobs.

Every job returns violations ``(rule, table, row_id, value)``. Uniqueness reports every row but the first holder of a
key; references report the rows whose parent is missing. All rules share one pass over all tables: rows are turned into
stacked entries, keys they hold, refer to or are the parent of, and one aggregate of keys as single numbers finds those
that may be bad, combined on the map side, so one key may hold much of a table. A second scan tells the texts among them
apart, a third meets its entries with the bad keys, which are few, and says which value rules its rows break.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.functions.clock import local_ts
from frostline.schemas import (
    CLEAR_STATUSES,
    CONTRACT_TYPES,
    PAYOUT_TYPES,
    PROOF_CONDITIONS,
    PROOF_SALT,
    PROOF_SURFACES,
    SITE_SURFACES,
    STORM_STATUSES,
    STORM_TYPES,
    TABLES,
)
from frostline.sources.shared import written_once
from frostline.sources.tables import OpsTables

# The text shapes a clock and a local start must have.
CLOCK_SHAPE = "^[0-2][0-9]:[0-5][0-9]$"
START_SHAPE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-2][0-9]:[0-5][0-9]"
START_OFFSET = "T.*[+-]"


@dataclass(frozen=True)
class Check:
    rule: str
    column: str
    broken: Column


def outside(column: str, allowed: tuple[str, ...], required: bool = True) -> Column:
    bad = ~F.col(column).isin(*allowed)
    return bad | F.col(column).isNull() if required else bad


def bad_clock(column: str) -> Column:
    return ~F.col(column).rlike(CLOCK_SHAPE)


def bad_start(column: str) -> Column:
    text = F.col(column)
    return ~text.rlike(START_SHAPE) | text.rlike(START_OFFSET) | text.endswith("Z")


def value_checks() -> dict[str, tuple[str, list[Check]]]:
    """Table -> (id column, its value rules)."""
    sla = F.col("sla_deadline")
    return {
        "contracts": ("contract_id", [
            Check("contract_type", "contract_type", outside("contract_type", CONTRACT_TYPES)),
            Check("contract_sla_clock", "sla_deadline", bad_clock("sla_deadline")),
        ]),
        "sites": ("site_id", [
            Check("site_surface", "surface", outside("surface", SITE_SURFACES)),
            Check("site_sla_clock", "sla_deadline", bad_clock("sla_deadline")),
        ]),
        "operators": ("operator_id", [
            Check("payout_type", "payout_type", outside("payout_type", PAYOUT_TYPES, required=False)),
        ]),
        "storms": ("storm_id", [
            Check("storm_date", "storm_date", F.col("storm_date").isNull()),
            Check("storm_type", "storm_type", outside("storm_type", STORM_TYPES)),
            Check("storm_sla_clock", "sla_deadline", bad_clock("sla_deadline")),
            Check("storm_status", "status", outside("status", STORM_STATUSES)),
            Check("storm_clock_unreal", "sla_deadline", sla.rlike(CLOCK_SHAPE) & (sla >= "24:00")),
        ]),
        "clears": ("clear_id", [
            Check("scheduled_start", "scheduled_start", bad_start("scheduled_start")),
            Check("duration_minutes", "duration_minutes", ~F.col("duration_minutes").between(5, 720)),
            Check("clear_status", "status", outside("status", CLEAR_STATUSES)),
            # Advisory: accepted by the store, but nothing downstream can use the value.
            Check(
                "start_unreadable", "scheduled_start",
                F.col("scheduled_start").isNotNull() & local_ts(F.col("scheduled_start")).isNull(),
            ),
            Check("proof_surface", "surface", outside("surface", PROOF_SURFACES, required=False)),
            Check("proof_condition", "condition", outside("condition", PROOF_CONDITIONS, required=False)),
            Check("proof_salt", "salt_applied", outside("salt_applied", PROOF_SALT, required=False)),
        ]),
        "mileage": ("trip_id", [
            Check("miles", "miles", F.col("miles").isNull() | (F.col("miles") < 0)),
        ]),
    }


# Rule, table, id column, key column: the key must be unique wherever it is present.
UNIQUE = (
    ("unique_address", "sites", "site_id", "normalized_address"),
    ("unique_worker", "operators", "operator_id", "ext_worker_id"),
    ("unique_storm_ref", "storms", "storm_id", "storm_ref"),
    ("unique_shift", "clears", "clear_id", "ext_shift_id"),
    ("unique_invoice_number", "invoices", "invoice_id", "invoice_number"),
    ("unique_payout_clear", "payouts", "payout_id", "clear_id"),
)

# Rule, child table, child id, foreign key, parent table, parent key.
REFERENCES = (
    ("site_contract", "sites", "site_id", "contract_id", "contracts", "contract_id"),
    ("clear_storm", "clears", "clear_id", "storm_id", "storms", "storm_id"),
    ("clear_site", "clears", "clear_id", "site_id", "sites", "site_id"),
    ("clear_operator", "clears", "clear_id", "operator_id", "operators", "operator_id"),
    ("mileage_clear", "mileage", "trip_id", "clear_id", "clears", "clear_id"),
    ("invoice_contract", "invoices", "invoice_id", "contract_id", "contracts", "contract_id"),
    ("payout_operator", "payouts", "payout_id", "operator_id", "operators", "operator_id"),
    ("payout_clear", "payouts", "payout_id", "clear_id", "clears", "clear_id"),
)


def repeated_settings(settings: DataFrame) -> DataFrame:
    """Settings have no number, so a repeated key is reported once."""
    return settings.groupBy("key").count().where(F.col("count") > 1).select(
        F.lit("unique_setting").alias("rule"), F.lit("settings").alias("table"),
        F.lit(None).cast("long").alias("row_id"), F.col("key").alias("value"),
    )


# The slot of a clear: one that is not cancelled holds its storm and site.
SLOT = "one_clear_per_site_storm"

_HOLDER, _CHILD, _PARENT = 0, 1, 2
#: Keys that are broadcast at most.
FEW = 1 << 17
#: A key is a number ``k`` or a text ``t``, whose hash is ``k`` then.
_KEY = ("domain", "k", "t")


_TEXT_RULES = [rule for rule, table, _, key in UNIQUE if TABLES[table][key].dataType.simpleString() == "string"]


def _domain(name: str) -> int:
    """Keys of different domains never meet: a uniqueness rule is one, a table that others refer to is one."""
    names = ["value", SLOT, *[rule for rule, *_ in UNIQUE], *dict.fromkeys(parent for *_, parent, _ in REFERENCES)]
    return names.index(name)


#: Domains whose keys are texts.
_TEXTS = [_domain(name) for name in (SLOT, *_TEXT_RULES)]

def _rules() -> list[tuple[str, str]]:
    """Every rule of an entry and its table; entries hold the place of their rule."""
    values = [(check.rule, table) for table, (_, checks) in value_checks().items() for check in checks]
    return [(SLOT, "clears"), *[r[:2] for r in UNIQUE], *[r[:2] for r in REFERENCES], *values]


def _domains() -> list[str]:
    """The domain of every rule, by its place."""
    keys = {SLOT: SLOT, **{r: r for r, *_ in UNIQUE}, **{r: parent for r, *_, parent, _ in REFERENCES}}
    return [keys.get(rule, "value") for rule, _ in _rules()]


def _said(domain: str, rule: str, role: int, ident: str, k: Column, t: Column, whole: bool) -> Column:
    key = [F.lit(_domain(domain)).alias("domain"), F.lit(role).alias("role"), F.col(ident).cast("long").alias("row_id"),
           k.cast("long").alias("k"), t.cast("string").alias("t")]
    return F.struct(*key, F.lit([r for r, _ in _rules()].index(rule)).alias("rule")) if whole else F.struct(*key)


def _entry(rule: str, domain: str, role: int, ident: str, *key: str, whole: bool, where: Column | None = None) -> Column:
    """What a row says about a key: that it holds it, refers to it or is the parent; null where the key is absent. Keys
    are a number, or a text: that of one column or of two numbers. Only a ``whole`` entry names its rule."""
    present = reduce(Column.__and__, [F.col(k).isNotNull() for k in key])
    if _domain(domain) in _TEXTS:
        k, t = F.xxhash64(*key), F.concat_ws("/", *key)
    else:
        k, t = F.col(*key), F.lit("")
    return F.when(present if where is None else present & where, _said(domain, rule, role, ident, k, t, whole))


def _broken(check: Check, ident: str) -> Column:
    """A broken value rule as an entry with a key of its own; the value stands as its text."""
    return F.when(check.broken, _said("value", check.rule, _HOLDER, ident, F.col(ident), F.col(check.column), True))


#: Id column of every table that rules name.
IDENTS = {
    "contracts": "contract_id", "sites": "site_id", "operators": "operator_id", "storms": "storm_id", "clears": "clear_id",
    "mileage": "trip_id", "invoices": "invoice_id", "payouts": "payout_id",
}


def _entries(t: OpsTables, whole: bool) -> DataFrame:
    """All that the rows of all tables say about keys, in one scan of each; ``whole`` for the second scan, with rules, the
    broken value rules and no parents, bare for the first."""
    checks, stacked = value_checks(), []
    for table, ident in IDENTS.items():
        df: DataFrame = getattr(t, table)
        said = [_entry(rule, rule, _HOLDER, ident, key, whole=whole) for rule, of, _, key in UNIQUE if of == table]
        said += [_entry(rule, parent, _CHILD, ident, key, whole=whole) for rule, child, _, key, parent, _ in REFERENCES if child == table]
        if table == "clears":
            said.append(_entry(SLOT, SLOT, _HOLDER, ident, "storm_id", "site_id", whole=whole, where=F.col("status") != "cancelled"))
        if whole:
            said += [_broken(check, ident) for check in checks.get(table, (ident, []))[1]]
        elif any(parent == table for *_, parent, _ in REFERENCES):
            said.append(_entry(table, table, _PARENT, ident, ident, whole=False))
        if not said:
            continue
        # Exploded first and filtered then: both are generated code, a filter by a lambda is not.
        stacked.append(df.select(F.explode(F.array(*said)).alias("e")).where(F.col("e").isNotNull()).select("e.*"))
    return reduce(DataFrame.unionByName, stacked)


def _bad_keys(entries: DataFrame) -> DataFrame:
    """Keys that several rows hold, with the first of them, and keys that are referred to without a parent. One
    aggregate, combined before its only shuffle."""
    holder = F.col("role") == _HOLDER
    return entries.groupBy(*_KEY).agg(
        F.sum(F.when(holder, 1).otherwise(0)).alias("_holders"), F.min(F.when(holder, F.col("row_id"))).alias("_first"),
        F.max("role").alias("_role"),
    ).where((F.col("_holders") > 1) | (F.col("_role") == _CHILD)).select(*_KEY, "_first")


def _met(keys: DataFrame) -> DataFrame:
    """Written keys for a join: a few are broadcast, many are met by a hash of them, whatever Spark takes their files for."""
    return keys if keys.count() <= FEW else keys.hint("shuffle_hash")


def _violations(bad: DataFrame, judged: DataFrame) -> DataFrame:
    """Rows of ``judged`` that break a value rule, hold a key that an earlier row holds, or lack a parent. The rule says what
    domain a key is of and what the row says about it, so entries meet the keys as rule, row and key."""
    domains, rule = [_domain(d) for d in _domains()], F.col("rule")
    is_value, is_text, refers = (
        rule.isin(*[i for i, found in enumerate(kind) if found])
        for kind in ([d == _domain("value") for d in domains], [d in _TEXTS for d in domains], [r in [ref[0] for ref in REFERENCES] for r, _ in _rules()])
    )
    by_key = F.col("_bad") & (refers | (F.col("row_id") != F.col("_first")))
    rules, of = (F.array(*map(F.lit, names)) for names in zip(*_rules()))
    value = F.when(is_value | is_text, F.col("t")).otherwise(F.col("k").cast("string"))
    entries = judged.select(F.array(*map(F.lit, domains))[rule].alias("domain"), "rule", "row_id", "k", "t")
    return entries.join(bad.withColumn("_bad", F.lit(True)), list(_KEY), "left").where(is_value | by_key).select(
        rules[rule].alias("rule"), of[rule].alias("table"), "row_id", value.alias("value")
    )


def _suspects(entries: DataFrame) -> DataFrame:
    """Numbers ``k`` that several holders share, with the first of them, and numbers that are referred to without a
    parent. They are all bad keys that are numbers, and the hashes of all that are texts and of few others. A key's text
    is not shuffled."""
    refers = F.col("domain").isin(*[_domain(parent) for *_, parent, _ in REFERENCES])
    unique = (F.col("role") == _HOLDER) & ~F.col("domain").isin(*_TEXTS)
    return entries.groupBy("domain", "k").agg(
        F.sum(F.when(F.col("role") == _CHILD, 0).otherwise(1)).alias("_rows"), F.min(F.when(unique, F.col("row_id"))).alias("_first"),
    ).where(F.when(refers, F.col("_rows") == 0).otherwise(F.col("_rows") > 1)).select("domain", "k", "_first")


def _met(keys: DataFrame) -> DataFrame:
    """Written keys for a join: few are broadcast, many are met by a hash of them, whatever Spark takes their files for."""
    return keys if keys.count() <= FEW else keys.hint("shuffle_hash")


def dq_violations(t: OpsTables) -> DataFrame:
    """All violations of all rules. Every table is scanned three times: for its keys as numbers, which are aggregated once
    for all rules, for the texts among the few that may be bad, and for its values and the rows that hold or refer to bad
    keys. What is found is written in between and counted: few keys are broadcast to the next scan, many are met by a
    shuffle, by a hash of them, so that the entries are not sorted."""
    bare, text = _entries(t, whole=False), F.col("domain").isin(*_TEXTS)
    suspects = written_once(_suspects(bare), "suspects")
    texts = _bad_keys(bare.where(text).join(_met(suspects.where(text)), ["domain", "k"], "left_semi"))
    numbers = suspects.where(~text).select("domain", "k", F.lit("").alias("t"), "_first")
    bad = written_once(numbers.unionByName(texts), "bad-keys")
    return _violations(_met(bad), _entries(t, whole=True)).unionByName(repeated_settings(t.settings))


def double_bookings(clears: DataFrame) -> DataFrame:
    """Clears that are not cancelled on a storm and site another one already holds."""
    said = _entry(SLOT, SLOT, _HOLDER, "clear_id", "storm_id", "site_id", whole=True, where=F.col("status") != "cancelled")
    held = clears.select(said.alias("e")).where(F.col("e").isNotNull()).select("e.*")
    return _violations(_bad_keys(held), held)


#: Rules that say what nothing downstream can use, not what may not be stored.
ADVISORY = ("start_unreadable", "storm_clock_unreal")


def gate(t: OpsTables, table: str, violations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of a table that may be written, and the rejected ones with the rules they break. Give ``violations`` (a
    written table) to judge several tables by one pass."""
    ident, rows = IDENTS[table], getattr(t, table)
    found = dq_violations(t) if violations is None else violations
    broken = found.where((F.col("table") == table) & ~F.col("rule").isin(*ADVISORY)).groupBy("row_id").agg(
        F.sort_array(F.collect_set("rule")).alias("rules")
    )
    named = broken.withColumnRenamed("row_id", ident)
    if violations is not None and violations.count() > FEW:
        named = named.hint("shuffle_hash")  # Spark takes millions of ids for few
    return rows.join(named, ident, "left_anti").select(*rows.columns), rows.join(named, ident)


def dq_violation_counts(t: OpsTables) -> DataFrame:
    return dq_violations(t).groupBy("rule", "table").agg(
        F.count("*").alias("violations"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row")
    )
