"""A staging batch with bad rows in it: the operations tables as careless imports would have left them.

Every integrity rule has rows that break it. The expressions are plain SQL that any engine reads, over the columns as
they were before.
"""

from __future__ import annotations

from frostline.sources.tables import OpsTables

SPOILED: dict[str, dict[str, str]] = {
    "contracts": {
        "contract_type": "CASE WHEN contract_type = 'municipal' THEN 'city' ELSE contract_type END",
        "sla_deadline": "CASE WHEN contract_type = 'hoa' THEN '7am' ELSE sla_deadline END",
    },
    "sites": {
        "surface": "CASE WHEN surface = 'walk' THEN 'roof' ELSE surface END",
        "sla_deadline": "CASE WHEN surface = 'mixed' THEN '07:60' ELSE sla_deadline END",
        "contract_id": "CASE WHEN surface = 'lot' THEN -contract_id ELSE contract_id END",
        "normalized_address": "CASE WHEN surface = 'driveway' THEN lower(street_name) ELSE normalized_address END",
    },
    "operators": {
        "payout_type": "CASE WHEN payout_type = 'percent' THEN 'share' ELSE payout_type END",
        "ext_worker_id": "CASE WHEN payout_type = 'per_clear' THEN CAST(1 AS BIGINT) ELSE ext_worker_id END",
    },
    "storms": {
        "storm_date": "CASE WHEN storm_type = 'mix' THEN NULL ELSE storm_date END",
        "storm_type": "CASE WHEN status = 'cancelled' THEN 'hail' ELSE storm_type END",
        "sla_deadline": "CASE storm_type WHEN 'ice' THEN '25:30' WHEN 'mix' THEN 'noon' ELSE sla_deadline END",
        "status": "CASE WHEN status = 'closed' THEN 'over' ELSE status END",
        "storm_ref": "CASE WHEN storm_type = 'ice' THEN 'ST-ICE' ELSE storm_ref END",
    },
    "clears": {
        "scheduled_start": "CASE status WHEN 'cancelled' THEN concat(substr(scheduled_start, 1, 10), ' noon') "
        "WHEN 'skipped' THEN concat(substr(scheduled_start, 1, 10), 'T29:00') ELSE scheduled_start END",
        "duration_minutes": "CASE WHEN status = 'skipped' THEN 2 ELSE duration_minutes END",
        "status": "CASE WHEN status = 'cancelled' THEN 'void' ELSE status END",
        "surface": "CASE WHEN condition = 'icy' THEN 'roof' ELSE surface END",
        "condition": "CASE WHEN condition = 'packed' THEN 'wet' ELSE condition END",
        "salt_applied": "CASE WHEN salt_applied = 'pretreated' THEN 'maybe' ELSE salt_applied END",
        "ext_shift_id": "CASE WHEN status = 'completed' THEN site_id ELSE ext_shift_id END",
        "storm_id": "CASE WHEN salt_applied = 'no' THEN -storm_id ELSE storm_id END",
        "site_id": "CASE WHEN condition = 'bare' THEN -site_id ELSE site_id END",
        "operator_id": "CASE WHEN status = 'skipped' THEN -operator_id ELSE operator_id END",
    },
    "mileage": {
        "miles": "CASE WHEN clear_id IS NULL THEN -miles ELSE miles END",
        "clear_id": "CASE WHEN miles > 10 THEN -clear_id ELSE clear_id END",
    },
    "invoices": {
        "invoice_number": "CASE WHEN paid = 1 THEN concat('INV-', CAST(contract_id AS STRING)) ELSE invoice_number END",
        "contract_id": "CASE WHEN paid = 0 THEN -contract_id ELSE contract_id END",
    },
    "payouts": {
        "clear_id": "CASE WHEN paid = 1 THEN operator_id ELSE clear_id END",
        "operator_id": "CASE WHEN paid = 0 THEN -operator_id ELSE operator_id END",
    },
}


def spoiled(t: OpsTables) -> OpsTables:
    changed = {}
    for name, columns in SPOILED.items():
        table = getattr(t, name)
        changed[name] = table.selectExpr(*[
            f"CAST({columns[f.name]} AS {f.dataType.simpleString()}) AS {f.name}" if f.name in columns else f.name for f in table.schema.fields
        ])
    return t.having(**changed, settings=t.settings.unionByName(t.settings.where("key LIKE 'default%'")))
