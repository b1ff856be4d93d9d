"""Checking SQL: the answer of each catalogue query worked out a second time, for a plain SQL database.

The prelude projects the generic tables onto the operations tables (same definitions as the Spark projection) and
fills the defaults; money is kept in whole cents until the last step. Each query then states its answer in its own
terms, with joins, subqueries and windows where the Spark side uses aggregates, hashing and streams.
"""

from __future__ import annotations

from frostline.plans import projection as p
from frostline.plans.staging import SPOILED

DIALECT = {"days": "date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))", "ntz": "TIMESTAMP"}

A = "TIMESTAMP '2001-08-01 05:40:00'"
B = "TIMESTAMP '2001-07-20 05:40:00'"


def _select(spec: dict[str, str]) -> str:
    return ",\n    ".join(f"{expr.format(**DIALECT)} AS {name}" for name, expr in spec.items())


def ts(text: str) -> str:
    return f"TRY_CAST(substr({text}, 1, 19) AS TIMESTAMP)"


def usd(cents: str) -> str:
    return f"CAST({cents} AS DOUBLE) / CAST(100 AS DOUBLE)"


def iso(d: str) -> str:
    return f"CAST({d} AS VARCHAR)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def _normalized(*parts: str) -> str:
    joined = f"lower(concat_ws(' ', {', '.join(parts)}))"
    return f"trim(regexp_replace(regexp_replace({joined}, '[,.#]', '', 'g'), '\\s+', ' ', 'g'))"


_SETTINGS = ", ".join(f"('{k}', {'NULL' if v is None else repr(v)})" for k, v in p.SETTINGS.items())

PRELUDE = f"""
WITH settings(key, value) AS (VALUES {_SETTINGS}),
contracts AS (SELECT {_select(p.CONTRACTS)} FROM customer),
sites AS (
  SELECT *, {_normalized('address', 'city', 'state', 'zip')} AS normalized_address
  FROM (SELECT {_select(p.SITES)} FROM (SELECT *, (SELECT count(*) FROM customer) AS n_customer FROM part))),
operators AS (SELECT {_select(p.OPERATORS)} FROM supplier),
raw_storms AS (
  SELECT {_select(p.STORMS)}
  FROM (SELECT DISTINCT o_orderdate, push FROM orders CROSS JOIN (VALUES (0), (1)) AS two(push))),
storms AS (
  SELECT * REPLACE (coalesce(sla_deadline, '07:00') AS sla_deadline),
    'ST-' || strftime(storm_date, '%Y') || '-' || printf('%04d', storm_id) AS storm_ref
  FROM raw_storms),
claims AS (
  SELECT *, {_select(p.VISIT_KEYS)}
  FROM (SELECT l.*, o_orderdate, (SELECT CAST(count(*) / 50 AS BIGINT) FROM part) AS n_hot_sites
        FROM lineitem l JOIN orders ON l_orderkey = o_orderkey)),
visits AS (
  SELECT * FROM claims
  QUALIFY row_number() OVER (PARTITION BY storm_id, site_id, {p.SLOT} ORDER BY {', '.join(p.CLAIM_ORDER)}) = 1),
raw_clears AS (SELECT {_select(p.CLEARS)}, CAST(o_orderdate AS DATE) AS visit_day FROM visits),
clears AS (
  SELECT c.* REPLACE (
      coalesce(c.scheduled_start, CAST(st.storm_date AS VARCHAR) || 'T04:00') AS scheduled_start,
      CAST(coalesce(c.duration_minutes, 180) AS INTEGER) AS duration_minutes,
      coalesce(c.operator_id, 1) AS operator_id,
      coalesce(c.fee_cents, ct.per_clear_fee_cents, 0) AS fee_cents,
      coalesce(c.salt_fee_cents, ct.salt_fee_cents, 0) AS salt_fee_cents,
      coalesce(c.other_fee_cents, 0) AS other_fee_cents)
  FROM raw_clears c
  LEFT JOIN raw_storms st USING (storm_id)
  LEFT JOIN sites si USING (site_id)
  LEFT JOIN contracts ct ON ct.contract_id = si.contract_id),
raw_mileage AS (SELECT {_select(p.MILEAGE)} FROM events),
mileage AS (
  SELECT trip_id, clear_id, trip_date, miles_cents, coalesce(rate_cents, 70) AS rate_cents,
    CAST(round(CAST(miles_cents * coalesce(rate_cents, 70) AS DECIMAL(18,0)) / 100) AS BIGINT) AS deduction_cents
  FROM raw_mileage),
raw_invoices AS (SELECT {_select(p.INVOICES)} FROM orders JOIN customer ON c_custkey = o_custkey),
invoices AS (
  SELECT invoice_id, contract_id, invoice_date, invoice_date + CAST(terms AS INTEGER) AS due_date, total_cents, paid,
    sent_date, 'INV-' || strftime(invoice_date, '%Y') || '-' || printf('%04d', invoice_id) AS invoice_number
  FROM raw_invoices),
billed AS (
  SELECT c.*,
    CASE WHEN status = 'completed' AND salt_applied IN ('yes', 'pretreated') THEN salt_fee_cents ELSE 0 END AS salt_cents,
    CASE status WHEN 'planned' THEN 0 WHEN 'completed' THEN fee_cents ELSE 0 END
      + CASE WHEN status = 'completed' AND salt_applied IN ('yes', 'pretreated') THEN salt_fee_cents ELSE 0 END
      + CASE WHEN status = 'planned' THEN 0 ELSE other_fee_cents END AS bill_cents,
    CAST({ts("coalesce(checked_in_at, scheduled_start)")} AS DATE) AS work_day
  FROM clears c),
raw_payouts AS (SELECT {_select(p.PAYOUTS)} FROM visits WHERE {p.PAYOUT_FILTER}),
payouts AS (
  SELECT p.payout_id, p.operator_id, p.clear_id, p.paid,
    coalesce(p.amount_cents, CASE payout_type WHEN 'per_clear' THEN payout_value * 100
      WHEN 'percent' THEN (bill_cents * payout_value + 50) // 100 END) AS amount_cents
  FROM raw_payouts p LEFT JOIN operators USING (operator_id) LEFT JOIN billed b USING (clear_id)),
full_sites AS (
  SELECT si.*, ct.contract_name, ct.contract_type, ct.contact_name, ct.billing_email, ct.payment_terms_days,
    ct.sla_deadline AS contract_sla, ct.is_active AS contract_active,
    address || coalesce(', ' || city, '') || coalesce(', ' || state, '') || coalesce(' ' || zip, '') AS street_address,
    coalesce(street_name, address) AS label,
    coalesce(place_label, 'Site - ' || coalesce(street_name, address)) AS location_name,
    CASE WHEN ext_location_id IS NULL THEN 1 ELSE 0 END AS needs_location
  FROM sites si JOIN contracts ct USING (contract_id)),
site_days AS (
  SELECT site_id, CAST({ts('scheduled_start')} AS DATE) AS start_day, arg_min(ext_event_id, clear_id) AS day_event
  FROM clears WHERE ext_event_id IS NOT NULL GROUP BY ALL),
wide AS (
  SELECT b.*, st.storm_ref, st.storm_name, st.storm_date, st.storm_type, st.status AS storm_status,
    si.contract_id, si.contract_name, si.contract_type, si.address, si.city, si.state, si.zip, si.street_name,
    si.street_address, si.label, si.location_name, si.needs_location, si.ext_location_id,
    si.surface AS site_surface, si.access_notes AS site_access_notes,
    o.operator_name, o.ext_worker_id,
    coalesce(nullif(si.sla_deadline, ''), nullif(si.contract_sla, ''), nullif(st.sla_deadline, ''), '07:00') AS clock,
    {ts('scheduled_start')} AS start_at,
    CAST({ts('scheduled_start')} AS DATE) AS start_day
  FROM billed b JOIN storms st USING (storm_id) JOIN full_sites si USING (site_id)
  LEFT JOIN operators o USING (operator_id)),
timed AS (
  SELECT w.*, CAST(storm_date AS VARCHAR) || 'T' || clock AS clock_at,
    TRY_CAST(CAST(storm_date AS VARCHAR) || ' ' || clock || ':00' AS TIMESTAMP) AS deadline,
    coalesce(w.ext_event_id, d.day_event) AS event_or_sibling,
    'event-site-' || w.site_id || '-' || strftime(w.start_day, '%Y%m%d') AS event_key
  FROM wide w LEFT JOIN site_days d ON d.site_id = w.site_id AND d.start_day = w.start_day),
left_over AS (
  SELECT st.storm_id, st.storm_ref, st.storm_name, st.storm_date, st.storm_type, st.status AS storm_status,
    si.*, c.clear_id, c.status AS clear_status, c.scheduled_start, c.ext_event_id, c.ext_shift_id, c.operator_id,
    coalesce(nullif(si.sla_deadline, ''), nullif(si.contract_sla, ''), nullif(st.sla_deadline, ''), '07:00') AS clock
  FROM (SELECT * FROM storms WHERE status IN ('active', 'forecast')) st
  JOIN (SELECT * FROM full_sites WHERE is_active = 1 AND contract_active = 1) si ON TRUE
  LEFT JOIN (SELECT * FROM clears WHERE status <> 'cancelled') c ON c.storm_id = st.storm_id AND c.site_id = si.site_id
  WHERE c.clear_id IS NULL OR c.status = 'planned')
"""

_STORM = f"storm_id, storm_ref, storm_name, {iso('storm_date')} AS storm_date, storm_type, storm_status"


def _dispatch(as_of: str) -> str:
    return f"""
  clear_id, status, is_adhoc, scheduled_start, duration_minutes,
  strftime(start_at, '%Y-%m-%dT%H:%M:%S') || '-06:00' AS start_iso,
  strftime(start_at + to_minutes(duration_minutes), '%Y-%m-%dT%H:%M:%S') || '-06:00' AS end_iso,
  {_STORM}, clock AS sla_deadline, clock_at AS sla_deadline_at,
  CAST(date_sub('minute', {as_of}, deadline) AS INTEGER) AS minutes_to_deadline,
  site_id, address, city, state, zip, street_address, location_name,
  'Clear ' || CAST(storm_date AS VARCHAR) || ' - ' || label AS event_title, site_surface, site_access_notes,
  ext_location_id, needs_location, event_or_sibling AS ext_event_id,
  CASE WHEN event_or_sibling IS NULL THEN 1 ELSE 0 END AS needs_event,
  {iso('start_day')} AS event_start_date, {iso('start_day')} AS event_end_date, ext_shift_id,
  CASE WHEN ext_shift_id IS NULL AND status = 'planned' THEN 1 ELSE 0 END AS needs_shift,
  operator_id, operator_name, ext_worker_id, contract_id, contract_name, contract_type, notes,
  'loc-site-' || site_id AS loc_idempotency_key, event_key AS event_idempotency_key,
  'shift-clear-' || clear_id AS shift_idempotency_key"""


_PLANNED = "timed WHERE status = 'planned'"
_OPEN_ITEMS = """(SELECT * FROM wide WHERE invoiced = 0 AND status <> 'planned' AND bill_cents > 0)"""
_RUN = f"""(SELECT contract_id, sum(bill_cents) AS total_cents, count(*) AS line_count,
    contract_id + (SELECT coalesce(max(invoice_id), 0) FROM invoices) AS invoice_id,
    'INV-2001-' || printf('%04d', contract_id + (SELECT coalesce(max(invoice_id), 0) FROM invoices)) AS invoice_number
  FROM {_OPEN_ITEMS} GROUP BY contract_id)"""

_CLEAR_STATE = f"""clear_id, storm_id, site_id, operator_id, scheduled_start, duration_minutes, status,
  {usd('fee_cents')} AS fee, {usd('salt_fee_cents')} AS salt_fee, {usd('other_fee_cents')} AS other_fee, ext_event_id,
  ext_shift_id"""


def _fresh(storm: str, ident: str, start: str, minutes: str, source: str) -> str:
    """Freshly inserted planned clears at the sites ``si`` of ``source`` (contract terms from ``full_sites``)."""
    return f"""
SELECT {ident} AS clear_id, {storm} AS storm_id, si.site_id, CAST(1 AS BIGINT) AS operator_id, {start} AS scheduled_start,
  {minutes} AS duration_minutes, 'planned' AS status, {usd('coalesce(ct.per_clear_fee_cents, 0)')} AS fee,
  {usd('coalesce(ct.salt_fee_cents, 0)')} AS salt_fee, CAST(0 AS DOUBLE) AS other_fee,
  CAST(NULL AS BIGINT) AS ext_event_id, CAST(NULL AS BIGINT) AS ext_shift_id
FROM {source} JOIN contracts ct USING (contract_id)"""


_BOARDS = {
    "billable_clears": f"""
SELECT clear_id, storm_id, storm_ref, storm_name, {iso('storm_date')} AS storm_date, storm_type, site_id, contract_id,
  contract_name, contract_type, address, street_name, street_address, status, surface, condition, salt_applied,
  is_adhoc, {iso('coalesce(work_day, storm_date)')} AS completed_date, {usd('fee_cents')} AS fee,
  {usd('salt_cents')} AS salt_fee_billed, {usd('other_fee_cents')} AS other_fee, {usd('bill_cents')} AS billable_total,
  invoiced, paid_out, operator_id
FROM wide""",
    "clears_planned": f"SELECT {_dispatch(B)} FROM {_PLANNED}",
    "clears_upcoming": f"SELECT {_dispatch(B)} FROM {_PLANNED} AND start_day >= DATE '2001-07-20' AND start_day < DATE '2001-07-27'",
    "clears_today": f"""
SELECT {_dispatch(B)}, surface, condition, salt_applied, photo_count, gps_verified, checkin_distance_m, checked_in_at,
  checked_out_at
FROM timed WHERE status IN ('planned', 'completed') AND start_day = DATE '2001-07-20'""",
    "sites_uncleared": f"""
SELECT {_STORM}, site_id, address, city, state, zip, street_name, street_address, location_name,
  'Clear ' || CAST(storm_date AS VARCHAR) || ' - ' || label AS event_title, surface AS site_surface,
  access_notes AS site_access_notes, ext_location_id, needs_location, contract_id, contract_name, contract_type,
  clock AS sla_deadline, CAST(storm_date AS VARCHAR) || 'T' || clock AS sla_deadline_at, clear_id, clear_status,
  scheduled_start, ext_event_id, ext_shift_id, l.operator_id, operator_name, ext_worker_id,
  CASE WHEN clear_id IS NULL THEN 1 ELSE 0 END AS needs_clear,
  CASE WHEN clear_id > 0 AND ext_shift_id IS NULL THEN 1 ELSE 0 END AS needs_shift,
  'loc-site-' || site_id AS loc_idempotency_key,
  'event-site-' || site_id || '-' || strftime(storm_date, '%Y%m%d') AS event_idempotency_key,
  'shift-clear-' || clear_id AS shift_idempotency_key
FROM left_over l LEFT JOIN operators o ON o.operator_id = l.operator_id""",
    "sla_at_risk": f"""
SELECT clear_id, status, scheduled_start, checked_in_at, ext_shift_id,
  CASE WHEN ext_shift_id IS NULL THEN 1 ELSE 0 END AS needs_shift, {_STORM}, clock AS sla_deadline,
  clock_at AS sla_deadline_at, CAST(date_sub('minute', {A}, deadline) AS INTEGER) AS minutes_to_deadline,
  CASE WHEN deadline <= {A} THEN 1 ELSE 0 END AS deadline_passed, site_id, address, street_name, street_address,
  site_access_notes, contract_id, contract_name, operator_id, operator_name, ext_worker_id
FROM timed WHERE status = 'planned' AND checked_in_at IS NULL AND deadline - INTERVAL 60 MINUTE <= {A}""",
    "storms_open": f"""
SELECT st.storm_id, storm_ref, storm_name, {iso('storm_date')} AS storm_date, storm_type, st.sla_deadline, st.status,
  (SELECT count(*) FROM full_sites WHERE is_active = 1 AND contract_active = 1) AS active_sites,
  count(c.clear_id) FILTER (c.status = 'planned') AS planned_clears,
  count(c.clear_id) FILTER (c.status = 'completed') AS completed_clears,
  count(c.clear_id) FILTER (c.status = 'skipped') AS skipped_clears,
  (SELECT count(*) FROM full_sites WHERE is_active = 1 AND contract_active = 1)
    - count(DISTINCT si.site_id) FILTER (c.status <> 'cancelled') AS sites_without_clear
FROM storms st LEFT JOIN clears c USING (storm_id)
LEFT JOIN full_sites si ON si.site_id = c.site_id AND si.is_active = 1 AND si.contract_active = 1
WHERE st.status IN ('forecast', 'active') GROUP BY ALL""",
    "needs_location": """
SELECT si.site_id, address, city, state, zip, street_name, street_address, location_name, ext_location_id,
  access_notes, surface, contract_id, needs_location, 'loc-site-' || si.site_id AS loc_idempotency_key,
  coalesce(n, 0) AS planned_clears
FROM full_sites si
LEFT JOIN (SELECT site_id, count(*) AS n FROM clears WHERE status = 'planned' GROUP BY 1) c USING (site_id)
WHERE ext_location_id IS NULL AND is_active = 1
  AND (n > 0 OR EXISTS (FROM storms WHERE status IN ('forecast', 'active')))""",
}

_BILLING = {
    "receivables_by_contract": f"""
SELECT contract_id, ct.contract_name, ct.contract_type, contact_name, billing_email, payment_terms_days,
  count(*) AS clear_count, count(*) FILTER (status = 'completed') AS completed_count,
  count(*) FILTER (status = 'skipped') AS skipped_count, {usd('sum(bill_cents)')} AS total_billable,
  {iso('min(storm_date)')} AS first_date, {iso('max(coalesce(work_day, storm_date))')} AS last_date
FROM {_OPEN_ITEMS} i JOIN contracts ct USING (contract_id) GROUP BY ALL""",
    "invoice_run": f"""
SELECT r.invoice_id, contract_id, r.invoice_number, '2001-08-01' AS invoice_date,
  {iso("DATE '2001-08-01' + payment_terms_days")} AS due_date, {usd('total_cents')} AS total_amount, line_count
FROM {_RUN} r JOIN contracts USING (contract_id)""",
    "invoice_lines": f"""
SELECT invoice_number, contract_id, line_count, clear_id, storm_ref, {iso('storm_date')} AS storm_date,
  street_name AS street, surface, condition, salt_applied, status, {usd('fee_cents')} AS fee,
  {usd('salt_cents')} AS salt_fee, {usd('other_fee_cents')} AS other_fee, {usd('bill_cents')} AS billable,
  label AS street_label
FROM {_OPEN_ITEMS} i JOIN {_RUN} r USING (contract_id)""",
    "clears_invoiced": f"""
SELECT clear_id, status, CASE WHEN hit THEN 1 ELSE invoiced END AS invoiced, CASE WHEN hit THEN 1 ELSE 0 END AS touched
FROM (SELECT *, invoiced = 0 AND status <> 'planned' AND contract_id IN (SELECT contract_id FROM {_RUN}) AS hit FROM wide)""",
    "invoices_outstanding": f"""
SELECT invoice_id, invoice_number, contract_id, contract_name, contract_type, contact_name, billing_email,
  payment_terms_days, {iso('invoice_date')} AS invoice_date, {iso('due_date')} AS due_date,
  {iso('sent_date')} AS sent_date, {usd('total_cents')} AS total_amount, CAST(late AS INTEGER) AS days_past_due,
  CASE WHEN late > 60 OR late IS NULL THEN '90+' WHEN late > 30 THEN '60' WHEN late > 0 THEN '30' ELSE 'current' END
    AS aging_bucket,
  CASE WHEN late > 0 THEN 1 ELSE 0 END AS overdue
FROM (SELECT *, date_diff('day', due_date, DATE '2001-08-01') AS late FROM invoices WHERE paid = 0) i
JOIN contracts USING (contract_id)""",
    "aging_summary": f"""
SELECT aging_bucket, count(*) AS invoice_count, {usd('sum(total_cents)')} AS amount_due,
  CAST(max(late) AS INTEGER) AS oldest_days,
  CASE aging_bucket WHEN '90+' THEN 1 WHEN '60' THEN 2 WHEN '30' THEN 3 ELSE 4 END AS bucket_rank
FROM (SELECT total_cents, late, CASE WHEN late > 60 OR late IS NULL THEN '90+' WHEN late > 30 THEN '60'
        WHEN late > 0 THEN '30' ELSE 'current' END AS aging_bucket
      FROM (SELECT *, date_diff('day', due_date, DATE '2001-08-01') AS late FROM invoices WHERE paid = 0))
GROUP BY ALL""",
    "invoices_marked": """
SELECT invoice_id, invoice_number, CASE WHEN pays THEN 1 ELSE paid END AS paid,
  CASE WHEN pays THEN '2001-08-01' END AS paid_date,
  CASE WHEN sends THEN '2001-08-01' ELSE CAST(sent_date AS VARCHAR) END AS sent_date
FROM (SELECT i.*, paid = 0 AND due_date <= DATE '2001-08-01' AND contract_type = 'commercial' AS pays,
        sent_date IS NULL AND invoice_date >= DATE '2001-06-02' AS sends
      FROM invoices i JOIN contracts USING (contract_id))""",
}

_SALT_WORD = "CASE salt_applied WHEN 'yes' THEN 'Salted' WHEN 'pretreated' THEN 'Pretreated' WHEN 'no' THEN 'No salt' ELSE '-' END"


def _title_case(x: str) -> str:
    return f"upper(substr({x}, 1, 1)) || substr({x}, 2)"


# Documents are rows: heading (0), lines (1) by their id, total (2).
_BILLING.update({
    "invoice_line_items": f"""
SELECT invoice_number, storm_ref, count(*) AS lines,
  '[' || string_agg(CAST(json_object('storm_ref', storm_ref, 'storm_date', CAST(storm_date AS VARCHAR), 'street', street_name,
    'surface', surface, 'condition', condition, 'salt_applied', salt_applied, 'status', status, 'fee', {usd('fee_cents')},
    'salt_fee', {usd('salt_cents')}, 'other_fee', {usd('other_fee_cents')}, 'billable', {usd('bill_cents')}) AS VARCHAR),
    ',' ORDER BY clear_id) || ']' AS line_items
FROM {_OPEN_ITEMS} i JOIN {_RUN} r USING (contract_id) GROUP BY invoice_number, storm_ref""",
    "invoices_with_items": f"""
SELECT invoice_id, contract_id, invoice_number, '2001-08-01' AS invoice_date, {iso("DATE '2001-08-01' + payment_terms_days")} AS due_date,
  {usd('total_cents')} AS total_amount, storm_ref, lines, line_items
FROM {_RUN} JOIN contracts USING (contract_id) JOIN (
  SELECT invoice_number, storm_ref, count(*) AS lines,
    '[' || string_agg(CAST(json_object('storm_ref', storm_ref, 'storm_date', CAST(storm_date AS VARCHAR), 'street', street_name,
      'surface', surface, 'condition', condition, 'salt_applied', salt_applied, 'status', status, 'fee', {usd('fee_cents')},
      'salt_fee', {usd('salt_cents')}, 'other_fee', {usd('other_fee_cents')}, 'billable', {usd('bill_cents')}) AS VARCHAR),
      ',' ORDER BY clear_id) || ']' AS line_items
  FROM {_OPEN_ITEMS} i JOIN {_RUN} r USING (contract_id) GROUP BY invoice_number, storm_ref) USING (invoice_number)""",
    "invoice_documents": f"""
SELECT invoice_number, contract_id, 0 AS section, CAST(0 AS BIGINT) AS position,
  'My Snow Service' || chr(10) || 'Invoice ' || invoice_number || chr(10) || 'To: ' || ct.contract_name || ' (' || ct.billing_email
    || ')' || chr(10) || 'Date: Aug 1, 2001    Due: ' || strftime(DATE '2001-08-01' + ct.payment_terms_days, '%b %-d, %Y')
    || ' (net ' || ct.payment_terms_days || ')' AS line
FROM {_RUN} r JOIN contracts ct USING (contract_id)
UNION ALL
SELECT invoice_number, contract_id, 1, clear_id, '  ' || storm_ref || '  ' || label || '  '
  || {_title_case('coalesce(surface, status)')} || '  ' || {_title_case("coalesce(condition, '-')")} || '  ' || {_SALT_WORD}
  || '  $' || printf('%.2f', {usd('bill_cents')})
FROM {_OPEN_ITEMS} i JOIN {_RUN} r USING (contract_id)
UNION ALL
SELECT invoice_number, contract_id, 2, 0, 'Total due: $' || printf('%.2f', {usd('total_cents')}) FROM {_RUN}""",
})

_LEFT = "(SELECT storm_id, contract_id, count(*) AS uncleared FROM left_over GROUP BY 1, 2)"

_DUE = """(SELECT p.*, o.operator_name, o.payout_type, o.payout_value, w.storm_id, w.storm_ref, w.label, w.status,
    w.work_day, w.surface, w.condition, w.salt_applied, w.bill_cents, w.invoiced
  FROM payouts p JOIN operators o USING (operator_id) JOIN wide w ON w.clear_id = p.clear_id
  WHERE p.paid = 0 AND o.is_owner = 0)"""
_MISSING = """(SELECT w.*, o.payout_type, o.payout_value FROM wide w JOIN operators o USING (operator_id)
  WHERE w.status = 'completed' AND o.is_owner = 0 AND w.clear_id NOT IN (SELECT clear_id FROM payouts))"""
_SPLIT = """CASE payout_type WHEN 'per_clear' THEN payout_value * 100
    WHEN 'percent' THEN (bill_cents * payout_value + 50) // 100 END"""
_PER_CLEAR = "operator_id IN (SELECT operator_id FROM operators WHERE payout_type = 'per_clear')"

_PAYOUTS = {
    "payouts_due": f"""
SELECT payout_id, operator_id, operator_name, CAST(NULL AS VARCHAR) AS email, payout_type,
  CAST(payout_value AS DOUBLE) AS payout_value, clear_id, storm_id, storm_ref, label AS site_label,
  status AS clear_status, {iso('work_day')} AS work_date, surface, condition, salt_applied,
  {usd('bill_cents')} AS billable_total, {usd('amount_cents')} AS amount,
  CASE WHEN amount_cents IS NULL THEN 1 ELSE 0 END AS needs_amount,
  {usd('sum(amount_cents) OVER (PARTITION BY operator_id)')} AS operator_total_due, invoiced AS contract_invoiced
FROM {_DUE}""",
    "payouts_missing": f"""
SELECT clear_id, storm_ref, label AS site_label, status, {iso('work_day')} AS work_date, surface, condition,
  operator_id, operator_name, payout_type, CAST(payout_value AS DOUBLE) AS payout_value,
  {usd('bill_cents')} AS billable_total
FROM {_MISSING}""",
    "payouts_priced": f"""
SELECT payout_id, p.operator_id, p.clear_id, {usd(f"CASE WHEN amount_cents = 3333 THEN 3333 ELSE {_SPLIT} END")} AS amount, p.paid
FROM payouts p LEFT JOIN operators o ON o.operator_id = p.operator_id LEFT JOIN billed b ON b.clear_id = p.clear_id""",
    "payout_run": f"""
SELECT clear_id AS payout_id, operator_id, clear_id, {usd(_SPLIT)} AS amount, 0 AS paid FROM {_MISSING}""",
    "payouts_settled": f"""
SELECT payout_id, operator_id, clear_id, {usd('amount_cents')} AS amount,
  CASE WHEN {_PER_CLEAR} THEN 1 ELSE paid END AS paid,
  CASE WHEN {_PER_CLEAR} AND paid = 0 THEN '2001-08-01' END AS paid_date
FROM payouts""",
    "payouts_amounts_set": f"""
SELECT payout_id, p.operator_id, p.clear_id, {usd('CASE WHEN amount_cents IS NULL AND p.paid = 0 THEN bill_cents ELSE amount_cents END')} AS amount, p.paid
FROM payouts p LEFT JOIN billed b ON b.clear_id = p.clear_id""",
    "clears_paid_out": f"""
SELECT clear_id, operator_id, CASE WHEN hit THEN 1 ELSE paid_out END AS paid_out, CASE WHEN hit THEN 1 ELSE 0 END AS touched
FROM (SELECT *, clear_id IN (SELECT clear_id FROM payouts WHERE paid = 1 AND {_PER_CLEAR}) AS hit FROM clears)""",
    "payout_statements": f"""
SELECT operator_id, operator_name, 0 AS section, CAST(0 AS BIGINT) AS position, 'Statement for ' || operator_name AS line
FROM {_DUE} GROUP BY ALL
UNION ALL
SELECT operator_id, operator_name, 1, payout_id, '  ' || CAST(work_day AS VARCHAR) || '  ' || storm_ref || '  ' || label || '  '
  || coalesce(condition, '-') || '  ' || coalesce('$' || printf('%.2f', {usd('amount_cents')}), 'amount open') FROM {_DUE}
UNION ALL
SELECT operator_id, operator_name, 2, 0, 'Total due: $' || printf('%.2f', {usd('coalesce(sum(amount_cents), 0)')})
FROM {_DUE} GROUP BY operator_id, operator_name""",
    "payout_totals": f"""
SELECT operator_id, operator_name, CAST(NULL AS VARCHAR) AS email, count(*) AS clear_count,
  {usd('sum(amount_cents)')} AS total_due, count(*) - count(amount_cents) AS missing_amounts,
  {iso('min(work_day)')} AS first_date, {iso('max(work_day)')} AS last_date
FROM {_DUE} GROUP BY ALL""",
}

_ARRIVED = f"{ts('''substr(checked_in_at, 1, 16) || ':00' ''')}"
_OUTCOME = f"""(SELECT *, CAST(date_sub('minute', {_ARRIVED}, deadline) AS INTEGER) AS margin_minutes
  FROM timed WHERE status = 'completed' AND checked_in_at IS NOT NULL)"""

_ACTIVITY = {
    "operator_activity": f"""
SELECT o.operator_id, operator_name, is_owner, is_active, count(c.clear_id) AS clears_30d,
  count(*) FILTER (condition = 'bare') AS bare_30d, count(*) FILTER (condition = 'packed') AS packed_30d,
  count(*) FILTER (condition = 'icy') AS icy_30d,
  count(*) FILTER (salt_applied IN ('yes', 'pretreated')) AS salted_30d,
  count(*) FILTER (is_adhoc = 1) AS adhoc_30d, count(*) FILTER (gps_verified = 1) AS gps_verified_30d,
  CASE WHEN count(c.clear_id) > 0 THEN CAST((count(*) FILTER (gps_verified = 1) * 2000 + count(c.clear_id))
    // (2 * count(c.clear_id)) AS DOUBLE) / 10 END AS gps_verified_pct,
  count(*) FILTER (photo_count > 0) AS with_photo_30d,
  max(coalesce(substr(checked_in_at, 1, 16), scheduled_start)) AS last_clear_at,
  (SELECT count(*) FROM clears f WHERE f.operator_id = o.operator_id AND f.status = 'planned'
     AND f.scheduled_start >= '2001-08-01T05:40') AS planned_ahead
FROM operators o
LEFT JOIN (SELECT * FROM billed WHERE status = 'completed' AND work_day >= DATE '2001-07-02') c
  ON c.operator_id = o.operator_id
GROUP BY o.operator_id, operator_name, is_owner, is_active""",
    "mileage_by_month": f"""
SELECT strftime(trip_date, '%Y-%m') AS month, count(*) AS trips, {usd('sum(miles_cents)')} AS miles,
  {usd('sum(deduction_cents)')} AS deduction,
  {usd('sum(CASE WHEN clear_id IS NULL THEN miles_cents ELSE 0 END)')} AS non_clear_miles
FROM mileage GROUP BY 1""",
    "sla_outcome": f"""
SELECT clear_id, storm_id, storm_ref, {iso('storm_date')} AS storm_date, site_id, contract_id, contract_name,
  operator_id, operator_name, checked_in_at, clock_at AS sla_deadline_at, margin_minutes,
  CASE WHEN margin_minutes < 0 THEN 1 ELSE 0 END AS missed
FROM {_OUTCOME}""",
    "sla_outcome_by_contract": f"""
SELECT contract_id, contract_name, count(*) AS clears, count(*) FILTER (margin_minutes < 0) AS missed,
  min(margin_minutes) AS worst_margin, max(margin_minutes) AS best_margin
FROM {_OUTCOME} GROUP BY ALL""",
    "visit_evidence": """
SELECT clear_id, storm_ref, site_id, label AS site_label, operator_id, operator_name, status, checked_in_at,
  checked_out_at, gps_verified, checkin_distance_m, surface, condition, salt_applied, photo_count,
  CASE WHEN checked_in_at IS NULL THEN 'no check-in' WHEN gps_verified IS NULL THEN 'checked in, not verified'
    WHEN gps_verified = 1 THEN 'verified on site' ELSE 'phone not at the site' END AS verdict
FROM wide WHERE status <> 'cancelled'""",
    "operator_hours": f"""
SELECT operator_id, operator_name, {iso('work_date')} AS work_date, visits, seconds,
  {usd('(seconds * 100 + 1800) // 3600')} AS hours
FROM (SELECT operator_id, CAST({ts('checked_in_at')} AS DATE) AS work_date, count(*) AS visits,
        {big(f"sum(date_diff('second', {ts('checked_in_at')}, {ts('checked_out_at')}))")} AS seconds
      FROM clears WHERE checked_in_at IS NOT NULL AND checked_out_at IS NOT NULL GROUP BY ALL) h
JOIN operators USING (operator_id)""",
    "punch_rows": """
SELECT clear_id, operator_id, ext_shift_id, 'in' AS punch_type, checked_in_at AS punched_at FROM clears
WHERE checked_in_at IS NOT NULL
UNION ALL
SELECT clear_id, operator_id, ext_shift_id, 'out', checked_out_at FROM clears WHERE checked_out_at IS NOT NULL""",
    "storm_cost": f"""
SELECT storm_id, storm_ref, visits, bare AS proofs_without_photos, coalesce(pins, 0) AS new_locations,
  {usd('coalesce(pins, 0) * 3 + visits * 20 + visits * 15 - bare * 10')} AS cost
FROM storms
JOIN (SELECT storm_id, count(*) AS visits, count(*) FILTER (status = 'completed' AND photo_count = 0) AS bare
      FROM clears WHERE status IN ('planned', 'completed') GROUP BY 1) v USING (storm_id)
LEFT JOIN (SELECT storm_id, count(*) AS pins FROM (
    SELECT storm_id FROM clears JOIN sites USING (site_id) WHERE clears.status = 'planned' AND ext_location_id IS NULL
    QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY clear_id) = 1) GROUP BY 1) n USING (storm_id)""",
    "storm_recap": f"""
SELECT storm_id, storm_ref, {iso('storm_date')} AS storm_date, contract_id, contract_name,
  count(*) FILTER (status = 'completed') AS completed,
  count(*) FILTER (status = 'completed' AND salt_applied <> 'no') AS salted,
  count(*) FILTER (status = 'completed' AND condition = 'bare') AS bare,
  count(*) FILTER (status = 'completed' AND condition = 'packed') AS packed,
  count(*) FILTER (status = 'completed' AND condition = 'icy') AS icy,
  count(*) FILTER (status = 'skipped') AS skipped, coalesce(any_value(l.uncleared), 0) AS uncleared,
  {usd('sum(bill_cents)')} AS billable, {usd('sum(bill_cents) FILTER (invoiced = 0)')} AS receivable
FROM wide w LEFT JOIN {_LEFT} l USING (storm_id, contract_id)
GROUP BY storm_id, storm_ref, storm_date, contract_id, contract_name
UNION ALL
SELECT storm_id, storm_ref, {iso('storm_date')}, NULL, NULL, 0, 0, 0, 0, 0, 0, CAST(sum(uncleared) AS BIGINT), NULL, NULL
FROM {_LEFT} l JOIN storms USING (storm_id)
WHERE NOT EXISTS (FROM wide w WHERE w.storm_id = l.storm_id AND w.contract_id = l.contract_id)
GROUP BY storm_id, storm_ref, storm_date""",
}

_DEFAULTS = {
    "storms_numbered": f"SELECT storm_id, storm_ref, {iso('storm_date')} AS storm_date, status FROM storms",
    "storms_defaulted": "SELECT storm_id, sla_deadline FROM storms",
    "clears_defaulted": f"SELECT {_CLEAR_STATE}, strftime(visit_day, '%Y-%m') AS storm_month, notes FROM clears",
    "mileage_defaulted": f"""
SELECT trip_id, clear_id, {iso('trip_date')} AS trip_date, {usd('miles_cents')} AS miles, {usd('rate_cents')} AS rate,
  {usd('deduction_cents')} AS deduction
FROM mileage""",
    "mileage_recomputed": f"""
SELECT trip_id, {usd('miles')} AS miles, {usd('rate')} AS rate,
  {usd('CAST(round(CAST(miles * coalesce(rate, 0) AS DECIMAL(18,0)) / 100) AS BIGINT)')} AS deduction
FROM (SELECT trip_id, CASE WHEN clear_id IS NULL THEN miles_cents + 200 ELSE miles_cents END AS miles,
        CASE WHEN clear_id IS NULL THEN rate_cents END AS rate FROM mileage)""",
    "invoices_numbered": f"""
SELECT invoice_id, invoice_number, {iso('invoice_date')} AS invoice_date, {iso('due_date')} AS due_date,
  {usd('total_cents')} AS total_amount
FROM invoices""",
}


def _value_rule(rule: str, table: str, ident: str, column: str, broken: str) -> str:
    return (
        f"SELECT '{rule}' AS rule, '{table}' AS \"table\", {ident} AS row_id, CAST({column} AS VARCHAR) AS value "
        f"FROM {table} WHERE {broken}"
    )


def _unique_rule(rule: str, table: str, ident: str, key: str, shown: str | None = None, where: str = "TRUE") -> str:
    return (
        f"SELECT '{rule}', '{table}', {ident}, CAST({shown or key} AS VARCHAR) FROM (SELECT *, "
        f"row_number() OVER (PARTITION BY {key} ORDER BY {ident}) AS nth FROM {table} "
        f"WHERE {where} AND ({key}) IS NOT NULL) WHERE nth > 1"
    )


def _reference_rule(rule: str, child: str, ident: str, key: str, parent: str) -> str:
    return (
        f"SELECT '{rule}', '{child}', {ident}, CAST({key} AS VARCHAR) FROM {child} c "
        f"WHERE {key} IS NOT NULL AND NOT EXISTS (FROM {parent} p WHERE p.{key} = c.{key})"
    )


_CLOCK = "sla_deadline IS NOT NULL AND NOT regexp_full_match(sla_deadline, '[0-2][0-9]:[0-5][0-9]')"
_START = "'[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-2][0-9]:[0-5][0-9].*'"
_VIOLATIONS = "\nUNION ALL ".join([
    _value_rule("contract_type", "contracts", "contract_id", "contract_type", "contract_type NOT IN ('hoa', 'commercial', 'municipal', 'residential', 'other')"),
    _value_rule("contract_sla_clock", "contracts", "contract_id", "sla_deadline", _CLOCK),
    _value_rule("site_surface", "sites", "site_id", "surface", "surface NOT IN ('driveway', 'lot', 'walk', 'mixed')"),
    _value_rule("site_sla_clock", "sites", "site_id", "sla_deadline", _CLOCK),
    _value_rule("payout_type", "operators", "operator_id", "payout_type", "payout_type NOT IN ('per_clear', 'percent')"),
    _value_rule("storm_date", "storms", "storm_id", "storm_date", "storm_date IS NULL"),
    _value_rule("storm_type", "storms", "storm_id", "storm_type", "storm_type NOT IN ('snow', 'ice', 'mix')"),
    _value_rule("storm_sla_clock", "storms", "storm_id", "sla_deadline", _CLOCK),
    _value_rule("storm_status", "storms", "storm_id", "status", "status NOT IN ('forecast', 'active', 'closed', 'cancelled')"),
    _value_rule("storm_clock_unreal", "storms", "storm_id", "sla_deadline", "sla_deadline BETWEEN '24:00' AND '29:59'"),
    _value_rule("scheduled_start", "clears", "clear_id", "scheduled_start", f"NOT regexp_full_match(scheduled_start, {_START}) OR regexp_matches(scheduled_start, 'T.*[+-]') OR scheduled_start LIKE '%Z'"),
    _value_rule("duration_minutes", "clears", "clear_id", "duration_minutes", "duration_minutes < 5 OR duration_minutes > 720"),
    _value_rule("clear_status", "clears", "clear_id", "status", "status NOT IN ('planned', 'completed', 'cancelled', 'skipped')"),
    _value_rule("start_unreadable", "clears", "clear_id", "scheduled_start", f"scheduled_start IS NOT NULL AND {ts('scheduled_start')} IS NULL"),
    _value_rule("proof_surface", "clears", "clear_id", "surface", "surface NOT IN ('driveway', 'lot', 'walk', 'all')"),
    _value_rule("proof_condition", "clears", "clear_id", "condition", "condition NOT IN ('bare', 'packed', 'icy')"),
    _value_rule("proof_salt", "clears", "clear_id", "salt_applied", "salt_applied NOT IN ('yes', 'no', 'pretreated')"),
    _value_rule("miles", "mileage", "trip_id", "printf('%.2f', miles_cents / 100.0)", "miles_cents < 0"),
    _unique_rule("unique_address", "sites", "site_id", "normalized_address"),
    _unique_rule("unique_worker", "operators", "operator_id", "ext_worker_id"),
    _unique_rule("unique_storm_ref", "storms", "storm_id", "storm_ref"),
    _unique_rule("unique_shift", "clears", "clear_id", "ext_shift_id"),
    _unique_rule("unique_invoice_number", "invoices", "invoice_id", "invoice_number"),
    _unique_rule("unique_payout_clear", "payouts", "payout_id", "clear_id"),
    _unique_rule("one_clear_per_site_storm", "clears", "clear_id", "storm_id, site_id", "storm_id || '/' || site_id", "status <> 'cancelled'"),
    _reference_rule("site_contract", "sites", "site_id", "contract_id", "contracts"),
    _reference_rule("clear_storm", "clears", "clear_id", "storm_id", "storms"),
    _reference_rule("clear_site", "clears", "clear_id", "site_id", "sites"),
    _reference_rule("clear_operator", "clears", "clear_id", "operator_id", "operators"),
    _reference_rule("mileage_clear", "mileage", "trip_id", "clear_id", "clears"),
    _reference_rule("invoice_contract", "invoices", "invoice_id", "contract_id", "contracts"),
    _reference_rule("payout_operator", "payouts", "payout_id", "operator_id", "operators"),
    _reference_rule("payout_clear", "payouts", "payout_id", "clear_id", "clears"),
])

def _spoiled_tables() -> str:
    """The spoiled tables under their own names; miles are kept in hundredths here."""
    made = []
    for table, columns in SPOILED.items():
        own = {k.replace("miles", "miles_cents"): v.replace("miles > 10", "miles > 1000").replace("miles", "miles_cents") for k, v in columns.items()} if table == "mileage" else columns
        replaced = ", ".join(f"{v} AS {k}" for k, v in own.items())
        made.append(f"bad_{table} AS (SELECT * REPLACE ({replaced}) FROM {table})")
    made.append("bad_settings AS (FROM settings UNION ALL FROM settings WHERE key LIKE 'default%')")
    made += [f"{table} AS (FROM bad_{table})" for table in [*SPOILED, "settings"]]
    return ",\n".join(made)


_STAGED = f"""SELECT * FROM (WITH {_spoiled_tables()}
{_VIOLATIONS}
UNION ALL SELECT 'unique_setting', 'settings', NULL, key FROM settings GROUP BY key HAVING count(*) > 1)"""

_GATED = ("contracts", "sites", "operators", "storms", "clears", "mileage", "invoices", "payouts")
_GATED_ROWS = " UNION ALL ".join(f"SELECT '{name}' AS \"table\", count(*) AS n FROM {name}" for name in _GATED)

_QUALITY = {
    "dq_gate": f"""
SELECT "table", n - coalesce(bad, 0) AS accepted, coalesce(bad, 0) AS rejected
FROM (WITH {_spoiled_tables()} {_GATED_ROWS}) LEFT JOIN (
  SELECT "table", count(DISTINCT row_id) AS bad FROM ({_STAGED}) WHERE rule NOT IN ('start_unreadable', 'storm_clock_unreal')
  GROUP BY "table") USING ("table")""",
    "dq_violations": _VIOLATIONS,
    "dq_staged_violations": _STAGED,
    "dq_violation_counts": f"""
SELECT rule, "table", count(*) AS violations, min(row_id) AS first_row, max(row_id) AS last_row
FROM ({_VIOLATIONS}) GROUP BY ALL""",
    "delete_plan": """
SELECT 'storms' AS "table", storm_id AS row_id, 'delete' AS action, 'named' AS cause FROM storms WHERE status = 'cancelled'
UNION ALL SELECT 'clears', clear_id, 'delete', 'storm' FROM clears JOIN storms st USING (storm_id) WHERE st.status = 'cancelled'
UNION ALL SELECT 'payouts', payout_id, 'delete', 'clear' FROM payouts JOIN clears USING (clear_id) JOIN storms st USING (storm_id) WHERE st.status = 'cancelled'
UNION ALL SELECT 'mileage', trip_id, 'set null', 'clear' FROM mileage JOIN clears USING (clear_id) JOIN storms st USING (storm_id) WHERE st.status = 'cancelled'
UNION ALL SELECT 'operators', operator_id, 'delete', 'named' FROM operators WHERE is_active = 0
UNION ALL SELECT 'payouts', payout_id, 'delete', 'operator' FROM payouts JOIN operators USING (operator_id) WHERE is_active = 0
UNION ALL SELECT 'clears', clear_id, 'set null', 'operator' FROM clears JOIN operators USING (operator_id) WHERE is_active = 0
UNION ALL SELECT 'contracts', contract_id, CASE WHEN contract_id IN (SELECT contract_id FROM sites) THEN 'blocked' ELSE 'delete' END,
  CASE WHEN contract_id IN (SELECT contract_id FROM sites) THEN 'sites' ELSE 'named' END FROM contracts WHERE is_active = 0
UNION ALL SELECT 'invoices', invoice_id, 'delete', 'contract' FROM invoices JOIN contracts USING (contract_id)
  WHERE is_active = 0 AND contract_id NOT IN (SELECT contract_id FROM sites)
UNION ALL SELECT 'sites', site_id, CASE WHEN site_id IN (SELECT site_id FROM clears) THEN 'blocked' ELSE 'delete' END,
  CASE WHEN site_id IN (SELECT site_id FROM clears) THEN 'clears' ELSE 'named' END FROM sites WHERE is_active = 0""",
}

_TO_PIN = f"(SELECT DISTINCT site_id, contract_id, location_name, street_address FROM {_PLANNED} AND needs_location = 1)"
_TO_EVENT = f"""(SELECT * FROM {_PLANNED} AND event_or_sibling IS NULL AND start_day IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY clear_id) = 1)"""
_EVENT_ID = "site_id * 100000000 + CAST(strftime(start_day, '%Y%m%d') AS BIGINT)"
_SHIFT_REQUEST = """clear_id, event_or_sibling AS event_id, ext_worker_id AS worker_id,
  strftime(start_at, '%Y-%m-%dT%H:%M:%S') || '-06:00' AS "start",
  strftime(start_at + to_minutes(duration_minutes), '%Y-%m-%dT%H:%M:%S') || '-06:00' AS "end" """

_DISPATCH = {
    "storm_open_clears": _fresh(
        "st.storm_id", """st.storm_id * 1000000000 + si.site_id + 10000000000000000
          * (SELECT count(*) FROM clears e WHERE e.storm_id = st.storm_id AND e.site_id = si.site_id)""", "CAST(st.storm_date AS VARCHAR) || 'T04:00'", "180",
        """(SELECT * FROM storms WHERE status = 'forecast') st JOIN (SELECT * FROM sites WHERE is_active = 1) si ON NOT EXISTS (
    FROM clears c WHERE c.storm_id = st.storm_id AND c.site_id = si.site_id AND c.status <> 'cancelled')""",
    ),
    "outbox_locations": f"""
SELECT site_id, contract_id, location_name AS name, street_address, 150 AS checkin_radius_m,
  'loc-site-' || site_id AS idempotency_key FROM {_TO_PIN}""",
    "outbox_events": f"""
SELECT site_id, contract_id, ext_location_id, 'Clear ' || CAST(storm_date AS VARCHAR) || ' - ' || label AS title,
  {iso('start_day')} AS start_date, {iso('start_day')} AS end_date, event_key AS idempotency_key FROM {_TO_EVENT}""",
    "outbox_form_assign": f"""
SELECT CAST(NULL AS BIGINT) AS form_id, {_EVENT_ID} AS event_id, 'assign-proof-' || ({_EVENT_ID}) AS idempotency_key
FROM {_TO_EVENT}""",
    "outbox_shifts": f"""
SELECT {_SHIFT_REQUEST}, 'shift-clear-' || clear_id AS idempotency_key FROM {_PLANNED} AND ext_shift_id IS NULL""",
    "outbox_ledger": f"""
SELECT 'loc-site-' || site_id AS idempotency_key, 'location' AS kind, 'morning' AS claim, CAST(1 AS BIGINT) AS sent FROM {_TO_PIN}
UNION ALL SELECT 'shift-clear-' || clear_id, 'shift', 'morning', 1 FROM {_PLANNED} AND ext_shift_id IS NULL
UNION ALL SELECT event_key, 'event', 'stream-0', 1 FROM {_TO_EVENT}""",
    "outbox_privacy_audit": f"""
SELECT 'locations' AS outbox, count(*) AS requests,
  count(*) FILTER (position(lower(access_notes) IN lower(q.location_name || ' ' || q.street_address)) > 0) AS leaks_access,
  count(*) FILTER (position(lower(contact_name) IN lower(q.location_name || ' ' || q.street_address)) > 0) AS leaks_contact
FROM {_TO_PIN} q JOIN full_sites USING (site_id)
UNION ALL
SELECT 'events', count(*),
  count(*) FILTER (position(lower(access_notes) IN lower('Clear ' || CAST(storm_date AS VARCHAR) || ' - ' || q.label)) > 0),
  count(*) FILTER (position(lower(contact_name) IN lower('Clear ' || CAST(storm_date AS VARCHAR) || ' - ' || q.label)) > 0)
FROM {_TO_EVENT} q JOIN full_sites USING (site_id)""",
    "locations_pinned": f"""
SELECT site_id, CASE WHEN hit THEN site_id + 500000000 ELSE ext_location_id END AS ext_location_id,
  CASE WHEN hit THEN 1 ELSE 0 END AS touched
FROM (SELECT *, site_id IN (SELECT site_id FROM {_TO_PIN}) AS hit FROM sites)""",
    "events_recorded": f"""
SELECT clear_id, status, CASE WHEN hit THEN {_EVENT_ID} ELSE ext_event_id END AS ext_event_id,
  CASE WHEN hit THEN 1 ELSE 0 END AS touched
FROM (SELECT *, ext_event_id IS NULL AND event_key IN (SELECT event_key FROM {_TO_EVENT}) AS hit FROM timed)""",
    "shifts_recorded": """
SELECT clear_id, status, CASE WHEN status = 'planned' THEN coalesce(ext_shift_id, -clear_id) ELSE ext_shift_id END AS ext_shift_id,
  CASE WHEN status = 'planned' AND ext_shift_id IS NULL THEN 1 ELSE 0 END AS touched
FROM clears""",
}

_LATEST_STORM = "(SELECT storm_id FROM storms WHERE status IN ('forecast', 'active') ORDER BY storm_date DESC, storm_id DESC LIMIT 1)"
_TYPED = f"""(SELECT site_id AS entry_id,
    contract_id + CASE WHEN surface = 'mixed' THEN 1000000000 ELSE 0 END AS contract_id,
    {_normalized("'#' || upper(address) || '.,'", "'  ' || coalesce(city, 'Edina')", 'state', 'zip')} AS typed FROM sites)"""


def _changed(hit: str, start: str = "scheduled_start", **values: str) -> str:
    """All clears with some columns replaced where ``hit`` holds (alias ``w`` has the storm and site columns)."""
    shown = {
        "operator_id": "operator_id", "scheduled_start": "scheduled_start", "status": "status",
        "other_fee": usd("other_fee_cents"), "ext_shift_id": "ext_shift_id",
    }
    for name, value in values.items():
        shown[name] = f"CASE WHEN hit THEN {value} ELSE {shown[name]} END"
    return f"""
SELECT clear_id, storm_id, site_id, {shown['operator_id']} AS operator_id, {shown['scheduled_start']} AS scheduled_start,
  duration_minutes, {shown['status']} AS status, {usd('fee_cents')} AS fee, {usd('salt_fee_cents')} AS salt_fee,
  {shown['other_fee']} AS other_fee, ext_event_id, {shown['ext_shift_id']} AS ext_shift_id,
  CASE WHEN hit THEN 1 ELSE 0 END AS touched
FROM (SELECT *, status = 'planned' AND {hit} AS hit FROM wide)"""


_INACTIVE_CONTRACT = "contract_id IN (SELECT contract_id FROM contracts WHERE is_active = 0)"
_INACTIVE_OPERATOR = "operator_id IN (SELECT operator_id FROM operators WHERE is_active = 0)"

# Feeds in their checking form: window punches of planned clears, recorded punches of completed ones.
_STAMP = "'%Y-%m-%dT%H:%M:%S'"
FEEDS = f""",
shifts AS (
  SELECT *, {ts('scheduled_start')} AS start_at,
    CASE WHEN status = 'planned' THEN strftime({ts('scheduled_start')}, {_STAMP}) || '-06:00' ELSE checked_in_at END AS in_text,
    CASE WHEN status = 'planned' AND duration_minutes >= 60
      THEN strftime({ts('scheduled_start')} + to_minutes(duration_minutes), {_STAMP}) || '-06:00'
      WHEN status = 'completed' THEN checked_out_at END AS out_text,
    coalesce(checkin_distance_m, duration_minutes) AS metres, coalesce(gps_verified, 1) AS verified
  FROM clears WHERE ext_shift_id IS NOT NULL AND status IN ('planned', 'completed')),
punches AS (
  SELECT ext_shift_id AS shift_id, operator_id AS worker_id, 'in' AS punch_type, in_text AS punched_at, verified, metres
  FROM shifts WHERE in_text IS NOT NULL
  UNION ALL
  SELECT ext_shift_id, operator_id, 'out', out_text, verified, metres FROM shifts WHERE out_text IS NOT NULL),
shift_windows AS (
  SELECT ext_shift_id AS shift_id, clear_id, {ts('scheduled_start')} AS starts_at,
    {ts('scheduled_start')} + to_minutes(duration_minutes) AS ends_at
  FROM clears WHERE ext_shift_id IS NOT NULL AND status <> 'cancelled'),
watched AS (
  SELECT ext_shift_id AS shift_id, clear_id, site_id, deadline, deadline - INTERVAL 60 MINUTE AS alert_at
  FROM timed WHERE ext_shift_id IS NOT NULL AND status <> 'cancelled' AND deadline IS NOT NULL)
"""
_IN = f"(SELECT shift_id, {ts('punched_at')} AS moment FROM punches WHERE punch_type = 'in')"
_OUT = f"(SELECT shift_id, {ts('punched_at')} AS moment FROM punches WHERE punch_type = 'out')"

_CHANGES = {
    "adhoc_candidates": """
SELECT * FROM (WITH waiting AS (
    SELECT w.*, CASE WHEN w.storm_status IN ('active', 'forecast') THEN w.storm_ref END AS open_ref FROM wide w WHERE w.status = 'planned'),
  found AS (FROM sites WHERE contains(lower(concat_ws(chr(10), street_name, address)), 'ring'))
SELECT f.site_id, f.street_name, f.address, f.ext_location_id, clear_id, ext_event_id, ext_shift_id, scheduled_start,
  open_ref AS storm_ref
FROM waiting RIGHT JOIN found f ON waiting.site_id = f.site_id)""",
    "adhoc_batch": """
SELECT * FROM (WITH waiting AS (
    SELECT w.*, CASE WHEN w.storm_status IN ('active', 'forecast') THEN w.storm_ref END AS open_ref FROM wide w WHERE w.status = 'planned'),
  asked AS (SELECT site_id AS request_id, trim(lower(CASE WHEN site_id % 1000 = 1 THEN substr(street_name, 1, 2) WHEN site_id % 1000 = 2 THEN 'qzx'
      ELSE substr(address, 2, 6) END)) AS said FROM sites),
  found AS (SELECT request_id, si.* FROM asked JOIN sites si
    ON said <> '' AND (contains(lower(address), said) OR coalesce(contains(lower(street_name), said), FALSE)))
SELECT f.request_id, f.site_id, f.street_name, f.address, f.ext_location_id, clear_id, ext_event_id, ext_shift_id, scheduled_start,
  open_ref AS storm_ref
FROM waiting RIGHT JOIN found f ON waiting.site_id = f.site_id)""",
    "adhoc_inserts": "SELECT *, 1 AS is_adhoc FROM (" + _fresh(
        _LATEST_STORM, "-si.site_id", "'2001-07-20T05:40'", "30",
        f"""(SELECT * FROM sites WHERE surface = 'lot' AND ext_location_id IS NOT NULL
      AND site_id NOT IN (SELECT site_id FROM clears WHERE status = 'planned')
      AND site_id NOT IN (SELECT site_id FROM clears WHERE status <> 'cancelled' AND storm_id = {_LATEST_STORM})) si""",
    ) + ")",
    "adhoc_verdicts": f"""
SELECT -site_id AS clear_id, site_id, CAST(1 AS BIGINT) AS operator_id, CASE
    WHEN site_id IN (SELECT site_id FROM clears WHERE status = 'planned') THEN 'planned clear'
    WHEN {_LATEST_STORM} IS NULL THEN 'no open storm'
    WHEN site_id IN (SELECT site_id FROM clears WHERE status <> 'cancelled' AND storm_id = {_LATEST_STORM}) THEN 'already served'
    ELSE 'inserted' END AS verdict
FROM sites WHERE surface = 'lot' AND ext_location_id IS NOT NULL""",
    "contract_appends": """
SELECT base + contract_id AS contract_id, contract_type,
  CASE WHEN contract_type = 'hoa' THEN 'new-' ELSE '' END || billing_email AS billing_email,
  CASE WHEN contract_type <> 'hoa' THEN 'known key' WHEN base = 1000000000 THEN 'accepted' ELSE 'repeated in batch' END AS verdict
FROM contracts CROSS JOIN (VALUES (1000000000), (2000000000)) AS two(base)""",
    "worker_invitations": """
SELECT min(operator_id) AS operator_id, 'crew' || right(operator_name, 1) || '@example.com' AS email,
  'worker-crew' || right(operator_name, 1) || '@example.com' AS idempotency_key
FROM operators GROUP BY right(operator_name, 1)""",
    "clears_rescheduled": _changed(
        "storm_type = 'ice'", scheduled_start="strftime(start_at + INTERVAL 30 MINUTE, '%Y-%m-%dT%H:%M')"
    ),
    "clears_cancelled": _changed(_INACTIVE_CONTRACT, status="'cancelled'"),
    "cancellation_requests": f"""
SELECT clear_id, ext_shift_id, 'cancelled' AS reason, 'cancel-shift-' || ext_shift_id AS idempotency_key
FROM wide WHERE status = 'planned' AND ext_shift_id IS NOT NULL AND {_INACTIVE_CONTRACT}""",
    "clears_skipped": _changed(
        "site_surface = 'walk'", status="'skipped'",
        other_fee=usd("coalesce((SELECT salt_fee_cents FROM contracts ct WHERE ct.contract_id = q.contract_id), 0)"),
    ).replace("FROM wide)", "FROM wide) q"),
    "operator_swaps": _changed(_INACTIVE_OPERATOR, operator_id="1", ext_shift_id="NULL"),
    "swapped_shift_requests": f"""
SELECT {_SHIFT_REQUEST.replace('ext_worker_id', 'CAST(800 AS BIGINT)')}, 'shift-clear-' || clear_id || '-2' AS idempotency_key
FROM {_PLANNED} AND {_INACTIVE_OPERATOR}""",
    "clears_moved_day": _changed("storm_type = 'mix'", status="'cancelled'") + f"""
UNION ALL
SELECT -clear_id, storm_id, site_id, operator_id, strftime(start_at + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M'), duration_minutes,
  'planned', {usd('coalesce(ct.per_clear_fee_cents, 0)')}, {usd('coalesce(ct.salt_fee_cents, 0)')}, CAST(0 AS DOUBLE),
  NULL, NULL, 0
FROM wide JOIN contracts ct USING (contract_id) WHERE status = 'planned' AND storm_type = 'mix'""",
    "lots_linked": """
SELECT site_id + again * CAST(1000000000 AS BIGINT) AS site_id, site_id AS lot FROM sites CROSS JOIN (VALUES (1), (2), (3)) AS spelled(again)""",
    "storm_batch_months": """
SELECT storm_month, count(*) AS clears, count(*) FILTER (status = 'cancelled' OR (storm_id = busiest AND status = 'planned')) AS cancelled,
  max(CASE WHEN storm_id = busiest THEN 1 ELSE 0 END) AS rewritten
FROM (SELECT *, strftime(visit_day, '%Y-%m') AS storm_month FROM clears)
CROSS JOIN (SELECT storm_id AS busiest FROM clears WHERE status = 'planned' GROUP BY 1 ORDER BY count(*) DESC, storm_id LIMIT 1)
GROUP BY storm_month""",
    "storms_closed": """
SELECT storm_id, storm_ref, CASE WHEN done THEN 'closed' ELSE status END AS status, CASE WHEN done THEN 1 ELSE 0 END AS touched
FROM (SELECT *, status IN ('forecast', 'active') AND storm_id NOT IN (SELECT storm_id FROM left_over) AS done FROM storms)""",
    "terms_changed": f"""
SELECT contract_id, contract_type,
  {usd("per_clear_fee_cents + CASE WHEN contract_type = 'hoa' THEN 500 ELSE 0 END")} AS per_clear_fee,
  {usd('salt_fee_cents')} AS salt_fee, CASE WHEN contract_type = 'hoa' THEN '06:15' ELSE sla_deadline END AS sla_deadline,
  CASE WHEN contract_type = 'hoa' THEN 1 ELSE 0 END AS touched
FROM contracts""",
    "deactivated": """
SELECT site_id, surface, CASE WHEN surface = 'mixed' THEN 0 ELSE is_active END AS is_active,
  CASE WHEN surface = 'mixed' THEN 1 ELSE 0 END AS touched
FROM sites""",
    "operators_retired": """
SELECT operator_id, payout_type, CASE WHEN payout_type = 'percent' THEN 0 ELSE is_active END AS is_active,
  CASE WHEN payout_type = 'percent' THEN 1 ELSE 0 END AS touched
FROM operators""",
    "settings_upserted": """
SELECT key, CASE key
  WHEN 'default_operator_id' THEN (SELECT CAST(operator_id AS VARCHAR) FROM clears WHERE status = 'completed'
    GROUP BY operator_id ORDER BY count(*) DESC, operator_id DESC LIMIT 1)
  WHEN 'default_clear_minutes' THEN (SELECT CAST(duration_minutes AS VARCHAR) FROM clears
    GROUP BY duration_minutes ORDER BY count(*) DESC, duration_minutes DESC LIMIT 1)
  WHEN 'default_clear_start' THEN (SELECT min(substr(scheduled_start, 12, 5)) FROM clears)
  ELSE value END AS value
FROM settings""",
    "dimension_appends": f"""
SELECT base + entry_id AS site_id, e.contract_id, typed AS normalized_address, 'driveway' AS surface, 1 AS is_active,
  CASE WHEN NOT EXISTS (FROM contracts ct WHERE ct.contract_id = e.contract_id) THEN 'unknown contract'
    WHEN typed IN (SELECT normalized_address FROM sites) THEN 'known address'
    WHEN row_number() OVER (PARTITION BY typed ORDER BY base + entry_id) > 1 THEN 'repeated in batch'
    ELSE 'accepted' END AS verdict
FROM {_TYPED} e CROSS JOIN (VALUES (1000000000), (2000000000)) AS two(base)""",
    "mileage_append": f"""
SELECT -clear_id AS trip_id, clear_id, {iso('work_day')} AS trip_date, {usd('duration_minutes * 10')} AS miles,
  'site ' || site_id AS to_label, CAST(70 AS DOUBLE) / 100 AS rate, {usd('duration_minutes * 7')} AS deduction
FROM billed WHERE status = 'completed' AND work_day >= DATE '2001-07-02'""",
    "address_book_normalized": f"""
SELECT entry_id, typed AS normalized_address, site_id, ext_location_id, CASE WHEN site_id IS NULL THEN 1 ELSE 0 END AS is_new
FROM {_TYPED} e LEFT JOIN sites ON normalized_address = typed""",
    "sites_merged": """
SELECT m.site_id, keep AS kept_site_id, pin AS kept_location_id, count(c.clear_id) AS clears_moved,
  count(*) FILTER (c.status <> 'cancelled' AND EXISTS (
    FROM clears o JOIN members n ON n.site_id = o.site_id
    WHERE n.lot = m.lot AND o.storm_id = c.storm_id AND o.status <> 'cancelled' AND o.clear_id < c.clear_id)) AS blocked
FROM members m LEFT JOIN clears c ON c.site_id = m.site_id
WHERE m.site_id <> keep GROUP BY ALL""",
    "clears_with_results": f"""
SELECT clear_id, storm_id, site_id, operator_id, scheduled_start, duration_minutes,
  CASE WHEN hit THEN 'completed' ELSE status END AS status, {usd('fee_cents')} AS fee, {usd('salt_fee_cents')} AS salt_fee,
  {usd('other_fee_cents')} AS other_fee, ext_event_id, ext_shift_id,
  CASE WHEN hit THEN CASE WHEN sub IS NOT NULL THEN 'Lot' END ELSE surface END AS surface,
  CASE WHEN hit THEN CASE WHEN sub IS NOT NULL THEN 'bare' END ELSE condition END AS condition,
  CASE WHEN hit THEN NULL ELSE salt_applied END AS salt_applied,
  CASE WHEN hit THEN CASE WHEN sub IS NOT NULL THEN 2 ELSE 0 END ELSE photo_count END AS photo_count,
  CASE WHEN hit THEN sub ELSE report_id END AS report_id,
  CASE WHEN hit THEN in_text ELSE checked_in_at END AS checked_in_at,
  CASE WHEN hit THEN out_text ELSE checked_out_at END AS checked_out_at,
  CASE WHEN hit THEN 1 ELSE gps_verified END AS gps_verified,
  CASE WHEN hit THEN metres ELSE checkin_distance_m END AS checkin_distance_m,
  CASE WHEN hit THEN 1 ELSE 0 END AS touched
FROM (SELECT v.*, f.sub
      FROM (SELECT *, CASE WHEN hit THEN row_number() OVER (PARTITION BY ext_event_id, hit ORDER BY in_text, clear_id) END AS turn
            FROM (SELECT c.*, s.in_text, s.out_text, s.metres, c.status = 'planned' AND s.out_text IS NOT NULL AS hit
                  FROM clears c LEFT JOIN shifts s USING (clear_id))) v
      LEFT JOIN (SELECT ext_event_id AS event_id, -clear_id AS sub,
                   row_number() OVER (PARTITION BY ext_event_id ORDER BY scheduled_start, -clear_id) AS turn
                 FROM clears WHERE status = 'planned' AND ext_event_id IS NOT NULL) f
        ON f.event_id = v.ext_event_id AND f.turn = v.turn)""",
}
_WITH_FEEDS = {"clears_with_results"}
_MEMBERS = """,
members AS (
  SELECT site_id, lot, min(site_id) OVER (PARTITION BY lot) AS keep,
    first_value(ext_location_id IGNORE NULLS) OVER (PARTITION BY lot ORDER BY site_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS pin
  FROM (SELECT *, contract_id || '|' || lower(street_name) AS lot FROM sites) WHERE lot IS NOT NULL)
"""

_NORMAL_TEXT = "trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
_PROOF_PROBLEMS = """array_to_string(list_filter([
    CASE WHEN status = 'planned' THEN 'surface unknown' END,
    CASE WHEN status = 'planned' THEN 'salt_applied missing' END,
    CASE WHEN status <> 'planned' AND photo_count = 0 THEN 'after photo missing' END], lambda x: x IS NOT NULL), '; ')"""

_TEXT = {
    "proof_option_keys": """
SELECT label, option_key, uses, count(*) OVER (PARTITION BY option_key) AS labels_with_key
FROM (SELECT label, left(regexp_replace(lower(label), '[^a-z0-9]', '_', 'g'), 30) AS option_key, count(*) AS uses
      FROM (SELECT p_brand || ' / ' || p_type || ' (' || p_size || '-inch, after photo)' AS label FROM part) GROUP BY ALL)""",
    "proof_validation": f"""
SELECT * FROM (
  SELECT coalesce(report_id, -clear_id) AS submission_id, ext_event_id AS event_id, operator_id AS worker_id,
    CASE WHEN status = 'planned' THEN 2 ELSE photo_count END AS photos, {_PROOF_PROBLEMS} AS problems
  FROM clears WHERE report_id IS NOT NULL OR (status = 'planned' AND ext_event_id IS NOT NULL))
WHERE problems <> ''""",
    "notes_leak_scan": f"""
SELECT text_id, CASE WHEN coded THEN 1 ELSE 0 END AS gate_code, coalesce(names, 0) AS names, first_name
FROM (SELECT text_id, contains(low, 'gate') OR contains(low, 'door') OR contains(low, 'lockbox') OR contains(low, 'access') OR contains(low, 'entry') AS may,
        may AND regexp_matches(text, '(?i)\\b(gate|door|lockbox|access|entry)( code| pin)?( is|:|#)? *#?[0-9]{{3,8}}\\b') AS coded
      FROM texts) t
LEFT JOIN (SELECT text_id, count(*) AS names, min(contact_name) AS first_name
      FROM (SELECT DISTINCT text_id, unnest(regexp_extract_all(' ' || {_NORMAL_TEXT} || ' ', 'contact [0-9]+ ')) AS said
            FROM texts WHERE contains(low, 'contact')) s
      JOIN contracts ON lower(contact_name) = trim(said) GROUP BY 1) n USING (text_id)
WHERE coded OR names > 0""",
}
_TEXTS = """,
texts AS MATERIALIZED (
  SELECT *, lower(text) AS low FROM (
    SELECT 'clear-' || clear_id AS text_id, notes AS text FROM clears WHERE notes IS NOT NULL
    UNION ALL SELECT 'document-' || doc_id, text FROM documents
    UNION ALL SELECT DISTINCT concat_ws('-', 'turn', conv_id, turn, role, md5(text)), text FROM conversations)
  WHERE text IS NOT NULL)
"""

_STREAMS = {
    "stream_punches_dedup": """
SELECT shift_id, punch_type, punched_at, verified AS gps_verified, metres AS distance_m FROM punches""",
    "stream_proofs_once": """
SELECT -clear_id AS submission_id, ext_event_id AS event_id, 'Lot' AS surface, 2 AS media_count
FROM clears WHERE status = 'planned' AND ext_event_id IS NOT NULL""",
    "stream_punch_match": f"""
SELECT shift_id, clear_id, punched_at, metres AS distance_m,
  CASE WHEN starts_at IS NULL THEN 'no window'
    WHEN date_diff('second', {ts('punched_at')}, starts_at) > 2700 THEN 'too early'
    WHEN date_diff('second', ends_at, {ts('punched_at')}) > 2700 THEN 'too late'
    WHEN metres > 150 THEN 'not at the site' ELSE 'accepted' END AS verdict
FROM (SELECT * FROM punches WHERE punch_type = 'in') p LEFT JOIN shift_windows USING (shift_id)""",
    "stream_sla_alerts": f"""
SELECT shift_id, clear_id, site_id, {iso('alert_at')} AS alert_at, {iso('deadline')} AS deadline_at
FROM watched w
WHERE NOT EXISTS (FROM {_IN} i WHERE i.shift_id = w.shift_id AND i.moment <= w.alert_at)""",
    "stream_sla_clears": f"""
SELECT shift_id, clear_id, site_id, {iso('moment')} AS in_at, CASE WHEN moment > deadline THEN 1 ELSE 0 END AS missed
FROM watched JOIN {_IN} i USING (shift_id) WHERE moment > alert_at""",
    "stream_shift_state": f"""
SELECT shift_id, 'scheduled' AS state, {iso('starts_at')} AS "at" FROM shift_windows
UNION ALL SELECT shift_id, CASE punch_type WHEN 'in' THEN 'checked_in' ELSE 'checked_out' END, {iso(ts('punched_at'))} FROM punches
UNION ALL SELECT shift_id, 'missed', {iso('ends_at + INTERVAL 45 MINUTE')} FROM shift_windows w
  WHERE NOT EXISTS (FROM {_IN} i WHERE i.shift_id = w.shift_id AND i.moment <= ends_at + INTERVAL 45 MINUTE)
UNION ALL SELECT shift_id, 'forgot_check_out', {iso('ends_at + INTERVAL 15 MINUTE')} FROM shift_windows w
  WHERE NOT EXISTS (FROM {_OUT} o WHERE o.shift_id = w.shift_id AND o.moment <= ends_at + INTERVAL 15 MINUTE)
    AND EXISTS (FROM {_IN} i WHERE i.shift_id = w.shift_id AND i.moment <= ends_at + INTERVAL 15 MINUTE)""",
    "stream_shift_events": f"""
SELECT shift_id, clear_id, 'scheduled' AS state, {iso('starts_at')} AS "at", {iso('deadline')} AS deadline_at, CAST(NULL AS INTEGER) AS missed
  FROM shift_windows LEFT JOIN (SELECT clear_id, deadline FROM watched) USING (clear_id)
UNION ALL SELECT shift_id, NULL, CASE punch_type WHEN 'in' THEN 'checked_in' ELSE 'checked_out' END, {iso(ts('punched_at'))}, NULL, NULL FROM punches
UNION ALL SELECT shift_id, clear_id, 'alert', {iso('alert_at')}, {iso('deadline')}, NULL FROM watched w
  WHERE NOT EXISTS (FROM {_IN} i WHERE i.shift_id = w.shift_id AND i.moment <= w.alert_at)
UNION ALL SELECT shift_id, clear_id, 'alert_ended', {iso('moment')}, {iso('deadline')}, CASE WHEN moment > deadline THEN 1 ELSE 0 END
  FROM watched JOIN {_IN} i USING (shift_id) WHERE moment > alert_at
UNION ALL SELECT shift_id, clear_id, 'missed', {iso('ends_at + INTERVAL 45 MINUTE')}, {iso('deadline')}, NULL
  FROM shift_windows w LEFT JOIN (SELECT clear_id, deadline FROM watched) USING (clear_id)
  WHERE NOT EXISTS (FROM {_IN} i WHERE i.shift_id = w.shift_id AND i.moment <= ends_at + INTERVAL 45 MINUTE)
UNION ALL SELECT shift_id, clear_id, 'forgot_check_out', {iso('ends_at + INTERVAL 15 MINUTE')}, {iso('deadline')}, NULL
  FROM shift_windows w LEFT JOIN (SELECT clear_id, deadline FROM watched) USING (clear_id)
  WHERE NOT EXISTS (FROM {_OUT} o WHERE o.shift_id = w.shift_id AND o.moment <= ends_at + INTERVAL 15 MINUTE)
    AND EXISTS (FROM {_IN} i WHERE i.shift_id = w.shift_id AND i.moment <= ends_at + INTERVAL 15 MINUTE)""",
    "stream_checkins_windowed": f"""
SELECT {iso('window_start')} AS window_start, {iso('window_start + INTERVAL 15 MINUTE')} AS window_end,
  count(*) AS checkins, count(*) FILTER (verified = 1) AS verified
FROM (SELECT time_bucket(INTERVAL 15 MINUTE, {ts('punched_at')}) AS window_start, verified FROM punches WHERE punch_type = 'in')
GROUP BY window_start""",
    "stream_checkins_late": f"""
SELECT 0 AS late, {iso('window_start')} AS window_start, {iso('window_start + INTERVAL 15 MINUTE')} AS window_end,
  count(*) AS checkins, count(*) FILTER (verified = 1) AS verified, CAST(NULL AS BIGINT) AS shift_id, CAST(NULL AS VARCHAR) AS punched_at
FROM (SELECT time_bucket(INTERVAL 15 MINUTE, {ts('punched_at')}) AS window_start, verified FROM punches
      WHERE punch_type = 'in' AND shift_id % 5 <> 0)
GROUP BY window_start
UNION ALL SELECT 1, {iso('window_start')}, {iso('window_start + INTERVAL 15 MINUTE')}, 1, CASE WHEN verified = 1 THEN 1 ELSE 0 END, shift_id, punched_at
FROM (SELECT *, time_bucket(INTERVAL 15 MINUTE, {ts('punched_at')}) AS window_start FROM punches WHERE punch_type = 'in' AND shift_id % 5 = 0)""",
    "feed_quarantine": """
SELECT reason, count(*) AS lines, count(*) FILTER (reason = 'accepted') AS punches
FROM (SELECT CASE WHEN shift_id % 7 = 0 OR (shift_id % 11 = 0 AND shift_id % 13 <> 0) THEN 'unreadable' WHEN shift_id % 13 = 0 THEN 'no shift'
        WHEN shift_id % 17 = 0 THEN 'unknown punch type' WHEN shift_id % 19 = 0 THEN 'no time' ELSE 'accepted' END AS reason FROM punches)
GROUP BY reason""",
    "stream_operator_sessions": f"""
SELECT worker_id, {iso('min(moment)')} AS session_start, {iso('max(moment) + INTERVAL 2 HOUR')} AS session_end, count(*) AS punches
FROM (SELECT *, sum(CASE WHEN moment <= before + INTERVAL 2 HOUR THEN 0 ELSE 1 END) OVER (
        PARTITION BY worker_id ORDER BY moment RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
      FROM (SELECT worker_id, {ts('punched_at')} AS moment,
              lag({ts('punched_at')}) OVER (PARTITION BY worker_id ORDER BY {ts('punched_at')}) AS before FROM punches))
GROUP BY worker_id, run""",
}


def _after_batches() -> str:
    """The prelude with clears as three batches leave them: walks skipped, sites of inactive contracts called off, HOAs
    invoiced."""
    start = PRELUDE.index("\nclears AS (") + 1
    before, rest = PRELUDE[:start], PRELUDE[start:]
    end = rest.index("raw_mileage AS (")
    changed = """clears AS (
  SELECT * EXCLUDE (surface_of, salt_of, active_of, type_of) REPLACE (
      CASE WHEN status = 'planned' AND surface_of = 'walk' THEN 'skipped' WHEN status = 'planned' AND active_of = 0 THEN 'cancelled'
        ELSE status END AS status,
      CASE WHEN status = 'planned' AND surface_of = 'walk' THEN coalesce(salt_of, 0) ELSE other_fee_cents END AS other_fee_cents,
      CASE WHEN type_of = 'hoa' AND invoiced = 0 AND NOT (status = 'planned' AND surface_of <> 'walk' AND active_of <> 0)
        THEN 1 ELSE invoiced END AS invoiced)
  FROM (SELECT c.*, si.surface AS surface_of, ct.salt_fee_cents AS salt_of, ct.is_active AS active_of, ct.contract_type AS type_of
        FROM clears_before c LEFT JOIN sites si USING (site_id) LEFT JOIN contracts ct ON ct.contract_id = si.contract_id)),
"""
    return before + rest[:end].replace("clears AS (", "clears_before AS (", 1) + changed + rest[end:]


def _view_counts() -> str:
    """Every view's checking SQL, at one instant, counted behind the filter that the query gives it."""
    from frostline.plans.catalogue import VIEW_FILTERS

    bodies = {**_BOARDS, **_BILLING, **_PAYOUTS, **_ACTIVITY}
    counts = []
    for name, asked in VIEW_FILTERS.items():
        body = bodies[name].replace("2001-08-01", "2001-07-20") if name in ("sla_at_risk", "invoices_outstanding", "operator_activity") else bodies[name]
        counts.append(f"SELECT '{name}' AS view, count(*) AS n FROM ({PRELUDE}\n{body.strip()}) WHERE {asked}")
    return "\nUNION ALL\n".join(counts)


def _clears_audit() -> str:
    """What the three outboxes ask for, all columns in a line, against the secrets of the clear's own site and contract."""
    asked = {"shifts": _DISPATCH["outbox_shifts"], "cancellations": _CHANGES["cancellation_requests"], "swapped_shifts": _CHANGES["swapped_shift_requests"]}
    parts = []
    for name, body in asked.items():
        columns = "clear_id, ext_shift_id, reason" if name == "cancellations" else 'clear_id, event_id, worker_id, "start", "end"'
        said = f"lower(concat_ws(' ', {', '.join('q.' + c.strip() for c in columns.split(','))}, q.idempotency_key))"
        parts.append(f"""SELECT '{name}' AS outbox, count(*) AS requests,
  CAST(sum(CASE WHEN contains({said}, nullif(lower(access_notes), '')) THEN 1 ELSE 0 END) AS BIGINT) AS leaks_access,
  CAST(sum(CASE WHEN contains({said}, nullif(lower(contact_name), '')) THEN 1 ELSE 0 END) AS BIGINT) AS leaks_contact
FROM ({body.strip()}) q JOIN clears c ON c.clear_id = q.clear_id JOIN full_sites f ON f.site_id = c.site_id HAVING count(*) > 0""")
    return f"{PRELUDE}\n" + "\nUNION ALL ".join(parts)


def oracle_sql() -> dict[str, str]:
    found = {"sql_views": _view_counts(), "outbox_clears_audit": _clears_audit()}
    found["sql_storm_board"] = f"""SELECT clear_id, scheduled_start, street_address, sla_deadline, operator_name, needs_shift
FROM ({PRELUDE}\n{_BOARDS['clears_planned'].strip()}) WHERE storm_id = 1 OR storm_ref LIKE 'ST-2001-%7'"""
    for name, like in (("receivables_maintained", _BILLING["receivables_by_contract"]), ("recap_maintained", _ACTIVITY["storm_recap"])):
        found[name] = f"{_after_batches()}\n{like.strip()}"
    for group in (_BOARDS, _BILLING, _PAYOUTS, _ACTIVITY, _DEFAULTS, _QUALITY, _DISPATCH, _CHANGES, _TEXT, _STREAMS):
        for name, body in group.items():
            prelude = PRELUDE
            if group is _STREAMS or name in _WITH_FEEDS:
                prelude += FEEDS
            if name == "sites_merged":
                prelude += _MEMBERS
            if name == "notes_leak_scan":
                prelude += _TEXTS
            found[name] = f"{prelude}\n{body.strip()}"
    return found
