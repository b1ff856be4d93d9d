"""Every query by name: (spark, sf_dir) -> DataFrame, in types that compare across engines."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, TimestampNTZType, TimestampType

from frostline.operators import (
    activity,
    billing,
    boards,
    defaults,
    marts,
    outbox,
    payouts,
    place_index,
    proofs,
    quality,
    same_lot,
    transitions,
)
from frostline.plans import commands as cmd
from frostline.plans.commands import AS_OF_A, AS_OF_B, AUDIT
from frostline.plans.projection import clears_of_claims, load_raw, written_claims
from frostline.plans.staging import spoiled
from frostline.plans.views import VIEWS, register_views
from frostline.plans.workspace import tables, versioned
from frostline.schemas import MILES, PUNCHES, RATE, SETTING_SEEDS
from frostline.sources import quarantine
from frostline.sources.outbox_ledger import Ledger, send_batch, sender
from frostline.sources.shared import shared_folder, written_once
from frostline.sources.tables import OpsTables
from frostline.sources.versions import Store, Version
from frostline.streaming import alerts, late, punches, shifts
from frostline.streaming.runner import as_stream, drain

Query = Callable[[SparkSession, str], DataFrame]


def comparable(df: DataFrame) -> DataFrame:
    """Query boundary: decimals as doubles, dates and instants as ISO text."""

    def shown(name: str, kind) -> Column:
        c = F.col(f"`{name}`")
        if isinstance(kind, DecimalType):
            return c.cast("double").alias(name)
        if isinstance(kind, DateType):
            return c.cast("string").alias(name)
        if isinstance(kind, (TimestampType, TimestampNTZType)):
            return F.substring(c.cast("string"), 1, 19).alias(name)
        return c

    return df.select(*[shown(f.name, f.dataType) for f in df.schema.fields])


def on_tables(plan: Callable[[OpsTables], DataFrame]) -> Query:
    return lambda spark, sf_dir: comparable(plan(tables(spark, sf_dir)))


def on_raw(plan: Callable[[OpsTables], DataFrame]) -> Query:
    return lambda spark, sf_dir: comparable(plan(load_raw(spark, sf_dir)))


def on_versions(batch: Callable[[OpsTables], DataFrame], shown: Callable[[DataFrame], DataFrame]) -> Query:
    """Apply a batch's changed clears to the store, on a branch of its own, and show the table of the new version."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        store, base, t = versioned(spark, sf_dir)
        after = store.apply(base, batch(t), branch=uuid.uuid4().hex)
        return comparable(shown(store.read(after).clears))

    return query


def clears_paid_out(store: Store, base: Version, t: OpsTables) -> DataFrame:
    """The clears once those that operators were paid for are marked in the store, on a branch of its own."""
    after = store.mark(base, payouts.paid_clears(t, payers(t)), lambda rows: payouts.set_paid_out(rows, AUDIT), branch=uuid.uuid4().hex)
    return _stamped(store.read(after).clears, "clear_id", "operator_id", "paid_out")


CLEAR_STATE = (
    "clear_id", "storm_id", "site_id", "operator_id", "scheduled_start", "duration_minutes", "status", "fee",
    "salt_fee", "other_fee", "ext_event_id", "ext_shift_id",
)


def _clear_state(df: DataFrame, *more: str) -> DataFrame:
    stamped = F.when(F.col("updated_at").isNotNull(), 1).otherwise(0).alias("touched")
    return df.select(*CLEAR_STATE, *more, stamped)


def _stamped(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.when(F.col("updated_at").isNotNull(), 1).otherwise(0).alias("touched"))


# -- defaults ---------------------------------------------------------------------------------------------------


def storms_numbered(raw: OpsTables) -> DataFrame:
    return defaults.number_storms(raw.storms).select("storm_id", "storm_ref", "storm_date", "status")


def storms_defaulted(raw: OpsTables) -> DataFrame:
    return defaults.fill_storm_defaults(raw.storms, raw.settings).select("storm_id", "sla_deadline")


def clears_defaulted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storms are written first: Spark then knows that they are few and moves no clear to meet them."""
    claims = written_claims(spark, sf_dir)
    raw = load_raw(spark, sf_dir, claims)
    storms = written_once(defaults.fill_storm_defaults(raw.storms, raw.settings), "storms")
    done = clears_of_claims(claims, raw.having(storms=storms))
    return done.select(*CLEAR_STATE, "storm_month", "notes")


def mileage_defaulted(raw: OpsTables) -> DataFrame:
    return defaults.fill_mileage(raw.mileage, raw.settings).select(
        "trip_id", "clear_id", "trip_date", "miles", "rate", "deduction"
    )


def mileage_recomputed(t: OpsTables) -> DataFrame:
    """After an edit: trips for a clear lose their rate, the others get two miles more."""
    linked = F.col("clear_id").isNotNull()
    edited = t.mileage.withColumns({
        "rate": F.when(~linked, F.col("rate")).cast(RATE),
        "miles": F.when(linked, F.col("miles")).otherwise(F.col("miles") + 2).cast(MILES),
    })
    return defaults.recompute_mileage(edited).select("trip_id", "miles", "rate", "deduction")


def invoices_numbered(raw: OpsTables) -> DataFrame:
    return defaults.number_invoices(raw.invoices, raw.settings).select(
        "invoice_id", "invoice_number", "invoice_date", "due_date", "total_amount"
    )


def payouts_priced(t: OpsTables) -> DataFrame:
    unpriced = t.payouts.withColumn("amount", F.when(F.col("amount") == F.lit("33.33").cast("decimal(12,2)"), F.col("amount")))
    return defaults.fill_payout_amount(unpriced, t.operators, billing.billable_facts(t.clears)).select(
        "payout_id", "operator_id", "clear_id", "amount", "paid"
    )


# -- transitions ------------------------------------------------------------------------------------------------


def opening(t: OpsTables) -> DataFrame:
    return t.storms.where(F.col("status") == "forecast")


def dq_gate(t: OpsTables) -> DataFrame:
    """The spoiled batch at the gate: rows of each table that may be written and rows that may not."""
    batch = spoiled(t)
    found = written_once(quality.dq_violations(batch), "violations")
    counts = []
    for table in quality.IDENTS:
        sides = zip((1, 0), quality.gate(batch, table, found))
        both = reduce(DataFrame.unionByName, [rows.select(F.lit(side).alias("side")) for side, rows in sides])
        counts.append(both.agg(F.count_if(F.col("side") == 1).alias("accepted"), F.count_if(F.col("side") == 0).alias("rejected")).select(
            F.lit(table).alias("table"), "accepted", "rejected"
        ))
    return reduce(DataFrame.unionByName, counts)


def busiest_storm(t: OpsTables) -> DataFrame:
    """The storm with the most planned clears (the lowest id of several) and its month."""
    counts = t.clears.where(F.col("status") == "planned").groupBy("storm_id", "storm_month").agg(F.count("*").alias("n"))
    best = counts.agg(F.max_by(F.struct("storm_id", "storm_month"), F.struct("n", -F.col("storm_id"))).alias("s"))
    return best.select("s.storm_id", "s.storm_month")


def storm_batch_months(store: Store, base: Version, t: OpsTables) -> DataFrame:
    """One storm's planned clears are called off: the months of the new version, their rows, and which were rewritten."""
    commands = t.clears.where(F.col("status") == "planned").join(busiest_storm(t), ["storm_id", "storm_month"], "left_semi")
    batch = transitions.cancel(t, commands.select("clear_id", "storm_month"), AUDIT, delta=True)
    after = store.apply(base, batch, branch=uuid.uuid4().hex)
    moved = [month or "" for month in after.months() if after.held["clears", month] != base.held.get(("clears", month))]
    return store.read(after).clears.groupBy("storm_month").agg(
        F.count("*").alias("clears"), F.sum(F.when(F.col("status") == "cancelled", 1).otherwise(0)).alias("cancelled")
    ).withColumn("rewritten", F.when(F.coalesce("storm_month", F.lit("")).isin(*moved), 1).otherwise(0))


def marts_after_batches(store: Store, base: Version, t: OpsTables) -> tuple[marts.Marts, OpsTables]:
    """The marts, written, carried along by three batches: walks are skipped, sites of inactive contracts called off, HOAs
    invoiced."""
    def kept(now: marts.Marts) -> marts.Marts:
        return marts.Marts(written_once(now.work, "mart-work"), written_once(now.slots, "mart-slots"))

    hoas = t.contracts.where(F.col("contract_type") == "hoa")
    batches = (
        lambda now: transitions.skip(now, cmd.skip_walks(now), AUDIT, delta=True),
        lambda now: transitions.cancel(now, cmd.withdraw_inactive(now), AUDIT, delta=True),
        lambda now: billing.mark_invoiced(now, AUDIT, hoas, delta=True),
    )
    version, now, held = base, t, kept(marts.build(t))
    line = uuid.uuid4().hex
    for batch in batches:
        version = store.apply(version, batch(now), branch=line, log=True)
        now = store.read(version)
        held = kept(marts.maintain(held, now.sites, store.logged(version)))
    return held, now


def clears_with_results(t: OpsTables) -> DataFrame:
    done = transitions.apply_results(t, cmd.punch_feed(t), cmd.proof_feed(t), AUDIT)
    return _clear_state(
        done, "surface", "condition", "salt_applied", "photo_count", "report_id", "checked_in_at", "checked_out_at",
        "gps_verified", "checkin_distance_m",
    )


def delete_plan(t: OpsTables) -> DataFrame:
    """Cancelled storms, inactive operators, inactive contracts and inactive sites are to be deleted."""
    return transitions.delete_plan(
        t,
        storms=t.storms.where(F.col("status") == "cancelled"),
        contracts=t.contracts.where(F.col("is_active") == 0),
        operators=t.operators.where(F.col("is_active") == 0),
        sites=t.sites.where(F.col("is_active") == 0),
    )


def settings_upserted(t: OpsTables) -> DataFrame:
    pairs = [F.struct(F.lit(k).alias("key"), F.lit(v).cast("string").alias("value")) for k, v in SETTING_SEEDS.items()]
    seeds = t.spark.range(1).select(F.explode(F.array(*pairs)).alias("s")).select("s.*")
    return transitions.upsert_settings(t.settings, seeds, cmd.chosen_settings(t))


def dimension_appends(t: OpsTables) -> DataFrame:
    return transitions.append_sites(t, cmd.site_entries(t)).select(
        "site_id", "contract_id", "normalized_address", "surface", "is_active", "verdict"
    )


def sites_merged(t: OpsTables) -> DataFrame:
    """Sites of one contract on the same street count as one lot."""
    lot = F.concat(F.col("contract_id").cast("string"), F.lit("|"), F.lower("street_name"))
    return transitions.merge_sites(t, lot)


def address_book(t: OpsTables) -> DataFrame:
    """Every site with a street type and a suite, spelled again in two ways, and with neighbours that are other lots."""
    n = F.col("site_id")
    house, street = F.substring_index("address", " ", 1), F.substring_index("address", " ", -2)
    suite = (n % 7 + 1).cast("string")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("Avenue", "Street", "Road", "Drive")]), (n % 4 + 1).cast("int"))
    short = F.element_at(F.array(*[F.lit(k) for k in ("Ave.", "ST", "Rd", "dr.")]), (n % 4 + 1).cast("int"))
    typo = F.concat(F.substring(street, 1, 3), F.expr("substring(substring_index(address, ' ', -2), 5)"))
    zipped = F.when(F.col("zip").isNull() & F.col("city").isNull(), F.lit("55001")).otherwise(F.col("zip"))

    def rows(shift: int, address: Column, city: Column = F.col("city"), zip_: Column = zipped) -> DataFrame:
        return t.sites.select((n + shift * 1_000_000_000).alias("site_id"), address.alias("address"), city.alias("city"), "state", zip_.alias("zip"))

    spelled = F.concat_ws(" ", house, street, kind, F.lit("Ste"), suite)
    made = [
        rows(0, spelled), rows(1, F.concat_ws(" ", F.concat(F.lit("#"), suite), house, F.upper(street), short), F.lit(None).cast("string")),
        rows(2, F.concat(house, F.lit(" "), typo, F.lit(" "), short, F.lit(", Unit "), suite)), rows(3, spelled),
        rows(4, F.concat_ws(" ", (house.cast("long") + 2).cast("string"), street, kind, F.lit("Ste"), suite)),
        rows(5, F.concat_ws(" ", house, street, kind, F.lit("Ste"), (n % 7 + 2).cast("string"))), rows(6, F.concat_ws(" ", house, street, kind)),
    ]
    return reduce(DataFrame.unionByName, made)


def lots_linked(t: OpsTables) -> DataFrame:
    return same_lot.lots(address_book(t)).where("site_id <> lot")


def places_said(t: OpsTables) -> DataFrame:
    """A request from every site: six letters of its address; from every thousandth two letters, and one nobody knows."""
    n = F.col("site_id")
    said = F.when(n % 1000 == 1, F.substring("street_name", 1, 2)).when(n % 1000 == 2, F.lit("qzx")).otherwise(F.upper(F.substring("address", 2, 6)))
    return t.sites.select(n.alias("request_id"), said.alias("said"))


#: What is asked of each view in ``sql_views``: a filter, if its columns allow one.
VIEW_FILTERS = dict.fromkeys(("billable_clears", "clears_planned", "clears_today", "clears_upcoming", "sla_at_risk", "storms_open"), "storm_id % 3 = 1")
VIEW_FILTERS |= dict.fromkeys(("receivables_by_contract", "invoices_outstanding"), "contract_type = 'hoa'")
VIEW_FILTERS |= dict.fromkeys(("payouts_due", "payouts_missing", "operator_activity"), "operator_id % 2 = 0")
VIEW_FILTERS |= {"sites_uncleared": "storm_id % 3 = 1 AND site_id % 5 = 0", "needs_location": "contract_id % 2 = 0", "mileage_by_month": "trips > 1"}


def sql_views(t: OpsTables) -> DataFrame:
    """Rows that SQL finds in every view behind a filter."""
    prefix = f"v{uuid.uuid4().hex}_"
    register_views(t, AS_OF_B, prefix)
    counts = [f"SELECT '{name}' AS view, count(*) AS n FROM {prefix}{name} WHERE {VIEW_FILTERS[name]}" for name in VIEWS]
    return t.spark.sql(" UNION ALL ".join(counts))


def sql_storm_board(t: OpsTables) -> DataFrame:
    """The planned board of one storm by SQL, in its order."""
    prefix = f"v{uuid.uuid4().hex}_"
    register_views(t, AS_OF_B, prefix)
    return t.spark.sql(f"""
        SELECT clear_id, scheduled_start, street_address, sla_deadline, operator_name, needs_shift
        FROM {prefix}clears_planned WHERE storm_id = 1 OR storm_ref LIKE 'ST-2001-%7' ORDER BY scheduled_start, clear_id""")


def new_operators(t: OpsTables) -> DataFrame:
    """Every operator as if just hired: an address, no worker id; colleagues of one first name share an address."""
    address = F.concat(F.lit("crew"), F.substring("operator_name", -1, 1), F.lit("@example.com"))
    return t.operators.withColumns({"email": address, "ext_worker_id": F.lit(None).cast("long")})


def payers(t: OpsTables) -> DataFrame:
    """Operators that are settled: everyone paid per clear."""
    return t.operators.where(F.col("payout_type") == "per_clear").select("operator_id")


# -- text -------------------------------------------------------------------------------------------------------


def all_notes(t: OpsTables, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free text from every place it is kept, under one unique text id."""

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    texts = [
        t.clears.where(F.col("notes").isNotNull()).select(F.concat(F.lit("clear-"), "clear_id").alias("text_id"), F.col("notes").alias("text")),
        read("documents").select(F.concat(F.lit("document-"), "doc_id").alias("text_id"), "text"),
        # Two texts of one turn stay two texts: the role and a digest of the text are part of the id.
        read("conversations").select(
            F.concat_ws("-", F.lit("turn"), "conv_id", "turn", "role", F.md5(F.col("text").cast("binary"))).alias("text_id"), "text"
        ).distinct(),
    ]
    return reduce(DataFrame.unionByName, texts)


def notes_leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return proofs.notes_leak_scan(all_notes(t, spark, sf_dir), "text_id", "text", t.contracts, "contact_name")


def proof_option_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option labels made of a part's brand, type and size."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    label = F.concat("p_brand", F.lit(" / "), "p_type", F.lit(" ("), F.col("p_size").cast("string"), F.lit("-inch, after photo)"))
    return proofs.option_keys(part.select(label.alias("option")), "option")


# -- streams ----------------------------------------------------------------------------------------------------


def repeated(feed: DataFrame, again: Column) -> DataFrame:
    """The feed with some rows sent twice."""
    return feed.unionByName(feed.where(again))


def stream_punches_dedup(t: OpsTables) -> DataFrame:
    feed = repeated(cmd.punch_feed(t), F.col("gps_verified") == 0)
    return drain(punches.punches_once(as_stream(feed, "punches")), "punches").select(
        "shift_id", "punch_type", "punched_at", "gps_verified", "distance_m"
    )


def stream_proofs_once(t: OpsTables) -> DataFrame:
    feed = repeated(cmd.proof_feed(t), F.size("media") > 1)
    return drain(punches.proofs_once(as_stream(feed, "proofs"), t), "proofs").select(
        "submission_id", "event_id", F.col("data.surface").alias("surface"), F.size("media").alias("media_count")
    )


def stream_punch_match(t: OpsTables) -> DataFrame:
    matched = punches.match_punches(as_stream(cmd.punch_feed(t), "punches"), punches.shift_windows(t))
    return drain(matched, "match")


def shift_blocks(t: OpsTables) -> int:
    """Blocks for the shifts of all clears; only their number reaches the driver."""
    return shifts.blocks_for(t.clears.where(F.col("ext_shift_id").isNotNull()).count())


def stream_sla_alerts(t: OpsTables) -> DataFrame:
    watched, ticks = as_stream(alerts.watch_list(t), "watch"), as_stream(cmd.closing_tick(t), "ticks")
    return drain(alerts.sla_alerts(watched, as_stream(cmd.punch_feed(t), "punches"), ticks=ticks, blocks=shift_blocks(t)), "alerts", rocksdb=True)


def stream_sla_clears(t: OpsTables) -> DataFrame:
    watched = as_stream(alerts.watch_list(t), "watch")
    return drain(alerts.sla_clears(watched, as_stream(cmd.punch_feed(t), "punches"), blocks=shift_blocks(t)), "clears", rocksdb=True)


def stream_shift_state(t: OpsTables) -> DataFrame:
    windows, ticks = as_stream(punches.shift_windows(t), "windows"), as_stream(cmd.closing_tick(t), "ticks")
    return drain(alerts.shift_states(windows, as_stream(cmd.punch_feed(t), "punches"), ticks=ticks, blocks=shift_blocks(t)), "states", rocksdb=True)


def stream_shift_events(t: OpsTables) -> DataFrame:
    """States, alerts and their ends in one pass."""
    windows, ticks = as_stream(alerts.watched_windows(t), "windows"), as_stream(cmd.closing_tick(t), "ticks")
    told = drain(shifts.follow(windows, as_stream(cmd.punch_feed(t), "punches"), ticks, blocks=shift_blocks(t)), "shifts", rocksdb=True)
    return told.select("shift_id", "clear_id", "state", "at", "deadline_at", "missed")


def stream_checkins_windowed(t: OpsTables) -> DataFrame:
    feed, ticks = as_stream(cmd.punch_feed(t), "punches"), as_stream(cmd.closing_tick(t), "ticks")
    return drain(punches.checkins_per_window(feed, ticks=ticks), "checkins")


def stream_checkins_late(t: OpsTables) -> DataFrame:
    """A fifth of the phones deliver their punches only when the clock is long past them."""
    feed, spark = cmd.punch_feed(t), t.spark
    slow = F.pmod(F.col("shift_id"), F.lit(5)) == 0
    path, ticks = shared_folder(spark, "feed-late"), as_stream(cmd.closing_tick(t), "ticks")
    checkpoint, sink = shared_folder(spark, "checkpoint-late"), shared_folder(spark, "sink-late")
    for part in (~slow, slow):
        feed.where(part).write.mode("append").parquet(path)
        punched = spark.readStream.schema(feed.schema).parquet(path)
        told = drain(late.checkins_with_late(punched, ticks=ticks), "late", checkpoint, sink, rocksdb=True)
    return told.select(F.col("late").cast("int").alias("late"), "window_start", "window_end", "checkins", "verified", "shift_id", "punched_at")


def damaged_lines(t: OpsTables) -> DataFrame:
    """The punch feed as JSON lines, some of them spoiled: cut off, a shift in letters, none, a break, a vague time."""
    n = F.col("shift_id")
    text = F.to_json(F.struct(
        F.when(n % 13 == 0, F.lit(None)).otherwise(n).alias("shift_id"), "worker_id", "event_id",
        F.when(n % 17 == 0, "break").otherwise(F.col("punch_type")).alias("punch_type"),
        F.when(n % 19 == 0, "soon").otherwise(F.col("punched_at")).alias("punched_at"), "gps_verified", "distance_m",
    ))
    cut = F.when(n % 7 == 0, F.substring(text, 1, 20)).when(n % 11 == 0, F.replace(text, F.lit('"shift_id":'), F.lit('"shift_id":"no","was":')))
    return cmd.punch_feed(t).select(F.coalesce(cut, text).alias("value"))


def feed_quarantine(t: OpsTables) -> DataFrame:
    """Damaged lines through the splitter, in two runs: how many were accepted and rejected, and why."""
    spark, path = t.spark, shared_folder(spark=t.spark, purpose="lines")
    good, bad, checkpoint = (shared_folder(spark, p) for p in ("good", "bad", "checkpoint-lines"))
    for part in (0, 1):
        damaged_lines(t).where(F.pmod(F.xxhash64("value"), F.lit(2)) == part).write.mode("append").text(path)
        quarantine.split_stream(quarantine.judge_punches(quarantine.read_lines(spark, path, True)), PUNCHES, good, bad, checkpoint)
    taken = spark.read.schema(PUNCHES).parquet(good).select(F.lit("accepted").alias("reason"), "shift_id", "punch_type")
    refused = spark.read.schema("line string, reason string").parquet(bad).select("reason", *[F.lit(None).cast(k).alias(c) for c, k in (("shift_id", "long"), ("punch_type", "string"))])
    return taken.unionByName(refused).groupBy("reason").agg(F.count("*").alias("lines"), F.countDistinct("shift_id", "punch_type").alias("punches"))


def requests(t: OpsTables, as_of: datetime) -> dict[str, DataFrame]:
    """Requests of three outboxes in one form: key, kind, body."""
    made = {"location": outbox.outbox_locations(t, as_of), "event": outbox.outbox_events(t, as_of), "shift": outbox.outbox_shifts(t, as_of)}
    return {
        kind: rows.select("idempotency_key", F.lit(kind).alias("kind"), F.to_json(F.struct(*[c for c in rows.columns if c != "idempotency_key"])).alias("body"))
        for kind, rows in made.items()
    }


def outbox_ledger(t: OpsTables) -> DataFrame:
    """Two runs and a stream ask for the same things, the stream twice, and its first batch is replayed."""
    spark, made = t.spark, requests(t, AS_OF_B)
    made["everything"] = reduce(DataFrame.unionByName, [*made.values(), *made.values()])
    ledger = Ledger(spark, shared_folder(spark, "ledger"), made["event"].schema)
    out, checkpoint = shared_folder(spark, "requests"), shared_folder(spark, "checkpoint-requests")
    send_batch(ledger, made["location"].unionByName(made["shift"]), "morning", out)
    feed = as_stream(made["everything"], "requests")
    send = sender(ledger, out, "stream")
    feed.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    send(made["everything"], 0)
    send_batch(ledger, made["shift"], "evening", out)
    sent = spark.read.schema("idempotency_key string, kind string").json(out).groupBy("idempotency_key").agg(F.count("*").alias("sent"))
    return ledger.claims().join(sent, "idempotency_key", "left").select("idempotency_key", "kind", "claim", "sent")


def stream_operator_sessions(t: OpsTables) -> DataFrame:
    feed, ticks = as_stream(cmd.punch_feed(t), "punches"), as_stream(cmd.closing_tick(t), "ticks")
    return drain(punches.operator_sessions(feed, ticks=ticks), "sessions")


def queries() -> dict[str, Query]:
    a, b = AS_OF_A, AS_OF_B
    plain: dict[str, Callable[[OpsTables], DataFrame]] = {
        # billing
        "billable_clears": billing.billable_clears,
        "receivables_by_contract": billing.receivables_by_contract,
        "invoice_run": lambda t: billing.invoice_run(t, a),
        "invoice_lines": lambda t: billing.invoice_lines(t, a),
        "invoice_line_items": lambda t: billing.as_json(billing.invoice_line_items(t, a)),
        "invoices_with_items": lambda t: billing.invoices_with_items(t, a),
        "invoice_documents": lambda t: billing.invoice_documents(t, a),
        "invoices_outstanding": lambda t: billing.invoices_outstanding(t, a),
        "aging_summary": lambda t: billing.aging_summary(t, a),
        "invoices_marked": lambda t: billing.mark_invoices(t.invoices, cmd.money_in(t, a)).select(
            "invoice_id", "invoice_number", "paid", "paid_date", "sent_date"
        ),
        # boards
        "clears_planned": lambda t: boards.clears_planned(t, b),
        "clears_today": lambda t: boards.clears_today(t, b),
        "clears_upcoming": lambda t: boards.clears_upcoming(t, b),
        "sites_uncleared": boards.sites_uncleared,
        "sla_at_risk": lambda t: boards.sla_at_risk(t, a),
        "storms_open": boards.storms_open,
        "needs_location": boards.needs_location,
        # payouts
        "payouts_due": payouts.payouts_due,
        "payouts_missing": payouts.payouts_missing,
        "payouts_priced": payouts_priced,
        "payout_run": lambda t: payouts.payout_run(t).select("payout_id", "operator_id", "clear_id", "amount", "paid"),
        "payouts_settled": lambda t: payouts.settle_payouts(t, payers(t), a).select(
            "payout_id", "operator_id", "clear_id", "amount", "paid", "paid_date"
        ),
        "payouts_amounts_set": lambda t: payouts.set_amounts(t, cmd.agreed_amounts(t)).select(
            "payout_id", "operator_id", "clear_id", "amount", "paid"
        ),
        "payout_totals": payouts.payout_totals,
        "payout_statements": payouts.payout_statements,
        # activity
        "operator_activity": lambda t: activity.operator_activity(t, a),
        "mileage_by_month": activity.mileage_by_month,
        "sla_outcome": activity.sla_outcome,
        "sla_outcome_by_contract": lambda t: activity.sla_outcome_by(t, "contract_id", "contract_name"),
        "visit_evidence": activity.visit_evidence,
        "operator_hours": activity.operator_hours,
        "punch_rows": activity.punch_rows,
        "storm_cost": activity.storm_cost,
        "storm_recap": activity.storm_recap,
        # defaults on complete tables
        "mileage_recomputed": mileage_recomputed,
        # quality
        "dq_violations": quality.dq_violations,
        "dq_staged_violations": lambda t: quality.dq_violations(spoiled(t)),
        "dq_violation_counts": quality.dq_violation_counts,
        "dq_gate": dq_gate,
        "delete_plan": delete_plan,
        # dispatch
        "storm_open_clears": lambda t: transitions.open_storm(t, opening(t)).select(*CLEAR_STATE),
        "outbox_locations": lambda t: outbox.outbox_locations(t, b),
        "outbox_events": lambda t: outbox.outbox_events(t, b),
        "outbox_form_assign": lambda t: outbox.outbox_form_assign(t, cmd.event_answers(t, b)),
        "outbox_shifts": lambda t: outbox.outbox_shifts(t, b),
        "outbox_privacy_audit": lambda t: outbox.outbox_privacy_audit(t, b),
        "outbox_clears_audit": lambda t: outbox.audit_of_clears(t, {
            "shifts": outbox.outbox_shifts(t, b), "cancellations": transitions.cancellations(t, cmd.withdraw_inactive(t)),
            "swapped_shifts": outbox.outbox_swapped_shifts(
                t.having(clears=transitions.swap_operator(t, cmd.hand_over(t), AUDIT)), b, cmd.hand_over(t)
            ),
        }),
        "locations_pinned": lambda t: _stamped(
            transitions.pin_locations(t, cmd.location_answers(t, b), AUDIT), "site_id", "ext_location_id"
        ),
        # ad hoc
        "adhoc_candidates": lambda t: transitions.adhoc_candidates(t, "%RING%"),
        "adhoc_batch": lambda t: place_index.candidates(t, places_said(t)),
        "adhoc_inserts": lambda t: transitions.adhoc_inserts(t, cmd.here_now(t, b)).select(*CLEAR_STATE, "is_adhoc"),
        "adhoc_verdicts": lambda t: transitions.adhoc_verdicts(t, cmd.here_now(t, b)),
        # changes to clears
        "clears_with_results": clears_with_results,
        "clears_moved_day": lambda t: _clear_state(transitions.move_day(t, cmd.move_mix(t), AUDIT)),
        "cancellation_requests": lambda t: transitions.cancellations(t, cmd.withdraw_inactive(t)),
        "swapped_shift_requests": lambda t: outbox.outbox_swapped_shifts(
            t.having(clears=transitions.swap_operator(t, cmd.hand_over(t), AUDIT)), b, cmd.hand_over(t)
        ),
        "storms_closed": lambda t: _stamped(transitions.close_storms(t, AUDIT), "storm_id", "storm_ref", "status"),
        # dimensions
        "terms_changed": lambda t: _stamped(
            transitions.change_terms(t.contracts, cmd.raise_hoa_fees(t), AUDIT),
            "contract_id", "contract_type", "per_clear_fee", "salt_fee", "sla_deadline",
        ),
        "deactivated": lambda t: _stamped(
            transitions.deactivate(t.sites, t.sites.where(F.col("surface") == "mixed").select("site_id"), "site_id", AUDIT),
            "site_id", "surface", "is_active",
        ),
        "operators_retired": lambda t: _stamped(
            transitions.deactivate(t.operators, t.operators.where(F.col("payout_type") == "percent").select("operator_id"), "operator_id", AUDIT),
            "operator_id", "payout_type", "is_active",
        ),
        "settings_upserted": settings_upserted,
        "dimension_appends": dimension_appends,
        "contract_appends": lambda t: transitions.append_unique(
            t.contracts, cmd.contract_entries(t), "billing_email", "contract_id"
        ).select("contract_id", "contract_type", "billing_email", "verdict"),
        "worker_invitations": lambda t: outbox.outbox_workers(new_operators(t)),
        "mileage_append": lambda t: transitions.append_trips(t, cmd.trips_to_log(t, a)).select(
            "trip_id", "clear_id", "trip_date", "miles", "to_label", "rate", "deduction"
        ),
        "address_book_normalized": lambda t: transitions.look_up_addresses(t, cmd.typed_addresses(t)),
        "sites_merged": sites_merged,
        "lots_linked": lots_linked,
        # SQL
        "sql_views": sql_views,
        "sql_storm_board": sql_storm_board,
        # proofs
        "proof_validation": lambda t: proofs.proof_validation(cmd.proof_feed(t)),
        # streams
        "stream_punches_dedup": stream_punches_dedup,
        "stream_proofs_once": stream_proofs_once,
        "stream_punch_match": stream_punch_match,
        "stream_sla_alerts": stream_sla_alerts,
        "stream_sla_clears": stream_sla_clears,
        "stream_shift_state": stream_shift_state,
        "stream_shift_events": stream_shift_events,
        "stream_checkins_windowed": stream_checkins_windowed,
        "stream_checkins_late": stream_checkins_late,
        "feed_quarantine": feed_quarantine,
        "outbox_ledger": outbox_ledger,
        "stream_operator_sessions": stream_operator_sessions,
    }
    raw: dict[str, Callable[[OpsTables], DataFrame]] = {
        "storms_numbered": storms_numbered,
        "storms_defaulted": storms_defaulted,
        "mileage_defaulted": mileage_defaulted,
        "invoices_numbered": invoices_numbered,
    }
    def columns(*names: str) -> Callable[[DataFrame], DataFrame]:
        return lambda clears: _stamped(clears, *names)

    # Batches that change clears: the months they touch are rewritten, the others stay where they are.
    batches: dict[str, tuple[Callable[[OpsTables], DataFrame], Callable[[DataFrame], DataFrame]]] = {
        "clears_invoiced": (lambda t: billing.mark_invoiced(t, AUDIT, delta=True), columns("clear_id", "status", "invoiced")),
        "events_recorded": (
            lambda t: transitions.record_events(t, cmd.event_answers(t, b), AUDIT, delta=True), columns("clear_id", "status", "ext_event_id")
        ),
        "shifts_recorded": (
            lambda t: transitions.record_shifts(t, cmd.shift_answers(t, b), AUDIT, delta=True), columns("clear_id", "status", "ext_shift_id")
        ),
        "clears_rescheduled": (lambda t: transitions.reschedule(t, cmd.delay_ice(t), AUDIT, delta=True), _clear_state),
        "clears_cancelled": (lambda t: transitions.cancel(t, cmd.withdraw_inactive(t), AUDIT, delta=True), _clear_state),
        "clears_skipped": (lambda t: transitions.skip(t, cmd.skip_walks(t), AUDIT, delta=True), _clear_state),
        "operator_swaps": (lambda t: transitions.swap_operator(t, cmd.hand_over(t), AUDIT, delta=True), _clear_state),
    }
    found: dict[str, Query] = {name: on_tables(plan) for name, plan in plain.items()}
    found.update({name: on_versions(*batch) for name, batch in batches.items()})
    for name, report in (("receivables_maintained", marts.receivables), ("recap_maintained", marts.recap)):
        found[name] = lambda spark, sf_dir, report=report: comparable(report(*marts_after_batches(*versioned(spark, sf_dir))))
    found["clears_paid_out"] = lambda spark, sf_dir: comparable(clears_paid_out(*versioned(spark, sf_dir)))
    found["storm_batch_months"] = lambda spark, sf_dir: comparable(storm_batch_months(*versioned(spark, sf_dir)))
    found.update({name: on_raw(plan) for name, plan in raw.items()})
    found["clears_defaulted"] = lambda spark, sf_dir: comparable(clears_defaulted(spark, sf_dir))
    found["notes_leak_scan"] = lambda spark, sf_dir: comparable(notes_leak_scan(spark, sf_dir))
    found["proof_option_keys"] = lambda spark, sf_dir: comparable(proof_option_keys(spark, sf_dir))
    return found
