"""Files that leave the system."""

from __future__ import annotations

import json
from pathlib import Path

from frostline.schemas import PUNCHES
from frostline.sources import quarantine
from frostline.sources.outbox_ledger import Ledger, send_batch, sender
from frostline.sources.shared import shared_folder
from frostline.sources.sinks import write_documents, write_outbox, write_text


def lines(folder):
    return [line for part in sorted(Path(folder).glob("part-*")) for line in part.read_text().splitlines()]


def test_outbox_writes_a_key_once(spark):
    path = shared_folder(spark, "outbox")
    write_outbox(spark.createDataFrame([("k1", 1), ("k1", 1), ("k2", 2)], "idempotency_key string, n int"), path)
    assert sorted(json.loads(x)["idempotency_key"] for x in lines(path)) == ["k1", "k2"]


def test_documents(spark):
    docs = spark.createDataFrame([("INV-2026-0001", 0, "Invoice\nTotal due: $1.00")], "invoice_number string, part int, document string")
    path = shared_folder(spark, "documents")
    write_documents(docs, path, "invoice_number")
    assert json.loads(lines(path)[0]) == {"invoice_number": "INV-2026-0001", "part": 0, "document": "Invoice\nTotal due: $1.00"}
    path = shared_folder(spark, "text")
    write_text(docs, path)
    assert lines(path) == ["Invoice", "Total due: $1.00"]


def numbered(spark, *pairs):
    return spark.createDataFrame(list(pairs), "idempotency_key string, n int")


def test_a_key_goes_out_once_over_runs(spark):
    """Two runs, a stream and a replayed micro-batch ask for overlapping keys."""
    path, out = shared_folder(spark, "ledger"), shared_folder(spark, "sent")
    first = numbered(spark, ("a", 1), ("a", 2), ("b", 1), (None, 3))
    ledger = Ledger(spark, path, first.schema)
    assert sorted(tuple(r) for r in send_batch(ledger, first, "one", out).collect()) == [("a", 1), ("b", 1)]
    send_batch(ledger, numbered(spark, ("b", 9), ("c", 1)), "two", out)
    feed, checkpoint = shared_folder(spark, "asked"), shared_folder(spark, "checkpoint")
    send = sender(ledger, out, "stream")
    for rows in ([("c", 5), ("d", 1)], [("d", 2), ("e", 1)]):
        numbered(spark, *rows).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(first.schema).parquet(feed).writeStream.foreachBatch(send)
        stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    send(numbered(spark, ("c", 5), ("d", 1), ("z", 1)), 0)  # the first micro-batch again, grown on the way
    found = sorted((r.idempotency_key, r.n, r.claim) for r in ledger.claims().collect())
    assert found == [("a", 1, "one"), ("b", 1, "one"), ("c", 1, "two"), ("d", 1, "stream-0"), ("e", 1, "stream-1")]
    keys = [json.loads(x)["idempotency_key"] for part in Path(out).iterdir() for x in lines(part)]
    assert sorted(keys) == ["a", "b", "c", "d", "e"]


def test_a_claim_that_broke_off_is_made_again(spark):
    """Files without the mark of a finished write do not count as claimed."""
    path, out = shared_folder(spark, "broken"), shared_folder(spark, "sent")
    first = numbered(spark, ("a", 1))
    ledger = Ledger(spark, path, first.schema)
    send_batch(ledger, first, "one", out)
    (Path(path) / "claim=one" / "_SUCCESS").unlink()
    send_batch(ledger, numbered(spark, ("a", 1), ("b", 1)), "one", out)
    assert sorted(r.idempotency_key for r in ledger.claims().collect()) == ["a", "b"]


def test_lines_that_cannot_be_used_are_kept_apart(spark, tmp_path):
    """Accepted and rejected are all lines; a second run takes up the new ones only."""
    good_line = '{"shift_id": %d, "punch_type": "in", "punched_at": "2026-02-03T05:06:07-06:00"}'
    first = [good_line % 1, "", '{"shift_id": 2, "punch_', '{"shift_id": "two", "punch_type": "in", "punched_at": "2026-02-03T05:06:07"}', "[]", "null"]
    second = [good_line % 3, '{"punch_type": "in", "punched_at": "2026-02-03T05:06:07"}', '{"shift_id": 4, "punch_type": "nap", "punched_at": "2026-02-03T05:06:07"}',
              '{"shift_id": 5, "punch_type": "out", "punched_at": "at noon"}', '{"shift_id": 6, "punch_type": "out"}']
    inbox = tmp_path / "in"
    inbox.mkdir()
    good, bad, checkpoint = (shared_folder(spark, p) for p in ("good", "bad", "checkpoint"))
    for name, said in (("a", first), ("b", second)):
        (inbox / f"{name}.json").write_text("\n".join(said) + "\n")
        quarantine.split_stream(quarantine.judge_punches(quarantine.read_lines(spark, str(inbox), True)), PUNCHES, good, bad, checkpoint)
    taken = sorted(r.shift_id for r in spark.read.parquet(good).collect())
    refused = sorted((r.reason, r.line) for r in spark.read.parquet(bad).collect())
    assert taken == [1, 3]
    assert [reason for reason, _ in refused] == ["no shift", "no time", "no time", "unknown punch type"] + ["unreadable"] * 4
    assert len(taken) + len(refused) == len([x for x in first + second if x])
    batch = quarantine.judge_punches(quarantine.read_lines(spark, str(inbox)))
    assert sorted((r.reason, r.line) for r in quarantine.rejected(batch).collect()) == refused
    assert quarantine.accepted(batch, PUNCHES).count() == 2


def test_proof_lines(spark, tmp_path):
    said = ['{"submission_id": 5, "event_id": 7, "submitted_at": "2026-02-03 05:06:07", "data": {"surface": "lot"}, "media": []}',
            '{"submission_id": 5, "submitted_at": "2026-02-03 05:06:07"}', '{"submission_id": 5, "event_id": 7, "data": 3}']
    (tmp_path / "a.json").write_text("\n".join(said))
    judged = quarantine.judge_proofs(quarantine.read_lines(spark, str(tmp_path)))
    assert sorted(str(r.reason) for r in judged.collect()) == ["None", "no event", "unreadable"]
