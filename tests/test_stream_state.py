"""Keyed stream state: equal to the batch after a restart from the checkpoint; timers; repeats; nothing kept for good."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from archweave.derive import facts
from archweave.operators import events as ev
from archweave.streaming import state

SF = "/root/testdata/sf0.001"
START = dt.datetime(2026, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def run(spark, folder, parts, schema, build, keys):
    """Each part is a batch of a run of its own: the stream is stopped and started again from its checkpoint. All rows told, by run."""
    told = []
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        state.write_latest(build(stream), f"{folder}/out", f"{folder}/ck").trigger(availableNow=True).start().awaitTermination(120)
    table = spark.read.parquet(f"{folder}/out")
    return state.latest(table, keys), table


STEPS = "workflow_id long, seq long, step string, attempts long, outcome string, has_compensation boolean, timeout_ms long, at timestamp"


def test_workflows_are_as_in_the_batch_after_restarts(spark, tmp_path):
    rows = facts(spark, SF, "workflow_steps")
    given = rows.withColumns({"timeout_ms": F.lit(None).cast("long"), "at": F.lit(at(0))}).select(*[c.split(" ")[0] for c in STEPS.split(", ")]).collect()
    got, _ = run(spark, tmp_path, [given[1::3], given[0::3], given[2::3]], STEPS, state.stream_workflows, ["workflow_id"])
    want = ev.workflow_state(rows)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_a_stalled_step_fails_its_workflow(spark, tmp_path):
    step = lambda w, n, outcome, minute, timeout=None: (w, n, f"s{n}", 1, outcome, True, timeout, at(minute))
    parts = [
        [step(1, 1, "completed", 0), step(1, 2, "completed", 1), step(1, 3, "started", 2, 60_000), step(2, 1, "started", 2, 60_000), step(3, 1, "started", 2)],
        [step(2, 1, "completed", 3), step(9, 1, "completed", 60)],  # the watermark passes minute 3
        [step(9, 2, "completed", 61)],
        [step(1, 3, "completed", 62), step(9, 3, "completed", 63)],  # too late: the step has failed
    ]
    got, table = run(spark, tmp_path, parts, STEPS, lambda s: state.stream_workflows(s, "1 minute"), ["workflow_id"])
    rows = {r.workflow_id: r for r in got.collect()}
    assert tuple(rows[1]) == (1, "failed", "s1,s2", "s3", "s2,s1", 3, "step s3 timed out after 60000 ms")
    assert (rows[2].status, rows[3].status, rows[9].completed_steps) == ("completed", "running", "s1,s2,s3")


EVENTS = "event_id long, occurred_at timestamp, correlation_id string, intent string, value double"


def fold(held, event):
    return {"n": held["n"] + 1, "trail": (held["trail"] + [event["event_id"]])[-3:], "best": max(held["best"], event["value"] or 0)}


def test_read_models_by_a_fold_of_the_user(spark, tmp_path):
    rows = [(r.event_id, r.occurred_at, r.correlation_id, r.intent, r.value) for r in facts(spark, SF, "domain_events").orderBy("event_id").withColumn("occurred_at", F.lit(at(0)).cast("timestamp") + F.expr("make_dt_interval(0, 0, 0, event_id % 1000)")).collect()]
    parts = [rows[:400], rows[300:700], rows[700:]]  # a hundred come twice
    wanted = ["Domain.Order.Placed", "Application.Ui.Clicked"]
    build = lambda s: state.stream_read_model(s, ["intent"], fold, {"n": 0, "trail": [], "best": 0}, wanted, "1 hour")
    got, _ = run(spark, tmp_path, parts, EVENTS, build, ["intent"])
    for r in got.collect():
        mine = [e for e in rows if e[3] == r.intent]
        held = {"n": 0, "trail": [], "best": 0}
        seen = set()
        for part in parts:
            for e in sorted((e for e in part if e[3] == r.intent and e[0] not in seen), key=lambda e: (e[1], e[0])):
                held = fold(held, dict(zip(("event_id", "occurred_at", "correlation_id", "intent", "value"), e)))
                seen.add(e[0])
        last = max(mine, key=lambda e: (e[1], e[0]))
        assert (json.loads(r.state), r.applied, r.last_intent, r.last_correlation_id) == (held, len(mine), r.intent, last[2])
    assert {r.intent for r in got.collect()} == set(wanted)


CHANGES = "id string, seq long, status string, error string, at timestamp"


def test_buffered_events_are_as_in_the_batch_and_leave_when_dispatched(spark, tmp_path):
    change = lambda i, seq, status, minute: (i, seq, status, f"e{seq}" if status == "failed" else None, at(minute))
    parts = [
        [change("a", 1, "pending", 0), change("b", 1, "pending", 0), change("a", 3, "failed", 1), change("a", 2, "failed", 1)],
        [change("a", 3, "failed", 1), change("b", 2, "dispatched", 2), change("a", 4, "dispatched", 3)],  # one comes twice
        [change("c", 1, "failed", 200)],
        [change("c", 2, "pending", 201)],
        [change("c", 3, "pending", 202)],
    ]
    build = lambda s: state.stream_buffer(s, "5 minutes", keep_ms=60_000)
    got, table = run(spark, tmp_path, parts, CHANGES, build, ["id"])
    once = sorted({r for p in parts for r in p})
    want = ev.buffer_status(spark.createDataFrame(once, CHANGES))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    store = spark.read.format("statestore").option("path", f"{tmp_path}/ck").option("operatorId", 0).load()
    assert {r.key[0] for r in store.select("key").collect()} == {"c"}
