"""Keyed state on event streams: workflows with step timeouts, read models by a user's fold, buffered events.

Each operator keeps one small JSON document a key in Spark's state store and emits the key's row whenever it changes (update
mode), so a restart from the checkpoint goes on where the stream was. Time is event time, told by the watermark: timers
don't depend on when a batch runs. What is finished leaves the state ``keep_ms`` after its last change. Rows of a key may come
in any order and in any batches within the watermark; ``once`` drops what a source repeats.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archweave.ship import ship_package

#: What a key's state is: a JSON document, and the event time of its last change in milliseconds.
_STATE = "held string, last long"


def once(rows: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """Rows whose keys were seen before, in any batch within ``late``, are dropped; state is kept that long only."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def _records(batch: pd.DataFrame) -> list[dict]:
    """Rows of JSON values: nulls as None, times as ISO texts of microseconds, numbers as they are."""
    columns = []
    for name in batch.columns:
        column = batch[name]
        if pd.api.types.is_datetime64_any_dtype(column):
            column = column.dt.strftime("%Y-%m-%dT%H:%M:%S.%f")
        columns.append([None if missing else x for x, missing in zip(column.tolist(), column.isna().tolist(), strict=True)])
    return [dict(zip(batch.columns, row, strict=True)) for row in zip(*columns, strict=True)]


def _keyed(rows: DataFrame, keys: list[str], at: str, output: str, step: Callable, deadline: Callable, expire: Callable) -> DataFrame:
    """One state a key. step(held, row dicts in order of arrival) -> held; deadline(held, last) -> when to call expire, or None;
    expire(held) -> held, or None to forget the key; what these return is told by the ``row`` entry of held."""
    ship_package(rows.sparkSession)
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    names = [x.strip().split(" ")[0] for x in output.split(",")]

    def told(key: tuple, held: dict) -> pd.DataFrame:
        return pd.DataFrame([[*key, *held["row"]]], columns=[*keys, *names])

    def watch(state, held: dict, last: int) -> dict | None:
        """Set the timer; timers that the watermark has passed already are run at once."""
        while (when := deadline(held, last)) is not None and when <= state.getCurrentWatermarkMs():
            held = expire(held)
            if held is None:
                state.remove()
                return None
        state.update((json.dumps(held), last))
        if when is not None:
            state.setTimeoutTimestamp(int(when))
        return held

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        text, last = state.get if state.exists else ("{}", 0)
        held = json.loads(text)
        if state.hasTimedOut:
            held = expire(held)
            if held is None:
                state.remove()
                return
            yield told(key, held)
            watch(state, held, last)
            return
        found: list[dict] = []
        for batch in batches:
            last = max(last, int(pd.to_datetime(batch["_at"]).max().value // 1_000_000))
            found += _records(batch.drop(columns=keys))
        held = step(held, found)
        kept = watch(state, held, last)
        yield told(key, kept or held)

    given = rows.select(*keys, F.col(at).alias("_at"), *[c for c in rows.columns if c not in (*keys, at)])
    return given.groupBy(*keys).applyInPandasWithState(run, f"{kinds}, {output}", _STATE, "update", "EventTimeTimeout")


WORKFLOW = "status string, completed_steps string, failed_step string, compensations string, attempts bigint, error string"


def workflow_row(steps: dict[str, dict]) -> list:
    """Of a workflow's steps by number: what ``operators.events.workflow_state`` tells, running while a step is open, and why it failed."""
    order = [steps[k] for k in sorted(steps, key=int)]
    stop = next((i for i, s in enumerate(order) if s["outcome"] == "failed"), None)
    known = order if stop is None else order[: stop + 1]
    done = [s for s in known if s["outcome"] == "completed"]
    failed = stop is not None
    status = "failed" if failed else "running" if any(s["outcome"] == "started" for s in known) else "completed"
    handlers = [s["step"] for s in reversed(done) if s["has_compensation"]] if failed else []
    attempts = sum(s["attempts"] or 0 for s in known)
    return [status, ",".join(s["step"] for s in done), known[-1]["step"] if failed else None, ",".join(handlers), attempts, known[-1].get("error") if failed else None]


def stream_workflows(steps: DataFrame, late: str = "10 minutes", keep_ms: int = 86_400_000) -> DataFrame:
    """steps (workflow_id, seq, step, attempts, outcome, has_compensation, timeout_ms, at) -> the current row of each workflow that changes.

    outcome: started, completed or failed; a step that was started and has neither ended nor been seen again ``timeout_ms`` after is
    failed, with its workflow, once the watermark is past that. Later news of a step that has failed or completed changes nothing.
    """

    def step(held: dict, rows: list[dict]) -> dict:
        known = held.get("steps", {})
        for r in sorted(rows, key=lambda r: r["outcome"] == "started", reverse=True):
            before = known.get(str(r["seq"]))
            if before is None or before["outcome"] == "started":
                due = None
                if r["outcome"] == "started" and r["timeout_ms"] is not None:
                    due = int(pd.Timestamp(r["_at"]).value // 1_000_000) + int(r["timeout_ms"])
                known[str(r["seq"])] = {k: r[k] for k in ("step", "attempts", "outcome", "has_compensation", "timeout_ms")} | {"due": due}
        return {"steps": known, "row": workflow_row(known)}

    def open_steps(held: dict) -> list[dict]:
        return [s for s in held["steps"].values() if s["due"] is not None] if held["row"][0] == "running" else []

    def deadline(held: dict, last: int) -> int | None:
        return min([s["due"] for s in open_steps(held)], default=None if held["row"][0] == "running" else last + keep_ms)

    def expire(held: dict) -> dict | None:
        waiting = open_steps(held)
        if not waiting:
            return None
        s = min(waiting, key=lambda s: s["due"])
        s |= {"outcome": "failed", "due": None, "error": f"step {s['step']} timed out after {int(s['timeout_ms'])} ms"}
        return held | {"row": workflow_row(held["steps"])}

    return _keyed(steps.withWatermark("at", late), ["workflow_id"], "at", WORKFLOW, step, deadline, expire)


PROJECTED = "state string, applied bigint, last_intent string, last_correlation_id string"


def stream_read_model(events: DataFrame, keys: list[str], fold: Callable[[dict, dict], dict], initial: dict, intents: list[str] | None = None, late: str = "10 minutes", keep_ms: int | None = None) -> DataFrame:
    """events (event_id, occurred_at, intent, correlation_id, ...) -> keys, the read model as JSON, and its checkpoint: events applied, the last one's
    intent and correlation id.

    fold(state, event) -> state is the user's, on JSON values (times as text); events of a key are applied batch by batch, within a batch by time and id. An
    event_id that comes again within ``late`` is not applied again. Without ``keep_ms`` read models stay for good.
    """
    wanted = events if intents is None else events.where(F.col("intent").isin(intents))
    # A key may be a field that the fold reads too.
    named = [f"key_{k}" for k in keys]
    given = once(wanted, ["event_id"], "occurred_at", late).withColumns({n: F.col(k) for n, k in zip(named, keys, strict=True)})

    def step(held: dict, rows: list[dict]) -> dict:
        state, applied = held.get("state", initial), held.get("applied", 0)
        rows.sort(key=lambda r: (r["_at"], r["event_id"]))
        for r in rows:
            state = fold(state, {"occurred_at" if k == "_at" else k: v for k, v in r.items()})
        newest = max([*rows, *held.get("newest", [])], key=lambda r: (r["_at"], r["event_id"]))
        newest = {k: newest[k] for k in ("_at", "event_id", "intent", "correlation_id")}
        applied += len(rows)
        return {"state": state, "applied": applied, "newest": [newest], "row": [json.dumps(state, sort_keys=True), applied, newest["intent"], newest["correlation_id"]]}

    def deadline(held: dict, last: int) -> int | None:
        return None if keep_ms is None else last + keep_ms

    told = _keyed(given, named, "occurred_at", PROJECTED, step, deadline, lambda held: None)
    return told.withColumnsRenamed(dict(zip(named, keys, strict=True)))


BUFFERED = "status string, attempts bigint, error string"


def stream_buffer(changes: DataFrame, late: str = "10 minutes", keep_ms: int = 3_600_000) -> DataFrame:
    """changes (id, seq, status, error, at) -> the current row of each buffered event that changes, as ``operators.events.buffer_status``.

    A change (id, seq) that comes again within ``late`` counts once. Dispatched events leave the state ``keep_ms`` after their last change;
    pending and failed ones stay until they are dispatched, so state is bounded by what isn't delivered.
    """

    def step(held: dict, rows: list[dict]) -> dict:
        out = {"seq": None, "status": None, "attempts": 0, "failed": None, "error": None} | held
        for r in rows:
            if out["seq"] is None or r["seq"] > out["seq"]:
                out |= {"seq": r["seq"], "status": r["status"]}
            if r["status"] == "failed":
                out["attempts"] += 1
                if out["failed"] is None or r["seq"] > out["failed"]:
                    out |= {"failed": r["seq"], "error": r["error"]}
        return out | {"row": [out["status"], out["attempts"], out["error"]]}

    def deadline(held: dict, last: int) -> int | None:
        return last + keep_ms if held["status"] == "dispatched" else None

    return _keyed(once(changes, ["id", "seq"], "at", late), ["id"], "at", BUFFERED, step, deadline, lambda held: None)


def write_latest(updates: DataFrame, path: str, checkpoint: str):
    """Update rows to a table, a partition a batch; a batch that is written again replaces its own. ``latest`` reads the current rows."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return updates.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)


def latest(table: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of each key of a table that ``write_latest`` wrote."""
    own = F.struct(*[c for c in table.columns if c not in (*keys, "batch")])
    return table.groupBy(*keys).agg(F.max_by(own, "batch").alias("x")).select(*keys, "x.*")
