"""A user's own checks and changes of payloads in Python, beside contracts and interceptors that are Columns.

Only events that a function is registered for go to Python, in Arrow batches; what a function returns is checked, and an
exception is an issue, or a failure, of its own event: others of its batch, and the job, go on.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import partial, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archweave.operators import events as ev
from archweave.ship import ship_package

#: What a validator is given and returns: the parsed payload; issues as (path, message), path a string or its parts.
Check = Callable[[object], Iterable[tuple[object, str]] | None]


@dataclass(frozen=True)
class Validator:
    """Runs in addition to the contract of that intent and version."""

    intent: str
    version: str
    check: Check


def _path_of(path: object) -> str:
    """Parts joined as in contracts' issues: a.b[0]; none is the payload itself."""
    if path is None or path in ("", (), []):
        return "$"
    if isinstance(path, str):
        return path
    out = ""
    for part in path:
        if not isinstance(part, int | str) or isinstance(part, bool):
            raise TypeError("a path has names and positions")
        out += f"[{part}]" if isinstance(part, int) else f".{part}" if out else part
    return out


def issues_of(check: Check, payload: str | None) -> list[tuple[str, str, str]]:
    """(path, code, message) of one payload; code: invalid, not-json, asynchronous, or validator-error."""
    try:
        value = None if payload is None else json.loads(payload)
    except ValueError:
        return [("$", "not-json", "the payload is no JSON")]
    try:
        found = check(value)
        if inspect.isawaitable(found):
            if inspect.iscoroutine(found):
                found.close()
            return [("$", "asynchronous", "a validator must answer at once")]
        return [(_path_of(path), "invalid", str(message)) for path, message in found or ()]
    except Exception as error:  # noqa: BLE001
        return [("$", "validator-error", f"{type(error).__name__}: {error}")]


_ISSUES = "array<struct<path:string,code:string,message:string>>"


def _issues_column(check: Check) -> Callable[[str], Column]:
    def issues(payloads: pd.Series) -> pd.Series:
        return pd.Series([[{"path": p, "code": c, "message": m} for p, c, m in issues_of(check, x if isinstance(x, str) else None)] for x in payloads], dtype=object)

    return F.pandas_udf(issues, _ISSUES)


def validate_with(events: DataFrame, validators: tuple[Validator, ...], contracts: tuple[ev.EventContract, ...] = ev.CONTRACTS) -> DataFrame:
    """One row for each issue of contracts and validators: (event_id, intent, version, path, code, message).

    A validator runs where the event's contract is of its intent and version; two of one are both asked. A null payload
    is given as None. Issues of contracts have no message.
    """
    chosen = ev.selected_version(contracts)
    own = ev.validate_payload(events, contracts).withColumn("message", F.lit(None).cast("string"))
    parts = [own]
    for one in validators:
        rows = events.where((F.col("intent") == one.intent) & (chosen == one.version)).select("event_id", "intent", chosen.alias("version"), "payload")
        found = rows.withColumn("i", F.explode(_issues_column(one.check)("payload")))
        parts.append(found.select("event_id", "intent", "version", "i.path", "i.code", "i.message"))
    return reduce(DataFrame.union, parts)


@dataclass(frozen=True)
class CodedInterceptor:
    """change: parsed payload -> patch (a dict or list to be merged), or None to leave the event alone."""

    id: str
    intent: str
    change: Callable[[object], object]
    when: Column | None = None


def patch_of(change: Callable[[object], object], payload: str | None) -> tuple[str | None, str | None]:
    """(patch as JSON, error) for one payload."""
    try:
        patch = change(None if payload is None else json.loads(payload))
        if patch is None:
            return None, None
        if not isinstance(patch, dict | list):
            raise TypeError("a patch is an object or an array")
        return json.dumps(patch, sort_keys=True, separators=(",", ":"), allow_nan=False), None
    except Exception as error:  # noqa: BLE001
        return None, f"{type(error).__name__}: {error}"


def _stepped(change: Callable[[object], object], batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Batches with payload patched where _asked; _before, _patched, and _error: what was raised, or where it conflicts."""
    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns, strict=True))
        before = columns["payload"].to_pylist()
        after, patched, errors = list(before), [False] * len(before), [None] * len(before)
        for i, asked in enumerate(columns["_asked"].to_pylist()):
            patch, errors[i] = patch_of(change, before[i]) if asked else (None, None)
            if patch is not None:
                patched[i] = True
                after[i], conflict = ev._patched(before[i], patch)
                errors[i] = conflict and f"conflict: {conflict}"
        columns |= {"payload": pa.array(after, pa.string()), "_before": pa.array(before, pa.string()), "_patched": pa.array(patched, pa.bool_()), "_error": pa.array(errors, pa.string())}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def intercept_with(events: DataFrame, interceptors: tuple[CodedInterceptor, ...], strict: bool = False, contracts: tuple[ev.EventContract, ...] = ev.CONTRACTS) -> DataFrame:
    """``events.intercept_events`` with patches that functions compute from the payload as the ones before have left it.

    With interceptions, failures (arrays of ids) and errors (array<string>, 'id: exception'). A function that raises, or
    returns what is no patch, is a failure and leaves the event as it was. Each step is a map of its own, so a plan grows
    by as much with each interceptor; contracts are Columns between the steps.
    """
    ship_package(events.sparkSession)
    allowed = F.coalesce(F.col("allow_interception"), F.lit(True)) if "allow_interception" in events.columns else F.lit(True)
    none = F.array().cast("array<string>")
    rows = events.withColumns({"payload": F.col("payload").cast("string"), "interceptions": none, "failures": none, "errors": none})
    if not interceptors:
        return rows
    concerned = allowed & F.coalesce(F.col("intent").isin(*{one.intent for one in interceptors}), F.lit(False))
    others, rows = rows.where(~concerned), rows.where(concerned)
    for one in interceptors:
        hit = (F.col("intent") == one.intent) & (F.coalesce(one.when, F.lit(False)) if one.when is not None else F.lit(True))
        rows = rows.withColumn("_asked", hit)
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        rows = rows.mapInArrow(partial(_stepped, one.change), f"{fields}, _before string, _patched boolean, _error string")
        failed = F.col("_error").isNotNull() | (F.col("_patched") & ev.contract_gate(strict, contracts))
        rows = rows.withColumn("_failed", failed)
        added = lambda c, when, what: F.when(when, F.array_append(c, what)).otherwise(F.col(c))
        rows = rows.withColumns(
            {
                "payload": F.when(F.col("_failed"), F.col("_before")).otherwise(F.col("payload")),
                "interceptions": added("interceptions", F.col("_patched") & ~F.col("_failed"), F.lit(one.id)),
                "failures": added("failures", F.col("_failed"), F.lit(one.id)),
                "errors": added("errors", F.col("_error").isNotNull(), F.concat(F.lit(f"{one.id}: "), F.col("_error"))),
            }
        ).drop("_asked", "_before", "_patched", "_error", "_failed")
    return rows.unionByName(others)
