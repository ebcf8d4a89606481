"""Event governance. All checks are stateless Column work, so the same functions run on tables and on streams."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archweave.contract import DEFAULT_PREFIXES, Contract
from archweave.functions.names import intent_problem


@dataclass(frozen=True)
class EventField:
    """type: string, number, boolean, object, array or unknown. values: what is allowed, as JSON."""

    type: str = "unknown"
    required: bool = False
    values: tuple[str, ...] = ()
    fields: dict[str, EventField] | None = None
    items: EventField | None = None


@dataclass(frozen=True)
class EventContract:
    """Fields of a payload: name -> field, or (type, required) for short."""

    intent: str
    version: str
    fields: dict[str, EventField | tuple[str, bool]]
    deprecated: bool = False
    additional: bool = True


REGISTRY = ("Domain.Order.Placed", "Domain.User.Registered", "Application.Ui.Clicked", "Application.PlaceOrder", "Presentation.Web", "Domain.Order")
CONTRACTS = (
    EventContract("Domain.Order.Placed", "1", {"sku": ("string", True)}, deprecated=True),
    EventContract("Domain.Order.Placed", "2", {"k": ("number", True)}),
    EventContract("Domain.User.Registered", "1", {"k": ("number", True), "ref": ("string", False)}),
)


def enrich_metadata(events: DataFrame) -> DataFrame:
    return events.withColumn("source", F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("unknown")))


def guard_code(registry: tuple[str, ...] = REGISTRY) -> Column:
    """First guard that an event fails, null if none."""
    return (
        F.when(intent_problem(F.col("intent")).isNotNull(), "invalid-intent")
        .when(~F.col("intent").isin(*registry), "unregistered-intent")
        .when(F.col("source").isNull() | F.col("source").isin("", "unknown"), "unknown-source")
        .when(~F.col("source").isin(*registry), "unregistered-source")
    )


def guard_events(events: DataFrame, registry: tuple[str, ...] = REGISTRY) -> DataFrame:
    return events.withColumn("reject", guard_code(registry))


def selected_version(contracts: tuple[EventContract, ...] = CONTRACTS) -> Column:
    """The event's version, or where that is null the one registered last for its intent."""
    last = {c.intent: c.version for c in contracts}
    fallback = reduce(lambda w, kv: w.when(F.col("intent") == kv[0], kv[1]), last.items(), F.when(F.lit(False), ""))
    return F.coalesce(F.col("event_version"), fallback)


_NO_ISSUES = "array<struct<path:string,code:string>>"


def _kind(value: Column) -> Column:
    """The JSON type of a variant; null counts as an object."""
    schema = F.call_function("schema_of_variant", value)
    number = schema.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)")
    return F.when(schema.startswith("ARRAY"), "array").when(schema.startswith("OBJECT") | (schema == "VOID"), "object").when(schema == "STRING", "string").when(schema == "BOOLEAN", "boolean").when(number, "number").otherwise("unknown")


def _none() -> Column:
    return F.array().cast(_NO_ISSUES)


def _issue(path: Column, code: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(code).alias("code")))


def _value_issues(value: Column, field: EventField, path: Column) -> Column:
    """Issues of one value: another type ends it; else values, fields and items are looked at."""
    parts = []
    if field.values:
        parts.append(F.when(F.to_json(value).isin(*field.values), _none()).otherwise(_issue(path, "enum")))
    if field.type == "object" and field.fields is not None:
        is_null = F.call_function("is_variant_null", value)
        parts.append(F.when(is_null, _issue(path, "nested-object")).otherwise(_fields_issues(value, field.fields, path)))
    if field.type == "array" and field.items is not None:
        items = F.try_variant_get(value, "$", "array<variant>")
        each = F.transform(items, lambda x, i: _value_issues(x, field.items, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        parts.append(F.coalesce(F.flatten(each), _none()))
    found = F.concat(*parts) if parts else _none()
    return found if field.type == "unknown" else F.when(_kind(value) == field.type, found).otherwise(_issue(path, "type"))


def _fields_issues(value: Column, fields: dict[str, EventField], parent: Column | None) -> Column:
    found = []
    for name, field in fields.items():
        own = F.try_variant_get(value, f"$['{name}']", "variant")
        path = F.lit(name) if parent is None else F.concat(parent, F.lit(f".{name}"))
        found.append(F.when(own.isNull(), _issue(path, "missing-required") if field.required else _none()).otherwise(_value_issues(own, field, path)))
    return F.concat(*found) if found else _none()


def _issues_of(contract: EventContract) -> Column:
    """array<struct<path, code>> of a JSON payload against one contract; no payload, or no JSON, has no fields."""
    fields = {n: f if isinstance(f, EventField) else EventField(*f) for n, f in contract.fields.items()}
    value = F.try_parse_json(F.col("payload"))
    shaped = value.isNull() | (_kind(value).isin("object", "array") & ~F.call_function("is_variant_null", value))
    found = _fields_issues(value, fields, None)
    if not contract.additional:
        keys = F.array_sort(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")))
        extra = F.filter(keys, lambda k: ~k.isin(*fields) if fields else F.lit(True))
        found = F.concat(found, F.coalesce(F.transform(extra, lambda k: F.struct(k.alias("path"), F.lit("additional").alias("code"))), _none()))
    found = F.when(shaped, found).otherwise(_issue(F.lit("$"), "not-object"))
    return F.concat(_issue(F.lit("$"), "deprecated"), found) if contract.deprecated else found


def payload_issues(contracts: tuple[EventContract, ...] = CONTRACTS) -> Column:
    """Issues of the payload against the event's contract; an event without one has the issue no-contract."""
    out = F.when(F.lit(False), F.array(F.struct(F.lit("").alias("path"), F.lit("").alias("code"))))
    for c in contracts:
        out = out.when((F.col("intent") == c.intent) & (selected_version(contracts) == c.version), _issues_of(c))
    return out.otherwise(F.array(F.struct(F.lit("$").alias("path"), F.lit("no-contract").alias("code"))))


def validate_payload(events: DataFrame, contracts: tuple[EventContract, ...] = CONTRACTS) -> DataFrame:
    """One row for each issue: (event_id, intent, version, path, code)."""
    found = events.withColumns({"issues": payload_issues(contracts), "version": selected_version(contracts)})
    return found.select("event_id", "intent", "version", F.explode("issues").alias("i")).select("event_id", "intent", "version", "i.path", "i.code")


def contract_gate(strict: bool, contracts: tuple[EventContract, ...] = CONTRACTS) -> Column:
    """Whether the payload rejects the event: issues, and a contract that has them unless ``strict``."""
    codes = F.transform(payload_issues(contracts), lambda i: i["code"])
    return (F.size(codes) > 0) & (F.lit(strict) | ~F.array_contains(codes, "no-contract"))


def layer_flow(contract: Contract, prefixes: dict[str, tuple[str, ...]] = DEFAULT_PREFIXES) -> Column:
    """Whether the flow from the source's layer to the intent's is denied; peer rules have no paths and deny."""
    source, target = event_layer(F.col("source"), prefixes), event_layer(F.col("intent"), prefixes)
    denied = [(source == r.source) & (target == r.target) for r in contract.rules if not r.allowed and (r.source != r.target or r.peer_isolation)]
    return F.coalesce(reduce(lambda a, b: a | b, denied), F.lit(False)) if denied else F.lit(False)


def publish_pipeline(events: DataFrame, contract: Contract, policies: dict[str, Column] | None = None, hard_flow: bool = True, strict: bool = False) -> DataFrame:
    """Events with reject: the first of guards, contract, layer flow and policies that fails; null means accepted.

    policies: name -> predicate that must hold.
    """
    code = F.coalesce(guard_code(), F.when(contract_gate(strict), "contract"), F.when(layer_flow(contract), "layer-flow") if hard_flow else F.lit(None))
    for name, holds in (policies or {}).items():
        code = F.coalesce(code, F.when(~F.coalesce(holds, F.lit(False)), f"policy:{name}"))
    return events.withColumn("reject", code)


def fan_out(accepted: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(event_id, intent, n_subscribers): 0 where nobody listens. subscriptions (intent, subscriber)."""
    counts = subscriptions.groupBy("intent").agg(F.count("*").alias("n_subscribers"))
    return accepted.join(counts, "intent", "left").select("event_id", "intent", F.coalesce("n_subscribers", F.lit(0)).alias("n_subscribers"))


def project_events(events: DataFrame, keys: list[str], order: list[str], **folds: Column) -> DataFrame:
    """Read model of algebraic folds by key, with its checkpoint: applied count, last intent, last correlation id."""
    at = F.struct(*order)
    return events.groupBy(*keys).agg(*[c.alias(n) for n, c in folds.items()], F.count("*").alias("applied"), F.max_by("intent", at).alias("last_intent"), F.max_by("correlation_id", at).alias("last_correlation_id"))


def buffer_status(changes: DataFrame) -> DataFrame:
    """changes (id, seq, status, error) -> current status, attempts (failures so far), last error."""
    failed = F.col("status") == "failed"
    return changes.groupBy("id").agg(F.max_by("status", "seq").alias("status"), F.count_if(failed).alias("attempts"), F.max_by("error", F.when(failed, F.col("seq"))).alias("error"))


def workflow_state(steps: DataFrame) -> DataFrame:
    """steps (workflow_id, seq, step, attempts, outcome, has_compensation) -> one row a workflow.

    Steps after the first failed one don't count. completed: in order; compensations: completed steps that have a
    handler, last first, if the workflow failed.
    """
    failing = F.min(F.when(F.col("outcome") == "failed", F.col("seq"))).over(W.partitionBy("workflow_id"))
    known = steps.withColumn("stop", failing).where(F.col("stop").isNull() | (F.col("seq") <= F.col("stop")))
    done = F.col("outcome") == "completed"
    listed = lambda c: F.array_sort(F.collect_list(F.when(c, F.struct("seq", "step"))))
    names = lambda c: F.array_join(F.transform(c, lambda x: x["step"]), ",")
    grouped = known.groupBy("workflow_id").agg(
        F.max("stop").alias("stop"),
        listed(done).alias("c"),
        listed(done & F.col("has_compensation")).alias("h"),
        F.max_by("step", F.when(F.col("outcome") == "failed", F.col("seq"))).alias("failed_step"),
        F.sum("attempts").alias("attempts"),
    )
    failed = F.col("stop").isNotNull()
    return grouped.select(
        "workflow_id",
        F.when(failed, "failed").otherwise("completed").alias("status"),
        names(F.col("c")).alias("completed_steps"),
        F.when(failed, F.col("failed_step")).alias("failed_step"),
        F.when(failed, names(F.reverse("h"))).otherwise("").alias("compensations"),
        "attempts",
    )


def audit_query(records: DataFrame, since=None, until=None, limit: int | None = None, keys: list[str] | None = None, **equal: str) -> DataFrame:
    """Records from since to until with these values (kind, intent, correlation_id, subject); the last ``limit``, of each key if there are keys."""
    for name, value in equal.items():
        records = records.where(F.col(name) == value)
    if since is not None:
        records = records.where(F.col("occurred_at") >= since)
    if until is not None:
        records = records.where(F.col("occurred_at") <= until)
    newest = [F.desc("occurred_at"), F.desc("event_id")]
    if limit is None:
        return records
    if not keys:
        return records.orderBy(*newest).limit(limit)
    return records.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*newest))).where(F.col("_k") <= limit).drop("_k")


def event_layer(name: Column, prefixes: dict[str, tuple[str, ...]]) -> Column:
    """The layer of a name at the time of an event: layers by their longest prefix, the first in which any prefix fits.

    Unlike ``intent_layer``, a layer with a long prefix goes before another whose matching prefix is longer than its own.
    """
    dotted = {layer: [p if p.endswith(".") else f"{p}." for p in own] for layer, own in prefixes.items()}
    out = F.when(F.lit(False), "")
    for layer, own in sorted(dotted.items(), key=lambda kv: -max(map(len, kv[1]), default=0)):
        if own:
            out = out.when(reduce(lambda a, b: a | b, [name.startswith(p) for p in own]), layer)
    return out


def declared_layer_policy(edges: DataFrame, contract: Contract, prefixes: dict[str, tuple[str, ...]] = DEFAULT_PREFIXES) -> DataFrame:
    """edges (from_intent, to_intent, kind) that are declared, not observed, and that a rule of the contract denies.

    (from_intent, to_intent, from_layer, to_layer, rule): one row for each denying rule, whose number it has.
    """
    found = edges.where(F.col("kind").isin("declared", "produces", "dependsOn")).select("from_intent", "to_intent").distinct()
    found = found.withColumns({"from_layer": event_layer(F.col("from_intent"), prefixes), "to_layer": event_layer(F.col("to_intent"), prefixes)})
    hits = [F.when((F.col("from_layer") == r.source) & (F.col("to_layer") == r.target), F.lit(i).cast("long")) for i, r in enumerate(contract.rules) if not r.allowed]
    return found.select("*", F.explode(F.array_compact(F.array(*hits)) if hits else F.array().cast("array<bigint>")).alias("rule"))


def history_query(history: DataFrame, keys: list[str], newest: int, intent: str | None = None, kind: str | None = None) -> DataFrame:
    """The newest events or trace rows of each key, optionally of one intent or one kind."""
    rows = history
    if intent is not None:
        rows = rows.where(F.col("intent") == intent)
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    w = W.partitionBy(*keys).orderBy(F.desc("occurred_at"), F.desc("event_id"))
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= newest).drop("_k")


def validate_entities(fields: DataFrame) -> DataFrame:
    """fields (entity, field, type, relation) -> (entity, field, issue); an entity without fields has one row with null field."""
    names = fields.select(F.col("entity").alias("relation")).distinct().withColumn("known", F.lit(True))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    named = fields.groupBy("entity").agg(F.lit(1)).where(blank(F.col("entity"))).select("entity", F.lit(None).cast("string").alias("field"), F.lit("entity-name").alias("issue"))
    joined = fields.where("field is not null").join(names, "relation", "left")
    tests = [(blank(F.col("field")), "field-name"), (F.coalesce(F.col("type"), F.lit("")) == "", "field-type"), (F.col("relation").isNotNull() & F.col("known").isNull(), "unknown-relation")]
    return joined.select("entity", "field", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for c, k in tests]))).alias("issue")).union(named)


def entities_by_intent(entities: DataFrame) -> DataFrame:
    """entities (entity, emits, consumes array<string>) -> (intent, entity, role): both where it does both."""
    of = lambda c, role: entities.select("entity", F.explode(c).alias("intent"), F.lit(role).alias("role"))
    roles = of("emits", "emits").union(of("consumes", "consumes")).groupBy("intent", "entity").agg(F.countDistinct("role").alias("n"), F.min("role").alias("role"))
    return roles.select("intent", "entity", F.when(F.col("n") > 1, "both").otherwise(F.col("role")).alias("role"))


def _merged(value, patch, path: str):
    """Fills what is missing; raises where something is there already."""
    if isinstance(value, dict) and isinstance(patch, dict):
        out = dict(value)
        for key, own in patch.items():
            out[key] = _merged(out[key], own, f"{path}.{key}") if key in out else own
        return out
    if isinstance(value, list) and isinstance(patch, list):
        return [_merged(value[i], own, f"{path}[{i}]") if i < len(value) else own for i, own in enumerate(patch)] + value[len(patch) :]
    raise ValueError(path)


def _patched(payload: str | None, patch: str) -> tuple[str | None, str | None]:
    new = json.loads(patch)
    try:
        old = json.loads(payload) if payload is not None else None
        if payload is not None and type(old) is not type(new):
            raise ValueError("payload")
        return json.dumps(new if payload is None else _merged(old, new, "payload"), separators=(",", ":"), sort_keys=True), None
    except ValueError as error:
        return payload, str(error) if not isinstance(error, json.JSONDecodeError) else "payload"


def apply_payload_patch(events: DataFrame, patch: Column) -> DataFrame:
    """With payload filled from the patch (JSON), and conflict: the path at which it would have overwritten something.

    A patch adds keys and array slots that are missing, at any depth; where a value is there already the payload stays
    as it was. A null payload becomes the patch; a null patch changes nothing. A patched payload is JSON with sorted keys.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("payload string, conflict string")
    def merge(payloads: pd.Series, patches: pd.Series) -> pd.DataFrame:
        none = lambda x: x is None or x != x  # noqa: E731, PLR0124
        rows = [(None if none(p) else p, None) if none(q) else _patched(None if none(p) else p, q) for p, q in zip(payloads, patches, strict=True)]
        return pd.DataFrame(rows, columns=["payload", "conflict"], dtype=object)

    merged = events.withColumn("_m", merge(F.col("payload"), patch))
    return merged.withColumns({"payload": F.col("_m.payload"), "conflict": F.col("_m.conflict")}).drop("_m")


@dataclass(frozen=True)
class Interceptor:
    """Patches payloads of one intent; ``when`` narrows it. A patch is JSON."""

    id: str
    intent: str
    patch: str
    when: Column | None = None


def intercept_events(events: DataFrame, interceptors: tuple[Interceptor, ...], strict: bool = False, contracts: tuple[EventContract, ...] = CONTRACTS) -> DataFrame:
    """Events after their interceptors, in order, with interceptions and failures (arrays of interceptor ids).

    Each sees what the one before has left. One that would overwrite something, or after which the contract rejects the
    event, leaves it as it was and is a failure; events with allow_interception false are not touched.
    """
    allowed = F.coalesce(F.col("allow_interception"), F.lit(True)) if "allow_interception" in events.columns else F.lit(True)
    none = F.array().cast("array<string>")
    rows = events.withColumns({"interceptions": none, "failures": none})
    for one in interceptors:
        hit = allowed & (F.col("intent") == one.intent) & (F.coalesce(one.when, F.lit(False)) if one.when is not None else F.lit(True))
        rows = rows.withColumns({"_before": F.col("payload"), "_hit": F.coalesce(hit, F.lit(False))})
        rows = apply_payload_patch(rows, F.when(F.col("_hit"), F.lit(one.patch)))
        failed = F.col("_hit") & (F.col("conflict").isNotNull() | contract_gate(strict, contracts))
        rows = rows.withColumn("_failed", failed)
        added = lambda c, when: F.when(when, F.array_append(c, one.id)).otherwise(F.col(c))  # noqa: E731, B023
        rows = rows.withColumns({"payload": F.when(F.col("_failed"), F.col("_before")).otherwise(F.col("payload")), "interceptions": added("interceptions", F.col("_hit") & ~F.col("_failed")), "failures": added("failures", F.col("_failed"))}).drop("_before", "_hit", "_failed", "conflict")
    return rows


def evaluate_policies(events: DataFrame, policies: dict[str, tuple[str, Column]]) -> DataFrame:
    """(event_id, policy, severity, message): one row for each violation of each policy.

    policies: name -> (hard or soft, Column over the event): a boolean that must hold, a message or an array of
    messages where it doesn't. Null is no violation, but a null boolean is one.
    """
    rows = []
    for name, (severity, verdict) in policies.items():
        kind = events.select(verdict.alias("v")).schema["v"].dataType.simpleString()
        messages = verdict if kind == "array<string>" else F.when(verdict.isNotNull(), F.array(verdict)) if kind == "string" else F.when(~F.coalesce(verdict, F.lit(False)), F.array(F.lit(f"{name} failed")))
        rows.append(_violations_of(messages, name, severity))
    return events.select("event_id", F.explode(F.flatten(F.array(*rows))).alias("x")).select("event_id", "x.*")


def _violations_of(messages: Column, name: str, severity: str) -> Column:
    row = lambda m: F.struct(F.lit(name).alias("policy"), F.lit(severity).alias("severity"), m.alias("message"))
    return F.transform(F.coalesce(messages, F.array().cast("array<string>")), row)


def hard_rejects(violations: DataFrame) -> DataFrame:
    """(event_id, policies): events that a hard policy rejects, with the names of those policies."""
    return violations.where("severity = 'hard'").groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_set("policy")), ",").alias("policies"))


def drift_report(produces: DataFrame, observed: DataFrame, registry: DataFrame) -> DataFrame:
    """(list, from_intent, to_intent): all lists of the drift between declared and observed productions.

    produces, observed (from_intent, to_intent), registry (intent). A list of names has them in one of the columns.
    Flows from 'unknown' are never undeclared, but may be declared and unobserved.
    """
    pairs = ["from_intent", "to_intent"]
    declared, seen = produces.select(*pairs).distinct(), observed.select(F.coalesce("from_intent", F.lit("")).alias("from_intent"), "to_intent").distinct()
    known = registry.select("intent").distinct()
    named = lambda df, kind: df.select(F.lit(kind).alias("list"), *pairs)
    none = F.lit(None).cast("string")
    sources = seen.where("from_intent not in ('', 'unknown')").select(F.col("from_intent").alias("intent")).distinct().join(known, "intent", "left_anti")
    targets = seen.select(F.col("to_intent").alias("intent")).distinct().join(known, "intent", "left_anti")
    met = seen.select(F.explode(F.array("from_intent", "to_intent")).alias("intent")).distinct()
    parts = [
        named(declared.join(seen, pairs, "left_anti"), "declared-unobserved"),
        named(seen.where("from_intent <> 'unknown'").join(declared, pairs, "left_anti"), "observed-undeclared"),
        named(seen.where("from_intent in ('', 'unknown')"), "unknown-source"),
        sources.select(F.lit("unregistered-source"), "intent", none),
        targets.select(F.lit("unregistered-intent"), none, "intent"),
        known.join(met, "intent", "left_anti").select(F.lit("never-observed"), none, "intent"),
    ]
    return reduce(DataFrame.union, parts)
