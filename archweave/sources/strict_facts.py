"""Facts documents read strictly: all eight tables, and every departure from their form in a table of rejects.

Documents are one JSON object a line, each with its repo and snapshot. They are parsed once, as variants, so that keys that no
schema names are seen too, and their arrays are laid out as rows in one pass; each row is held against its table's fields by
Column expressions. A document with any reject gives no facts, as half a document would read as a smaller repository.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archweave.keys import sized
from archweave.lineage import cut
from archweave.operators.walls import CAPABILITIES

TEXT, PATH, LINE, COUNT, FLAG, TEXTS, METHODS = "text", "path", "line", "count", "flag", "texts", "methods"
# The versions and fields of a facts document; what may be absent is in OPTIONAL.
VERSIONS = ("1.0", "1.1")
COMPLETENESS = ("complete", "partial", "unavailable")
IDENTITIES = ("resolverIdentity", "compilerIdentity", "compilerOptionsHash", "tsconfigHash", "evidenceRequirementsHash")
FACTS = {
    "files": {"path": PATH, "contentHash": TEXT, "parseStatus": ("parsed", "invalid"), "parseDiagnosticCount": COUNT, "exportsOnlyTypes": FLAG, "typeOnlyExportNames": TEXTS, "hasTopLevelSideEffects": FLAG},
    "dependencies": {
        "from": PATH, "specifier": TEXT, "kind": ("import", "export", "dynamic-import", "require"), "typeOnly": FLAG, "line": LINE,
        "resolution": ("resolved-project", "resolved-external", "unresolved", "dynamic"), "target": PATH, "namedBindings": TEXTS,
        "targetTypeOnlyExports": FLAG, "sourcePureTypeModule": FLAG, "namedBindingsTypeOnly": FLAG, "portProofEligible": FLAG,
    },
    "capabilityUses": {"file": PATH, "line": LINE, "symbol": TEXT, "capability": CAPABILITIES, "source": ("ambient-global", "import-based")},
    "ambientUses": {"file": PATH, "line": LINE, "symbol": TEXT},
    "publishCalls": {"file": PATH, "line": LINE, "rawIntentName": TEXT, "objectHasIntent": FLAG, "arkPublishCandidate": FLAG, "hasSource": FLAG, "sourceIntent": TEXT},
    "intentReferences": {"file": PATH, "line": LINE, "intent": TEXT},
    "safetyUses": {"file": PATH, "line": LINE, "kind": ("ts-suppression", "any-cast", "dynamic-import", "dynamic-require", "in-memory-store"), "symbol": TEXT},
    "classShapes": {"file": PATH, "className": TEXT, "exported": FLAG, "hasPublicMutableFields": FLAG, "hasPublicSetters": FLAG, "hasPublicConstructor": FLAG, "hasStaticFactory": FLAG, "dataOnly": FLAG, "mutatingMethods": METHODS},
}
OPTIONAL = {
    "dependencies": ("specifier", "target", "namedBindings", "targetTypeOnlyExports", "sourcePureTypeModule", "namedBindingsTypeOnly", "portProofEligible"),
    "publishCalls": ("rawIntentName", "sourceIntent"),
    "safetyUses": ("symbol",),
    "classShapes": ("dataOnly",),
}
# Fixed value: paths inside a project.
PATH_PATTERN = r"^(?!/)(?![A-Za-z]:/)(?!.*\\)(?!.*//)(?!.*(?:^|/)\.{1,2}(?:/|$))(?!.*[\u0000-\u001f\u007f])(?!.*/$).+$"
_METHOD = "OBJECT<name: STRING, referencesGuardOrPublish: BOOLEAN>"
_CASTS = {LINE: "bigint", COUNT: "bigint", FLAG: "boolean", TEXTS: "array<string>", METHODS: "array<struct<name: string, referencesGuardOrPublish: boolean>>"}
_NAMES = {
    "files": {"contentHash": "content_hash", "parseStatus": "parse_status", "parseDiagnosticCount": "diagnostics", "exportsOnlyTypes": "exports_only_types", "typeOnlyExportNames": "type_only_export_names", "hasTopLevelSideEffects": "side_effects"},
    "dependencies": {"from": "from_path", "target": "to_path", "typeOnly": "type_only", "namedBindings": "named_bindings", "targetTypeOnlyExports": "target_type_only_exports", "sourcePureTypeModule": "source_pure_type_module", "namedBindingsTypeOnly": "named_bindings_type_only", "portProofEligible": "port_proof_eligible"},
    "publishCalls": {"rawIntentName": "raw_intent", "objectHasIntent": "object_has_intent", "arkPublishCandidate": "candidate", "hasSource": "has_source", "sourceIntent": "source_intent"},
    "classShapes": {"className": "class_name", "hasPublicMutableFields": "public_mutable", "hasPublicSetters": "public_setters", "hasPublicConstructor": "public_constructor", "hasStaticFactory": "static_factory", "dataOnly": "data_only", "mutatingMethods": "mutating"},
}
TABLES = {"files": "files", "dependencies": "dependencies", "capabilityUses": "capability_uses", "ambientUses": "ambient_uses", "publishCalls": "publish_calls", "intentReferences": "intent_references", "safetyUses": "safety_uses", "classShapes": "class_shapes"}
#: Documents with rejects whose numbers are broadcast.
SMALL = 1_000_000


def _cast(value: Column, kind) -> Column:
    return F.try_variant_get(value, "$", _CASTS.get(kind, "string") if isinstance(kind, str) else "string")


def _fits(value: Column, kind) -> Column:
    """Whether a variant is of a kind; enums are tuples of texts."""
    is_, got = F.schema_of_variant(value), _cast(value, kind)
    if isinstance(kind, tuple):
        return (is_ == "STRING") & got.isin(*kind)
    return {
        TEXT: (is_ == "STRING") & (got != ""),
        PATH: (is_ == "STRING") & got.rlike(PATH_PATTERN),
        LINE: (is_ == "BIGINT") & (got >= 1),
        COUNT: (is_ == "BIGINT") & (got >= 0),
        FLAG: is_ == "BOOLEAN",
        TEXTS: is_.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(got, lambda x: x == ""),
        METHODS: is_.isin(f"ARRAY<{_METHOD}>", "ARRAY<VOID>") & ~F.exists(got, lambda x: x["name"] == ""),
    }[kind]


def _issues(m: Column, fields: dict, optional: tuple[str, ...]) -> Column:
    """array<struct<key, reason>> of an object's keys: unknown, missing, invalid."""
    issue = lambda key, reason: F.struct(key.alias("key"), F.lit(reason).alias("reason"))
    unknown = F.transform(F.array_except(F.map_keys(m), F.array(*map(F.lit, fields))), lambda k: issue(k, "unknown-key"))
    found = []
    for name, kind in fields.items():
        there = F.map_contains_key(m, F.lit(name))
        absent = F.lit(False) if name in optional else ~there
        found.append(F.when(absent, issue(F.lit(name), "missing")).when(there & ~F.coalesce(_fits(F.get(F.array(m[name]), F.lit(0)), kind), F.lit(False)), issue(F.lit(name), "invalid")))
    return F.concat(unknown, F.array_compact(F.array(*found)))


def _conflicts(table: str, m: Column) -> Column:
    """array<struct<key, reason>>: fields that other fields rule out or ask for."""
    text = lambda key: F.try_variant_get(m[key], "$", "string")
    has = lambda key: F.map_contains_key(m, F.lit(key))
    rules = {
        "files": [("parseDiagnosticCount", (text("parseStatus") == "parsed") != (_cast(m["parseDiagnosticCount"], COUNT) == 0))],
        "dependencies": [("target", (text("resolution") == "resolved-project") != has("target")), ("specifier", (text("resolution") != "dynamic") & ~has("specifier"))],
        "safetyUses": [("symbol", (text("kind") == "in-memory-store") != has("symbol"))],
    }.get(table, [])
    none = F.array().cast("array<struct<key: string, reason: string>>")
    return F.array_compact(F.array(*[F.when(wrong, F.struct(F.lit(key).alias("key"), F.lit("conflict").alias("reason"))) for key, wrong in rules])) if rules else none


def read_facts_strictly(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """files, dependencies, capability_uses, ambient_uses, publish_calls, intent_references, safety_uses, class_shapes, each with repo,
    snapshot and ordinal, and rejects (repo, snapshot, at, reason).

    reason: not-json, missing, invalid, unknown-key, conflict, duplicate-path, unknown-file, incomplete (a complete document with
    reasons or invalid files, or one that isn't complete without reasons). classShapes may be absent.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("doc"), F.expr("try_cast(try_parse_json(value) as map<string, variant>)").alias("m"))
    lines = cut(lines)
    m = F.col("m")
    key = lambda name: F.try_variant_get(m[name], "$", "string")
    at = {"repo": key("repo"), "snapshot": key("snapshot")}
    array = lambda name: F.try_variant_get(m[name], "$", "array<variant>")
    row = lambda name: F.transform(F.coalesce(array(name), F.array().cast("array<variant>")), lambda x, i: F.struct(F.lit(name).alias("table"), i.alias("ordinal"), F.try_variant_get(x, "$", "map<string, variant>").alias("f")))
    # The document is dropped before its rows are laid out; else each of them would carry a copy of it.
    listed = lines.select("doc", *[c.alias(n) for n, c in at.items()], F.concat(*map(row, FACTS)).alias("all"))
    rows = cut(listed.select("doc", *at, F.explode("all").alias("x")).select("doc", *at, "x.*"))

    top = {"repo": TEXT, "snapshot": TEXT, "schemaVersion": VERSIONS, "completeness": COMPLETENESS, **dict.fromkeys((*IDENTITIES, "projectPackageName", "candidateTreeHash", "factsHash"), TEXT)}
    arrays = (*FACTS, "completenessReasons")
    lists = F.array_compact(F.array(*[F.when(array(a).isNull() & (F.lit(a != "classShapes") | F.map_contains_key(m, F.lit(a))), F.struct(F.lit(a).alias("key"), F.lit("invalid").alias("reason"))) for a in arrays]))
    own = F.filter(_issues(m, top, ("snapshot", "projectPackageName", "candidateTreeHash", "factsHash")), lambda x: ~x["key"].isin(*arrays))
    complete = (key("completeness") == "complete") & (F.size(array("completenessReasons")) > 0) | (key("completeness") != "complete") & (F.size(array("completenessReasons")) == 0)
    whole = F.when(complete, F.array(F.struct(F.lit("completenessReasons").alias("key"), F.lit("incomplete").alias("reason")))).otherwise(F.array().cast("array<struct<key: string, reason: string>>"))
    broken = F.array(F.struct(F.lit("").alias("key"), F.lit("not-json").alias("reason")))
    documents = lines.select("doc", *[c.alias(n) for n, c in at.items()], F.explode(F.when(m.isNull(), broken).otherwise(F.concat(own, lists, whole))).alias("x"))
    documents = documents.select("doc", *at, F.when(F.col("x.key") == "", "$").otherwise(F.concat(F.lit("$."), "x.key")).alias("at"), "x.reason")

    place = lambda name: F.concat(F.lit("$."), "table", F.lit("["), "ordinal", F.lit("]"), F.when(name != "", F.concat(F.lit("."), name)).otherwise(""))
    f = F.col("f")
    found = [documents]
    for table, fields in FACTS.items():
        mine = rows.where(F.col("table") == table)
        each = F.when(f.isNull(), F.array(F.struct(F.lit("").alias("key"), F.lit("invalid").alias("reason")))).otherwise(F.concat(_issues(f, fields, OPTIONAL.get(table, ())), _conflicts(table, f)))
        found.append(mine.select("*", F.explode(each).alias("x")).select("doc", *at, place(F.col("x.key")).alias("at"), "x.reason"))
    text = lambda name: F.try_variant_get(f[name], "$", "string")
    paths = rows.where("table = 'files'").select("doc", *at, "table", "ordinal", text("path").alias("path"), text("parseStatus").alias("status"))
    twice = paths.groupBy("doc", *at, "path").agg(F.count("*").alias("n"), F.max("ordinal").alias("ordinal")).where("n > 1 and path is not null")
    found.append(twice.select("doc", *at, F.concat(F.lit("$.files["), "ordinal", F.lit("].path")).alias("at"), F.lit("duplicate-path").alias("reason")))
    claimed = lines.where(key("completeness") == "complete").select("doc")
    found.append(paths.where("status = 'invalid'").join(claimed, "doc", "left_semi").select("doc", *at, place(F.lit("parseStatus")).alias("at"), F.lit("incomplete").alias("reason")))
    source = rows.where("table <> 'files'").select("doc", *at, "table", "ordinal", F.when(F.col("table") == "dependencies", text("from")).otherwise(text("file")).alias("path"))
    lost = source.where("path is not null").join(paths.select("doc", "path").distinct(), ["doc", "path"], "left_anti")
    found.append(lost.select("doc", *at, place(F.when(F.col("table") == "dependencies", "from").otherwise("file")).alias("at"), F.lit("unknown-file").alias("reason")))
    rejects = cut(reduce(DataFrame.union, found))

    good = rows.join(sized(cut(rejects.select("doc").distinct()), SMALL), "doc", "left_anti")
    out = {}
    for table, fields in FACTS.items():
        columns = [_cast(f[name], kind).alias(_NAMES.get(table, {}).get(name, name)) for name, kind in fields.items()]
        out[TABLES[table]] = good.where(F.col("table") == table).select(*at, "ordinal", *columns)
    return out | {"rejects": rejects.drop("doc")}
