"""Effect walls: capabilities of modules and globals, publish calls and intent references against the contract.

Policies are per layer and small, so they are Column expressions; only the lookup of an import's kind is a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archweave.contract import DEFAULT_PREFIXES, Contract
from archweave.functions.names import intent_layer
from archweave.operators.layers import denied_by_layers

# Capabilities, the ambient globals and the modules that stand for them.
CAPABILITIES = ("network", "filesystem", "clock", "randomness", "environment", "process", "persistence")
AMBIENT = {"fetch": "network", "XMLHttpRequest": "network", "Date": "clock", "Date.now": "clock", "Math.random": "randomness", "process.env": "environment", "process": "process"}
MODULES = {
    "filesystem": ("fs", "node:fs", "fs/promises", "node:fs/promises", "fs-extra", "graceful-fs", "memfs", "chokidar"),
    "network": (
        "http", "https", "http2", "net", "tls", "dgram", "dns",
        "node:http", "node:https", "node:http2", "node:net", "node:tls", "node:dgram", "node:dns",
        "axios", "undici", "node-fetch", "got", "ky", "superagent", "ws",
    ),
    "process": ("process", "node:process", "child_process", "node:child_process"),
    "persistence": (
        "@prisma/client", "prisma", "pg", "mysql", "mysql2", "mongodb", "mongoose", "sqlite3", "better-sqlite3",
        "redis", "ioredis", "typeorm", "knex", "drizzle-orm", "sequelize", "kysely", "@supabase/supabase-js",
    ),
}
#: Modules that are the import form of a forbidden global.
DUALS = {"process": ("process", "node:process")}
#: Names that look like intents.
INTENT_LIKE = r"^(Domain|Application|Adapter|Workflow|Job|Presentation|Reporting|Metadata|Security|Audit|Observability|Kernel)\.[A-Za-z0-9_.]+$"


def _literal_map(pairs: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])


def module_capability(specifier: Column) -> Column:
    """Capability of a module: of the specifier itself, of its first segment, or of its first two; null for project code."""
    known = _literal_map({m: F.lit(c) for c, own in MODULES.items() for m in own})
    parts = F.split(specifier, "/")
    at = lambda n: F.when(F.size(parts) > n, F.try_element_at(known, F.array_join(F.slice(parts, 1, n), "/")))
    return F.when((specifier != "") & ~specifier.rlike("^[./]"), F.coalesce(F.try_element_at(known, specifier), at(1), at(2)))


def ambient_capability(symbol: Column) -> Column:
    """Capability of the longest known dotted prefix of a global."""
    by_length = sorted(AMBIENT, key=lambda x: -x.count("."))
    return F.coalesce(*[F.when((symbol == name) | symbol.startswith(f"{name}."), AMBIENT[name]) for name in by_length])


def denied_capabilities(layer) -> list[str]:
    """A pure layer denies all; else what it declares, as far as known."""
    return sorted(CAPABILITIES) if layer.pure else sorted(set(layer.deny) & set(CAPABILITIES))


def _of_layer(contract: Contract, values) -> Column:
    """array<string> by from_layer."""
    of = {x.name: F.array(*map(F.lit, v)) if (v := values(x)) else F.array().cast("array<string>") for x in contract.layers}
    return F.coalesce(F.try_element_at(_literal_map(of), F.col("from_layer")), F.array().cast("array<string>"))


def forbidden_entry(symbol: Column, entries: Column) -> Column:
    """The longest entry that is the symbol or a dotted prefix of it."""
    hits = F.filter(entries, lambda e: (symbol == e) | symbol.startswith(F.concat(e, F.lit("."))))
    return F.array_max(F.transform(hits, lambda e: F.struct(F.length(e).alias("n"), e.alias("entry"))))["entry"]


def _placed(uses: DataFrame, files: DataFrame) -> DataFrame:
    """With from_layer, of the file; uses in files without a layer go. files: (repo, path, layer)."""
    return uses.join(files.where("layer is not null").select("repo", F.col("path").alias("file"), F.col("layer").alias("from_layer")), ["repo", "file"])


def capability_uses(imports: DataFrame, ambient: DataFrame) -> DataFrame:
    """imports (repo, file, line, specifier, type_only), ambient (repo, file, line, symbol) -> those that have a capability."""
    modules = imports.where("not type_only").select("repo", "file", "line", F.col("specifier").alias("symbol"), module_capability(F.col("specifier")).alias("capability"), F.lit("import-based").alias("evidence"))
    globals_ = ambient.select("repo", "file", "line", "symbol", ambient_capability(F.col("symbol")).alias("capability"), F.lit("ambient-global").alias("evidence"))
    return modules.union(globals_).where("capability is not null")


_OUT = ["repo", "rule_id", "file", "line", "from_layer", "target", "capability", "edge_kind"]


def forbidden_global_violations(ambient: DataFrame, files: DataFrame, contract: Contract) -> DataFrame:
    """Uses of globals that the file's layer forbids."""
    placed = _placed(ambient, files)
    hit = forbidden_entry(F.col("symbol"), _of_layer(contract, lambda x: x.forbidden_globals)).isNotNull()
    return placed.where(hit).select("repo", F.lit("FORBIDDEN_GLOBAL").alias("rule_id"), "file", "line", "from_layer", F.col("symbol").alias("target"), F.lit(None).cast("string").alias("capability"), F.lit(None).cast("string").alias("edge_kind"))


def capability_violations(uses: DataFrame, imports: DataFrame, files: DataFrame, contract: Contract) -> DataFrame:
    """Uses of capabilities that the file's layer denies; one voice where a forbidden global covers the use.

    An ambient use that a forbidden global covers is left to ``forbidden_global_violations``; an import that is the
    import form of one is a FORBIDDEN_GLOBAL itself. edge_kind: of the first import at that place that isn't type-only.
    """
    kinds = imports.where("not type_only").groupBy("repo", "file", "line", F.col("specifier").alias("symbol")).agg(F.min_by("kind", "ordinal").alias("edge_kind"))
    placed = _placed(uses, files).join(kinds, ["repo", "file", "line", "symbol"], "left")
    entries = _of_layer(contract, lambda x: x.forbidden_globals)
    by_import = F.col("evidence") == "import-based"
    covered = ~by_import & forbidden_entry(F.col("symbol"), entries).isNotNull()
    dual = by_import & reduce(lambda a, b: a | b, [F.array_contains(entries, g) & F.col("symbol").isin(*own) for g, own in DUALS.items()])
    denied = F.array_contains(_of_layer(contract, denied_capabilities), F.col("capability"))
    rule = F.when(covered, F.lit(None)).when(dual, "FORBIDDEN_GLOBAL").when(denied, "CAPABILITY_VIOLATION")
    judged = placed.withColumn("rule_id", rule).where("rule_id is not null")
    return judged.select("repo", "rule_id", "file", "line", "from_layer", F.col("symbol").alias("target"), F.when(F.col("rule_id") == "CAPABILITY_VIOLATION", F.col("capability")).alias("capability"), F.when(by_import, F.col("edge_kind")).alias("edge_kind"))


def publish_violations(calls: DataFrame, files: DataFrame, prefixes: dict[str, tuple[str, ...]] = DEFAULT_PREFIXES) -> DataFrame:
    """calls (repo, file, line, raw_intent, object_has_intent, candidate, has_source, source_intent) -> up to three rows each."""
    source_layer = intent_layer(F.col("source_intent"), prefixes)
    row = lambda when, rule, own, to, target: F.when(when, F.struct(F.lit(rule).alias("rule_id"), own.alias("from_layer"), to.alias("to_layer"), target.alias("target")))
    none = F.lit(None).cast("string")
    found = F.array_compact(
        F.array(
            row(F.coalesce(F.col("raw_intent").rlike(INTENT_LIKE), F.lit(False)) | F.col("object_has_intent"), "RAW_EVENT_PUBLISH", none, none, none),
            row(F.col("candidate") & ~F.col("has_source"), "PUBLISH_MISSING_SOURCE", F.col("from_layer"), none, none),
            row(source_layer != F.col("from_layer"), "PUBLISH_SOURCE_LAYER_MISMATCH", F.col("from_layer"), source_layer, F.col("source_intent")),
        )
    )
    return _placed(calls, files).select("repo", "file", "line", F.explode(found).alias("x")).select("repo", "x.rule_id", "file", "line", "x.from_layer", "x.to_layer", "x.target")


def intent_reference_violations(references: DataFrame, files: DataFrame, contract: Contract, prefixes: dict[str, tuple[str, ...]] = DEFAULT_PREFIXES) -> DataFrame:
    """references (repo, file, line, intent) to intents of a layer that the file's layer must not reach; peer rules deny."""
    placed = _placed(references, files).withColumn("to_layer", intent_layer(F.col("intent"), prefixes))
    rule = denied_by_layers(contract, F.col("from_layer"), F.col("to_layer"))
    return placed.withColumn("rule", rule).where("rule is not null").select("repo", F.lit("LAYER_INTENT_REFERENCE_VIOLATION").alias("rule_id"), "file", "line", "from_layer", "to_layer", F.col("intent").alias("target"), F.col("rule.message").alias("message"))


def coverage_atoms(contract: Contract, repos: DataFrame) -> DataFrame:
    """(repo, layer, kind, atom) of what each layer's walls and forbidden globals protect, in the finest units.

    kind: atom, or raw for a forbidden global that no known ambient entry stands for.
    """
    rows = set()
    for layer in contract.layers:
        for entry in layer.forbidden_globals:
            covered = [a for a in AMBIENT if a == entry or a.startswith(f"{entry}.")]
            rows |= {(layer.name, "atom", f"ambient:{a}") for a in covered} or {(layer.name, "raw", entry)}
            rows |= {(layer.name, "atom", f"import-exact:{m}") for m in DUALS.get(entry, ())}
        for capability in denied_capabilities(layer):
            rows |= {(layer.name, "atom", f"import:{capability}")}
            rows |= {(layer.name, "atom", f"import-exact:{m}") for m in (DUALS["process"] if capability == "process" else ())}
            # Longest match decides which entries stand for the capability.
            rows |= {(layer.name, "atom", f"ambient:{a}") for a, c in AMBIENT.items() if c == capability}
    each = F.array(*[F.struct(F.lit(a).alias("layer"), F.lit(b).alias("kind"), F.lit(c).alias("atom")) for a, b, c in sorted(rows)]) if rows else F.array().cast("array<struct<layer:string,kind:string,atom:string>>")
    return repos.select("repo", F.explode(each).alias("x")).select("repo", "x.*")


#: Suffixes that a relative specifier may stand without, first match first.
CANDIDATES = ("", ".ts", ".tsx", ".mts", ".cts", "/index.ts", "/index.tsx")


def resolve_specifiers(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (repo, file, line, specifier, ...) -> with to_path: the project file that a relative specifier names.

    Each import asks for its candidates by one equi join on (repo, path); the first that exists wins. '..' above the
    root is dropped. Other specifiers, and those that name no file, keep null. Distinct (file, specifier) pairs are
    asked once.
    """
    asked = imports.where(F.col("specifier").startswith(".")).select("repo", "file", "specifier").distinct()
    folder = F.split(F.regexp_replace("file", r"/?[^/]*$", ""), "/")
    start = F.filter(folder, lambda x: x != "")
    step = lambda stack, part: F.when(part.isin("", "."), stack).when(part == "..", F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(F.concat(stack, F.array(part)))
    base = F.array_join(F.aggregate(F.split("specifier", "/"), start, step), "/")
    each = F.posexplode(F.array(*[F.concat(base, F.lit(c)) for c in CANDIDATES])).alias("rank", "path")
    found = asked.select("repo", "file", "specifier", each).join(files.select("repo", "path"), ["repo", "path"])
    best = found.groupBy("repo", "file", "specifier").agg(F.min_by("path", "rank").alias("to_path"))
    return imports.join(best, ["repo", "file", "specifier"], "left")

